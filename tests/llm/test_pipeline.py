"""The pipeline stage by stage against brute force on a small fixture."""

from collections import defaultdict

import corpus_pipeline
import pytest
from test_dedup import brute_line_dedup
from test_jaccard import brute_kept

from cellspan.llm import decontaminate
from cellspan.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append((docs.collect(), f(spark, docs, sf)))
        out[-1][1].write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out[-1] = (*out[-1], docs.collect())
    return out


def test_stages_are_those_asked_for(stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "mixing"]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(df.columns == names for _, df, _ in stages[:-1])
    assert all(len(after) <= len(before) for before, _, after in stages)


def test_quality_keeps_clean_documents(stages, spark):
    before, _, after = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    long = {r["doc_id"] for r in before if len(r["text"].split()) >= 50}
    assert all(labels.get(d) != 1 or d in kept or d not in long for d in labels)


def test_lines(stages):
    before, _, after = stages[1]
    want = {i: t for i, _, _, t in brute_line_dedup([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {i: (t, len(t)) for i, t in want.items()}


def test_near_copies(stages):
    """Against all pairs of texts: five-word shingles at a similarity of 0.8 or more."""
    before, _, after = stages[2]
    before = sorted(before, key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == [before[i]["doc_id"] for i in brute_kept([r["text"] for r in before])]


def test_benchmark(stages, spark):
    before, _, after = stages[3]
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in after}
    for r in before:
        text = decontaminate.normalise(r["text"])
        assert (r["doc_id"] in clean) == (not any(x in text for x in items)), r["doc_id"]


def test_mixing(stages):
    before, _, after = stages[4]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += len(r["text"].split())
    for r in after:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] > 0
    assert sum(taken.values()) <= sum(sizes.values())


def test_run_gives_the_last_stage(stages, spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1][2]))


def test_duplicates_and_nulls_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{chr(97 + i % 26)} and{chr(97 + i // 26)} more" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", None, 3), (1, text, "en", None, 3), (None, text + " end", None, "a", None), (2, None, None, None, None)], schema)
    for _, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, "/root/testdata/sf0.001"))
    assert [r["doc_id"] for r in docs.collect()] in ([1], [])
    empty = spark.createDataFrame([], schema)
    for _, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, empty, "/root/testdata/sf0.001").collect() == []
