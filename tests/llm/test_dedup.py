"""SimHash near-dedup and line dedup against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cellspan.llm import graph, line_dedup, simhash

DOCS = "doc_id long, text string, fp long, key string, n_dropped int"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{position: smallest position} over links of 3 bits or fewer."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 200))) for _ in range(12)]
    out = list(base)
    for t in base[:8]:
        w = t.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" \t".join(w))
        out.append(t)
    return [*out, None, "", " \n ", "One", "one", "two words", "x " * 20000, "Ünïcode TEXT only once here"]


def test_fingerprints_and_components_match_brute_force(spark, texts):
    rows = [(i, t, 0, "k", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == dict(enumerate(fps))
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(fps)


@pytest.mark.parametrize("large", [2, 1000])
def test_links_match_brute_force_however_small_a_crowd_is(spark, large):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for x in list(fps)[:10]:
        for _ in range(12):  # a crowd around some, beyond what a block may hold
            y = x
            for b in rng.integers(0, 63, rng.integers(1, 4)):
                y ^= 1 << int(b)
            fps.add(y)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), large=large).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_keep_one_keeps_the_smallest_id_once(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (1, long.upper()), (2, long), (1, long.upper()), (None, long), (9, "quite another text of several words"), (None, "unlike all " * 9)]
    got = simhash.keep_one(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int"))
    assert got.columns == ["doc_id", "text", "component"]
    assert sorted(((r["doc_id"], r["text"][:5]) for r in got.collect()), key=str) == [(1, "W0 W1"), (9, "quite"), (None, "unlik")]


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_line_dedup(rows, min_chars=20, min_docs=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    common = ["This line is found in many documents", "  THIS line is found in many documents\t", "ÉCOLE line of some twenty characters", "short", "", "école line of some twenty characters", "x" * 19, "y" * 20]
    rows = [(i % 37, "\n".join(rng.choice([*common, f"a line that is found here only {rng.random()}"]) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    rows += [(None, "\n".join(common)), (500, None), (501, ""), (502, "\n\n"), (500, None), (503, "\n".join(f"line number {i} of a very long text" for i in range(5000)))]
    rows += [(i, "one line and the same in each of them") for i in (600, 601, 602)] * 2
    df = spark.createDataFrame([(i, t, 7, "k", 3) for i, t in rows], "doc_id long, text string, pos int, key string, n_dropped int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "key", "n_lines", "n_dropped", "kept_text"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=str) == brute_line_dedup(rows)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_give_the_contract_columns(spark, sf_dir):
    from cellspan.llm.queries import QUERIES

    one = QUERIES["op1_simhash"](spark, sf_dir)
    assert dict(one.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {r["doc_id"]: r["fingerprint"] for r in one.collect()} == {d["doc_id"]: f"{brute_fingerprint(d['text']):016x}" for d in docs}
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_line_dedup([(d["doc_id"], d["text"]) for d in docs])}
    assert {tuple(r) for r in QUERIES["op3_line_dedup"](spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want


NAMES = ["__text", "__id", "__own_id", "__own_th", "__gone", "own_id", "OWN_TH", "key_id", "Key_Th", "whole_text", "gone_at", "N_LINES", "Kept_Text", "id", "th", "a.b", "copies", "h1"]


def test_columns_of_any_name_pass_through(spark):
    """No stage's own columns clash with those of a table; those that a stage returns itself replace a table's in any case."""
    from cellspan.llm import decontaminate, jaccard, quality_rules

    line = "a line of some length that many documents share"
    rows = [(i, f"{line}\nword{i} and {i} more of it", *([f"v{i}"] * len(NAMES))) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *NAMES])
    quoted = [f"`{c}`" for c in NAMES]
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *[c for c in NAMES if c.lower() not in ("n_lines", "kept_text")], "n_lines", "n_dropped", "kept_text"]
    assert {r.doc_id: (r["own_id"], r["a.b"], r.n_dropped) for r in got.collect()} == {i: (f"v{i}", f"v{i}", int(i != 5)) for i in range(6)}
    items = spark.createDataFrame([(1, "word3 and 3 more of it")], "item_id long, text string")
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and 3 not in {r.doc_id for r in kept.select("doc_id", *quoted).collect()}
    for stage in (quality_rules.keep_good, jaccard.keep_one, simhash.keep_one):
        out = stage(docs)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= set(range(6))
