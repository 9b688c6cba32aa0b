"""The pipeline's near-dedup stage against brute force over all pairs of texts."""

import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from cellspan.llm import jaccard, simhash
from cellspan.llm.common import materialize, text_hash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(texts):
    sets, to = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((to[i], to[j]))
            to = [a if x == b else x for x in to]
    return sorted(set(to))


def stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    return sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())


def changed(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_copies_at_similarity_around_the_threshold(spark):
    rng, texts = random.Random(7), []
    for n in range(40):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400])))
        # at most five shingles go with a word: these are copies on either side of 0.8
        texts += [text, changed(rng, text, max(1, len(text.split()) * (n % 6) // 100))]
    texts += ["", None, " \n", "one", "ONE ", "two words"]
    want = brute_kept(texts)
    assert stage(spark, texts) == want
    assert 45 < len(want) < 80


def test_one_large_group_keeps_one(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    texts = [changed(rng, text, 1 + k % 5) for k in range(150)]
    assert stage(spark, texts) == brute_kept(texts)


def test_simhash_components_are_the_first_candidates(spark):
    """Every text is held against one of its SimHash component: fingerprints at most three bits apart, and those reached."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(600))
        texts += [text, changed(rng, text, 1), changed(rng, text, 2), changed(rng, text, 200)]
    docs = spark.createDataFrame(list(enumerate([*texts, "", None])), "id long, text string").withColumn("th", text_hash(F.col("text")))
    known = materialize(jaccard.signatures(docs, 5))
    nodes = {r["id"]: r["node"] for r in known.collect()}
    got = {(r["a"], r["b"]) for r in jaccard.fingerprint_pairs(docs, known.select("id", "th", "node", "n"), 0.8).collect()}
    fps, to = [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((to[i], to[j]))
            to = [a if x == b else x for x in to]
    want = set()
    for k in set(to):
        group = sorted(nodes[i] for i in range(len(texts)) if to[i] == k)
        want |= {(group[0], b) for b in group[1:]}
    assert got == want and len(want) >= 12


def test_components_are_only_run_where_links_need_them(spark, monkeypatch):
    """SimHash's stars need no rounds, and links between components only join components: one run without such links, two with."""
    rng, runs, texts = random.Random(13), [], []
    whole = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: runs.append(1) or whole(edges))
    for _ in range(3):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(600))
        texts += [text, changed(rng, text, 1), changed(rng, text, 2)]
    assert stage(spark, texts) == brute_kept(texts) == [0, 3, 6] and len(runs) == 1
    runs.clear()
    monkeypatch.setattr(jaccard, "leader_links", lambda rows, *_: rows.selectExpr("node AS a", "node AS b").where("false"))
    for _ in range(6):  # each is like the one before it
        texts.append(changed(rng, texts[-1], 8))
    assert stage(spark, texts) == brute_kept(texts) and len(runs) == 2
