"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints, then MinHash bands for what these leave apart;
links of both are checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm import simhash
from cellspan.llm.backoff import MIX1, grams, mix, word_hashes
from cellspan.llm.common import materialize, one_each, pieces, skewed_join, text_hash
from cellspan.llm.graph import components

#: Of two texts at similarity 0.8, the chance to share none of 24 bands of 5 values is (1 - 0.8 ** 5) ** 24, under 1 in 10,000.
BANDS, ROWS = 24, 5
ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
SHIFT = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, a text without a word has none."""
    hashes, of = word_hashes([text])
    if not len(hashes):
        return hashes
    n = min(shingle, len(hashes))
    return np.unique(grams(hashes, of, n)[-1][0][n - 1 :])


def band_keys(sets: np.ndarray) -> np.ndarray:
    """A hash of each band of the MinHash signature; bands differ in their keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        least = np.minimum(least, (sets[at : at + 2048, None] * ODD + SHIFT).min(0))
    rows, key = mix(least).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(MIX1) + rows[:, k])
    return key.view(np.int64)


def signatures(keyed: DataFrame, shingle: int) -> DataFrame:
    """(id, th, node, n, keys) for every row of keyed(id, th, text): node is a hash of the words, n the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            nodes, counts, keys = [], [], []
            for t in b.column(2):
                sets = shingles(t.as_py(), shingle)
                # equal sets are equal texts for what follows, so they are one node
                nodes.append(int(mix(np.array([np.bitwise_xor.reduce(mix(sets)) + np.uint64(len(sets))], np.uint64)).view(np.int64)[0]) if len(sets) else 0)
                counts.append(len(sets))
                keys.append(band_keys(sets) if len(sets) else np.zeros(0, np.int64))
            arrays = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "th", "node", "n", "keys"])

    schema = T.StructType([keyed.schema["id"], keyed.schema["th"]]).add("node", T.LongType()).add("n", T.IntegerType()).add("keys", T.ArrayType(T.LongType()))
    return keyed.select("id", "th", "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def similar(a: Column, b: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both + F.lit(1e-9) >= similarity * (F.size(a) + F.size(b) - both)


def fits(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(n, m) + F.lit(1e-9) >= similarity * F.greatest(n, m)


def checked(pairs: DataFrame, sets: DataFrame, similarity: float, most: int = 4096) -> DataFrame:
    """Those of pairs(a, b) whose sets(node, set) have at least that similarity. The set of an a of many pairs is dealt
    out, a copy for about `most` of them, so no task gets all pairs of one a."""
    times = materialize(pairs.groupBy("a").agg(F.count("*").alias("times")))
    parts = F.ceil(F.col("times") / most).cast("int")
    salted = skewed_join(pairs, times, ["a"], pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    left = sets.join(times, sets["node"] == times["a"]).select("a", F.col("set").alias("s"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    return right.join(left, ["a", "part"]).where(similar(F.col("s"), F.col("t"), similarity)).select("a", "b")


def fingerprint_pairs(keyed: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes to check: every node with the least node of its SimHash component, which op1's operator gives
    for keyed(id, th, text): fingerprints that differ in at most three bits. known(id, th, node, n) has a row for each of keyed."""
    near = simhash.near_duplicates(keyed, "id", "text", carry=("th",)).select(F.col("id").alias("own"), F.col("th").alias("own_th"), F.col("component").alias("fp"))
    same = known["id"].eqNullSafe(F.col("own")) & (known["th"] == F.col("own_th"))
    placed = materialize(known.where("n > 0").join(near.distinct(), same).select("node", "n", "fp").distinct())
    least = placed.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("l"), F.count("*").alias("times")).where("times > 1")
    led = skewed_join(placed, materialize(least), ["fp"], placed.count()).where("node <> l.node")
    return led.where(fits(F.col("n"), F.col("l.n"), similarity)).select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()


def leader_links(rows: DataFrame, sets: DataFrame, group: DataFrame, similarity: float, total: int) -> DataFrame:
    """rows(bucket, node, n, times) to links (a, b) of each node with the leader of its bucket, but for those that are in one
    component of group(node, component) already. The leader is the node that shares most places in buckets with others: of
    a group of copies, one near the middle."""
    score = rows.groupBy("node").agg(F.sum("times").alias("score"))
    best = rows.join(score, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("score", "node")).alias("l"), F.count("*").alias("times"))
    led = skewed_join(rows.drop("times"), materialize(best), ["bucket"], total).where("node <> l.node")
    led = led.where(fits(F.col("n"), F.col("l.n"), similarity)).select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
    for c in "ab":
        led = led.join(group.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left")
    led = led.where("a_in IS NULL OR b_in IS NULL OR a_in <> b_in").select("a", "b")
    return materialize(checked(materialize(led), sets, similarity))


def cross_links(rows: DataFrame, sets: DataFrame, group: DataFrame, similarity: float, total: int, tile: int = 250_000) -> DataFrame:
    """Links (a, b) between different components of group(node, component), of nodes that share a bucket.

    A node of n shingles of which `own` occur in no other node can only be similar to sets of at most
    (n - own) * (1 + similarity) / similarity - n: most changed copies can be similar to nothing in their bucket and drop
    out by that count. Of the rest, the nodes outside a bucket's largest component meet those of all other components.
    The buckets' nodes are dealt into tiles of about `tile` shingles, so a task never holds a bucket; pairs are compared
    inside the join, which gives links alone."""
    placed = rows.drop("times").join(group, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    placed = materialize(placed)

    def mixed(rows: DataFrame) -> DataFrame:
        """rows of buckets that hold several components, with the largest (main), the least n and the tiles."""
        shares = rows.groupBy("bucket", "comp").agg(F.count("*").alias("count"), F.min("n").alias("least"), F.sum(F.col("n").cast("long")).alias("sum"))
        per = shares.groupBy("bucket").agg(
            F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps"), F.min("least").alias("least"),
            F.sum("count").alias("times"), F.ceil(F.sum("sum") / tile).cast("int").alias("tiles"),
        )
        return materialize(skewed_join(rows, materialize(per.where("comps > 1").drop("comps")), ["bucket"], total))

    part = mixed(placed)
    held = part.select("node").distinct()
    alone = sets.join(held, "node", "left_semi").select("node", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("node").alias("node"))
    own = alone.where("df = 1").groupBy("node").agg(F.count("*").alias("own"))
    part = part.select("bucket", "node", "n", "comp", "least").join(own, "node", "left")
    cap = F.floor((F.col("n") - F.coalesce("own", F.lit(0))) * ((1 + similarity) / similarity) - F.col("n") + 1e-9)
    part = mixed(part.withColumn("cap", cap).where("cap >= least").select("bucket", "node", "n", "comp", "cap")).drop("times", "least")
    full = materialize(part.join(sets, "node"))
    side = lambda c, df: df.select("bucket", *[F.col(k).alias(f"{c}_{k}") for k in ("node", "n", "comp", "cap", "set")], "tile")
    x = side("x", full.where("comp <> main").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    y = side("y", full.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    may = (F.col("x_comp") != F.col("y_comp")) & (F.col("x_n") <= F.col("y_cap")) & (F.col("y_n") <= F.col("x_cap")) & fits(F.col("x_n"), F.col("y_n"), similarity)
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.tile") == F.col("y.tile"))
    found = x.alias("x").join(y.alias("y"), same & may & similar(F.col("x_set"), F.col("y_set"), similarity))
    return materialize(found.groupBy(F.col("x_node").alias("a"), "y_comp").agg(F.min("y_node").alias("b")).select("a", "b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each component of texts with at least that Jaccard similarity of word shingles, the row
    with the smallest id (null last) stays, with all its columns; where rows share that id, the one with the smallest
    text hash, once. Texts without a word are copies of each other. Repeated rows are copies; other columns are not read.
    An empty table gives an empty table.

    SimHash comes first: the texts of each component of fingerprints are held against one of them, and those that have the
    similarity are linked. Three bits reach few pairs near 0.8, so MinHash bands go on from there: all pairs of differing
    texts that share a band and have the similarity are linked, but for those whose ends are linked already. Each node is
    held against its buckets' leaders, which joins a group of copies at a pair a member; what is left between components
    is compared by cross_links, all of it."""
    keyed = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    known = materialize(signatures(keyed, shingle))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = materialize(known.groupBy("node").agg(F.min(rank).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    rows = nodes.where("n > 0").select("node", "n", F.explode("keys").alias("bucket"))
    total = nodes.count() * BANDS
    shared = materialize(rows.groupBy("bucket").agg(F.count("*").alias("times")).where("times > 1"))
    rows = materialize(skewed_join(rows, shared, ["bucket"], total))
    first = nodes.select("node", "r")
    alike = materialize(fingerprint_pairs(keyed, known.select("id", "th", "node", "n"), similarity))
    if not (rows.isEmpty() and alike.isEmpty()):
        held = rows.select("node").union(alike.select("a")).union(alike.select("b")).distinct()
        at = first.join(held, "node").select("node", F.col("r.id").alias("own"), F.col("r.th").alias("own_th"))
        texts = keyed.join(at.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("node", "text")
        sets = materialize(shingle_sets(texts, shingle).dropDuplicates(["node"]))
        near = materialize(checked(alike, sets, similarity))
        # these pairs are stars, so their components need no rounds
        star = near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(near.select("a", "a").distinct())
        group = components(near.union(leader_links(rows, sets, star, similarity, total))).select("node", "component")
        across = cross_links(rows, sets, group, similarity, total)
        first = first.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if not across.isEmpty():  # links between components, so components are the nodes of what is left
            for c in "ab":
                across = across.join(group.select(F.col("node").alias(c), F.col("component").alias("in")), c, "left").withColumn(c, F.coalesce("in", c)).drop("in")
            tops = components(across).select(F.col("node").alias("component"), F.col("component").alias("top"))
            first = first.join(tops, "component", "left").withColumn("component", F.coalesce("top", "component"))
    else:
        first = first.withColumn("component", F.col("node"))
    kept = first.groupBy("component").agg(F.min("r").alias("r"))
    return one_each(docs, kept.select("r.id", "r.th"), known.select("id", "th"), id_col, text_col)
