"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import materialize, one_each, pieces, text_hash
from cellspan.llm.graph import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half of the XXH64 values of the text's word shingles."""
    # bytes.lower() touches A-Z alone, bytes.split() splits at exactly \x20 and \x09-\x0D
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), seed) for i in range(at, min(n, at + (1 << 15)))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id_col, carry, fp long) for every row of docs; a null, empty or blank text has fingerprint 0."""
    names = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps, pa.int64())], names=[*names, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("fp", T.LongType())])
    return docs.select(*names, text_col).mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(taken: int, distance: int) -> list[int]:
    """Masks that add to the bits in taken two of distance + 2 equal blocks of the other bits. Two values that agree on
    taken and differ in at most distance bits agree on one of these masks at least."""
    free = [i for i in range(BITS) if not taken >> i & 1]
    if len(free) < distance + 2:
        return []
    cuts = np.array_split(np.array(free), distance + 2)
    blocks = [sum(1 << int(i) for i in c) for c in cuts]
    return [taken | a | b for a, b in combinations(blocks, 2)]


def links(fps: DataFrame, distance: int = 3, large: int = 256, levels: int = 4) -> DataFrame:
    """fps(fp) of distinct fingerprints, to (a, b), a < b: every pair that differs in at most distance bits.

    64 bits fall into distance + 2 blocks; a close pair shares two of them, so rows meet on every two blocks (26 bits
    each for distance 3). A block value that over `large` fingerprints share is not paired off as it is: its members are
    blocked again on their other bits, which keeps every close pair and parts the rest. Only the last level pairs
    whatever still shares its key; by then all but a few bits are equal."""
    level = [(m, _keys(m, distance)) for m in [0]]
    rows = fps.select("fp", F.lit(0).alias("mask"))
    found = None
    for depth in range(levels):
        children = F.array(*[F.array(*[F.lit(_signed(k)).cast("long") for k in keys]) for _, keys in level])
        keyed = rows.select("fp", "mask", F.posexplode(F.element_at(children, F.col("mask") + 1)).alias("child", "bits"))
        keyed = keyed.select("fp", (F.col("mask") * len(level[0][1]) + F.col("child")).alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
        level = [(k, _keys(k, distance)) for _, keys in level for k in keys]
        last = depth == levels - 1 or not all(keys for _, keys in level)
        if not last:
            keyed = materialize(keyed)
            crowded = materialize(keyed.groupBy("mask", "key").count().where(F.col("count") > large).drop("count"))
            last = crowded.isEmpty()
        small = keyed if last else keyed.join(crowded, ["mask", "key"], "left_anti")
        a, b = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        pairs = a.join(b, ["mask", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        rows = keyed.join(crowded, ["mask", "key"], "left_semi").select("fp", "mask")
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id_col, carry, fp (long), component (the smallest fingerprint that links reach),
    component_id (the smallest id).

    Rows with equal fingerprints are one node of the link graph, so thousands of copies cost one row; texts without a
    word have fingerprint 0 and link like any other. A null id is kept as a row and never is a component_id unless its
    component has no other. Rows may repeat. Other columns of docs are not read. An empty table gives an empty table."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, carry=carry))
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    comps = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    nodes = nodes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(nodes.join(firsts, "component").select("fp", "component", "component_id"), "fp", "left").select(id_col, *carry, "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id (null last) stays, with all its columns;
    where rows share that id, the one with the smallest text hash, once."""
    keyed = docs.select(id_col, text_col, text_hash(F.col(text_col)).alias("th"))
    near = materialize(near_duplicates(keyed, id_col, text_col, distance, shingle, carry=("th",)))
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "th")
    first = near.groupBy("component").agg(F.min(rank).alias("r")).select("r.id", "r.th")
    return one_each(docs, first, near.select(F.col(id_col).alias("id"), "th"), id_col, text_col)
