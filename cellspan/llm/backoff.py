"""Stupid-backoff language-model scores: corpus-wide n-gram counts, joined to the documents' n-grams, summed per document.

Documents are gathered into blocks of a few megabytes. A block counts its n-grams of every order, as 64-bit hashes, before
anything is shuffled; the counts are dealt by parts of the hash space, added up there, and go back to the blocks that asked, in
the order of their n-grams, so only one number an n-gram returns. Then each document takes its own counts off and is scored.
An n-gram costs a block one entry however often it occurs, so frequent words make no part larger than others. Larger tables
are counted in several rounds, each a share of the hash space, whose shuffle files go before the next begins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellspan.llm.common import materialize, pieces, text_hash

#: An odd base and multipliers with well spread bits.
BASE, MIX1, MIX2 = 0x5851F42D4C957F2D, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
POWERS = np.cumprod(np.full(1 << 12, BASE, np.uint64))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, A-Z as a-z; the text it is of), by one pass of array operations."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, end - start)
    # a word's bytes times powers of the base by place; beyond the table's 4,096 places the powers come round
    values = (data[at].astype(np.uint64) + np.uint64(1 + 256) * (place >> 12).astype(np.uint64)) * POWERS[place & 4095]
    length = end - start
    hashes = mix(np.add.reduceat(values, np.concatenate([[0], np.cumsum(length[:-1])])) + length.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(ends, start, "right")


def grams(hashes: np.ndarray, of: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order: (hash of the n-gram that ends at each word, whether the text has that many words before)."""
    out, now, ok = [], hashes, np.ones(len(hashes), bool)
    out.append((mix(now + np.uint64(1)), ok))
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), now[:-1]])
        now = mix(before * np.uint64(MIX1) + hashes)
        ok = np.concatenate([np.zeros(n - 1, bool), of[n - 1 :] == of[: 1 - n]]) if len(of) >= n else np.zeros(len(of), bool)
        out.append((mix(now + np.uint64(n)), ok))
    return out


def in_blocks(texts: DataFrame, size: int = 2_000_000) -> DataFrame:
    """(n_words, rows, block) of texts(id, th, m, text): its rows in arrays of up to about size bytes, the words in them, those of a
    row counted m times, and a number for each. Written once, so every reader sees the same blocks."""
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows=100_000, size=size):
            n = sum(m * len((t or "").encode("utf-8", "surrogatepass").split()) for m, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            rows = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.StructArray.from_arrays(b.columns, names))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), rows], ["n_words", "rows"])

    schema = T.StructType().add("n_words", T.LongType()).add("rows", T.ArrayType(texts.schema))
    return materialize(texts.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), compression="zstd")


def block_counts(blocks: DataFrame, order: int, bits: int, low: int, high: int) -> DataFrame:
    """(block, part, h, n): the distinct n-grams of each block, ascending, and their occurrences, in rows by part, the first bits of the
    hash; only of parts low to high - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = rows.values.field("m").to_numpy(zero_copy_only=False)
                hashes, of = word_hashes(rows.values.field("text").to_pylist())
                mine, whose = [], []
                for h, ok in grams(hashes, of, order):
                    part = h >> np.uint64(64 - bits)
                    on = np.flatnonzero(ok & (part >= low) & (part < high))
                    mine.append(h[on])
                    whose.append(of[on])
                keys, back, n = np.unique(np.concatenate(mine), return_inverse=True, return_counts=True)
                if (m != 1).any():
                    n = np.bincount(back, m[np.concatenate(whose)], len(keys)).astype(np.int64)
                cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(low, high + 1, dtype=np.uint64))
                has, cuts = np.flatnonzero(np.diff(cuts)), np.unique(cuts).astype(np.int32)
                if len(has):
                    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (keys.view(np.int64), n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), block)), pa.array((has + low).astype(np.int32)), *lists], ["block", "part", "h", "n"])

    return blocks.select("block", "rows").mapInArrow(run, "block long, part int, h array<long>, n array<int>")


def counted(counts: DataFrame) -> DataFrame:
    """(block, part, others) of block_counts(): in place of each n-gram's number in the block that of all other blocks, mostly 0."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        h, n = (rows.column(c).chunk(0) for c in ("h", "n"))
        keys, back = np.unique(h.flatten().to_numpy(), return_inverse=True)
        own = n.flatten().to_numpy().astype(np.int64)
        others = np.bincount(back, own, len(keys)).astype(np.int64)[back] - own
        cuts = h.offsets.to_numpy()
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "others": pa.ListArray.from_arrays(pa.array(cuts - cuts[0]), pa.array(others))})

    return counts.groupBy("part").applyInArrow(add, "block long, part int, others array<long>")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are deleted when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scores(texts: list[str | None], m: np.ndarray, elsewhere: np.ndarray, n_words: int, order: int, alpha: float) -> list[np.ndarray]:
    """(words, log_score, n_full, n_backed_off, n_unseen) of each text of a block, each counting m times; elsewhere: how often other
    blocks have its distinct n-grams, in the order of their hashes."""
    hashes, of = word_hashes(texts)
    found = grams(hashes, of, order)
    at = [np.flatnonzero(ok) for _, ok in found]
    keys, back = np.unique(np.concatenate([h[on] for (h, _), on in zip(found, at, strict=True)]), return_inverse=True)
    if len(keys) != len(elsewhere):
        raise ValueError("counts are not those of the block")
    whose = np.concatenate([of[on] for on in at])
    _, own, times = np.unique(whose * max(len(keys), 1) + back, return_inverse=True, return_counts=True)
    others = (elsewhere + np.bincount(back, m[whose], len(keys)).astype(np.int64))[back] - times[own]
    size = np.bincount(of, minlength=len(texts))
    divisor = np.log(np.maximum(n_words - size, 1))[of]
    log, level, reach, before, start = np.log(0.5) - divisor, np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), None, 0
    for n, on in enumerate(at, 1):
        now = np.zeros(len(of), np.int64)
        now[on], start = others[start : start + len(on)], start + len(on)
        seen = np.flatnonzero(now > 0)
        log[seen] = np.log(now[seen]) - (divisor[seen] if n == 1 else np.log(before[seen - 1]))
        level[seen] = n
        reach[on] = n
        before = now
    log += (reach - np.maximum(level, 1)) * np.log(alpha)
    per = lambda x: np.bincount(of, x, len(texts))
    return [size, per(log), *[per(x).astype(np.int64) for x in (level == reach, (level > 0) & (level < reach), level == 0)]]


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text", part: int = 1_000_000) -> DataFrame:
    """For every row of docs: id_col, th (the text's hash), n_words, log_score (sum over its words), mean_log_score (null
    without words), n_full (words scored by the longest n-gram they end), n_backed_off, n_unseen.

    A word scores count(n-gram) / count(its first n - 1 words) for the longest n up to order for which the other
    documents have the n-gram, times alpha for each order given up; for n = 1 the divisor is the number of their words. A
    word that no other document has counts as half an occurrence. Words are runs without white space, A-Z as a-z. Null,
    empty and blank texts have no words and score 0. Repeated rows are documents of their own (they see each other). An
    empty table gives an empty table; other columns are not read. N-grams are told apart by 64-bit hashes. part: about how
    many of a block's n-grams, over all blocks, meet in one part."""
    spark, th = docs.sparkSession, text_hash(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), th.alias("th"), F.lit(1).alias("m"), F.col(text_col).alias("text"))
    if not texts.groupBy("id").count().where("count > 1 or id is null").isEmpty():  # rows alike in id and text are one document that counts m times
        times = texts.groupBy(F.struct("id", "th").alias("doc")).agg(F.count("*").cast("int").alias("m"))
        texts = texts.select(F.struct("id", "th").alias("doc"), "text").dropDuplicates(["doc"]).join(times, "doc").select("doc.id", "doc.th", "m", "text")
    with shuffles_released(spark):
        blocks = in_blocks(texts)
        n_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
        parts = max(1, -(-n_words * order // part))
        rounds = 4 if parts > 4 else 1
        bits = max(8, (parts - 1).bit_length())
        cuts = [(1 << bits) * k // rounds for k in range(rounds + 1)]
        shares = [materialize(counted(block_counts(blocks, order, bits, low, high))) for low, high in zip(cuts, cuts[1:], strict=False)]
    totals = shares[0]
    for x in shares[1:]:
        totals = totals.union(x)

    def score(held: pa.Table, counts: pa.Table) -> pa.Table:
        rows = held.column("rows").combine_chunks().flatten() if held.num_rows else pa.array([], kind)
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        counts = counts.sort_by("part").combine_chunks()
        got = counts.column("others").chunk(0).flatten().to_numpy() if counts.num_rows else np.zeros(0, np.int64)
        m = rows.field("m").to_numpy()
        size, log, *levels = scores(rows.field("text").to_pylist(), m, got, n_words, order, alpha)
        mean = np.divide(log, size, out=np.zeros(len(log)), where=size > 0)
        columns = [rows.field("id"), rows.field("th"), pa.array(size.astype(np.int64)), pa.array(log), pa.array(mean, mask=size == 0), *map(pa.array, levels)]
        return pa.Table.from_arrays(columns, names).take(pa.array(np.repeat(np.arange(len(rows)), m)))

    schema = T.StructType([T.StructField(id_col, texts.schema["id"].dataType), T.StructField("th", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())])
    for name in ("n_full", "n_backed_off", "n_unseen"):
        schema = schema.add(name, T.LongType())
    names, kind = schema.names, to_arrow_schema(texts.schema)
    kind = pa.struct(list(kind))
    return blocks.select("block", "rows").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, schema)
