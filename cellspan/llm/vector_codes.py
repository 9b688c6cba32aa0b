"""Vector codes: every vector is cut into parts, each part named by the nearest entry of its position's codebook. Codebooks come
from Lloyd's rounds over integers, kept by their changes: a round's assignments are stored with the vectors, and only the parts
whose assignment has changed are added to, and taken from, running sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import materialize, pieces, release, skewed_join, written
from cellspan.llm.vectors import dimensions, matrix, usable

#: Squares of numbers below this, and sums of a few thousand of them, are exact in doubles.
EXACT = 1 << 20
#: Components beyond 65,536 count as that much, so that sums of squares stay within 64 bits.
MOST = 1 << 26


def nearest(parts: np.ndarray, entries: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry (the lowest of ties) and the squared distance, exact."""
    best, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    exact = not parts.size or (np.abs(parts).max() < EXACT and np.abs(entries).max() < EXACT and parts.shape[1] <= 4096)
    step = rows if exact else max(1, rows * 16 // max(1, entries.size))
    own = (entries.astype(float) ** 2).sum(1) if exact else None
    for k in range(0, len(parts), step):
        p = parts[k : k + step]
        if exact:  # the part's own square is the same for all entries
            best[k : k + step] = (own - 2 * (p.astype(float) @ entries.T.astype(float))).argmin(1)
        else:
            best[k : k + step] = ((p[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)
        error[k : k + step] = ((p - entries[best[k : k + step]]) ** 2).sum(1)
    return best, error


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with now, what was now as was, and the errors summed over parts; books are (parts, entries, width)."""
    n_parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 20_000, 16_000_000):
            q = matrix(b.column("q"), n_parts * width).astype(np.int64).reshape(b.num_rows, n_parts, width)
            both = [nearest(np.ascontiguousarray(q[:, k]), books[k]) for k in range(n_parts)]
            now = np.stack([x[0] for x in both], 1).astype(np.int32)
            arrays = {c: b.column(c) for c in b.schema.names} | {
                "was": b.column("now"), "now": pa.ListArray.from_arrays(np.arange(0, now.size + 1, n_parts, dtype=np.int32), now.ravel()), "error": pa.array(np.sum([x[1] for x in both], 0)),
            }
            yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names=names)

    names = rows.columns
    return rows.mapInArrow(run, rows.schema)


def _changes(rows: DataFrame, n_parts: int, width: int) -> DataFrame:
    """(part, entry, n, s0 ..): what the entries gain and lose in the parts whose assignment has changed, summed up within
    each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 20_000, 16_000_000):
            q = matrix(b.column("q"), n_parts * width).astype(np.int64).reshape(b.num_rows, n_parts, width)
            now, was = (matrix(b.column(c), n_parts).astype(np.int64) for c in ("now", "was"))
            for k in range(n_parts):
                moved = np.flatnonzero(now[:, k] != was[:, k])
                entry = np.concatenate([now[moved, k], was[moved, k]])
                sign = np.repeat([1, -1], len(moved))
                value = np.column_stack([sign, np.tile(q[moved, k], (2, 1)) * sign[:, None]])
                entry, value = entry[entry >= 0], value[entry >= 0]
                keys, at = np.unique(entry, return_inverse=True)
                sums = np.zeros((len(keys), 1 + width), np.int64)
                np.add.at(sums, at, value)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k)), pa.array(keys), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], names=names)

    sums = ["n", *(f"s{i}" for i in range(width))]
    names = ["part", "entry", *sums]
    moved = rows.where(~F.col("now").eqNullSafe(F.col("was"))).select("q", "now", "was")
    found = moved.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in sums])


def sha_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 4, n_entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256), a row for each usable vector.

    Components become floor(scale * x). Vectors are cut into n_parts equal parts, followed by zeros if they do not divide
    or are shorter than the longest. The first codebooks are the parts of the n_entries smallest ids (ascending, null ids
    last; rows of one id by their components); with fewer vectors there are fewer entries. Each round assigns all parts to
    their nearest entries, ties to the lower index, and sets each used entry to the floor of its parts' mean; then parts are
    assigned once more. code has two hex digits a part (more if there are over 256 entries), error is the squared distance
    summed over parts, label_error its sum over rows of equal label, nulls together; codebooks_sha256 is that of all final
    entries' components, comma-joined, by part, entry and position. Vectors that are null or hold a null or non-finite
    component are dropped; repeated rows are each kept; an empty table gives an empty table; other columns are not read.

    On the driver are the codebooks and sums alone (n_parts * n_entries rows). Vectors stay where they are: each round reads
    and writes them, with their assignments, in the shared folder, and the round before goes; what is shuffled is a row for each entry
    and batch in which a part has changed."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    dims = dimensions(own, "v")
    width = max(1, -(-dims // n_parts))
    whole = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")
    none = F.array(*[F.lit(-1)] * n_parts)
    rows = own.select("id", "label", F.transform("v", whole).alias("q"), none.alias("now"), none.alias("was"), F.lit(0).cast("long").alias("error"))
    start = written()
    rows = materialize(rows)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(n_entries).select("q").collect()
    books = np.zeros((max(1, len(seeds)), n_parts * width), np.int64)
    for k, s in enumerate(seeds):
        books[k, : len(s["q"])] = s["q"]
    books = np.ascontiguousarray(books.reshape(-1, n_parts, width).transpose(1, 0, 2))
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    for _ in range(rounds):
        rows = materialize(_assigned(rows, books))
        release(spark, start, written() - 1)
        for c in _changes(rows, n_parts, width).collect():  # n_parts * n_entries rows at most
            counts[c["part"], c["entry"]] += c["n"]
            sums[c["part"], c["entry"]] += list(c)[3:]
        used = counts > 0
        books = books.copy()
        books[used] = sums[used] // counts[used][:, None]
    rows = _assigned(rows, books)
    digits = max(2, len(f"{max(1, n_entries - 1):x}"))
    code = F.array_join(F.transform("now", lambda x: F.lower(F.lpad(F.hex(x), digits, "0"))), "")
    out = materialize(rows.select("id", "label", code.alias("code"), "error", F.isnull("label").alias("no_label"), F.col("label").cast("string").alias("of")).fillna("", ["of"]))
    release(spark, start, written() - 1)
    of_label = materialize(out.groupBy("no_label", "of").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("times")))
    return skewed_join(out, of_label, ["no_label", "of"], out.count()).select("id", "label", "code", "error", "label_error", F.lit(sha_of(books)).alias("codebooks_sha256"))


def encode_sql(table: str = "embeddings", n_parts: int = 4, n_entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """DuckDB SQL for the rows of encode() under the names of the query, for vectors of one length that n_parts divides."""
    steps = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM {table} "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, part, q[part * (len(q) // {n_parts}) + 1 : (part + 1) * (len(q) // {n_parts})] AS x FROM v, range({n_parts}) r(part))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {n_entries})",
        "b0 AS (SELECT part, entry, x AS c FROM p JOIN s USING (vec_id))",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT vec_id, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS near FROM "
            f"(SELECT vec_id, p.part, x, entry, {distance} AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY vec_id, part)"
        )
        if k < rounds:
            steps += [
                f"m{k} AS (SELECT part, entry, pos, floor(sum(y) / count(*))::BIGINT AS y FROM (SELECT part, near.entry AS entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY ALL)",
                f"u{k} AS (SELECT part, entry, list(y ORDER BY pos) AS c FROM m{k} GROUP BY ALL)",
                f"b{k + 1} AS (SELECT part, entry, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u USING (part, entry))",
            ]
    steps += [
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS sha FROM b{rounds})",
        f"o AS (SELECT vec_id, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM o JOIN v USING (vec_id), h"
