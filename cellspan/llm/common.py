"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, and the capitals that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local one if driver and executors are
    one machine, as in tests; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cellspan-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Where materialize() has written, in order.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that what follows neither recomputes it nor depends on
    the executor that made it. The files go by release(), at the latest when the driver's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _WRITTEN.append(at)
    return spark.read.schema(df.schema).parquet(at)


def written() -> int:
    """How many tables materialize() has written that are not released: a mark for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, start: int, end: int) -> None:
    """Deletes the tables written between two marks. DataFrames that read them must not be used after."""
    for at in _WRITTEN[start:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[start:end]


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Texts differ in length by orders of magnitude: batches cut into runs of few rows and, but for a single row that is
    longer by itself, few bytes, so that what a task makes of a run stays bounded whatever the session's batches are."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def words(text: Column) -> Column:
    """The words of a text, none for a null or blank one. One-character patterns spare the regular expression."""
    one_space = F.coalesce(text, F.lit(""))
    for ch in SPACE[1:]:
        one_space = F.replace(one_space, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(one_space, " "), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() is the fast way where the text is ASCII throughout."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def text_hash(text: Column) -> Column:
    """With the id, what tells rows apart where ids repeat or are null; rows alike in both are the same document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def matching(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (all columns, whatever their names) semi- or anti-joined with keys(id, th), null ids equal. The keys are hashed in
    each partition and the texts stream past them unsorted."""
    own_id, own_th, key_id, key_th = free(docs, "own_id", "own_th", "key_id", "key_th")
    own = docs.select("*", F.col(id_col).alias(own_id), text_hash(F.col(text_col)).alias(own_th))
    keys = keys.select(F.col("id").alias(key_id), F.col("th").alias(key_th)).hint("shuffle_hash")
    on = F.col(own_id).eqNullSafe(F.col(key_id)) & (F.col(own_th) == F.col(key_th))
    return own.join(keys, on, how).select(*quoted(docs.columns))


def one_each(docs: DataFrame, keys: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one of the distinct keys(id, th), once each. known(id, th) has a row for each row of docs, so
    texts are only compared where a pair of them occurs twice."""
    twice = materialize(known.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return matching(docs, keys, "left_semi", id_col, text_col)
    same = keys["id"].eqNullSafe(twice["id"]) & (keys["th"] == twice["th"])
    once, more = keys.join(twice, same, "left_anti"), keys.join(twice, same, "left_semi")
    return matching(docs, once, "left_semi", id_col, text_col).union(matching(docs, more, "left_semi", id_col, text_col).dropDuplicates([id_col, text_col]))


def skewed_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, heavy: int = 4096) -> DataFrame:
    """rows joined with keys(on, times, ...), one row a key, times being how many of the total rows have it.

    Keys of a heavy-th of all rows or more are at most `heavy` in number, so they are broadcast however often they occur;
    the join by key is left with keys below that share."""
    often = F.col("times") * heavy >= max(total, 1)
    many = F.broadcast(keys.where(often))
    known = rows.join(many, on)
    return known.union(rows.join(many.select(*on), on, "left_anti").join(keys.where(~often), on).select(*known.columns))
