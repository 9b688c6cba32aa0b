"""A bounded sample of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most max_rows labelled documents, chosen by the hash of the id, none of which has
    crc32(id as text) mod modulus equal to held_out. Null labels and ids are left out; where an id has several labels the
    largest counts; where several rows share an id, one of them (the smallest text) counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(F.crc32(F.col("id").cast("string")) % modulus != held_out).groupBy("id").agg(F.max("label").alias("label"))
    have = docs.select(F.col(id_col).alias("id")).where("id is not null")
    chosen = known.join(have, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most max_rows rows of an id and a label, by the limit above
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether labels of the id are kept from learning; false for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))
