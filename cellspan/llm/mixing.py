"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.llm.common import materialize, words


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """sizes(source, source_size), a row for each source, to source, source_size, target.

    Sources by code point, null last, weigh the given weights in turn, and share the sum of all sizes by weight. A target
    stops at max_repeats times its source's size; the excess goes to the others by weight until none is above. That is
    the level L at which the sum of least(cap, weight * L) is the total: in order of cap / weight, the capped sources
    come first, so L follows from running sums over the sources (one row each; no document is touched here)."""
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int") + 1)
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_repeats).cast("double").alias("cap"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "level": (F.sum(F.col("source_size").cast("double")).over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    })
    free = F.col("cap") / F.col("w") >= F.col("level")
    rows = rows.withColumn("final", F.min(F.when(free, F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("l")))).over(W.partitionBy())["l"])
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.col("final")).alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 42, grain: int = 4096,
) -> DataFrame:
    """A row for each row of docs: id_col, th (hash of the text), size (words), source_size, target, copies, taken.

    Every source's documents are shuffled by the MD5 of seed and id, and repeated up to max_repeats times in that order.
    A document's virtual finish time is the words its source has given once it is through, divided by the source's
    target. All documents of all sources are ranged by that time and taken until the next one would exceed the total of
    all sizes. Whole documents are taken; so a source misses its target by less than one of its documents, as a rule.

    Running sums never pass through one task: they are taken in hash ranges of a source (grain of them, so a source with
    a third of all rows is split), and the ranges' totals, at most grain a source, are added up in front. The cut is
    found the same way: fair queueing gives every stretch of virtual time about the same number of words, so grain
    stretches a unit of time are an even range partitioning. The one stretch in which the total is reached is parted into
    grain once more, and only the part in which it is reached is sorted.

    Null text: size 0, never taken. Null source: one more source, the last. Null id: shuffled by the text. Rows with
    the same id are ordered by size and text hash; rows alike in all these are interchangeable. Reruns agree. Other
    columns are not read. An empty table, or one without a word, gives rows with target 0 and taken 0 (or no rows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows without an id are dealt by their text, so that they do not all share a place
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), own))
    items = materialize(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"), key.alias("key"),
    ))
    spans = items.withColumn("span", F.substring("key", 1, 3))
    span_sizes = materialize(spans.groupBy("source", "span").agg(F.sum("size").alias("size")))
    targets = materialize(source_targets(span_sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    ahead = W.partitionBy("source").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    ahead = span_sizes.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    ahead = ahead.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    within = W.partitionBy("source", "span").orderBy("key", F.col("id").isNull(), "id", "size", "th").rowsBetween(W.unboundedPreceding, 0)
    queued = spans.withColumn("own", F.sum("size").over(within))
    queued = queued.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p")))
    queued = materialize(queued.select("id", "th", "source", "key", "size", "source_size", "target", (F.col("ahead") + F.col("own")).alias("through")))

    def finish(turn: Column) -> Column:
        return F.try_divide((F.col("source_size") * turn + F.col("through")).cast("double"), F.col("target"))

    def stretch(turn: Column) -> Column:
        return F.least(F.floor(finish(turn) * grain), F.lit(grain * 64)).cast("long")

    turns = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn")
    many = queued.where("size > 0").select("*", turns)
    at = many.groupBy(stretch(F.col("turn")).alias("at")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    cut = at.select("at", (upto - F.col("size")).alias("before"), upto.alias("upto")).join(F.broadcast(total))  # one row
    cut = cut.where(F.col("upto") > F.col("total")).agg(F.min_by(F.struct("at", "before", "total"), "at").alias("c")).first()["c"]
    if cut is None:  # nothing is beyond the total: all is taken
        copies = F.when(F.col("size") > 0, F.lit(max_repeats)).otherwise(0)
        return queued.select(F.col("id").alias(id_col), "th", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))
    edge = many.where(stretch(F.col("turn")) == cut["at"]).withColumn("time", finish(F.col("turn")))
    # the stretch itself is parted once more, so that what is sorted is a share of grain ** -2 of all
    fine = F.floor((F.col("time") * grain - cut["at"]) * grain).cast("long")
    sums = edge.groupBy(fine.alias("fine")).agg(F.sum("size").alias("size")).select("fine", F.sum("size").over(W.orderBy("fine").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), "size")
    last = sums.where(F.col("upto") + cut["before"] > cut["total"]).agg(F.min_by(F.struct("fine", (F.col("upto") - F.col("size")).alias("ahead")), "fine").alias("c")).first()["c"]
    surely = edge.where(fine < last["fine"])
    edge = edge.where(fine == last["fine"])
    in_order = W.orderBy("time", F.col("source").isNull(), "source", "key", F.col("id").isNull(), "id", "size", "th", "turn").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("sum", F.sum("size").over(in_order) + cut["before"] + last["ahead"]).where(F.col("sum") <= cut["total"])
    edge = edge.drop("sum").union(surely)
    # of rows alike in id, text and source, `through` tells which is which
    edge = edge.groupBy(F.col("id").alias("e_id"), F.col("th").alias("e_th"), F.col("source").alias("e_source"), F.col("through").alias("e_through")).agg(F.count("*").alias("more"))
    sure = sum((F.when(stretch(F.lit(i)) < cut["at"], 1).otherwise(0) for i in range(max_repeats)), F.lit(0))
    same = F.col("id").eqNullSafe(F.col("e_id")) & (F.col("th") == F.col("e_th")) & F.col("source").eqNullSafe(F.col("e_source")) & (F.col("through") == F.col("e_through"))
    copies = F.when(F.col("size") > 0, sure + F.coalesce("more", F.lit(0))).otherwise(0).cast("int")
    out = queued.join(edge, same, "left").select("*", copies.alias("copies"))
    return out.select(F.col("id").alias(id_col), "th", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))
