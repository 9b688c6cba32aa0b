"""Summaries over long tables: hierarchies, interfaces, schemes, frames, outliers and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def interface_ledger(surfs: DataFrame, side: Column, other: Column, area: Column, by: list[str]) -> DataFrame:
    """Surfaces that span two sides, by key: their number, area, largest and mean."""
    spans = surfs.where(side != other)
    return spans.groupBy(*by).agg(F.count("*").alias("n_surfs"), F.sum(area).alias("area"), F.max(area).alias("largest"), F.avg(area).alias("mean"))


def percent_of_first(frames: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Adds first (the key's first value by frame that is not null) and pct, the difference from it in per cent of its size,
    so that a rise is positive whatever first's sign; null if first is 0."""
    first = frames.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, frame).alias("first"))
    return frames.join(first, keys, "left").withColumn("pct", F.try_divide(100 * (F.col(value) - F.col("first")), F.abs("first")))


def moving_average(frames: DataFrame, keys: list[str], frame: str, value: str, width: int) -> DataFrame:
    """Adds moving: the mean of the odd number of rows around each, the ends mirrored (the end row itself not repeated). A key
    with fewer rows than reach on one side mirrors what it has."""
    if width % 2 == 0:
        raise ValueError("width must be odd")
    half = width // 2
    whole = W.partitionBy(*keys)
    w = whole.orderBy(frame)
    rows = frames.withColumns({"__at": F.row_number().over(w) - 1, "__n": F.count("*").over(whole)})
    near = F.collect_list(F.struct("__at", F.col(value).alias("v"))).over(w.rowsBetween(-2 * half, 2 * half))
    period = F.greatest(2 * (F.col("__n") - 1), F.lit(1))
    wanted = F.transform(F.sequence(F.col("__at") - half, F.col("__at") + half), lambda i: F.least(F.pmod(i, period), period - F.pmod(i, period)))
    picked = F.transform(wanted, lambda i: F.get(F.filter(near, lambda x: x["__at"] == F.least(i, F.col("__n") - 1)), F.lit(0))["v"])
    mean = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / width
    return rows.withColumn("moving", mean).drop("__at", "__n")


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, __n, __before, __total) for each distinct value of a key that is not null: how many rows have it, how many
    have less, and how many there are.

    Values are ranged over partitions, counted up in each, and the partitions' sums (one row each) put in front; so
    neither a key nor the whole table has to pass through one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranged = counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()).checkpoint()
    within = W.partitionBy("__part").orderBy(*keys, value).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(F.sum("__n").alias("s"))
    ahead = F.coalesce(F.sum("s").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("__here", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(sums.select("__part", ahead.alias("__ahead"))), "__part")
    rows = rows.withColumn("__at", F.col("__here") + F.col("__ahead"))
    groups = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__at").alias("__start"), F.sum("__n").alias("__total"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = rows.join(groups, on) if on else rows.join(F.broadcast(groups))  # without keys there is one group
    return rows.select(*keys, value, "__n", (F.col("__at") - F.col("__start")).alias("__before"), "__total")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): exact quantiles between neighbours, from running counts."""
    rows, out = running_counts(df, keys, value), {}
    for name, p in shares.items():
        place = (F.col("__total") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__n")), F.col(value).cast("double")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out[name] = low + (high - low) * F.max(place - F.floor(place))
    return rows.groupBy(*keys).agg(*[x.alias(c) for c, x in out.items()])


def average_ranks(df: DataFrame, value: str, rank: str, keys: list[str] | None = None, largest_first: bool = False, ties: str = "average") -> DataFrame:
    """Adds rank: places from 1 within the keys, ties sharing the mean of theirs (or the first: "min"); null for a null."""
    rows = running_counts(df, keys or [], value)
    before = F.col("__total") - F.col("__before") - F.col("__n") if largest_first else F.col("__before")
    place = before + (1 if ties == "min" else (F.col("__n") + 1) / 2)
    ranks = rows.select(*[F.col(k).alias(f"__{k}") for k in keys or []], F.col(value).alias("__value"), place.alias(rank))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys or []] + [F.col(value) == F.col("__value")]
    return df.join(ranks, on, "left").select(*df.columns, rank)


def rank_share(df: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """Adds pct, the average rank within the keys as a share of their rows; null for keys of fewer rows than least."""
    rows = running_counts(df, keys, value).where(F.col("__total") >= least)
    ranks = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__value"), ((F.col("__before") + (F.col("__n") + 1) / 2) / F.col("__total")).alias("pct"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(value) == F.col("__value")]
    return df.join(ranks, on, "left").select(*df.columns, "pct")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho, Pearson's correlation of average ranks of the rows that have both; n."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranks = average_ranks(average_ranks(both, a, "__ra"), b, "__rb")
    return ranks.agg(F.corr("__ra", "__rb").alias("rho"), F.count("*").alias("n"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number, mean, standard deviation, its standard error, coefficient of variation, least, most, range (also in per cent of
    the mean), quartiles and their distance."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))
    out = out.join(quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys)
    return out.withColumns({
        "cv": F.try_divide(F.col("sd"), F.abs("mean")), "iqr": F.col("q3") - F.col("q1"), "sem": F.col("sd") / F.sqrt("n"), "range": F.col("most") - F.col("least"),
        "range_pct": F.try_divide(100 * (F.col("most") - F.col("least")), F.abs("mean")),
    })


def long_spread(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(metric, ids, then as spread): the columns turned into rows first."""
    rows = df.unpivot(ids, values, "metric", "value")
    return spread(rows, ["metric", *ids], "value")


def percentile_outliers(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Rows outside of their group's percentiles. The bounds are aggregated and joined back: no group is sorted whole."""
    bounds = quantiles(df, keys, value, {"low": low, "high": high})
    return df.join(bounds, keys).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


#: Fixed value: the standard normal distribution's third quartile.
QUARTILE = 0.67448975


def robust_z(df: DataFrame, keys: list[str], value: str, least: int = 1, flat: float = 1e-12) -> DataFrame:
    """Adds z: QUARTILE * (x - median) / MAD by keys, with its sign; 0 where the MAD is flat, null for keys of fewer rows than
    least and for nulls."""
    middle = quantiles(df, keys, value, {"__median": 0.5}).join(df.groupBy(*keys).agg(F.count(value).alias("__n")), keys)
    off = df.join(middle, keys, "left").withColumn("__off", F.abs(F.col(value) - F.col("__median")))
    rows = off.join(quantiles(off, keys, "__off", {"__mad": 0.5}), keys, "left")
    z = F.when(F.col("__mad") <= flat, 0.0).otherwise(F.lit(QUARTILE) * (F.col(value) - F.col("__median")) / F.col("__mad"))
    return rows.withColumn("z", F.when((F.col("__n") >= least) & F.col(value).isNotNull(), z)).select(*df.columns, "z")


def robust_outliers(df: DataFrame, keys: list[str], value: str, cut: float = 3.5) -> DataFrame:
    """Rows whose robust z, of either sign, is beyond cut."""
    return robust_z(df, keys, value).where(F.abs("z") > cut)


def compare_schemes(a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str) -> DataFrame:
    """Full outer match: both, only_a or only_b, with the difference and that in per cent of the mean."""
    both = a.join(b, key, "full")
    diff = F.col(value_a) - F.col(value_b)
    state = F.when(F.col(value_a).isNull(), "only_b").when(F.col(value_b).isNull(), "only_a").otherwise("both")
    return both.withColumns({"state": state, "diff": diff, "pct": F.try_divide(200 * diff, F.col(value_a) + F.col(value_b))})


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows by bins of equal width; what lies outside goes to bin -1 or bins, high itself to the last bin."""
    width = (high - low) / bins
    k = F.floor((F.col(value) - low) / width)
    b = F.when(F.col(value) == high, bins - 1).when(k < 0, -1).when(k >= bins, bins).otherwise(k).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def mean_rank(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Average over columns of each row's rank (1 for the largest, ties share the mean of theirs) and that average's own
    rank."""
    out = df
    for k, v in enumerate(values):
        out = average_ranks(out, v, f"__r{k}", largest_first=True)
    ranks = [F.col(f"__r{k}") for k in range(len(values))]
    out = out.select(key, F.round(sum(ranks[1:], ranks[0]) / len(values), 9).alias("mean_rank"))
    return average_ranks(out, "mean_rank", "place")


def whole_sum(value: Column) -> Column:
    """The sum, or null if any row has none."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def set_union(arrays: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(arrays))))


def full_range(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """df with a row of nulls for every whole number between a key's least and largest `at` that has none."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    every = ends.select(*keys, F.explode(F.sequence("__lo", "__hi")).alias(at))
    return every.join(df, [*keys, at], "left").select(*df.columns)


def rollover(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """Adds turn: how often number has fallen before this row within the keys, so that numbers that start anew stay apart."""
    w = W.partitionBy(*keys).orderBy(*order)
    fell = (F.col(number) < F.lag(number).over(w)).cast("int")
    rows = df.withColumn("__fell", F.coalesce(fell, F.lit(0)))
    return rows.withColumn("turn", F.sum("__fell").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__fell")


def followers(df: DataFrame, key: str, order: str, values: list[str], n: int) -> DataFrame:
    """df with p0_<value> .. pn_<value>: each row's own values and those of the n rows that follow it in its key, null beyond.

    Rows are ranged over partitions by key and order, so a large key is split; each partition also gets the first n rows of
    the n partitions after it, which hold the next n rows at least."""
    ranged = df.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()).checkpoint()
    parts = ranged.select("__part").distinct().withColumn("__k", F.row_number().over(W.orderBy("__part")))  # a row a partition
    real = ranged.join(F.broadcast(parts), "__part").withColumn("__ghost", F.lit(False))
    within = W.partitionBy("__k").orderBy(key, order)
    heads = real.withColumn("__row", F.row_number().over(within)).where(F.col("__row") <= n).drop("__row")
    ghosts = heads.withColumn("__k", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: F.col("__k") - d))).withColumn("__ghost", F.lit(True))
    rows = real.unionByName(ghosts.select(*real.columns))
    after = lambda c, d: F.when(F.lead(key, d).over(within).eqNullSafe(F.col(key)), F.lead(c, d).over(within)) if d else F.col(c)
    return rows.select(*df.columns, "__ghost", *[after(c, d).alias(f"p{d}_{c}") for d in range(n + 1) for c in values]).where("NOT __ghost").drop("__ghost")


def top_by_each(df: DataFrame, keys: list[str], scores: list[str], n: int, id_col: str) -> DataFrame:
    """(keys, id, scores): the n rows of each key that are largest by any of the scores, with the scores they are there for."""
    picks = None
    for c in scores:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(c), id_col))
        part = df.where(F.col(c).isNotNull()).withColumn("__place", place).where(F.col("__place") <= n).select(*keys, id_col, F.lit(c).alias("c"))
        picks = part if picks is None else picks.union(part)
    return picks.groupBy(*keys, id_col).agg(F.sort_array(F.collect_set("c")).alias("scores"))


def unique_points(points: DataFrame, decimals: int, id_col: str) -> DataFrame:
    """Points that are alike to so many decimals, once: (x, y, z, first id, n). Minus zero is zero."""
    at = [(F.round(c, decimals) + F.lit(0.0)).alias(c) for c in "xyz"]
    return points.groupBy(*at).agg(F.min(id_col).alias(id_col), F.count("*").alias("n"))


def inertia(balls: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """(keys, mass, centre, ixx .. iyz): the tensor of solid spheres about their common centre of mass: each sphere's own
    2/5 m r^2 and its mass at its distance."""
    m = F.col(mass)
    sums = balls.groupBy(*keys).agg(
        F.sum(m).alias("m"), *[F.sum(m * F.col(c)).alias(f"s{c}") for c in "xyz"], F.sum(0.4 * m * F.col("rad") * F.col("rad")).alias("own"),
        *[F.sum(m * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")],
    )
    about = lambda a, b: F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("m")
    diagonal = {f"i{c}{c}": F.col("own") + sum((about(d, d) for d in "xyz" if d != c), F.lit(0.0)) for c in "xyz"}
    off = {f"i{a}{b}": -about(a, b) for a, b in ("xy", "xz", "yz")}
    return sums.select(*keys, F.col("m").alias("mass"), *[(F.col(f"s{c}") / F.col("m")).alias(f"c{c}") for c in "xyz"], *[x.alias(c) for c, x in {**diagonal, **off}.items()])
