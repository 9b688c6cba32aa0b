"""Queries over ranks, groups of surfaces and residues, ranges and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspan.operators import analysis as A
from cellspan.plans.hierarchy import FRAMES, ROBUST, frames
from cellspan.plans.space import balls, base, r6, spatial_checkpoints
from cellspan.sources.balls import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir):
    spatial_checkpoints(spark)
    return table(spark, sf_dir, "events")


def items(spark, sf_dir):
    spatial_checkpoints(spark)
    return table(spark, sf_dir, "lineitem")


_avg_rank = lambda c, part="": f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {(part.removeprefix('PARTITION BY ') + ', ') if part else ''}{c}) - 1) / 2.0::DOUBLE)"


@query(f"WITH s AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, {_avg_rank('q')} AS place FROM s")
def rank_data(spark, sf_dir):
    s = items(spark, sf_dir).groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return A.average_ranks(s, "q", "place").select("l_suppkey", "place")


@query(f"WITH r AS (SELECT {_avg_rank('l_quantity')} AS a, {_avg_rank('l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf_dir):
    return r6(A.spearman(items(spark, sf_dir), "l_quantity", "l_extendedprice"))


@query(f"SELECT event_id, event_type, round({_avg_rank('value', 'PARTITION BY event_type')} / count(*) OVER (PARTITION BY event_type), 6) AS pct FROM events WHERE value IS NOT NULL")
def within_group_percentile(spark, sf_dir):
    return r6(A.rank_share(events(spark, sf_dir).where("value IS NOT NULL"), ["event_type"], "value", 5).select("event_id", "event_type", "pct"))


@query(f"WITH {ROBUST} SELECT event_id, event_type, round(z, 6) + 0.0 AS z FROM z")
def within_group_robust_z(spark, sf_dir):
    return r6(A.robust_z(events(spark, sf_dir), ["event_type"], "value", least=5).select("event_id", "event_type", "z"))


@query(
    f"WITH {ROBUST} SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY round(z, 6) DESC)::DOUBLE AS high_place, rank() OVER (PARTITION BY event_type ORDER BY round(z, 6))::DOUBLE AS low_place FROM z WHERE abs(z) > 2"
)
def outlier_ranks(spark, sf_dir):
    """Places of outliers of a class from above and from below, ties at the first."""
    z = A.robust_z(events(spark, sf_dir), ["event_type"], "value").where("abs(z) > 2").withColumn("z", F.round("z", 6)).select("event_id", "event_type", "z").checkpoint()
    out = A.average_ranks(A.average_ranks(z, "z", "high_place", ["event_type"], largest_first=True, ties="min"), "z", "low_place", ["event_type"], ties="min")
    return out.select("event_id", "event_type", F.col("high_place").cast("double").alias("high_place"), F.col("low_place").cast("double").alias("low_place"))


@query(
    f"WITH {ROBUST} SELECT event_type, count(*) AS n, round(median(abs(z)), 6) AS median, round(avg(abs(z)), 6) AS mean, round(quantile_cont(abs(z), 0.95), 6) AS p95, round(max(abs(z)), 6) AS most FROM z WHERE abs(z) > 2 GROUP BY event_type"
)
def outlier_group_summary(spark, sf_dir):
    z = A.robust_z(events(spark, sf_dir), ["event_type"], "value").where("abs(z) > 2").select("event_type", F.abs("z").alias("z")).checkpoint()
    out = z.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.max("z").alias("most"))
    return r6(out.join(A.quantiles(z, ["event_type"], "z", {"median": 0.5, "p95": 0.95}), "event_type"))


@query(
    "WITH u AS (SELECT l_returnflag AS kind, unnest(['l_quantity', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) SELECT metric, kind, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, "
    "round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM u GROUP BY metric, kind"
)
def metric_summary_table(spark, sf_dir):
    """Several metrics of surfaces, turned into rows, by class."""
    l = items(spark, sf_dir).select(F.col("l_returnflag").alias("kind"), "l_quantity", "l_discount", "l_tax")
    return r6(A.long_spread(l, ["kind"], ["l_quantity", "l_discount", "l_tax"]).select("metric", "kind", "n", "mean", "sd", "q1", "median", "q3", "iqr"))


@query(
    "SELECT l_orderkey AS residue, CASE WHEN count(*) FILTER (l_returnflag <> 'A') = count(*) THEN round(sum(l_quantity), 6) END AS area, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS open_share, "
    "array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS neighbors FROM lineitem GROUP BY 1"
)
def residue_aggregate(spark, sf_dir):
    """Sums that are null if an atom has none, shares, and unions of neighbours."""
    q = F.col("l_quantity")
    known = F.when(F.col("l_returnflag") != "A", q)
    out = items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("residue")).agg(
        F.round(A.whole_sum(known), 6).alias("area"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(0.0)) / F.sum(q), 6).alias("open_share"), A.set_union(F.array("l_suppkey")).alias("n")
    )
    return out.select("residue", "area", "open_share", F.array_join("n", ",").alias("neighbors"))


@query(
    "WITH r AS (SELECT l_orderkey % 100 AS place, l_suppkey % 4 AS chain, coalesce(sum(l_quantity * l_discount) / nullif(sum(CASE WHEN l_discount > 0 THEN l_quantity ELSE 0 END), 0), 0) AS curv FROM lineitem GROUP BY 1, 2) "
    "SELECT place, count(*) AS n_chains, round(avg(curv), 6) AS mean, round(stddev_samp(curv), 6) AS sd, round(stddev_samp(curv) / sqrt(count(*)), 6) AS sem FROM r GROUP BY place"
)
def across_chains(spark, sf_dir):
    """A residue's area-weighted curvature, 0 where no area counts, then over its repeats in the chains."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    per = items(spark, sf_dir).groupBy((F.col("l_orderkey") % 100).alias("place"), (F.col("l_suppkey") % 4).alias("chain"))
    r = per.agg(F.coalesce(F.try_divide(F.sum(q * d), F.sum(F.when(d > 0, q).otherwise(0.0))), F.lit(0.0)).alias("curv"))
    return r6(r.groupBy("place").agg(F.count("*").alias("n_chains"), F.avg("curv").alias("mean"), F.stddev_samp("curv").alias("sd"), (F.stddev_samp("curv") / F.sqrt(F.count("*"))).alias("sem")))


@query(
    "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean_a, round(avg(l_discount * 500), 6) AS mean_b, round(stddev_samp(l_quantity), 6) AS sd_a, round(stddev_samp(l_discount * 500), 6) AS sd_b, "
    "round(sqrt(var_samp(l_quantity) + var_samp(l_discount * 500)), 6) AS spread, round(100 * (avg(l_discount * 500) - avg(l_quantity)) / avg(l_quantity), 6) AS delta_pct FROM lineitem GROUP BY 1 HAVING count(*) >= 20"
)
def group_stats(spark, sf_dir):
    """Means and deviations of two schemes for groups of enough atoms, their spread in both and the difference in per cent."""
    a, b = F.col("l_quantity"), F.col("l_discount") * 500
    out = items(spark, sf_dir).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_samp(a).alias("sd_a"), F.stddev_samp(b).alias("sd_b"),
        F.sqrt(F.var_samp(a) + F.var_samp(b)).alias("spread"), F.try_divide(100 * (F.avg(b) - F.avg(a)), F.avg(a)).alias("delta_pct"),
    )
    return r6(out.where("n >= 20"))


@query(
    "SELECT l_returnflag || l_linestatus AS residue_type, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem FROM lineitem GROUP BY 1"
)
def residue_types(spark, sf_dir):
    q = F.col("l_quantity")
    return r6(items(spark, sf_dir).groupBy(F.concat("l_returnflag", "l_linestatus").alias("residue_type")).agg(F.count("*").alias("n"), F.avg(q).alias("mean"), (F.stddev_samp(q) / F.sqrt(F.count(q))).alias("sem")))


@query(
    "WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS frame, event_type, avg(value) AS value, count(value) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2) SELECT frame, event_type, round(value, 6) AS value, n, n_users FROM f"
)
def frame_summary(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("frame"), "event_type")
    return r6(e.agg(F.avg("value").alias("value"), F.count("value").alias("n"), F.count_distinct("user_id").alias("n_users")))


@query(
    f"WITH {FRAMES}, d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', frame::DATE) * 2 AS pos, value FROM f), e AS (SELECT event_type AS k, unnest(range(min(pos), max(pos) + 1)) AS pos FROM d GROUP BY 1) SELECT k AS event_type, e.pos::INTEGER AS pos, round(value, 4) AS value FROM e LEFT JOIN d ON d.event_type = k AND d.pos = e.pos"
)
def full_range_expansion(spark, sf_dir):
    """Every number between a class's first and last, those without a value as null."""
    at = F.datediff(F.to_date("frame"), F.lit("2024-01-01").cast("date")) * 2
    return A.full_range(frames(spark, sf_dir).select("event_type", at.alias("pos"), "value"), ["event_type"], "pos").withColumn("value", F.round("value", 4))


@query(
    "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey % 97 AS num, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), f AS (SELECT *, CASE WHEN num < lag(num) OVER (PARTITION BY l_suppkey ORDER BY pos, num) THEN 1 ELSE 0 END AS fell FROM r) "
    "SELECT l_suppkey, pos, num, sum(fell) OVER (PARTITION BY l_suppkey ORDER BY pos, num ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM f"
)
def residue_rollover(spark, sf_dir):
    """Numbers that start anew within a chain, told apart by turns."""
    r = items(spark, sf_dir).select("l_suppkey", (F.col("l_partkey") % 97).alias("num"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return A.rollover(r, ["l_suppkey"], ["pos", "num"], "num").select("l_suppkey", "pos", "num", "turn")


@query(
    "WITH s AS (SELECT l_suppkey, l_orderkey, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey, l_orderkey, 'price' AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY price DESC, l_orderkey) AS k FROM s "
    "UNION ALL SELECT l_suppkey, l_orderkey, 'qty', row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_orderkey) FROM s) SELECT l_suppkey, l_orderkey, string_agg(c, ',' ORDER BY c) AS scores FROM r WHERE k <= 3 GROUP BY ALL"
)
def residue_top_candidates(spark, sf_dir):
    """The three largest of each supplier by either score."""
    s = items(spark, sf_dir).groupBy("l_suppkey", "l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return A.top_by_each(s, ["l_suppkey"], ["price", "qty"], 3, "l_orderkey").withColumn("scores", F.array_join("scores", ","))


@query(f"WITH {base()} SELECT round(x, 0) + 0.0 AS x, round(y, 0) + 0.0 AS y, round(z, 0) + 0.0 AS z, min(ball_id) AS ball_id, count(*) AS n FROM b GROUP BY 1, 2, 3")
def unique_points(spark, sf_dir):
    return A.unique_points(balls(spark, sf_dir), 0, "ball_id")


@query("SELECT max(abs(value)) AS most FROM (SELECT round(value, 6) AS value FROM events)")
def color_limit_scale(spark, sf_dir):
    """The one scale that holds all values on either side of 0."""
    return events(spark, sf_dir).agg(F.max(F.abs(F.round("value", 6))).alias("most"))


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def frozen_set_union(spark, sf_dir):
    """Unions of the sets that a supplier's orders hold."""
    sets = items(spark, sf_dir).groupBy("l_suppkey", "l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_partkey").alias("p"))
    out = sets.groupBy("l_suppkey").agg(A.set_union(F.col("f")).alias("f"), A.set_union(F.col("p")).alias("p"))
    return out.select("l_suppkey", F.array_join("f", ",").alias("flags"), F.size("p").cast("long").alias("n_parts"))


@query(
    "SELECT p_brand, CASE WHEN l_discount > 0.05 THEN 'convex' WHEN l_discount < 0.02 THEN 'concave' ELSE 'flat' END AS kind, count(*) AS n, round(sum(l_quantity), 4) AS area, round(sum(l_quantity * (l_discount - 0.035::DOUBLE)), 4) AS int_h FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
)
def oriented_curvature(spark, sf_dir):
    """Area and integral of mean curvature of convex, concave and flat parts."""
    j = items(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q, d = F.col("l_quantity"), F.col("l_discount")
    kind = F.when(d > 0.05, "convex").when(d < 0.02, "concave").otherwise("flat")
    return j.groupBy("p_brand", kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(q), 4).alias("area"), F.round(F.sum(q * (d - 0.035)), 4).alias("int_h"))


@query(
    "SELECT l_suppkey, round(min(l_quantity), 6) AS least, round(max(l_quantity), 6) AS most, round(sum(l_quantity), 6) AS total, round(avg(l_discount), 6) AS mean, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, count(*) AS n FROM lineitem GROUP BY 1"
)
def surface_statistics(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return r6(items(spark, sf_dir).groupBy("l_suppkey").agg(F.min(q).alias("least"), F.max(q).alias("most"), F.sum(q).alias("total"), F.avg(d).alias("mean"), A.weighted_mean(d, q).alias("weighted"), F.count("*").alias("n")))


@query("SELECT round(corr(l_quantity, l_discount), 6) AS r, 'l_quantity' AS a, 'l_discount' AS b, count(*) AS n FROM lineitem UNION ALL SELECT round(corr(l_quantity, l_tax), 6), 'l_quantity', 'l_tax', count(*) FROM lineitem UNION ALL SELECT round(corr(l_discount, l_tax), 6), 'l_discount', 'l_tax', count(*) FROM lineitem")
def correlation_pairs(spark, sf_dir):
    """Every pair of metrics, in one pass."""
    names = ["l_quantity", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = items(spark, sf_dir).agg(*[x for a, b in pairs for x in (F.corr(a, b).alias(f"r_{a}_{b}"), F.sum((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("long")).alias(f"n_{a}_{b}"))])
    rows = F.array(*[F.struct(F.col(f"r_{a}_{b}").alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n_{a}_{b}").alias("n")) for a, b in pairs])
    return r6(one.select(F.explode(rows).alias("x")).select("x.*"))
