"""Queries over energies, shapes, neighbour sets and distributions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.functions import geometry as G
from cellspan.operators import analysis, spatial
from cellspan.plans.hierarchy import FRAMES, frames
from cellspan.plans.space import BOTH, GAP, NEAR, PAIRS, TOUCH, WIDE, balls, base, r6, spatial_checkpoints
from cellspan.sources.balls import table
from cellspan.streaming import events as stream

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    "WITH s AS (SELECT l_suppkey, sum(l_quantity)::DOUBLE AS area, sum(l_quantity * l_discount)::DOUBLE AS h, sum(l_quantity::DOUBLE * l_discount::DOUBLE * l_discount::DOUBLE) AS h2 FROM lineitem GROUP BY 1) "
    "SELECT l_suppkey, round(0.5 * (4 * h2 - 4 * 0.02::DOUBLE * h + 0.02::DOUBLE * 0.02::DOUBLE * area), 6) AS energy FROM s"
)
def helfrich_energy(spark, sf_dir):
    q, d = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(q).alias("area"), F.sum(q * d).alias("h"), F.sum(q * d * d).alias("h2"))
    return r6(s.select("l_suppkey", G.helfrich_energy(F.col("h2"), F.col("h"), F.col("area"), c0=0.02).alias("energy")))


@query(
    f"WITH {base()}, s AS (SELECT chain, sum(4 / 3::DOUBLE * pi() * rad ** 3) AS v, sum(4 * pi() * rad * rad) AS a FROM b GROUP BY chain) "
    "SELECT chain, round(pi() ** (1 / 3::DOUBLE) * (6 * v) ** (2 / 3::DOUBLE) / a, 6) AS sphericity, round(36 * pi() * v * v / a ** 3, 6) AS iq FROM s"
)
def sphericity(spark, sf_dir):
    rad, pi = F.col("rad"), 3.141592653589793
    s = balls(spark, sf_dir).groupBy("chain").agg(F.sum(4 / 3 * pi * rad * rad * rad).alias("v"), F.sum(4 * pi * rad * rad).alias("a"))
    v, a = F.col("v"), F.col("a")
    return r6(s.select("chain", G.sphericity(v, a).alias("sphericity"), G.isoperimetric_quotient(v, a).alias("iq")))


@query(
    f"WITH {base()}, o AS (SELECT chain AS k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM b GROUP BY chain), d AS (SELECT chain, rad, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM b JOIN o ON chain = k) "
    "SELECT chain, round(max(d + rad), 6) AS farthest, round(min(d - rad), 6) AS nearest FROM d GROUP BY chain"
)
def spike_extrema(spark, sf_dir):
    b = balls(spark, sf_dir)
    centre = b.groupBy("chain").agg(*[F.avg(c).alias(f"c_{c}") for c in "xyz"])
    d = G.distance((F.col("x"), F.col("y"), F.col("z")), G.point("c"))
    return r6(b.join(centre, "chain").groupBy("chain").agg(F.max(d + F.col("rad")).alias("farthest"), F.min(d - F.col("rad")).alias("nearest")))


@query(
    f"WITH {base()}, {PAIRS}, {BOTH.format(GAP)} SELECT ball_id, count(*) AS n_wide, count(*) FILTER (gap <= {NEAR}) AS n_near, round(count(*) FILTER (gap <= {NEAR}) / count(*)::DOUBLE, 6) AS jaccard FROM n GROUP BY ball_id"
)
def neighbor_jaccard(spark, sf_dir):
    """Of the neighbour sets at two ranges; the near one is part of the wide one, so one join gives both."""
    n = spatial.neighbor_sums(balls(spark, sf_dir), GAP, NEAR).select("ball_id", F.col("n").alias("n_wide"), "n_near")
    return r6(n.withColumn("jaccard", F.col("n_near") / F.col("n_wide")))


@query(f"WITH {TOUCH} SELECT u AS node FROM t GROUP BY u HAVING count(*) = 1")
def open_vertices(spark, sf_dir):
    """Nodes of the contact graph with one neighbour."""
    near = spatial.both_ways(spatial.range_join(balls(spark, sf_dir, WIDE), NEAR))
    return near.groupBy(F.col("ball_id").alias("node")).count().where("count = 1").select("node")


@query(
    f"WITH {FRAMES} SELECT event_type, count(*) AS n_frames, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, "
    "round(arg_min(value, frame), 4) AS first, round(arg_max(value, frame), 4) AS last FROM f GROUP BY event_type"
)
def temporal_summary(spark, sf_dir):
    v = F.col("value")
    parts = {"least": F.min(v), "most": F.max(v), "mean": F.avg(v), "first": F.min_by(v, "frame"), "last": F.max_by(v, "frame")}
    return frames(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n_frames"), *[F.round(x, 4).alias(c) for c, x in parts.items()])


@query(
    "WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1) "
    "SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events JOIN q ON event_type = k"
)
def percentile_clip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spatial_checkpoints(spark)
    bounds = analysis.quantiles(e, ["event_type"], "value", {"lo": 0.05, "hi": 0.95})
    # null values stay null, as least and greatest would pass over them
    clipped = F.when(F.col("value").isNotNull(), F.least(F.greatest("value", "lo"), F.col("hi")))
    return r6(e.join(bounds, "event_type").select("event_id", clipped.alias("value")))


@query(
    "WITH s AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS s, event_type, value FROM events, range(4) r(k)) "
    "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL"
)
def sliding_window(spark, sf_dir):
    out = stream.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 hour", "15 minutes")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH s AS (SELECT l_suppkey, l_orderkey, sum(l_extendedprice)::DOUBLE AS price FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(price, 2) DESC, l_orderkey) AS place FROM s) "
    "SELECT l_suppkey, place::INTEGER AS place, l_orderkey, round(price, 2) AS price FROM r WHERE place <= 3"
)
def top_candidates(spark, sf_dir):
    """The three largest of each supplier; Spark keeps three a task before it shuffles."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("price"))
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("price"), "l_orderkey"))
    return s.withColumn("place", place).where("place <= 3").select("l_suppkey", "place", "l_orderkey", "price")
