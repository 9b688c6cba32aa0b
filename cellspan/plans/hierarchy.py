"""Queries over surfaces, hierarchies, schemes and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspan.operators import analysis
from cellspan.plans.space import r6, spatial_checkpoints
from cellspan.sources.balls import parse_pdb, table
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


@query("SELECT l_suppkey % 10 AS side_a, l_partkey % 10 AS side_b, count(*) AS n_surfs, round(sum(l_quantity), 6) AS area, round(max(l_quantity), 6) AS largest, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 10 GROUP BY 1, 2")
def interface_area_ledger(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumns({"side_a": F.col("l_suppkey") % 10, "side_b": F.col("l_partkey") % 10})
    return r6(analysis.interface_ledger(l, F.col("side_a"), F.col("side_b"), F.col("l_quantity").cast("double"), ["side_a", "side_b"]))


@query("SELECT l_orderkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS mean_curv, round(sum(l_quantity), 6) AS area, count(*) AS n_surfs FROM lineitem GROUP BY l_orderkey")
def residue_area_weighted_curvature(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    return l.groupBy("l_orderkey").agg(F.round(analysis.weighted_mean(d, q), 8).alias("mean_curv"), F.round(F.sum(q), 6).alias("area"), F.count("*").alias("n_surfs"))


@query(
    "SELECT r_name, n_name, count(*) AS n_atoms, round(sum(l_quantity), 2) AS area, GROUPING(n_name)::INTEGER AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"
)
def rollup_hierarchy(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_atoms"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("area"), F.grouping("n_name").cast("int").alias("level"))


@query("SELECT l_orderkey, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS facing_pct FROM lineitem GROUP BY l_orderkey")
def sol_facing_pct(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return r6(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((100 * F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0.0)) / F.sum(q)).alias("facing_pct")))


@query(
    "WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice)::DOUBLE AS aw FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS k, o_totalprice::DOUBLE AS pow FROM orders) "
    "SELECT k, round(aw, 2) AS aw, round(pow, 2) AS pow, CASE WHEN aw IS NULL THEN 'only_b' WHEN pow IS NULL THEN 'only_a' ELSE 'both' END AS state, round(aw - pow, 2) AS diff, round(200 * (aw - pow) / (aw + pow), 4) AS pct FROM a FULL JOIN p USING (k)"
)
def scheme_full_outer_match(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("aw"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("pow"))
    out = analysis.compare_schemes(a, p, "k", "aw", "pow")
    return out.select("k", F.round("aw", 2).alias("aw"), F.round("pow", 2).alias("pow"), "state", F.round("diff", 2).alias("diff"), F.round("pct", 4).alias("pct"))


def frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("frame"), "event_type").agg(F.sum("value").alias("value"))


FRAMES = "f AS (SELECT strftime(ts, '%Y-%m-%d') AS frame, event_type, sum(value) AS value FROM events GROUP BY 1, 2)"


@query(
    f"WITH {FRAMES}, o AS (SELECT event_type AS k, arg_min(value, frame) AS first FROM f GROUP BY 1) SELECT frame, event_type, round(value, 4) AS value, round(100 * (value - first) / abs(first), 4) AS pct FROM f JOIN o ON event_type = k"
)
def pct_diff_first_frame(spark, sf_dir):
    out = analysis.percent_of_first(frames(spark, sf_dir), ["event_type"], "frame", "value")
    return out.select("frame", "event_type", F.round("value", 4).alias("value"), F.round("pct", 4).alias("pct"))


@query(
    f"WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM f), "
    "o AS (SELECT frame, event_type, n, unnest(range(pos - 2, pos + 3)) AS k FROM n), m AS (SELECT *, ((k % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) AS t FROM o) "
    "SELECT m.frame, m.event_type, round(avg(n.value), 4) AS moving FROM m JOIN n ON n.event_type = m.event_type AND n.pos = least(t, 2 * (m.n - 1) - t) GROUP BY 1, 2"
)
def moving_average(spark, sf_dir):
    out = analysis.moving_average(frames(spark, sf_dir), ["event_type"], "frame", "value", 5)
    return out.select("frame", "event_type", F.round("moving", 4).alias("moving"))


@query(
    "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, "
    "round(stddev_samp(value) / abs(avg(value)), 6) AS cv, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, round(max(value) - min(value), 6) AS range, round(100 * (max(value) - min(value)) / abs(avg(value)), 6) AS range_pct FROM events GROUP BY event_type"
)
def frame_metric_stats(spark, sf_dir):
    spatial_checkpoints(spark)
    return r6(analysis.spread(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id, event_type, round(value, 6) AS value FROM events JOIN q ON event_type = k WHERE value < lo OR value > hi")
def outlier_percentile(spark, sf_dir):
    spatial_checkpoints(spark)
    return r6(analysis.percentile_outliers(table(spark, sf_dir, "events"), ["event_type"], "value", 0.01, 0.99).select("event_id", "event_type", "value"))


ROBUST = (
    "m AS (SELECT event_type AS k, median(value) AS med FROM events GROUP BY 1), o AS (SELECT event_id, event_type, value - med AS off FROM events JOIN m ON event_type = k), "
    "d AS (SELECT event_type AS k, median(abs(off)) AS mad FROM o GROUP BY 1), z AS (SELECT event_id, event_type, CASE WHEN mad <= 1e-12 THEN 0.0 ELSE 0.67448975::DOUBLE * off / mad END AS z FROM o JOIN d ON event_type = k)"
)


@query(f"WITH {ROBUST} SELECT event_id, event_type, round(z, 6) AS z FROM z WHERE abs(z) > 3.5")
def outlier_robust_z(spark, sf_dir):
    spatial_checkpoints(spark)
    return r6(analysis.robust_outliers(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_id", "event_type", "z"))


@query("SELECT CASE WHEN l_quantity = 50 THEN 9 ELSE floor((l_quantity - 0) / 5)::INTEGER END AS bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def fixed_bin_histogram(spark, sf_dir):
    return analysis.histogram(table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "q", 0.0, 50.0, 10)


_rank = lambda c, by: f"(rank() OVER (ORDER BY {c} {by}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


@query(
    "WITH s AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p, count(*) AS n FROM lineitem GROUP BY 1), "
    f"r AS (SELECT l_suppkey, round(({_rank('q', 'DESC')} + {_rank('p', 'DESC')} + {_rank('n', 'DESC')}) / 3, 9) AS mean_rank FROM s) SELECT l_suppkey, round(mean_rank, 6) AS mean_rank, {_rank('mean_rank', '')} AS place FROM r"
)
def avg_rank(spark, sf_dir):
    spatial_checkpoints(spark)
    l = table(spark, sf_dir, "lineitem")
    s = l.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("q"), F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("p"), F.count("*").alias("n"))
    return r6(analysis.mean_rank(s, "l_suppkey", ["q", "p", "n"]))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS area_price, round(corr(l_quantity, l_discount), 6) AS area_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem")
def pearson_matrix(spark, sf_dir):
    c = lambda a, b: F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    return r6(table(spark, sf_dir, "lineitem").agg(c("l_quantity", "l_extendedprice").alias("area_price"), c("l_quantity", "l_discount").alias("area_discount"), c("l_extendedprice", "l_tax").alias("price_tax")))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    out = stream.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_window(spark, sf_dir):
    out = stream.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def watermark_dedup(spark, sf_dir):
    return stream.distinct_events(table(spark, sf_dir, "events"), "ts", ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount = 0.0) GROUP BY p_brand")
def group_touch_filter(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    on = F.col("l_partkey") == F.col("p_partkey")
    return p.join(l.where("l_quantity >= 45"), on, "left_semi").join(l.where("l_discount = 0.0"), on, "left_anti").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT lower(regexp_replace(trim(split_part(text, chr(10), 1)), '[^A-Za-z0-9]+', '_', 'g')) AS header, count(*) AS n FROM documents GROUP BY 1")
def header_normalize(spark, sf_dir):
    first = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, sf_dir, "documents").groupBy(F.lower(F.regexp_replace(first, "[^A-Za-z0-9]+", "_")).alias("header")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n::INTEGER AS section, count(*) FILTER (length(trim(line)) > 0) AS n_rows FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id, n")
def log_section_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    return lines.groupBy("doc_id", "section").agg(F.sum((F.length(F.trim("line")) > 0).cast("long")).alias("n_rows"))


_mm = ", ".join(f"printf('%.3f', 20::DOUBLE * embedding[{k}]::DOUBLE)::DOUBLE AS {c}" for k, c in ((1, "x"), (2, "y"), (3, "z")))


@query(f"SELECT vec_id % 100000 AS ball_id, {_mm}, 1.7::DOUBLE AS rad, 'CA' AS name, 'C' AS element, 'ALA' AS res_name, chr((65 + label)::INTEGER) AS chain, (vec_id // 10 % 10000)::INTEGER AS res_seq, false AS is_solvent FROM embeddings")
def pdb_fixed_width_parse(spark, sf_dir):
    """Balls written as PDB lines and read again."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double") * 20
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("vec_id") % 100000, F.chr(F.lit(65) + F.col("label")), F.floor(F.col("vec_id") / 10) % 10000, at(0), at(1), at(2))
    return r6(parse_pdb(v.select(line.alias("value"))))
