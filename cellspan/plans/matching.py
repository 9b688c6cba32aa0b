"""Queries that match networks, schemes and structures, and over the keys of a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspan.operators import matching as M
from cellspan.operators import network, spatial
from cellspan.plans.selection import ATOMS, KEYS, SIDES, atoms, keys, sides
from cellspan.plans.space import balls, base, r6, spatial_checkpoints, verts
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


def items(spark, sf_dir):
    spatial_checkpoints(spark)
    return table(spark, sf_dir, "lineitem")


TRIPLES = "t AS (SELECT b0 AS f0, b1 AS f1, b2 AS f2, b3 AS o FROM v UNION ALL SELECT b0, b1, b3, b2 FROM v UNION ALL SELECT b0, b2, b3, b1 FROM v UNION ALL SELECT b1, b2, b3, b0 FROM v)"
STATUS = "CASE count(*) WHEN 1 THEN 'open' WHEN 2 THEN 'edge' ELSE 'several' END"


@query(f"WITH {KEYS}, {TRIPLES} SELECT f0, f1, f2, count(*) AS n_ends, {STATUS} AS status FROM t GROUP BY f0, f1, f2")
def vertex_edge_join(spark, sf_dir):
    return M.edge_counts(keys(spark, sf_dir))


@query(
    f"WITH {KEYS}, {TRIPLES} SELECT 0 AS dim, count(DISTINCT x) AS n FROM (SELECT unnest([b0, b1, b2, b3]) AS x FROM v) UNION ALL SELECT 1, count(DISTINCT f0 * 1000 + f1) FROM (SELECT unnest([b0, b0, b0, b1, b1, b2]) AS f0, unnest([b1, b2, b3, b2, b3, b3]) AS f1 FROM v) "
    "UNION ALL SELECT 2, count(DISTINCT f0 * 1000000 + f1 * 1000 + f2) FROM t UNION ALL SELECT 3, count(*) FROM v"
)
def key_dual_counts(spark, sf_dir):
    """Simplices of the dual of given vertices, by dimension."""
    return network.dual_counts(keys(spark, sf_dir))


@query(f"WITH {KEYS}, {TRIPLES}, e AS (SELECT DISTINCT f0, f1, f2 FROM t), b AS (SELECT unnest([f0, f1, f2]) AS ball_id, f0, f1, f2 FROM e) SELECT ball_id, count(*) AS n, min(f0 * 1000000 + f1 * 1000 + f2) AS first FROM b GROUP BY 1")
def reverse_adjacency_edges(spark, sf_dir):
    a = M.adjacency(M.edge_counts(keys(spark, sf_dir)), ["f0", "f1", "f2"])
    return a.select("ball_id", "n", (F.col("first")[0] * 1000000 + F.col("first")[1] * 1000 + F.col("first")[2]).alias("first"))


@query(f"WITH {KEYS}, p AS (SELECT DISTINCT unnest([b0, b0, b0, b1, b1, b2]) AS f0, unnest([b1, b2, b3, b2, b3, b3]) AS f1 FROM v), b AS (SELECT unnest([f0, f1]) AS ball_id, f0, f1 FROM p) SELECT ball_id, count(*) AS n, min(f0 * 1000 + f1) AS first FROM b GROUP BY 1")
def reverse_adjacency_surfs(spark, sf_dir):
    a = M.adjacency(network.faces(keys(spark, sf_dir), 2).select("f0", "f1").distinct(), ["f0", "f1"])
    return a.select("ball_id", "n", (F.col("first")[0] * 1000 + F.col("first")[1]).alias("first"))


@query(
    f"WITH {KEYS}, {TRIPLES}, d AS (SELECT DISTINCT f0, f1, f2 FROM t) SELECT x.f0 AS b0, x.f1 AS b1, x.f2 AS b2, y.f2 AS b3 FROM d x JOIN d y ON y.f0 = x.f0 AND y.f1 = x.f1 AND y.f2 > x.f2 JOIN d p ON p.f0 = x.f0 AND p.f1 = x.f2 AND p.f2 = y.f2 "
    "JOIN d q ON q.f0 = x.f1 AND q.f1 = x.f2 AND q.f2 = y.f2 WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.b0 = x.f0 AND v.b1 = x.f1 AND v.b2 = x.f2 AND v.b3 = y.f2)"
)
def missing_vertices(spark, sf_dir):
    return M.unseen_quads(keys(spark, sf_dir))


@query(f"WITH {KEYS}, {TRIPLES}, {SIDES}, e AS (SELECT DISTINCT f0, f1, f2 FROM t) SELECT f0, f1, f2 FROM e WHERE (f0 IN (SELECT ball_id FROM m WHERE side = 'a')) AND (f1 IN (SELECT ball_id FROM m WHERE side = 'b')) AND f2 BETWEEN 100 AND 109")
def water_edge_discovery(spark, sf_dir):
    """Edges with a ball of either side and a water."""
    water = spark.range(100, 110).select(F.col("id").alias("ball_id"), F.lit("water").alias("kind"))
    kinds = sides(spark).withColumnRenamed("side", "kind").union(water)
    edges = M.edge_counts(keys(spark, sf_dir)).select("f0", "f1", "f2")
    return M.with_kinds(edges, ["f0", "f1", "f2"], kinds, ("a", "b", "water")).where("has_a AND has_b AND has_water").select("f0", "f1", "f2")


PAIR_TABLE = "p AS (SELECT l_partkey % 50 AS f0, 50 + l_suppkey % 50 AS f1, round(sum(l_quantity), 4) AS area, min(l_discount) AS birth, bool_and(l_returnflag <> 'N' OR l_discount > 0.001) AS complete, count(*) AS n FROM lineitem GROUP BY 1, 2)"
PAIR_SETS = "s AS (SELECT p.*, f0 IN (SELECT ball_id FROM m WHERE side = 'a') AS ia, f1 IN (SELECT ball_id FROM m WHERE side = 'b') AS ib FROM p)"


def pairs(spark, sf_dir):
    d = F.col("l_discount")
    by = items(spark, sf_dir).groupBy((F.col("l_partkey") % 50).alias("f0"), (50 + F.col("l_suppkey") % 50).alias("f1"))
    return by.agg(F.round(F.sum("l_quantity"), 4).alias("area"), F.min(d).alias("birth"), F.min((F.col("l_returnflag") != "N") | (d > 0.001)).alias("complete"), F.count("*").alias("n"))


@query(f"WITH {SIDES}, {PAIR_TABLE}, {PAIR_SETS} SELECT CASE WHEN ia AND ib THEN 'direct' WHEN ia THEN 'side_a' WHEN ib THEN 'side_b' ELSE 'outside' END AS set, count(*) AS n, round(sum(area), 3) AS area FROM s GROUP BY 1")
def interface_sets(spark, sf_dir):
    return M.pair_sets(pairs(spark, sf_dir), sides(spark)).groupBy("set").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"))


FULL = (
    f"{SIDES}, {PAIR_TABLE}, {PAIR_SETS}, c AS (SELECT f0, f1, CASE WHEN n % 11 = 0 THEN NULL ELSE complete END AS complete, CASE WHEN n % 7 <> 0 THEN area END AS area FROM s WHERE ia AND ib), "
    "k AS (SELECT *, CASE WHEN complete IS NULL THEN 'unresolved' WHEN NOT complete THEN 'excluded_incomplete' WHEN area IS NULL THEN 'excluded_area_unavailable' ELSE 'selected' END AS status FROM c)"
)


def _full(spark, sf_dir):
    p = pairs(spark, sf_dir)
    p = p.withColumns({"complete": F.when(F.col("n") % 11 != 0, F.col("complete")), "area": F.when(F.col("n") % 7 != 0, F.col("area"))})
    triples = M.edge_counts(keys(spark, sf_dir)).select("f0", "f1", "f2", F.when(F.col("n_ends") > 1, True).otherwise(False).alias("complete"))
    return M.full_interface(p, triples, sides(spark))


@query(f"WITH {FULL} SELECT status, count(*) AS n, round(sum(area), 3) AS area FROM k GROUP BY status")
def full_interface_surfaces(spark, sf_dir):
    return _full(spark, sf_dir)[0].groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"))


@query(
    f"WITH {KEYS}, {TRIPLES}, {FULL}, e AS (SELECT f0, f1, f2, count(*) > 1 AS complete FROM t GROUP BY f0, f1, f2 HAVING f0 IN (SELECT ball_id FROM m WHERE side = 'a') AND f1 IN (SELECT ball_id FROM m WHERE side = 'b')), "
    "j AS (SELECT e.*, (SELECT count(*) FROM k WHERE k.status = 'selected' AND k.f0 = e.f0 AND k.f1 = e.f1) AS n FROM e) SELECT CASE WHEN NOT complete THEN 'excluded_incomplete' WHEN n = 1 THEN 'boundary' ELSE 'outside_selected_interface' END AS status, count(*) AS n FROM j GROUP BY 1"
)
def full_interface_edges(spark, sf_dir):
    return _full(spark, sf_dir)[1].groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {SIDES}, {PAIR_TABLE}, {PAIR_SETS} SELECT f0, f1, round(birth, 6) AS birth, n % 5 <> 0 AND complete AS eligible FROM s WHERE ia AND ib AND birth <= 0.02 + 1e-9")
def alpha_interface(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("bounded", F.col("n") % 5 != 0)
    return M.alpha_interface(p, sides(spark), 0.02).select("f0", "f1", F.round("birth", 6).alias("birth"), "eligible")


@query(
    "WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS o FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS o FROM lineitem WHERE l_linestatus = 'O'), j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ia, b.k IS NOT NULL AS ib FROM a FULL JOIN b ON a.k = b.k AND a.o = b.o) "
    "SELECT k AS l_suppkey, CASE WHEN NOT bool_or(ib) THEN 'only_a' WHEN NOT bool_or(ia) THEN 'only_b' ELSE 'both' END AS state, count(*) FILTER (ia) AS n_a, count(*) FILTER (ib) AS n_b, count(*) FILTER (ia AND ib) AS n_both, round(count(*) FILTER (ia AND ib) / count(*)::DOUBLE, 6) AS jaccard FROM j GROUP BY k"
)
def neighbor_set_match(spark, sf_dir):
    """Neighbours of the same cells in two schemes."""
    l = items(spark, sf_dir).select("l_suppkey", F.col("l_partkey").alias("other"), "l_returnflag", "l_linestatus")
    return r6(M.neighbor_match(l.where("l_returnflag = 'R'").select("l_suppkey", "other"), l.where("l_linestatus = 'O'").select("l_suppkey", "other"), "l_suppkey"))


CELLS = "a AS (SELECT l_orderkey AS k, sum(l_quantity) AS vol, sum(l_extendedprice) AS sa FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(l_quantity * (1 + l_discount)) AS vol, sum(l_extendedprice * (1 + l_tax) * CASE WHEN l_linenumber = 7 THEN 40 ELSE 1 END) AS sa FROM lineitem GROUP BY 1)"


def _cells(spark, sf_dir):
    l = items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("k"))
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    a = l.agg(F.sum(q).alias("vol"), F.sum(e).alias("sa"))
    b = l.agg(F.sum(q * (1 + F.col("l_discount"))).alias("vol"), F.sum(e * (1 + F.col("l_tax")) * F.when(F.col("l_linenumber") == 7, 40).otherwise(1)).alias("sa"))
    return a, b


@query(
    f"WITH {CELLS}, d AS (SELECT 'vol' AS value, (b.vol - a.vol) / a.vol AS d FROM a JOIN b USING (k) UNION ALL SELECT 'sa', (b.sa - a.sa) / a.sa FROM a JOIN b USING (k)) "
    "SELECT value, count(d) AS n, count(*) FILTER (d > 5) AS outliers, round(avg(CASE WHEN d <= 5 THEN d END), 6) AS mean, round(avg(abs(CASE WHEN d <= 5 THEN d END)), 6) AS mean_size FROM d GROUP BY value"
)
def scheme_compare(spark, sf_dir):
    return r6(M.scheme_differences(*_cells(spark, sf_dir), "k", ["vol", "sa"], cut=5.0))


@query(f"WITH {CELLS} SELECT k, CASE WHEN abs(b.vol - a.vol) > 5 OR abs(b.sa - a.sa) > 5000 THEN 'off' ELSE 'near' END AS kind FROM a JOIN b USING (k) JOIN orders ON o_orderkey = k")
def atom_compare(spark, sf_dir):
    """Three schemes' cells by key, with cuts on their differences."""
    a, b = _cells(spark, sf_dir)
    three = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    j = a.alias("a").join(b.alias("b"), "k").join(three, "k")
    off = (F.abs(F.col("b.vol") - F.col("a.vol")) > 5) | (F.abs(F.col("b.sa") - F.col("a.sa")) > 5000)
    return j.select("k", F.when(off, "off").otherwise("near").alias("kind"))


OTHER = "o AS (SELECT ball_id, (chain + 3) % 10 AS chain, res_seq, name, x, y, z FROM a WHERE ball_id % 5 <> 0)"


def _other(spark, sf_dir):
    return atoms(spark, sf_dir).where("ball_id % 5 <> 0").withColumn("chain", (F.col("chain") + 3) % 10)


@query(
    f"WITH {ATOMS}, {OTHER}, n AS (SELECT a.chain, o.chain AS other, count(*) AS shared FROM (SELECT DISTINCT chain, res_seq, name FROM a) a JOIN (SELECT DISTINCT chain, res_seq, name FROM o) o USING (res_seq, name) GROUP BY 1, 2), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY shared DESC, other) AS k FROM n) SELECT chain, other, shared FROM k WHERE k = 1"
)
def chain_map_inference(spark, sf_dir):
    return M.chain_map(atoms(spark, sf_dir), _other(spark, sf_dir), ["res_seq", "name"])


@query(
    f"WITH {ATOMS}, {OTHER}, e AS (SELECT a.ball_id, min(o.ball_id) AS other FROM a JOIN o USING (chain, res_seq, name) GROUP BY 1), u AS (SELECT res_seq, name, min(ball_id) AS other FROM o GROUP BY 1, 2 HAVING count(*) = 1) "
    "SELECT a.ball_id, coalesce(e.other, u.other) AS other, CASE WHEN e.other IS NOT NULL THEN 'exact' WHEN u.other IS NOT NULL THEN 'relaxed' END AS matched_by FROM a LEFT JOIN e USING (ball_id) LEFT JOIN u ON u.res_seq = a.res_seq AND u.name = a.name"
)
def atom_identity_match(spark, sf_dir):
    return M.match_atoms(atoms(spark, sf_dir), _other(spark, sf_dir), ["res_seq", "name"])


@query(
    f"WITH {ATOMS}, n AS (SELECT a.ball_id, arg_min(c.ball_id, sqrt((a.x - c.x - 0.01) ** 2 + (a.y - c.y) ** 2 + (a.z - c.z) ** 2)) AS other FROM a JOIN a c ON sqrt((a.x - c.x - 0.01) ** 2 + (a.y - c.y) ** 2 + (a.z - c.z) ** 2) <= 0.05 GROUP BY 1) "
    "SELECT a.ball_id, n.other, CASE WHEN n.other IS NOT NULL THEN 'nearest' END AS matched_by FROM a LEFT JOIN n USING (ball_id)"
)
def log_system_map(spark, sf_dir):
    """Atoms whose names say nothing, found again by their places, which are off by a little."""
    a = atoms(spark, sf_dir).withColumn("name", F.concat(F.lit("?"), F.col("ball_id").cast("string")))
    b = atoms(spark, sf_dir).withColumn("x", F.col("x") + 0.01)
    both = a.select((2 * F.col("ball_id")).alias("ball_id"), "x", "y", "z", "rad").union(b.select(2 * F.col("ball_id") + 1, "x", "y", "z", "rad"))
    p = spatial.both_ways(spatial.pairs_within(both, 0.05).withColumn("gap", F.lit(0.0)))
    near = p.where("ball_id % 2 = 0 AND other % 2 = 1").select((F.col("ball_id") / 2).cast("long").alias("ball_id"), ((F.col("other") - 1) / 2).cast("long").alias("other"), "d")
    return M.match_atoms(a, b, ["res_seq", "name"], near)


@query("WITH a AS (SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_tax < 0.05), b AS (SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_tax > 0.03) SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def compare_tables(spark, sf_dir):
    l = items(spark, sf_dir)
    names = ["l_suppkey", "l_linenumber", "l_returnflag"]
    return M.table_differences(l.where("l_tax < 0.05").select(*names), l.where("l_tax > 0.03").select(*names))


SOLVES = (
    "a AS (SELECT l_partkey % 50 AS f0, l_suppkey AS f1, sum(l_quantity) AS area, sum(l_discount) AS curv FROM lineitem GROUP BY 1, 2), "
    "b AS (SELECT l_partkey % 50 AS f0, l_suppkey AS f1, sum(l_quantity) AS area, sum(l_discount) + CASE WHEN l_suppkey % 3 = 0 THEN 0.5 ELSE 0 END AS curv FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1, 2 UNION ALL SELECT 60, 1, 1.0, 1.0)"
)


def _solves(spark, sf_dir):
    l = items(spark, sf_dir).groupBy((F.col("l_partkey") % 50).alias("f0"), F.col("l_suppkey").alias("f1"))
    a = l.agg(F.sum("l_quantity").alias("area"), F.sum("l_discount").alias("curv"))
    b = a.where("f1 % 10 <> 0").withColumn("curv", F.col("curv") + F.when(F.col("f1") % 3 == 0, 0.5).otherwise(0.0))
    return a, b.union(spark.createDataFrame([(60, 1, 1.0, 1.0)], "f0 long, f1 long, area double, curv double"))


@query(
    f"WITH {SOLVES} SELECT f0, f1, CASE WHEN a.area IS NULL THEN 'added' WHEN b.area IS NULL THEN 'removed' WHEN greatest(abs(a.area - b.area), abs(a.curv - b.curv)) > 1e-6 THEN 'changed' ELSE 'same' END AS state, "
    "CASE WHEN a.area IS NOT NULL AND b.area IS NOT NULL THEN round(greatest(abs(a.area - b.area), abs(a.curv - b.curv), 0.0), 6) END AS off FROM a FULL JOIN b USING (f0, f1)"
)
def compare_solves(spark, sf_dir):
    a, b = _solves(spark, sf_dir)
    return r6(M.compare_keyed(a, b, ["f0", "f1"], ["area", "curv"], 1e-6))


@query(f"WITH {SOLVES}, u AS (SELECT coalesce(a.f0, b.f0) AS f0, unnest(['area', 'curv']) AS metric, unnest([a.area, a.curv]) AS va, unnest([b.area, b.curv]) AS vb FROM a JOIN b ON a.f0 = b.f0 AND a.f1 = b.f1) SELECT f0, metric, count(*) AS n, round(sum(va), 4) AS pow, round(sum(vb), 4) AS aw, round(100 * (sum(vb) - sum(va)) / sum(va), 4) AS pct FROM u GROUP BY 1, 2")
def power_aw_compare(spark, sf_dir):
    """Metrics of two schemes side by side, in rows."""
    a, b = _solves(spark, sf_dir)
    names = ["area", "curv"]
    j = a.join(b.select("f0", "f1", *[F.col(c).alias(f"b_{c}") for c in names]), ["f0", "f1"])
    rows = j.select("f0", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("va"), F.col(f"b_{c}").alias("vb")) for c in names])).alias("x")).select("f0", "x.*")
    va, vb = F.sum("va"), F.sum("vb")
    return rows.groupBy("f0", "metric").agg(F.count("*").alias("n"), F.round(va, 4).alias("pow"), F.round(vb, 4).alias("aw"), F.round(F.try_divide(100 * (vb - va), va), 4).alias("pct"))


@query(f"WITH {ATOMS}, p AS (SELECT ball_id, rad + CASE WHEN name = 'SE' THEN 0.1 ELSE 0 END AS r FROM a WHERE chain <> 4) SELECT a.ball_id, CASE WHEN p.r IS NULL THEN 'removed' WHEN abs(a.rad - p.r) > 1e-6 THEN 'changed' ELSE 'same' END AS state, round(abs(a.rad - p.r), 6) AS off FROM a LEFT JOIN p USING (ball_id)")
def radii_audit(spark, sf_dir):
    """Radii as loaded against radii as analysed."""
    a = atoms(spark, sf_dir)
    b = a.where("chain <> 4").withColumn("rad", F.col("rad") + F.when(F.col("name") == "SE", 0.1).otherwise(0.0))
    return r6(M.compare_keyed(a, b, ["ball_id"], ["rad"], 1e-6))


BONDS = (
    "w AS (SELECT x.ball_id AS a_id, y.ball_id AS b_id FROM a x JOIN a y ON x.chain = y.chain AND x.res_seq = y.res_seq AND (x.name, y.name) IN (('N', 'CA'), ('CA', 'C'), ('C', 'O'), ('C', 'OXT'), ('CA', 'CB')) "
    "UNION SELECT x.ball_id, y.ball_id FROM a x JOIN a y ON x.chain = y.chain AND y.res_seq = x.res_seq + 1 AND x.name = 'C' AND y.name = 'N'), bonds AS (SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id FROM w)"
)


@query(f"WITH {ATOMS}, {BONDS} SELECT a_id, b_id FROM bonds")
def covalent_bonds(spark, sf_dir):
    return M.backbone_bonds(atoms(spark, sf_dir))


@query(f"WITH {ATOMS}, {BONDS} SELECT CASE WHEN k.a_id IS NULL THEN 'noncovalent' ELSE 'covalent' END AS kind, count(*) AS n FROM a x JOIN a y ON x.chain = y.chain AND x.res_seq = y.res_seq AND x.ball_id < y.ball_id LEFT JOIN bonds k ON k.a_id = x.ball_id AND k.b_id = y.ball_id GROUP BY 1")
def same_group_pair_class(spark, sf_dir):
    a = atoms(spark, sf_dir)
    p = a.select("chain", "res_seq", F.col("ball_id").alias("a_id")).join(a.select("chain", "res_seq", F.col("ball_id").alias("b_id")), ["chain", "res_seq"]).where("a_id < b_id")
    bonds = M.backbone_bonds(a).withColumn("bond", F.lit(True))
    return p.join(bonds, ["a_id", "b_id"], "left").groupBy(F.when(F.col("bond"), "covalent").otherwise("noncovalent").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n, round(sum(l_quantity), 4) AS area FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def interface_reconstruct(spark, sf_dir):
    """Pairs without direction, with the areas of all surfaces between them."""
    l = items(spark, sf_dir).where("l_partkey <> l_suppkey")
    return l.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("area"))


@query(f"WITH {KEYS} SELECT DISTINCT b0, b1, b2, b3 FROM (SELECT * FROM v WHERE b0 < 30 UNION ALL SELECT * FROM v WHERE b0 >= 20)")
def combine_subnets(spark, sf_dir):
    v = keys(spark, sf_dir)
    return v.where("b0 < 30").unionByName(v.where("b0 >= 20")).dropDuplicates(["b0", "b1", "b2", "b3"])


@query(
    f"WITH {base()}, l1 AS (SELECT *, (x > (SELECT median(x) FROM b))::INTEGER AS p FROM b), m2 AS (SELECT p, median(y) AS m FROM l1 GROUP BY p), l2 AS (SELECT ball_id, z, 2 * l1.p + (y > m)::INTEGER AS p FROM l1 JOIN m2 ON m2.p = l1.p), m3 AS (SELECT p, median(z) AS m FROM l2 GROUP BY p) "
    "SELECT ball_id, 2 * l2.p + (z > m)::INTEGER AS box FROM l2 JOIN m3 ON m3.p = l2.p"
)
def box_division(spark, sf_dir):
    return M.divide_box(balls(spark, sf_dir), 3).select("ball_id", "box")


@query("WITH s AS (SELECT DISTINCT o_custkey * 10 + 5 AS v FROM orders), l AS (SELECT l_partkey AS v FROM lineitem) SELECT s.v, (SELECT count(*) FROM l WHERE l.v < s.v) AS place FROM s")
def sorted_search(spark, sf_dir):
    """Where each asked value would go in the sorted list."""
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 10 + 5).alias("v")).distinct()
    return M.insertion_points(items(spark, sf_dir).select(F.col("l_partkey").alias("v")), asked, "v")


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_returnflag || l_linestatus) = 1 AS consistent FROM lineitem GROUP BY 1")
def shared_results_collection(spark, sf_dir):
    return M.single_context(items(spark, sf_dir), "l_suppkey", ["l_returnflag", "l_linestatus"])


@query(
    f"WITH {KEYS}, s AS (SELECT [b0, b1, b2, b3] AS ids FROM v UNION SELECT [b0, b1, b2] FROM v WHERE b0 % 3 <> 0 UNION SELECT [b0, b1] FROM v), f AS (SELECT unnest([ids[2:4], [ids[1], ids[3], ids[4]], [ids[1], ids[2], ids[4]], ids[1:3]]) AS face FROM s WHERE len(ids) = 4 UNION "
    "SELECT unnest([ids[2:3], [ids[1], ids[3]], ids[1:2]]) FROM s WHERE len(ids) = 3 UNION SELECT unnest([[ids[1]], [ids[2]]]) FROM s WHERE len(ids) = 2) SELECT len(face)::INTEGER AS size, count(*) AS n FROM f WHERE face NOT IN (SELECT ids FROM s) GROUP BY 1"
)
def closure_gaps(spark, sf_dir):
    """Faces that a set of simplices lacks."""
    v = keys(spark, sf_dir)
    s = v.select(F.array("b0", "b1", "b2", "b3").alias("ids")).union(v.where("b0 % 3 <> 0").select(F.array("b0", "b1", "b2"))).union(v.select(F.array("b0", "b1"))).distinct()
    return M.missing_faces(s).groupBy(F.size("face").alias("size")).agg(F.count("*").alias("n"))


@query()
def perimeter_ordering(spark, sf_dir):
    """Vertices of the faces of the power network in order around them."""
    return M.perimeters(verts(spark, sf_dir, "pow")).select("f0", "f1", F.size("loop").alias("n"))
