"""Joins that match one network, scheme or structure with another, and joins over a network's keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.operators.graphs import components
from cellspan.operators.network import faces


def edge_counts(keys: DataFrame) -> DataFrame:
    """(f0, f1, f2, n_ends, status) of the triples of keys(b0 .. b3): open with one vertex, edge with two, several above."""
    n = faces(keys, 3).groupBy("f0", "f1", "f2").agg(F.count("*").alias("n_ends"))
    return n.withColumn("status", F.when(F.col("n_ends") == 1, "open").when(F.col("n_ends") == 2, "edge").otherwise("several"))


def adjacency(keys: DataFrame, ids: list[str]) -> DataFrame:
    """(ball_id, n, first) over keys of balls: how many keys a ball is in, and the least of them."""
    rows = keys.select(F.explode(F.array(*ids)).alias("ball_id"), F.array(*ids).alias("k"))
    return rows.groupBy("ball_id").agg(F.count("*").alias("n"), F.min("k").alias("first"))


def unseen_quads(keys: DataFrame) -> DataFrame:
    """Four balls of which every three share a vertex, but which have none themselves. The third and fourth triple are joined
    by both of their shared balls, so a pair of triples only meets where it has an edge in common."""
    t = faces(keys, 3).select("f0", "f1", "f2").distinct()
    named = lambda *c: t.select(*[F.col(f"f{k}").alias(n) for k, n in enumerate(c)])
    four = named("b0", "b1", "b2").join(named("b0", "b1", "b3"), ["b0", "b1"]).where("b2 < b3")
    four = four.join(named("b0", "b2", "b3"), ["b0", "b2", "b3"], "left_semi").join(named("b1", "b2", "b3"), ["b1", "b2", "b3"], "left_semi")
    return four.join(keys.select("b0", "b1", "b2", "b3"), ["b0", "b1", "b2", "b3"], "left_anti").select("b0", "b1", "b2", "b3")


def with_kinds(keys: DataFrame, ids: list[str], members: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """keys with has_<kind>, a flag for each kind of members(ball_id, kind) among its balls."""
    rows = keys.select(*ids, F.explode(F.array(*ids)).alias("ball_id")).join(members, "ball_id")
    flags = rows.groupBy(*ids).agg(*[F.max(F.col("kind") == k).alias(f"has_{k}") for k in kinds])
    return keys.join(flags, ids, "left").na.fill(False, [f"has_{k}" for k in kinds])


def pair_sets(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs(f0, f1) with set: direct between the sides a and b, side_a or side_b within or at the rim of one, outside."""
    m = lambda c: members.select(F.col("ball_id").alias(c), F.col("side").alias(f"s_{c}"))
    rows = pairs.join(m("f0"), "f0", "left").join(m("f1"), "f1", "left")
    has = lambda side: F.coalesce(F.col("s_f0") == side, F.lit(False)) | F.coalesce(F.col("s_f1") == side, F.lit(False))
    kind = F.when(has("a") & has("b"), "direct").when(has("a"), "side_a").when(has("b"), "side_b").otherwise("outside")
    return rows.withColumn("set", kind).drop("s_f0", "s_f1")


def full_interface(pairs: DataFrame, triples: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surfaces and edges of the interface between sides a and b, each with a status.

    pairs(f0, f1, area, complete): direct ones are unresolved if complete is not known, excluded_incomplete if they are not,
    excluded_area_unavailable without an area, else selected. triples(f0, f1, f2, complete) with balls of both sides are
    unresolved or excluded_incomplete likewise, else by the selected surfaces they bound: nonmanifold (over two), shared,
    boundary, outside_selected_interface."""
    direct = pair_sets(pairs, members).where("set = 'direct'").drop("set")
    unknown = F.when(F.col("complete").isNull(), "unresolved").when(~F.col("complete"), "excluded_incomplete")
    surfs = direct.withColumn("status", unknown.when(F.col("area").isNull(), "excluded_area_unavailable").otherwise("selected"))
    chosen = surfs.where("status = 'selected'").select(F.array("f0", "f1").alias("pair"))
    sides = with_kinds(triples, ["f0", "f1", "f2"], members.withColumnRenamed("side", "kind"), ("a", "b")).where("has_a AND has_b")
    bounds = sides.select("f0", "f1", "f2", F.explode(F.array(*[F.array(x, y) for x, y in combinations(("f0", "f1", "f2"), 2)])).alias("pair"))
    n = bounds.join(chosen, "pair").groupBy("f0", "f1", "f2").agg(F.count("*").alias("n_selected"))
    edges = sides.join(n, ["f0", "f1", "f2"], "left").na.fill(0, ["n_selected"]).drop("has_a", "has_b")
    k = F.col("n_selected")
    edges = edges.withColumn("status", unknown.when(k > 2, "nonmanifold").when(k == 2, "shared").when(k == 1, "boundary").otherwise("outside_selected_interface"))
    return surfs, edges


def alpha_interface(pairs: DataFrame, members: DataFrame, alpha: float, slack: float = 1e-9) -> DataFrame:
    """pairs(f0, f1, birth, area, bounded, complete) between the sides that are born by alpha, with eligible: bounded, complete
    and of known area."""
    born = pair_sets(pairs, members).where((F.col("set") == "direct") & (F.col("birth") <= alpha + slack)).drop("set")
    return born.withColumn("eligible", F.coalesce(F.col("bounded") & F.col("complete") & F.col("area").isNotNull(), F.lit(False)))


def surface_parts(edges: DataFrame) -> DataFrame:
    """(surface, component) of surfaces joined by shared edges: edges(f0, f1, f2, s0, s1), s0 and s1 the two surfaces."""
    return components(edges.select(F.col("s0").alias("a"), F.col("s1").alias("b")))


def neighbor_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Of two schemes' neighbours(key, other), by key: state, n_a, n_b, n_both, jaccard (null if neither has one)."""
    both = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), [key, "other"], "full")
    out = both.groupBy(key).agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1).otherwise(0)).alias("n_both"), F.count("*").alias("every"))
    state = F.when(F.col("n_b") == 0, "only_a").when(F.col("n_a") == 0, "only_b").otherwise("both")
    return out.select(key, state.alias("state"), "n_a", "n_b", "n_both", (F.col("n_both") / F.col("every")).alias("jaccard"))


def scheme_differences(a: DataFrame, b: DataFrame, key: str, values: list[str], cut: float = 25.0) -> DataFrame:
    """One row for each value: n, outliers (the relative difference (b - a) / a is above cut, on that side only), mean and mean
    size of the differences of the rest."""
    rows = a.select(key, *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select(key, *[F.col(v).alias(f"b_{v}") for v in values]), key)
    diff = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.try_divide(F.col(f"b_{v}") - F.col(f"a_{v}"), F.col(f"a_{v}")).alias("d")) for v in values])).alias("x")
    kept = F.when(F.col("d") <= cut, F.col("d"))
    return rows.select(diff).select("x.*").groupBy("value").agg(
        F.count("d").alias("n"), F.sum((F.col("d") > cut).cast("long")).alias("outliers"), F.avg(kept).alias("mean"), F.avg(F.abs(kept)).alias("mean_size")
    )


def chain_map(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    """(chain, other, shared): for each chain of a the chain of b that has most of its atoms by identity; ties by name. Chains
    only meet where they share an atom."""
    left = a.select("chain", *identity).distinct()
    right = b.select(F.col("chain").alias("other"), *identity).distinct()
    n = left.join(right, identity).groupBy("chain", "other").agg(F.count("*").alias("shared"))
    best = F.row_number().over(W.partitionBy("chain").orderBy(F.desc("shared"), "other"))
    return n.withColumn("k", best).where("k = 1").drop("k")


def match_atoms(a: DataFrame, b: DataFrame, identity: list[str], near: DataFrame | None = None) -> DataFrame:
    """(ball_id, other, matched_by) for every atom of a: by the chain and identity (exact), by identity alone where that is one atom of
    b (relaxed), by place, near(ball_id, other, d) being candidates (nearest), else null."""
    exact = a.join(b.select(F.col("ball_id").alias("other"), "chain", *identity), ["chain", *identity]).groupBy("ball_id").agg(F.min("other").alias("exact"))
    alone = b.groupBy(*identity).agg(F.count("*").alias("n"), F.min("ball_id").alias("relaxed")).where("n = 1").drop("n")
    out = a.join(exact, "ball_id", "left").join(alone, identity, "left")
    if near is not None:
        out = out.join(near.groupBy("ball_id").agg(F.min_by("other", F.struct("d", "other")).alias("nearest")), "ball_id", "left")
    else:
        out = out.withColumn("nearest", F.lit(None).cast("long"))
    by = F.when(F.col("exact").isNotNull(), "exact").when(F.col("relaxed").isNotNull(), "relaxed").when(F.col("nearest").isNotNull(), "nearest")
    return out.select("ball_id", F.coalesce("exact", "relaxed", "nearest").alias("other"), by.alias("matched_by"))


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of two tables, with side: every repeat counts."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def compare_keyed(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float) -> DataFrame:
    """(key, state, off): added, removed, changed (a value is off by more than tolerance, or known on one side only) or same;
    off is the largest difference."""
    side = lambda df, c: df.select(*key, F.lit(True).alias(f"in_{c}"), *[F.col(v).alias(f"{c}_{v}") for v in values])
    rows = side(a, "a").join(side(b, "b"), key, "full")
    off = F.greatest(*[F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values], F.lit(0.0))
    torn = F.lit(False)
    for v in values:
        torn = torn | (F.col(f"a_{v}").isNull() != F.col(f"b_{v}").isNull())
    both = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(torn | (off > tolerance), "changed").otherwise("same")
    return rows.select(*key, both.alias("state"), F.when(F.col("in_a") & F.col("in_b"), off).alias("off"))


#: Heavy-atom bonds within every amino acid.
BACKBONE_BONDS = (("N", "CA"), ("CA", "C"), ("C", "O"), ("C", "OXT"), ("CA", "CB"))


def backbone_bonds(atoms: DataFrame, bonds: tuple[tuple[str, str], ...] = BACKBONE_BONDS) -> DataFrame:
    """(a_id, b_id), a_id < b_id: bonds of the template within residues, and from each residue's C to the N of the next of its
    chain."""
    side = lambda c: atoms.select("chain", "res_seq", F.col("ball_id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    pick = lambda pairs: F.struct("a_name", "b_name").isin(*[F.struct(F.lit(x), F.lit(y)) for x, y in pairs])
    within = side("a").join(side("b"), ["chain", "res_seq"]).where(pick(bonds))
    following = side("b").withColumn("res_seq", F.col("res_seq") - 1)
    across = side("a").where("a_name = 'C'").join(following.where("b_name = 'N'"), ["chain", "res_seq"])
    rows = within.select("a_id", "b_id").union(across.select("a_id", "b_id"))
    return rows.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()


def perimeters(verts: DataFrame) -> DataFrame:
    """(f0, f1, loop): the vertices of each closed face, as arrays of their balls, in order around it, from the least on,
    towards the lesser neighbour. Faces that make no single loop have none."""
    import pandas as pd

    ids = ("b0", "b1", "b2", "b3")
    pick = list(combinations(range(4), 2))
    one = F.array(*[F.struct(F.col(ids[i]).alias("f0"), F.col(ids[j]).alias("f1")) for i, j in pick])
    rows = verts.select(*ids, F.explode(one).alias("f")).select("f.f0", "f.f1", *ids)

    def walk(corners: list[tuple]) -> list[tuple]:
        f0, f1 = corners[0][:2]
        four = sorted({c[2:] for c in corners})
        by_third: dict[int, list] = {}
        for v in four:
            for x in set(v) - {f0, f1}:
                by_third.setdefault(x, []).append(v)
        if len(four) < 3 or any(len(x) != 2 for x in by_third.values()):
            return []
        near = {v: sorted(w for x in set(v) - {f0, f1} for w in by_third[x] if w != v) for v in four}
        loop, now = [four[0]], near[four[0]][0]
        while now != four[0]:
            loop.append(now)
            now = next(w for w in near[now] if w != loop[-2])
        return loop if len(loop) == len(four) else []

    def several(group: pd.DataFrame) -> pd.DataFrame:
        faces_: dict[tuple, list] = {}
        for r in group[["f0", "f1", *ids]].itertuples(index=False):
            faces_.setdefault((int(r[0]), int(r[1])), []).append(tuple(map(int, r)))
        done = [(f0, f1, [list(v) for v in loop]) for (f0, f1), c in faces_.items() if (loop := walk(c))]
        return pd.DataFrame(done, columns=["f0", "f1", "loop"])

    # whole faces by hash, some hundreds a group, so that a face is not a call of its own
    groups = rows.count() // 5000 + 1
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("f0", "f1"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(several, "f0 long, f1 long, loop array<array<long>>")


def insertion_points(values: DataFrame, asked: DataFrame, value: str) -> DataFrame:
    """asked(value) with place, the number of values that are less: where a sorted list of them would take it."""
    from cellspan.operators.analysis import running_counts

    steps = running_counts(values.select(value), [], value).select(F.col(value).alias("v"), "__before", "__n")
    exact = asked.join(steps.select(F.col("v").alias(value), F.col("__before").alias("place")), value, "left")
    # a value that is not there takes the place after the greatest one below it: found in a ranged union with the steps
    ranged = asked.select(F.col(value).alias("v"), F.lit(None).cast("long").alias("after")).union(steps.select("v", F.col("__before") + F.col("__n"))).distinct()
    parts = ranged.repartitionByRange("v").withColumn("part", F.spark_partition_id()).checkpoint()
    most = parts.groupBy("part").agg(F.max("after").alias("most"))
    ahead = most.select("part", F.coalesce(F.max("most").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    below = F.max("after").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, -1))
    filled = parts.withColumn("below", below).join(F.broadcast(ahead), "part").where("after IS NULL").select(F.col("v").alias(value), F.coalesce("below", "ahead").alias("gap"))
    return exact.join(filled, value, "left").select(value, F.coalesce("place", "gap").alias("place"))


def divide_box(balls: DataFrame, levels: int) -> DataFrame:
    """balls with box: halved at the median of x, y, z in turn, `levels` times; a bit a level, 1 above the median."""
    from cellspan.operators.analysis import quantiles

    out = balls.withColumn("box", F.lit(0))
    for k in range(levels):
        c = "xyz"[k % 3]
        middle = quantiles(out, ["box"], c, {"__middle": 0.5})
        out = out.join(middle, "box").withColumn("box", 2 * F.col("box") + (F.col(c) > F.col("__middle")).cast("int")).drop("__middle")
    return out


def single_context(results: DataFrame, group: str, context: list[str]) -> DataFrame:
    """(group, n, consistent): whether all results of a group come from the same context."""
    return results.groupBy(group).agg(F.count("*").alias("n"), (F.count_distinct(F.struct(*context)) == 1).alias("consistent"))


def missing_faces(simplices: DataFrame) -> DataFrame:
    """(face) of simplices(ids) that are not there themselves, ids being sorted arrays of two balls or more."""
    every = simplices.where(F.size("ids") > 1).select(F.explode(F.transform("ids", lambda gone: F.array_remove("ids", gone))).alias("ids")).distinct()
    return every.join(simplices, "ids", "left_anti").select(F.col("ids").alias("face"))

