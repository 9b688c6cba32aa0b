"""Voronoi networks of balls: vertices from whole cells; edges, surfaces and duals by exploding their keys."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.functions import geometry as G
from cellspan.operators.curved_cells import cell_quads, curved_cells
from cellspan.operators.power_cells import cell_vertices, power_cells

SCHEMES = ("prm", "pow", "aw")


def solve(four: DataFrame, scheme: str) -> DataFrame:
    """Adds (x, y, z, rad) of the point at equal distance of the four balls p0 .. p3: plain distance (prm), power, whose
    value is rad (pow), or distance to the surfaces (aw, up to two rows). Balls in one plane give no row."""
    p = [G.point(f"p{k}") for k in range(4)]
    r = [F.col(f"p{k}_rad") for k in range(4)]
    rows = [G.sub(p[k], p[0]) for k in (1, 2, 3)]
    own = lambda k: G.dot(p[k], p[k]) - (r[k] * r[k] if scheme != "prm" else F.lit(0.0))
    det = G.dot(rows[0], G.cross(rows[1], rows[2]))
    inverse = [G.cross(rows[1], rows[2]), G.cross(rows[2], rows[0]), G.cross(rows[0], rows[1])]
    at = lambda c: tuple(sum((inverse[k][x] * c[k] for k in range(1, 3)), inverse[0][x] * c[0]) / F.col("det") for x in range(3))
    size = F.lit(1.0)
    for r3 in rows:
        size = size * F.sqrt(G.dot(r3, r3))
    four = four.withColumn("det", det).where(F.abs("det") > 1e-12 * size)
    const = at([(own(k) - own(0)) / 2 for k in (1, 2, 3)])
    four = four.withColumns(dict(zip(("cx", "cy", "cz"), const, strict=True)))
    c = tuple(F.col(x) for x in ("cx", "cy", "cz"))
    if scheme != "aw":
        d = G.sub(c, p[0])
        power = G.dot(d, d) - (r[0] * r[0] if scheme == "pow" else F.lit(0.0))
        return four.withColumn("rad", power if scheme == "pow" else F.sqrt(power)).withColumns(dict(zip("xyz", c, strict=True)))
    # |x - p| = R + r for each: x = c + R * s, then one quadratic in R
    slope = at([r[0] - r[k] for k in (1, 2, 3)])
    four = four.withColumns(dict(zip(("sx", "sy", "sz"), slope, strict=True)))
    s, d = tuple(F.col(x) for x in ("sx", "sy", "sz")), G.sub(c, p[0])
    qa, qb, qc = G.dot(s, s) - 1, 2 * (G.dot(s, d) - r[0]), G.dot(d, d) - r[0] * r[0]
    four = four.withColumns({"qa": qa, "qb": qb, "qc": qc}).withColumn("disc", F.col("qb") * F.col("qb") - 4 * F.col("qa") * F.col("qc")).where("disc >= 0")
    flat = F.abs("qa") < 1e-12
    root = lambda sign: (-F.col("qb") + sign * F.sqrt("disc")) / (2 * F.col("qa"))
    four = four.withColumn("rad", F.explode(F.when(flat, F.array(F.try_divide(-F.col("qc"), F.col("qb")))).otherwise(F.array(root(1), root(-1)))))
    least = F.least(*r)
    four = four.where((F.col("rad") >= -least) & F.col("rad").isNotNull())
    return four.withColumns({k: F.col(f"c{k}") + F.col("rad") * F.col(f"s{k}") for k in "xyz"})


def vertices(balls: DataFrame, scheme: str, max_vert: float) -> DataFrame:
    """(b0, b1, b2, b3, x, y, z, rad): the points at equal distance of four balls to which no other ball is nearer, the
    touching sphere (for pow, the sphere whose radius is the square root of rad) having at most max_vert as its radius."""
    if scheme not in SCHEMES:
        raise ValueError(f"scheme {scheme} is none of {', '.join(SCHEMES)}")
    if scheme == "aw":
        return cell_quads(curved_cells(balls, max_vert))
    flat = cell_vertices(power_cells(balls, scheme, max_vert))
    rad = F.col("power") if scheme == "pow" else F.sqrt(F.greatest("power", F.lit(0.0)))
    return flat.select("b0", "b1", "b2", "b3", "x", "y", "z", rad.alias("rad")).where(F.col("rad") <= (max_vert**2 if scheme == "pow" else max_vert))


def faces(verts: DataFrame, n: int) -> DataFrame:
    """Each vertex's keys of n of its four balls: columns f0 .. and the vertex's b0 .. b3."""
    keys = F.array(*[F.array(*[F.col(f"b{k}") for k in pick]) for pick in combinations(range(4), n)])
    rows = verts.select("b0", "b1", "b2", "b3", F.explode(keys).alias("f"))
    return rows.select(*[F.col("f")[k].alias(f"f{k}") for k in range(n)], "b0", "b1", "b2", "b3")


def mark_doublets(verts: DataFrame) -> DataFrame:
    """Adds dub: null, or 0 and 1 for the two vertices of the same four balls, the one nearer to rad 0 first."""
    key = W.partitionBy("b0", "b1", "b2", "b3")
    place = F.row_number().over(key.orderBy(F.abs("rad"), "rad", "x", "y", "z")) - 1
    return verts.withColumn("dub", F.when(F.count("*").over(key) > 1, place))


def _matched(places: np.ndarray, others: list[int]) -> list[tuple[int, int]]:
    """The pairs of all ends that have the least sum of distances, ends of the same fourth ball never paired; none if there
    is no such pairing. Up to 12 ends exactly, more by the shortest pair first."""
    n = len(others)
    if n % 2:
        return []
    apart = np.linalg.norm(places[:, None] - places[None], axis=2)
    fits = lambda i, j: others[i] != others[j]
    if n > 12:
        out, left = [], set(range(n))
        for _, i, j in sorted((apart[i, j], i, j) for i in range(n) for j in range(i) if fits(i, j)):
            if i in left and j in left:
                out.append((j, i))
                left -= {i, j}
        return [] if left else out
    best: dict[int, tuple[float, list]] = {0: (0.0, [])}
    for mask in range(1, 1 << n):
        i = mask.bit_length() - 1
        ways = [(best[rest][0] + apart[i, j], best[rest][1] + [(j, i)]) for j in range(i) if mask >> j & 1 and fits(i, j) and (rest := mask ^ 1 << i ^ 1 << j) in best]
        if ways:
            best[mask] = min(ways)
    return best.get((1 << n) - 1, (0.0, []))[1]


def edges(verts: DataFrame) -> DataFrame:
    """(f0, f1, f2, edge, n_ends, status) of every key of three balls with a vertex: status is edge, open (one end), or
    unpaired (an odd number, or ends that only fit their own kind); edge numbers the edges of a key that has several.

    Keys of two ends are the rule. The few with more go to their pairing of least total distance, each key by itself."""
    ends = corners(verts, 3)
    keys = ends.groupBy("f0", "f1", "f2").agg(F.count("*").alias("n_ends"), F.count_distinct("other").alias("kinds"))
    plain = keys.where("n_ends <= 2").select("f0", "f1", "f2", F.lit(0).alias("edge"), "n_ends", F.when(F.col("n_ends") == 1, "open").when(F.col("kinds") == 2, "edge").otherwise("unpaired").alias("status"))

    def pair(group):
        import pandas as pd

        group = group.sort_values(["other", "x", "y", "z"])
        got = _matched(group[["x", "y", "z"]].to_numpy(), group["other"].tolist())
        rows = [(*group.iloc[0][["f0", "f1", "f2"]].astype(int), k, len(group), "edge" if got else "unpaired") for k in range(max(1, len(got)))]
        return pd.DataFrame(rows, columns=["f0", "f1", "f2", "edge", "n_ends", "status"])

    several = ends.join(keys.where("n_ends > 2").select("f0", "f1", "f2"), ["f0", "f1", "f2"])
    return plain.union(several.groupBy("f0", "f1", "f2").applyInPandas(pair, "f0 long, f1 long, f2 long, edge int, n_ends long, status string"))


def corners(verts: DataFrame, n: int) -> DataFrame:
    """Each vertex's keys of n of its four balls, with the fourth (other; for n = 3) and its place."""
    picks = list(combinations(range(4), n))
    rest = lambda pick: F.col(f"b{next(k for k in range(4) if k not in pick)}")
    keys = F.array(*[F.struct(*[F.col(f"b{k}").alias(f"f{i}") for i, k in enumerate(pick)], rest(pick).alias("other")) for pick in picks])
    return verts.select(F.explode(keys).alias("k"), "b0", "b1", "b2", "b3", "x", "y", "z", "rad").select("k.*", "b0", "b1", "b2", "b3", "x", "y", "z", "rad")


def surfaces(verts: DataFrame) -> DataFrame:
    """(f0, f1, n_verts, n_edges, closed): pairs of balls with a face between them; closed if its vertices are as many as
    its edges."""
    n_verts = faces(verts, 2).groupBy("f0", "f1").agg(F.count("*").alias("n_verts"))
    pairs = F.array(*[F.struct(F.col(f"f{a}").alias("p"), F.col(f"f{b}").alias("q")) for a, b in combinations(range(3), 2)])
    n_edges = edges(verts).where("status = 'edge'").select(F.explode(pairs).alias("k")).groupBy(F.col("k.p").alias("f0"), F.col("k.q").alias("f1")).agg(F.count("*").alias("n_edges"))
    out = n_verts.join(n_edges, ["f0", "f1"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("closed", F.col("n_edges") == F.col("n_verts"))


def incidence(verts: DataFrame) -> DataFrame:
    """(kind, a, b): what lies on what, as sorted arrays of ball ids: edge_vert, surf_edge, surf_vert, ball_surf, ball_edge
    and ball_vert. Surfaces and edges are named by their balls, so no numbering is needed."""
    key = lambda *c: F.array(*[F.col(x) for x in c])
    four = key("b0", "b1", "b2", "b3")
    parts = lambda names, n: F.array(*[key(*p) for p in combinations(names, n)])
    tri = edges(verts).where("status = 'edge'").select(key("f0", "f1", "f2").alias("a"), "f0", "f1", "f2").distinct()
    pairs = surfaces(verts).select(key("f0", "f1").alias("a"), "f0", "f1")
    v = verts.select(four.alias("v"), "b0", "b1", "b2", "b3").distinct()
    names = ("b0", "b1", "b2", "b3")
    ev = v.select(F.lit("edge_vert").alias("kind"), F.explode(parts(names, 3)).alias("a"), F.col("v").alias("b")).join(tri.select("a"), "a", "left_semi").select("kind", "a", "b")
    se = tri.select(F.lit("surf_edge").alias("kind"), F.explode(parts(("f0", "f1", "f2"), 2)).alias("a"), F.col("a").alias("b"))
    sv = v.select(F.lit("surf_vert").alias("kind"), F.explode(parts(names, 2)).alias("a"), F.col("v").alias("b"))
    bs = pairs.select(F.lit("ball_surf").alias("kind"), F.explode(parts(("f0", "f1"), 1)).alias("a"), F.col("a").alias("b"))
    be = tri.select(F.lit("ball_edge").alias("kind"), F.explode(parts(("f0", "f1", "f2"), 1)).alias("a"), F.col("a").alias("b"))
    bv = v.select(F.lit("ball_vert").alias("kind"), F.explode(parts(names, 1)).alias("a"), F.col("v").alias("b"))
    return ev.union(se).union(sv).union(bs).union(be).union(bv)


def cells(verts: DataFrame) -> DataFrame:
    """(ball_id, n_verts, n_edges, n_surfs, euler, status) of each ball with a vertex: V - E + F is 2 for a closed cell."""
    one = lambda df, cols, name: df.select(F.explode(F.array(*cols)).alias("ball_id")).groupBy("ball_id").agg(F.count("*").alias(name))
    out = one(verts, ["b0", "b1", "b2", "b3"], "n_verts")
    out = out.join(one(edges(verts).where("status = 'edge'"), ["f0", "f1", "f2"], "n_edges"), "ball_id", "left")
    out = out.join(one(surfaces(verts).where("closed"), ["f0", "f1"], "n_surfs"), "ball_id", "left").na.fill(0)
    euler = F.col("n_verts") - F.col("n_edges") + F.col("n_surfs")
    status = F.when((F.col("n_verts") < 3) | (F.col("n_edges") < 4) | (F.col("n_surfs") < 3), "unbounded").when(2 * F.col("n_edges") == 3 * F.col("n_verts"), "complete").otherwise("incomplete")
    return out.withColumns({"euler": euler, "status": status})


def dual_counts(verts: DataFrame) -> DataFrame:
    """Simplices of the dual by dimension: balls, pairs, triples and fours that share a vertex."""
    per = [faces(verts, n).select(*[f"f{k}" for k in range(n)]).distinct().agg(F.lit(n - 1).alias("dim"), F.count("*").alias("n")) for n in (1, 2, 3, 4)]
    out = per[0]
    for x in per[1:]:
        out = out.union(x)
    return out


def least_power(p: list, r: list) -> tuple[list, Column]:
    """The point of least power of two or three balls at which they have the same power, and that power."""
    a, power = p[0], lambda c: G.dot(G.sub(c, p[0]), G.sub(c, p[0])) - r[0] * r[0]
    u = G.sub(p[1], a)
    h = lambda q, rad: (G.dot(q, q) + r[0] * r[0] - rad * rad) / 2
    if len(p) == 2:
        t = h(u, r[1]) / G.dot(u, u)
        c = tuple(a[k] + t * u[k] for k in range(3))
    else:
        w = G.sub(p[2], a)
        uu, uw, ww, hu, hw = G.dot(u, u), G.dot(u, w), G.dot(w, w), h(u, r[1]), h(w, r[2])
        det = uu * ww - uw * uw
        s, t = (hu * ww - hw * uw) / det, (hw * uu - hu * uw) / det
        c = tuple(a[k] + s * u[k] + t * w[k] for k in range(3))
    return c, power(c)


def alpha_filtration(balls: DataFrame, verts: DataFrame) -> DataFrame:
    """(dim, ids, birth, source) of the power filtration: every simplex of the dual and the least alpha at which it is there.

    A tetrahedron is born at its vertex's power. A lower simplex is born at its own least power (source own), unless a
    ball that it has a coface with is nearer to that point; then with its first coface (source coface)."""
    spots = balls.select(F.col("ball_id").alias("id"), F.struct("x", "y", "z", "rad").alias("s"))
    simplex = verts.groupBy(F.array("b0", "b1", "b2", "b3").alias("ids")).agg(F.min("rad").alias("birth")).checkpoint()
    out = simplex.select(F.lit(3).alias("dim"), "ids", "birth", F.lit("own").alias("source"))
    for n in (3, 2, 1):
        up = simplex.select("birth", F.explode(F.array(*[F.struct(F.array(*[F.col("ids")[k] for k in range(n + 1) if k != gone]).alias("ids"), F.col("ids")[gone].alias("other")) for gone in range(n + 1)])).alias("f")).select("birth", "f.*")
        up = up.join(spots.select(F.col("id").alias("other"), F.col("s").alias("q")), "other")
        for k in range(n):
            up = up.join(spots.select(F.col("id").alias(f"i{k}"), F.col("s").alias(f"s{k}")), F.col("ids")[k] == F.col(f"i{k}"))
        p = [tuple(F.col(f"s{k}")[c] for c in "xyz") for k in range(n)]
        r = [F.col(f"s{k}")["rad"] for k in range(n)]
        c, own = (p[0], -r[0] * r[0]) if n == 1 else least_power(p, r)
        q = tuple(F.col("q")[k] for k in "xyz")
        nearer = G.dot(G.sub(c, q), G.sub(c, q)) - F.col("q")["rad"] * F.col("q")["rad"] < own - 1e-9
        per = up.groupBy("ids").agg(F.min("birth").alias("up"), F.max(nearer.cast("int")).alias("attached"), F.first(own).alias("own"))
        born = F.when(F.col("attached") == 1, F.col("up")).otherwise(F.col("own"))
        source = F.when(F.col("attached") == 1, "coface").otherwise("own")
        level = per.select("ids", born.alias("birth"), source.alias("source")).checkpoint()
        out = out.union(level.select(F.lit(n - 1).alias("dim"), "ids", "birth", "source"))
        simplex = level.select("ids", "birth")
    return out


def closure_issues(filtration: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Simplices of filtration(ids, birth) that are there before one of their faces: (ids, birth, face, face_birth)."""
    rows = filtration.where(F.size("ids") > 1).select("ids", "birth", F.explode(F.transform("ids", lambda gone: F.array_remove("ids", gone))).alias("face"))
    return rows.join(filtration.select(F.col("ids").alias("face"), F.col("birth").alias("face_birth")), "face").where(F.col("face_birth") > F.col("birth") + slack).select("ids", "birth", "face", "face_birth")


def alpha_counts(filtration: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Simplices of filtration(dim, birth) born by each alpha: (alpha, dim, n)."""
    levels = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    return filtration.select("dim", "birth", levels).groupBy("alpha", "dim").agg(F.sum((F.col("birth") <= F.col("alpha")).cast("long")).alias("n"))
