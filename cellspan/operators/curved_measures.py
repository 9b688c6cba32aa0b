"""Measures of curved cells: integrals along edges, areas and volumes, angular defects at vertices, and the Gauss-Bonnet sum of
every cell.

An edge is x = p + u / (a . u + b), u running along a circle of directions from the centre p of its first ball. Integrals are Gauss
sums over intervals that are halved, in rounds, until halves and whole agree; edges are summed as arrays, many at once.

A face is a sheet of a hyperboloid around the line of its balls' centres. Area and volume between that line and a direction have
closed forms, so by Stokes a face's area, and the volume of the cone from a ball to it, are integrals along the face's edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.functions import geometry as G
from cellspan.operators.spatial import dealt

KEY = ["b0", "b1", "b2", "start"]
PAIRS = ((0, 1), (0, 2), (1, 2))
SUMS = ("length", "turning", "turning_sq", "m0", "m1", "m2", "g01", "g02", "g12", "k01", "k02", "k12", "a01", "a02", "a12", "v01", "v10", "v02", "v20", "v12", "v21")
NODES = 10


def _put(name: str, v: G.Vec) -> dict[str, Column]:
    return {f"{name}_{c}": x for c, x in zip("xyz", v, strict=True)}


def _mix(*terms: tuple[Column, G.Vec]) -> G.Vec:
    """The sum of vectors times factors."""
    return tuple(sum((k * v[c] for k, v in terms[1:]), terms[0][0] * terms[0][1][c]) for c in range(3))


def _norm(v: G.Vec) -> Column:
    return F.sqrt(G.dot(v, v))


Vec = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sum(*terms: tuple[np.ndarray | float, Vec]) -> Vec:
    """The sum of vectors of arrays times factors."""
    return tuple(sum((k * v[c] for k, v in terms[1:]), terms[0][0] * terms[0][1][c]) for c in range(3))


def _size(v: Vec) -> np.ndarray:
    return np.sqrt(G.dot(v, v))


def sheet_area(a: np.ndarray, b: np.ndarray, far: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Area of the sheet at distance 1 / (a z + b) from the ball, from its axis out to z (a cosine), per radian around the axis and
    divided by 1 - z * z; far is the distance at z. Differences are taken apart by hand, so nothing cancels near the axis."""
    g = np.sqrt((a - b) * (a + b))
    y = g * g * far + b
    s = np.sqrt(np.maximum(y * y - b * b, 0.0))
    slope = (y + a) / (s + g)
    q = (1 + slope) / (a + g)
    grown = (y - a) * q
    small = np.abs(grown) < 1e-7
    log = q * np.where(small, 1 - grown / 2, np.log1p(grown) / np.where(small, 1.0, grown))
    return (s + a * slope - b * b * log) * far / (2 * g * (a + b) * (1 + z))


def cone_volume(a: np.ndarray, b: np.ndarray, far: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The same for the volume between the ball's centre and the sheet."""
    return (a + b + 1 / far) * far * far / (6 * (a + b) * (a + b) * (1 + z))


def integrands(e: dict[str, np.ndarray], t: np.ndarray) -> np.ndarray:
    """At angles t, a row of them for each edge of e (vectors in three columns, balls' places as p0 .. p2), the SUMS per unit of t:
    length, turning and squared curvature; half the angle between the two faces' normals for each ball's cell (m); and for each
    face geodesic curvature towards its inside (g), the area its normals sweep on the unit sphere (k), its own area (a) and the
    volumes of the cones from either ball to it (v)."""
    at = {c: tuple(v[:, q, None] for q in range(3)) for c, v in e.items() if v.ndim == 2}
    p = [at[f"p{i}"] for i in range(3)]
    cos, sin = np.cos(t), np.sin(t)
    w, du = _sum((cos, at["e1"]), (sin, at["e2"])), _sum((cos, at["e2"]), (-sin, at["e1"]))
    u = _sum((1.0, at["middle"]), (1.0, w))
    k, dk, ddk = G.dot(at["a"], u) + e["b"][:, None], G.dot(at["a"], du), -G.dot(at["a"], w)
    d = _sum((1 / k, du), (-dk / (k * k), u))
    dd = _sum((-1 / k, w), (-2 * dk / (k * k), du), (2 * dk * dk / (k * k * k) - ddk / (k * k), u))
    x, speed = _sum((1.0, p[0]), (1 / k, u)), _size(d)
    away = [G.sub(x, p[i]) for i in range(3)]
    far = [_size(v) for v in away]
    r = [_sum((1 / f, v)) for f, v in zip(far, away, strict=True)]
    dr = [_sum((1 / far[i], d), (-G.dot(r[i], d) / far[i], r[i])) for i in range(3)]
    apart = {(i, j): G.sub(r[i], r[j]) for i, j in PAIRS}
    long = {ij: _size(v) for ij, v in apart.items()}
    n = {ij: _sum((1 / long[ij], v)) for ij, v in apart.items()}
    normal = lambda i, j: n[i, j] if i < j else tuple(-c for c in n[j, i])
    bend = _size(G.cross(d, dd))
    out = {"length": speed, "turning": bend / (speed * speed), "turning_sq": bend * bend / speed**5}
    for i in range(3):
        v, m = (normal(i, j) for j in range(3) if j != i)
        out[f"m{i}"] = np.arctan2(_size(G.cross(v, m)), G.dot(v, m)) * speed / 2
    for i, j in PAIRS:
        third, v = 3 - i - j, n[i, j]
        # the inside of a face lies away from the third ball
        side = -np.sign(G.dot(G.cross(v, d), normal(i, third)))
        axis = G.sub(p[j], p[i])
        between = _size(axis)
        axis = _sum((1 / between, axis))
        wider = far[j] - far[i]
        over = 2 / ((between - wider) * (between + wider))
        steep, shift = between * over, wider * over
        sweep = G.dot(G.cross(v, G.sub(dr[i], dr[j])), axis) / (long[i, j] * (1 + G.dot(v, axis)))
        out |= {f"g{i}{j}": side * G.dot(dd, G.cross(v, d)) / (speed * speed), f"k{i}{j}": side * sweep}
        for m, (o, sign) in {i: (j, 1), j: (i, -1)}.items():
            turn, z = side * G.dot(axis, G.cross(r[m], dr[m])), sign * G.dot(axis, r[m])
            out[f"v{m}{o}"] = turn * cone_volume(steep, sign * shift, far[m], z)
            if m == i:
                out[f"a{i}{j}"] = turn * sheet_area(steep, shift, far[i], z)
    return np.stack([out[c] for c in SUMS], axis=2)


def integrals(e: dict[str, np.ndarray], tolerance: float, rounds: int, step: int = 500) -> np.ndarray:
    """The SUMS of each edge of e, a row each, from start to stop. An interval is accepted if the Gauss sum over both halves and that
    over the whole differ by tolerance at most (absolute, or relative to sums above 1), else its halves are looked at in turn; after
    that many rounds all are accepted."""
    places, weights = np.polynomial.legendre.leggauss(NODES)
    total = np.zeros((len(e["start"]), len(SUMS)))

    def over(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        t = lo[:, None] + (places + 1) / 2 * (hi - lo)[:, None]
        return np.einsum("ntc,t->nc", integrands({c: v[of] for c, v in e.items()}, t), weights / 2) * (hi - lo)[:, None]

    for at in range(0, len(total), step):
        of = np.arange(at, min(at + step, len(total)))
        stack = [(of, e["start"][of], e["stop"][of], over(of, e["start"][of], e["stop"][of]), 1)]
        while stack:
            of, lo, hi, whole, turn = stack.pop()
            middle = (lo + hi) / 2
            first, last = over(of, lo, middle), over(of, middle, hi)
            both = first + last
            done = (np.abs(both - whole) / np.maximum(np.abs(both), 1.0)).max(1) <= tolerance if turn < rounds else np.ones(len(of), bool)
            np.add.at(total, of[done], both[done])
            left = np.flatnonzero(~done)
            for part in (left[q : q + step] for q in range(0, len(left), step)):
                stack.append((of[part], lo[part], middle[part], first[part], turn + 1))
                stack.append((of[part], middle[part], hi[part], last[part], turn + 1))
    return total


def edge_integrals(edges: DataFrame, balls: DataFrame, tolerance: float = 1e-9, rounds: int = 30) -> DataFrame:
    """(b0, b1, b2, start, end0, end1, closed and the SUMS) of each edge of curved_cells.cell_edges(), kept. Edges get their balls'
    places by joins; each is then summed where it is, as arrays, so no interval or node is a row."""
    held = edges
    for k in range(3):
        held = held.join(balls.select(F.col("ball_id").alias(f"b{k}"), F.struct("x", "y", "z").alias(f"p{k}")), f"b{k}")
    held = held.checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c) for c in batch.schema.names}
            of = lambda v: np.column_stack([v.field(c).to_numpy(zero_copy_only=False) for c in "xyz"]).astype(float)
            e = {c: of(at[c]) for c in ("middle", "e1", "e2", "a", "p0", "p1", "p2")} | {c: at[c].to_numpy(zero_copy_only=False) for c in ("start", "stop", "b")}
            with np.errstate(all="ignore"):
                sums = integrals(e, tolerance, rounds)
            yield pa.RecordBatch.from_arrays([*[at[c] for c in names], *map(pa.array, sums.T)], [*names, *SUMS])

    names = [*KEY, "end0", "end1", "closed"]
    kinds = dict(held.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + [f"{c} double" for c in SUMS])
    return dealt(held, held.count(), "b0", 2000).mapInArrow(run, schema).checkpoint()


def vertex_defects(verts: DataFrame, balls: DataFrame) -> DataFrame:
    """(b0 .. b3, rad, ball_id, defect): at each vertex, for each of its four cells, 2 pi less the angles of the cell's three faces.
    Near the vertex a cell is where three planes' insides meet; a face's angle lies between its edges with the two others."""
    rows = verts.select("b0", "b1", "b2", "b3", "rad", "x", "y", "z")
    for k in range(4):
        rows = rows.join(balls.select(F.col("ball_id").alias(f"b{k}"), *[F.col(c).alias(f"p{k}_{c}") for c in "xyz"]), f"b{k}")
        away = G.sub(tuple(F.col(c) for c in "xyz"), G.point(f"p{k}"))
        rows = rows.withColumns(_put(f"r{k}", _mix((1 / _norm(away), away))))
    cells = []
    for i in range(4):
        others = [j for j in range(4) if j != i]
        cells.append(F.struct(F.col(f"b{i}").alias("ball_id"), *[x.alias(f"n{m}_{c}") for m, j in enumerate(others) for c, x in zip("xyz", G.sub(G.point(f"r{i}"), G.point(f"r{j}")), strict=True)]))
    rows = rows.select("b0", "b1", "b2", "b3", "rad", F.explode(F.array(*cells)).alias("cell")).select("b0", "b1", "b2", "b3", "rad", "cell.*")
    n = [G.point(f"n{k}") for k in range(3)]
    for k in range(3):
        way = G.cross(n[(k + 1) % 3], n[(k + 2) % 3])  # the edge of the faces other than k, pointing to k's inside
        rows = rows.withColumns(_put(f"w{k}", _mix((-F.signum(G.dot(way, n[k])), way))))
    angle = lambda a, b: F.atan2(_norm(G.cross(a, b)), G.dot(a, b))
    w = [G.point(f"w{k}") for k in range(3)]
    return rows.select("b0", "b1", "b2", "b3", "rad", "ball_id", (2 * np.pi - angle(w[0], w[1]) - angle(w[0], w[2]) - angle(w[1], w[2])).alias("defect"))


def by_ball(integrals: DataFrame) -> DataFrame:
    """(b0, b1, b2, start, ball_id, length, m, g): an edge's shares in each of its three cells."""
    of = [
        F.struct(F.col(f"b{i}").alias("ball_id"), F.col(f"m{i}").alias("m"), sum((F.col(f"g{p}{q}") for p, q in PAIRS if i in (p, q)), F.lit(0.0)).alias("g"))
        for i in range(3)
    ]
    return integrals.select(*KEY, "length", F.explode(F.array(*of)).alias("e")).select(*KEY, "e.ball_id", "length", "e.m", "e.g")


def by_face(integrals: DataFrame) -> DataFrame:
    """(f0, f1, n_edges, boundary, geodesic, gauss): of each face the edges around it, their length, their geodesic curvature
    towards the face, and the integral of the face's own Gaussian curvature, which is the area its normals cover."""
    of = [F.struct(F.col(f"b{i}").alias("f0"), F.col(f"b{j}").alias("f1"), F.col(f"g{i}{j}").alias("g"), F.col(f"k{i}{j}").alias("k")) for i, j in PAIRS]
    rows = integrals.select("length", F.explode(F.array(*of)).alias("f"))
    return rows.groupBy("f.f0", "f.f1").agg(F.count("*").alias("n_edges"), F.sum("length").alias("boundary"), F.sum("f.g").alias("geodesic"), F.sum("f.k").alias("gauss"))


def gauss_bonnet(cells: DataFrame, integrals: DataFrame, defects: DataFrame) -> DataFrame:
    """(ball_id, status, faces, edges, vertices, residual) of each cell with edges: the integrals of Gaussian curvature over
    its faces, of geodesic curvature along its edges (both faces) and the defects at its vertices. residual is their sum
    less 4 pi, null unless the cell is complete: zero for a cell whose surface is a sphere's."""
    faces = by_face(integrals).select(F.explode(F.array("f0", "f1")).alias("ball_id"), F.col("gauss").alias("faces"), F.lit(0.0).alias("edges"), F.lit(0.0).alias("vertices"))
    edges = by_ball(integrals).select("ball_id", F.lit(0.0), F.col("g"), F.lit(0.0))
    corners = defects.select("ball_id", F.lit(0.0), F.lit(0.0), F.col("defect"))
    sums = faces.union(edges).union(corners).groupBy("ball_id").agg(*[F.sum(c).alias(c) for c in ("faces", "edges", "vertices")])
    out = cells.select("ball_id", "status").join(sums, "ball_id")
    return out.withColumn("residual", F.when(F.col("status") == "complete", F.col("faces") + F.col("edges") + F.col("vertices") - 4 * np.pi))


def face_measures(cells: DataFrame, integrals: DataFrame) -> DataFrame:
    """(f0, f1, n_edges, whole, area, volume0, volume1): each face's area and the volumes of the cones from its two balls to it,
    null unless the face is whole, that is, unless one of its cells is complete."""
    of = [F.struct(F.col(f"b{i}").alias("f0"), F.col(f"b{j}").alias("f1"), F.col(f"a{i}{j}").alias("area"), F.col(f"v{i}{j}").alias("v0"), F.col(f"v{j}{i}").alias("v1")) for i, j in PAIRS]
    rows = integrals.select(F.explode(F.array(*of)).alias("f")).select("f.*")
    sums = rows.groupBy("f0", "f1").agg(F.count("*").alias("n_edges"), *[F.sum(c).alias(c) for c in ("area", "v0", "v1")])
    done = cells.select("ball_id", (F.col("status") == "complete").alias("done"))
    for c in ("f0", "f1"):
        sums = sums.join(done.select(F.col("ball_id").alias(c), F.col("done").alias(f"done_{c}")), c)
    sums = sums.withColumn("whole", F.col("done_f0") | F.col("done_f1"))
    own = {"area": "area", "v0": "volume0", "v1": "volume1"}
    return sums.select("f0", "f1", "n_edges", "whole", *[F.when(F.col("whole"), F.col(c)).alias(n) for c, n in own.items()])


def cell_measures(cells: DataFrame, integrals: DataFrame) -> DataFrame:
    """(ball_id, status, n_faces, area, volume, sphericity) of every cell; the last three are null unless it is complete. Sphericity
    is the area of a sphere of the cell's volume over the cell's area."""
    f = face_measures(cells, integrals)
    sides = f.select(F.col("f0").alias("ball_id"), "area", F.col("volume0").alias("volume")).union(f.select("f1", "area", "volume1"))
    sums = sides.groupBy("ball_id").agg(F.sum("area").alias("area"), F.sum("volume").alias("volume"))
    out = cells.select("ball_id", "status", F.size("faces").cast("long").alias("n_faces")).join(sums, "ball_id", "left")
    out = out.withColumns({c: F.when(F.col("status") == "complete", F.col(c)) for c in ("area", "volume")})
    return out.withColumn("sphericity", np.pi ** (1 / 3) * F.pow(6 * F.col("volume"), F.lit(2 / 3)) / F.col("area"))
