"""Whole cells of flat networks (prm, pow): each ball's cell is cut from its neighbours, in rings that widen until no ball
further off can cut it. Vertices, faces and the cells' measures come out of that; nothing depends on max_vert but what is
left out as too large."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators.spatial import close_reach, gathered, named, pieces

#: The most that is added to a weight to part ties: far above rounding, far below what six places show.
NUDGE = 1e-8
CUBE = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], float)
CORNERS = np.array([[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float)
CORNER_PLANES = np.array([[0 if x > 0 else 1, 2 if y > 0 else 3, 4 if z > 0 else 5] for x, y, z in CORNERS])


def clip(normals: np.ndarray, offsets: np.ndarray, half: float, slack: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n, 3) of the part of a cube of half-width `half` around 0 with normals @ x <= offsets, and the three planes
    that meet in each: -6 .. -1 for the cube's sides, else places in normals. Planes should come nearest first."""
    at, planes = CORNERS * half, CORNER_PLANES - 6
    todo = np.arange(len(normals))
    while len(todo) and len(at):
        # of the next planes, those that cut what is left; the first of them is taken, the others are looked at again
        look = todo[:256]
        cuts = (normals[look] @ at.T).max(1) > offsets[look] + slack * half
        if not cuts.any():
            todo = todo[256:]
            continue
        k = look[np.argmax(cuts)]
        todo = todo[np.argmax(cuts) + 1 :]
        side = at @ normals[k] - offsets[k]
        out = side > slack * half
        kept = ~out
        if not kept.any():
            return at[:0], planes[:0]
        shared = (planes[out][:, None, :, None] == planes[kept][None, :, None, :]).any(3)
        i, j = np.nonzero(shared.sum(2) == 2)  # the cut edges
        a, b = at[out][i], at[kept][j]
        t = side[out][i] / (side[out][i] - side[kept][j])
        both = planes[out][i][shared[i, j]].reshape(-1, 2)
        at = np.concatenate([at[kept], a + t[:, None] * (b - a)])
        planes = np.concatenate([planes[kept], np.column_stack([both, np.full(len(both), k)])])
    return at, planes


def face_area(points: np.ndarray, normal: np.ndarray) -> tuple[float, np.ndarray]:
    """Area and centroid of a convex polygon, its corners in any order."""
    middle = points.mean(0)
    x = points[0] - middle
    x = x - normal * (x @ normal)
    y = np.cross(normal, x)
    p = points[np.argsort(np.arctan2((points - middle) @ y, (points - middle) @ x))] - middle
    q = np.roll(p, -1, 0)
    each = np.cross(p, q) @ normal / 2
    area = float(each.sum())
    return abs(area), middle + (each[:, None] * (p + q) / 3).sum(0) / area if area else middle


def edge_curvature(at: np.ndarray, planes: np.ndarray, normals: np.ndarray) -> tuple[float, float]:
    """Of a polyhedron: half the sum over edges of length times turning of the outward normals, and the sum over vertices of
    2 pi less the angles of their faces. The latter is 4 pi for every closed one."""
    i, j = np.nonzero(np.triu((planes[:, None, :, None] == planes[None, :, None, :]).any(3).sum(2) == 2, 1))
    length = np.linalg.norm(at[i] - at[j], axis=1)
    shared = (planes[i][:, :, None] == planes[j][:, None, :]).any(2)
    faces = planes[i][shared].reshape(-1, 2)
    turn = np.arccos(np.clip((normals[faces[:, 0]] * normals[faces[:, 1]]).sum(1), -1, 1))
    n = normals[planes]  # at a vertex the face of one plane lies between the edges with the two others
    ways = [np.cross(n[:, a], n[:, b]) for a, b in ((1, 2), (2, 0), (0, 1))]
    ways = [w * -np.sign((w * n[:, k]).sum(1))[:, None] / np.maximum(np.linalg.norm(w, axis=1), 1e-300)[:, None] for k, w in enumerate(ways)]
    angles = sum(np.arccos(np.clip((ways[a] * ways[b]).sum(1), -1, 1)) for a, b in ((0, 1), (1, 2), (0, 2)))
    return float((length * turn).sum() / 2), float((2 * np.pi - angles).sum())


def solve_cell(centre: np.ndarray, weight: float, at: np.ndarray, weights: np.ndarray, half: float, most: float, reach: float = np.inf) -> dict:
    """The power cell of a ball against others (weights are squared radii; zero for prm): its vertices' planes, its faces,
    its corners, and how far off (need) a ball of weight `most` can be that could still cut one of them. Faces and cell are
    measured only if that is within the reach."""
    d = at - centre
    length = np.linalg.norm(d, axis=1)
    real = length > 0
    normals = np.where(real[:, None], d / np.where(real, length, 1)[:, None], 0.0)
    # twins in one place part nothing unless their weights differ, and then the lesser has no cell
    offsets = np.where(real, (length**2 + weight - weights) / (2 * np.where(real, length, 1)), np.where(weights > weight, -1.0, 1.0))
    order = np.lexsort((length, ~(~real & (weights > weight))))
    v, planes = clip(normals[order], offsets[order], half)
    far = np.linalg.norm(v, axis=1)
    own = far**2 - weight
    need = far + np.sqrt(np.maximum(own + most, 0.0))
    named = np.where(planes >= 0, np.append(order, 0)[np.maximum(planes, 0)], -1)
    out = {"planes": named, "rad": own, "faces": [], "at": centre + v, "need": need, "empty": not len(v)}
    out["bounded"] = bool(len(v)) and bool((planes >= 0).all())
    if len(need) and need.max() > reach:
        out["faces"] = [(int(order[k]), None, 0, False) for k in np.unique(planes[planes >= 0])]
        return out | dict.fromkeys(("volume", "area", "mean_curv", "gauss_curv", "centroid"))
    volume, area, moment = 0.0, 0.0, np.zeros(3)
    for k in np.unique(planes[planes >= 0]):
        on = (planes == k).any(1)
        size, middle = face_area(v[on], normals[order[k]])
        whole = bool((planes[on] >= 0).all())
        out["faces"].append((int(order[k]), size if whole else None, int(on.sum()), whole))
        if out["bounded"]:
            part = size * float(offsets[order[k]]) / 3
            volume, area, moment = volume + part, area + size, moment + part * 0.75 * middle
    out["volume"], out["area"] = (volume, area) if out["bounded"] else (None, None)
    out["mean_curv"], out["gauss_curv"] = edge_curvature(v, planes, normals[order]) if out["bounded"] else (None, None)
    out["centroid"] = centre + moment / volume if out["bounded"] and volume else None
    return out


SOLVED = (
    "ball_id long, x double, y double, z double, rad double, reach double, need double, corners array<struct<x: double, y: double, z: double, power: double>>, bounded boolean, empty boolean, volume double, area double, mean_curv double, gauss_curv double, cx double, cy double, cz double, "
    "quads array<struct<o: array<long>, x: double, y: double, z: double, power: double>>, faces array<struct<other: long, area: double, n_verts: int, whole: boolean>>"
)


def power_cells(balls: DataFrame, scheme: str, max_vert: float, start: float = 0.0) -> DataFrame:
    """A row for each ball: its cell cut off at a cube that holds every vertex of up to max_vert (radius of the touching
    sphere, for pow the root of the power). quads are the vertices' other three balls, by id, with their place and power;
    bounded: the cube cuts nothing; empty: the ball has no cell, as others cover it.

    Weights are made a little larger, each by its own amount from its ball's id, so that no five balls have the same power in one
    place: all cells see the same weights, so they agree on the vertices of balls on a lattice, where eight would meet in one.

    A round joins the open balls with those in reach, by grid cells, and cuts their cells, each from its own neighbours. A cell is
    the hull of its corners, so in later rounds, of few balls, only those that are nearer to one of them than its own ball is are sent,
    besides those with a face. A ball goes on until no ball further off could cut a corner: with twice the reach, or what its
    corners ask for if that is less. Inner cells close in the first rounds whatever max_vert is; the first reach is as short as the
    balls lie close, so where they lie closer a ball is sent no more of them."""
    if scheme not in ("prm", "pow"):
        raise ValueError(f"cells of scheme {scheme} are not flat")
    share = F.pmod(F.xxhash64("ball_id"), F.lit(1 << 20)) / float(1 << 20)
    weight = NUDGE * share if scheme == "prm" else F.col("rad") * F.col("rad") + NUDGE * share
    balls = balls.select("ball_id", "x", "y", "z", "rad")
    count, largest = balls.agg(F.count("*"), F.coalesce(F.max("rad"), F.lit(0.0))).first()
    most = (largest**2 if scheme == "pow" else 0.0) + NUDGE
    half = (max_vert**2 + most) ** 0.5
    end = 2 * 3**0.5 * half + 2 * largest
    reach = min(start or close_reach(balls, 4 * largest + 1e-6, 30.0), end)
    # the root of the weight stands for the radius from here on
    own = balls.withColumn("rad", F.sqrt(weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, near = [], b.column(b.schema.get_field_index("near"))
            cuts, values = near.offsets.to_numpy() - near.offsets[0].as_py(), near.flatten()
            every_id, every_rad = values.field("id").to_numpy(zero_copy_only=False), values.field("rad").to_numpy(zero_copy_only=False)
            every_at = np.column_stack([values.field(c).to_numpy(zero_copy_only=False) for c in "xyz"])
            for k, r in enumerate(b.drop_columns(["near"]).to_pylist()):
                part = slice(cuts[k], cuts[k + 1])
                ids, at = every_id[part], every_at[part]
                got = solve_cell(np.array([r["x"], r["y"], r["z"]]), r["rad"] ** 2, at, every_rad[part] ** 2, half, most, r["reach"] if r["reach"] < end else np.inf)
                sound = (got["planes"] >= 0).all(1) & (got["rad"] <= max_vert**2)
                corner = lambda i: {"x": float(got["at"][i, 0]), "y": float(got["at"][i, 1]), "z": float(got["at"][i, 2]), "power": float(got["rad"][i])}  # noqa: B023, E731
                rows.append(r | {
                    "need": min(float(got["need"].max()), end) if len(got["need"]) else 0.0, "corners": [corner(i) for i in np.flatnonzero(got["need"] > r["reach"])],
                    "bounded": got["bounded"], "empty": got["empty"], "volume": got["volume"], "area": got["area"], "mean_curv": got["mean_curv"], "gauss_curv": got["gauss_curv"],
                    **dict(zip(("cx", "cy", "cz"), got["centroid"] if got["centroid"] is not None else (None,) * 3, strict=True)),
                    "quads": [{"o": ids[got["planes"][i]].tolist()} | corner(i) for i in np.flatnonzero(sound)],
                    "faces": [{"other": int(ids[k]), "area": a, "n_verts": n, "whole": w} for k, a, n, w in got["faces"]],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    place = [(c, pa.float64()) for c in ("x", "y", "z", "power")]
    arrow = pa.schema([
        ("ball_id", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "z", "rad", "reach", "need")), ("corners", pa.list_(pa.struct(place))),
        ("bounded", pa.bool_()), ("empty", pa.bool_()), *((c, pa.float64()) for c in ("volume", "area", "mean_curv", "gauss_curv", "cx", "cy", "cz")),
        ("quads", pa.list_(pa.struct([("o", pa.list_(pa.int64())), *place]))), ("faces", pa.list_(pa.struct([("other", pa.int64()), ("area", pa.float64()), ("n_verts", pa.int32()), ("whole", pa.bool_())]))),
    ])

    def cuts(r: dict, at: np.ndarray, rads: np.ndarray) -> np.ndarray:
        corners = np.array([[c["x"], c["y"], c["z"], c["power"]] for c in r["corners"]]).reshape(-1, 4)
        out, centre = np.zeros(len(at), bool), np.array([r["x"], r["y"], r["z"]])
        own, far = ((at - centre) ** 2).sum(1) - rads**2, corners[:, :3] - centre
        for v, size, power in zip(far, (far**2).sum(1), corners[:, 3], strict=True):
            out |= own - 2 * ((at - centre) @ v) + size < power + 1e-9
        return out

    other, found = named(own, "q"), None
    todo = own.withColumn("reach", F.lit(float(reach)))
    while True:
        solved = gathered(todo, other, count, cuts).mapInArrow(run, SOLVED).checkpoint()
        done = solved.where("need <= reach").drop("x", "y", "z", "rad", "reach", "need", "corners")
        found = done if found is None else found.union(done)
        further = F.least(F.col("need") * (1 + 1e-9), 2 * F.col("reach"))
        todo = solved.where("need > reach").select("ball_id", "x", "y", "z", "rad", further.alias("reach"), F.col("reach").alias("inner"), F.col("faces.other").alias("known"), "corners")
        if todo.isEmpty():
            return found


def cell_vertices(cells: DataFrame) -> DataFrame:
    """(b0, b1, b2, b3, x, y, z, power), ids ascending, of each vertex once, as the cell of its smallest id has it; all its
    four cells name it alike."""
    q = cells.select("ball_id", F.explode("quads").alias("q")).where(F.col("ball_id") < F.array_min("q.o"))
    ids = F.sort_array(F.array_append("q.o", F.col("ball_id")))
    return q.select(*[ids[i].alias(f"b{i}") for i in range(4)], "q.x", "q.y", "q.z", "q.power")


def cell_faces(cells: DataFrame) -> DataFrame:
    """(f0, f1, area, n_verts, whole): the face between two balls, once; area is null where the cube cuts it."""
    f = cells.select("ball_id", F.explode("faces").alias("f")).where("ball_id < f.other")
    return f.select(F.col("ball_id").alias("f0"), F.col("f.other").alias("f1"), "f.area", "f.n_verts", "f.whole")


def cell_measures(cells: DataFrame) -> DataFrame:
    """(ball_id, status, volume, area, sphericity, isoperimetric_quotient, n_neighbors, largest_face, mean_curv, gauss_curv,
    gauss_bonnet, cx, cy, cz): status is complete, unbounded or empty, and all measures but n_neighbors are null unless
    complete. gauss_bonnet is gauss_curv less the 4 pi that a closed surface without holes has."""
    status = F.when(F.col("empty"), "empty").when(F.col("bounded"), "complete").otherwise("unbounded")
    v, a = F.col("volume"), F.col("area")
    return cells.select(
        "ball_id", status.alias("status"), "volume", "area", F.try_divide(F.lit(np.pi ** (1 / 3)) * F.pow(6 * v, F.lit(2 / 3)), a).alias("sphericity"),
        F.try_divide(36 * np.pi * v * v, a * a * a).alias("isoperimetric_quotient"), F.size("faces").alias("n_neighbors"),
        F.when(F.col("bounded"), F.array_max(F.transform("faces", lambda f: f["area"]))).alias("largest_face"), "mean_curv", "gauss_curv", (F.col("gauss_curv") - 4 * np.pi).alias("gauss_bonnet"), "cx", "cy", "cz",
    )


def cell_neighbors(cells: DataFrame, balls: DataFrame) -> DataFrame:
    """(ball_id, n_neighbors, nearest_neighbor, nearest_distance, mean_distance, rmsd, overlap, contact_area, n_second,
    mean_second): over the balls that a cell has a face with, by the distance of surfaces; rmsd is the deviation from the mean,
    overlap the largest one, contact_area the faces towards overlapping balls. Second neighbours are the faces' neighbours'
    neighbours that are neither; mean_second is the mean distance of their centres."""
    own = lambda c: balls.select(F.col("ball_id").alias(c), F.struct("x", "y", "z", "rad").alias(f"{c}_s"))
    near = cells.select("ball_id", F.explode("faces").alias("f")).select("ball_id", F.col("f.other").alias("other"), F.col("f.area").alias("area")).checkpoint()

    def apart(rows: DataFrame) -> DataFrame:
        j = rows.join(own("ball_id"), "ball_id").join(own("other"), "other")
        a, b = F.col("ball_id_s"), F.col("other_s")
        d = F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))
        return j.withColumns({"centre": d, "gap": d - a["rad"] - b["rad"]}).drop("ball_id_s", "other_s")

    first = apart(near).groupBy("ball_id").agg(
        F.count("*").alias("n_neighbors"), F.min_by("other", F.struct("gap", "other")).alias("nearest_neighbor"), F.min("gap").alias("nearest_distance"), F.avg("gap").alias("mean_distance"),
        F.stddev_pop("gap").alias("rmsd"), F.max(F.greatest(-F.col("gap"), F.lit(0.0))).alias("overlap"), F.sum(F.when(F.col("gap") < 0, F.col("area")).otherwise(0.0)).alias("contact_area"),
    )
    two = near.select("ball_id", "other").join(near.select(F.col("ball_id").alias("other"), F.col("other").alias("second")), "other").where("second <> ball_id")
    two = two.select("ball_id", F.col("second").alias("other")).distinct().join(near.select("ball_id", "other"), ["ball_id", "other"], "left_anti")
    return first.join(apart(two).groupBy("ball_id").agg(F.count("*").alias("n_second"), F.avg("centre").alias("mean_second")), "ball_id", "left")


def group_summary(cells: DataFrame, balls: DataFrame, members: DataFrame, mass: str) -> DataFrame:
    """(group_id, n_cells, n_complete, volume, mass, vdw_volume, packing_fraction, cx, cy, cz, surface_area) of
    members(group_id, ball_id): sums over complete cells, the centre by mass, and the faces between the group and all else
    (null if one of them is cut)."""
    rows = members.join(cells.select("ball_id", "bounded", "volume", "faces"), "ball_id").join(balls, "ball_id")
    whole, m, vdw = F.col("bounded"), F.col(mass), F.lit(4 / 3 * np.pi) * F.col("rad") * F.col("rad") * F.col("rad")
    if_whole = lambda x: F.sum(F.when(whole, x))
    out = rows.groupBy("group_id").agg(
        F.count("*").alias("n_cells"), F.sum(whole.cast("long")).alias("n_complete"), if_whole(F.col("volume")).alias("volume"), if_whole(m).alias("mass"), if_whole(vdw).alias("vdw_volume"),
        F.try_divide(if_whole(vdw), if_whole(F.col("volume"))).alias("packing_fraction"), *[F.try_divide(if_whole(m * F.col(c)), if_whole(m)).alias(f"c{c}") for c in "xyz"],
    )
    faces = rows.select("group_id", F.explode("faces").alias("f")).select("group_id", F.col("f.other").alias("ball_id"), F.col("f.area").alias("area"))
    rim = faces.join(members, ["group_id", "ball_id"], "left_anti").groupBy("group_id").agg(F.when(F.count("area") == F.count("*"), F.sum("area")).alias("surface_area"))
    return out.join(rim, "group_id", "left")
