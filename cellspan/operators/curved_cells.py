"""Whole cells by distance to the balls' surfaces (scheme aw), with their vertices and curved edges.

Seen from a ball, another one bounds the cell, in direction u, at a distance whose inverse is at least a . u + b, a and b being
known from the two balls. So the cell is the greatest of linear functions over the unit sphere: where one is greatest is a convex
polyhedron cut by the sphere, its sides are circles, and a vertex is where an edge of the polyhedron meets the sphere. That finds
loops, doublets and parts of the network that no edge connects, as no edge has to be followed. Cells of a whole table are cut in rings
that widen for the balls that are still open, each only as far as its own cell asks for."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators.spatial import close_reach, gathered, named, pieces

CAP = -1
TURN = 2 * np.pi


def functions(centre: np.ndarray, rad: float, at: np.ndarray, rads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """a, b of the balls that can bound the cell, which of them these are, and whether one swallows the ball."""
    d, s = at - centre, rads - rad
    far = np.linalg.norm(d, axis=1)
    bounds = far > np.abs(s)
    over = 2 / np.where(bounds, far**2 - s**2, 1)
    return d[bounds] * over[bounds, None], s[bounds] * over[bounds], np.flatnonzero(bounds), bool((s >= far).any())


def mesh() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions in the middle of 80 triangles that cover the unit sphere, corners, and which six of these hold each triangle's part
    of the sphere: those of the flat triangle, and these moved out."""
    gold = (1 + 5**0.5) / 2
    at = [np.array(v) / np.hypot(1, gold) for x in (-1, 1) for y in (-gold, gold) for v in ((0, x, y), (x, y, 0), (y, 0, x))]
    side = min(np.linalg.norm(at[0] - v) for v in at[1:])
    near = lambda i, j: np.linalg.norm(at[i] - at[j]) < side + 1e-6
    halves: dict[tuple[int, int], int] = {}
    triangles = []
    for i, j, k in [t for t in combinations(range(12), 3) if all(near(*e) for e in combinations(t, 2))]:
        for e in ((i, j), (j, k), (i, k)):
            if e not in halves:
                halves[e] = len(at)
                at.append((at[e[0]] + at[e[1]]) / np.linalg.norm(at[e[0]] + at[e[1]]))
        ij, jk, ik = halves[i, j], halves[j, k], halves[i, k]
        triangles += [(i, ij, ik), (j, ij, jk), (k, ik, jk), (ij, jk, ik)]
    at, of = np.array(at), np.array(triangles)
    normals = np.cross(at[of[:, 1]] - at[of[:, 0]], at[of[:, 2]] - at[of[:, 0]])
    out = (np.linalg.norm(normals, axis=1) / np.abs((normals * at[of[:, 0]]).sum(1))).max() * (1 + 1e-12)
    middles = at[of].sum(1)
    return middles / np.linalg.norm(middles, axis=1)[:, None], np.vstack([at, at * out]), np.hstack([of, of + len(at)])


MIDDLES, CORNERS, HOLD = mesh()
SEEN = np.vstack([MIDDLES, CORNERS[: len(CORNERS) // 2]])


def bounds_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A value at each corner of the mesh: a further function that exceeds none of these is nowhere greatest, as in each part of the
    mesh it is less than the one that is greatest in its middle."""
    least = np.full(len(CORNERS), np.inf)
    first = (a @ MIDDLES.T + b[:, None]).argmax(0)
    np.minimum.at(least, HOLD, (a @ CORNERS.T + b[:, None])[first[:, None], HOLD])
    return least


def exceeds(a: np.ndarray, b: np.ndarray, tops: tuple[np.ndarray, np.ndarray], rim: dict[str, np.ndarray]) -> np.ndarray:
    """Which functions a, b are somewhere greater than the greatest of tops, whose arcs are rim (with a0, b0, one of each arc's two
    functions): at a point of an arc, or else all around the peak of its difference to one of tops."""
    slack = 1e-11 * (1 + np.linalg.norm(a, axis=1) + np.abs(b))
    hit = np.zeros(len(b), bool)
    if len(rim["start"]):
        level, x, y = (a @ rim[c].T - _dot(rim["a0"], rim[c]) for c in ("middle", "e1", "e2"))
        level += b[:, None] - rim["b0"] + slack[:, None]
        for t in (rim["start"], rim["stop"]):
            hit |= (level + x * np.cos(t) + y * np.sin(t) > 0).any(1)
        i, e = np.nonzero((level > 0) | (x * x + y * y > level * level))
        i, e = i[~hit[i]], e[~hit[i]]
        hit[i[(np.arctan2(y[i, e], x[i, e]) - rim["start"][e]) % TURN <= rim["stop"][e] - rim["start"][e]]] = True
    rest = np.flatnonzero(~hit)
    away = a[rest, None] - tops[0]
    peak = away / np.maximum(np.linalg.norm(away, axis=2), 1e-300)[:, :, None]
    hit[rest] = ((peak * a[rest, None]).sum(2) + (b + slack)[rest, None] > (peak @ tops[0].T + tops[1]).max(2)).any(1)
    return hit


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.column_stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]])


def _dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[:, 0] * v[:, 0] + u[:, 1] * v[:, 1] + u[:, 2] * v[:, 2]


def arcs_of(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray, j: np.ndarray, k: np.ndarray, most: int = 400_000) -> dict[str, np.ndarray]:
    """Where two functions j, k of one cell are equal and greatest, for many cells at once; a cell's functions are the count[x] from
    first[x] on, of which first and count are given by pair. Both are equal on a circle of directions, of which any third one
    takes an interval of angles; what is left are arcs: j, k, the circle's middle and two half-axes, the angles start and stop, and
    the functions that end it (-1: it is a whole circle)."""
    parts, at = [], 0
    upto = np.cumsum(count)
    while at < len(j):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        parts.append(_arcs(a, b, *(x[at:end] for x in (first, count, j, k))))
        at = end
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else _arcs(a, b, first, count, j, k)


def _arcs(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray, j: np.ndarray, k: np.ndarray) -> dict[str, np.ndarray]:
    away = a[k] - a[j]
    length = np.sqrt(_dot(away, away))
    with np.errstate(all="ignore"):
        offset = (b[j] - b[k]) / length
        meet = (length > 1e-300) & (np.abs(offset) < 1)
    first, count, j, k, offset = (x[meet] for x in (first, count, j, k, offset))
    normal = away[meet] / length[meet, None]
    e1 = _cross(normal, np.eye(3)[np.abs(normal).argmin(1)])
    e1 /= np.sqrt(_dot(e1, e1))[:, None]
    size = np.sqrt(np.maximum(1 - offset * offset, 0))[:, None]
    middle, e1, e2 = normal * offset[:, None], e1 * size, _cross(normal, e1) * size
    # every pair with every function of its cell, as differences to the flatter one of the pair
    norm = _dot(a, a)
    flat = np.where(norm[k] < norm[j], k, j)
    of = np.repeat(np.arange(len(j)), count)
    third = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    away = a[third] - a[flat][of]
    x, y, room = _dot(away, e1[of]), _dot(away, e2[of]), (b[flat][of] - b[third]) - _dot(away, middle[of])
    r = np.sqrt(x * x + y * y)
    takes = (room < r) & (third != j[of]) & (third != k[of])
    gone = np.zeros(len(j), bool)
    gone[of[takes & (room <= -r)]] = True
    takes &= ~gone[of]
    of, third, x, y, share = of[takes], third[takes], x[takes], y[takes], room[takes] / r[takes]
    half = np.arccos(np.clip(share, -1, 1))
    low = (np.arctan2(y, x) - half) % TURN
    n = np.bincount(of, minlength=len(j))
    whole = np.flatnonzero((n == 0) & ~gone)
    cols = [(whole, np.zeros(len(whole)), np.full(len(whole), TURN), np.full(len(whole), -1), np.full(len(whole), -1))]
    place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    for least, most in ((0, 4), (4, 8), (8, 16), (16, 1 << 30)):
        rows = np.flatnonzero((n > least) & (n <= most))
        if not len(rows):
            continue
        row = np.full(len(j), -1)
        row[rows] = np.arange(len(rows))
        on = row[of] >= 0
        # each interval twice, a turn apart: those before an interval's start then tell up to where all is taken
        shape, width = (len(rows), 2 * int(n[rows].max())), int(n[rows].max())
        lows, highs, who = np.full(shape, np.inf), np.full(shape, -np.inf), np.full(shape, -1)
        for shift in (0, 1):
            spot = row[of[on]], place[on] + shift * width
            lows[spot], highs[spot], who[spot] = low[on] - (1 - shift) * TURN, low[on] + 2 * half[on] - (1 - shift) * TURN, third[on]
        order = lows.argsort(1)
        lows, highs, who = (np.take_along_axis(v, order, 1) for v in (lows, highs, who))
        taken = np.maximum.accumulate(highs, 1)
        last = np.maximum.accumulate(np.where(highs == taken, np.arange(shape[1]), 0), 1)
        i, c = np.nonzero((lows[:, 1:] > taken[:, :-1]) & (lows[:, 1:] >= 0) & (lows[:, 1:] < np.inf))
        start = taken[i, c] % TURN
        cols.append((rows[i], start, start + (lows[i, c + 1] - taken[i, c]), who[i, last[i, c]], who[i, c + 1]))
    pair, start, stop, end0, end1 = (np.concatenate(c) for c in zip(*cols, strict=True))
    return {"j": j[pair], "k": k[pair], "end0": end0, "end1": end1, "middle": middle[pair], "e1": e1[pair], "e2": e2[pair], "start": start, "stop": stop}


RIM = (*[f"{v}{c}" for v in ("m", "e", "f") for c in "xyz"], "start", "stop", "ax", "ay", "az", "b")
TOPS = ("ax", "ay", "az", "b")
VECTOR = "struct<x: double, y: double, z: double>"
SOLVED = (
    "ball_id long, status string, need double, reach double, verts array<struct<o1: long, o2: long, o3: long, x: double, y: double, z: double, rad: double>>, "
    f"arcs array<struct<o1: long, o2: long, end0: long, end1: long, closed: boolean, middle: {VECTOR}, e1: {VECTOR}, e2: {VECTOR}, start: double, stop: double, a: {VECTOR}, b: double>>, faces array<long>, direct array<long>, "
    f"known array<long>, corners array<double>, rim array<struct<{', '.join(f'{c}: double' for c in RIM)}>>, tops array<struct<{', '.join(f'{c}: double' for c in TOPS)}>>"
)
_V = pa.struct([(c, pa.float64()) for c in "xyz"])
ARROW = pa.schema([
    ("ball_id", pa.int64()), ("status", pa.string()), ("need", pa.float64()), ("reach", pa.float64()),
    ("verts", pa.list_(pa.struct([*((c, pa.int64()) for c in ("o1", "o2", "o3")), *((c, pa.float64()) for c in ("x", "y", "z", "rad"))]))),
    ("arcs", pa.list_(pa.struct([*((c, pa.int64()) for c in ("o1", "o2", "end0", "end1")), ("closed", pa.bool_()), *((c, _V) for c in ("middle", "e1", "e2")), ("start", pa.float64()), ("stop", pa.float64()), ("a", _V), ("b", pa.float64())]))),
    ("faces", pa.list_(pa.int64())), ("direct", pa.list_(pa.int64())),
    ("known", pa.list_(pa.int64())), ("corners", pa.list_(pa.float64())),
    *((name, pa.list_(pa.struct([(c, pa.float64()) for c in names]))) for name, names in (("rim", RIM), ("tops", TOPS))),
])


def _rims(sets: list[tuple[np.ndarray, ...] | None]) -> tuple:
    """The functions of all sets (a, b, ids; the last is the cap) in one, the set of each, sizes and starts of the sets, which
    functions are caps, and all arcs."""
    held = [x for x in sets if x is not None]
    a, b, ids = (np.concatenate([e, *[x[c] for x in held]]) for c, e in enumerate((np.empty((0, 3)), np.empty(0), np.empty(0, np.int64))))
    sizes = np.array([0 if x is None else len(x[1]) for x in sets], np.int64)
    starts, cell = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sets)), sizes)
    cap = np.zeros(len(b), bool)
    cap[(starts + sizes - 1)[sizes > 0]] = True
    j, k = np.concatenate([np.empty((2, 0), np.int64), *[np.array(np.triu_indices(n, 1)) + s for n, s in zip(sizes, starts, strict=True)]], axis=1)
    return a, b, ids, cell, sizes, starts, cap, arcs_of(a, b, starts[cell[j]], sizes[cell[j]], j, k)


def solve_cells(own: list[dict], near: list[tuple[np.ndarray, np.ndarray, np.ndarray]], max_vert: float, largest: float) -> pa.RecordBatch:
    """Rows of SOLVED for balls (ball_id, x, y, z, rad, reach), each with ids, places and radii of others. need is how far from the centre a ball
    may be that could still change the cell. Where that is more than twice the reach, the row has what known balls bound the
    cell, its arcs and the corners that a further one has to exceed.

    The functions that are greatest in some direction of the mesh are cut first; those that exceed them anywhere join them."""
    n, every, sets = len(own), [], []
    for r, (ids, at, rads) in zip(own, near, strict=True):
        a, b, which, swallowed = functions(np.array([r["x"], r["y"], r["z"]]), r["rad"], at, rads)
        if swallowed:
            every.append(None)
            sets.append(None)
            continue
        order = ids[which].argsort()
        a, b, ids = np.vstack([a[order], np.zeros(3)]), np.append(b[order], 1 / max(max_vert + r["rad"], 1e-12)), np.append(ids[which][order], CAP)
        first = np.arange(len(b)) if len(b) <= 16 else np.union1d((a @ SEEN.T + b[:, None]).argmax(0), [len(b) - 1])
        every.append((a, b, ids, first))
        sets.append((a[first], b[first], ids[first]))
    a, b, _, cell, sizes, starts, cap, e = _rims(sets)
    order = cell[e["j"]].argsort(kind="stable")
    e = {c: v[order] for c, v in e.items()} | {"a0": a[e["j"][order]], "b0": b[e["j"][order]]}
    cuts = np.searchsorted(cell[e["j"]], np.arange(n + 1))
    for x in range(n):
        if every[x] is not None:
            of_a, of_b, ids, first = every[x]
            rim = {c: v[cuts[x] : cuts[x + 1]] for c, v in e.items()}
            tops = np.union1d(np.unique(np.concatenate([rim["j"], rim["k"]])) - starts[x], [sizes[x] - 1]).astype(int)
            rest = np.delete(np.arange(len(of_b)), first)
            if len(rest) > 200:
                rest = rest[(of_a[rest] @ CORNERS.T + of_b[rest, None] > bounds_of(*sets[x][:2]) - 1e-9).any(1)]
            more = rest[exceeds(of_a[rest], of_b[rest], (sets[x][0][tops], sets[x][1][tops]), rim)]
            few = np.sort(np.append(first[tops], more))
            sets[x] = of_a[few], of_b[few], ids[few]
    a, b, ids, cell, sizes, starts, cap, e = _rims(sets)
    j, k, of = e["j"], e["k"], cell[e["j"]]
    base, x, y = _dot(a[j], e["middle"]) + b[j], _dot(a[j], e["e1"]), _dot(a[j], e["e2"])
    bottom = (np.arctan2(y, x) + np.pi - e["start"]) % TURN + e["start"]
    low = base + np.where(bottom <= e["stop"], -np.hypot(x, y), np.minimum(*(x * np.cos(t) + y * np.sin(t) for t in (e["start"], e["stop"]))))
    lowest = np.full(n, np.inf)
    np.minimum.at(lowest, of, low)
    floor = 1 / np.maximum(max_vert + np.array([r["rad"] for r in own]), 1e-12)
    beyond = np.ones(n, bool)  # a cell without arcs has no bounds at all
    beyond[of] = False
    beyond[of[cap[k]]] = True
    lowest = np.where(beyond, floor, np.maximum(lowest, floor))
    empty = np.array([x is None for x in sets], bool)
    need = np.where(empty, 0.0, 2 / lowest - np.array([r["rad"] for r in own]) + largest)
    # faces: functions with an arc, and whether they are greatest at their peak
    face = np.unique(np.concatenate([j, k]))
    face = face[~cap[face]]
    peak = np.sqrt(_dot(a[face], a[face]))
    top = a[face] / np.maximum(peak, 1e-300)[:, None]
    which = np.repeat(np.arange(len(face)), sizes[cell[face]])
    other = np.arange(len(which)) - np.repeat(np.cumsum(sizes[cell[face]]) - sizes[cell[face]], sizes[cell[face]]) + starts[cell[face]][which]
    away = a[other] - a[face][which]
    over = _dot(away, top[which]) > b[face][which] - b[other] + 1e-12 * np.sqrt(_dot(away, away))
    direct = np.bincount(which[over], minlength=len(face)) == 0
    # vertices: ends of arcs, each from the circle of its two first functions
    ends = [(np.flatnonzero((e[end] > k) & ~cap[e[end]]), end, t) for end, t in (("end0", "start"), ("end1", "stop"))]
    arc = np.concatenate([on for on, _, _ in ends])
    third, t = (np.concatenate([e[c][on] for on, *cs in ends for c in (cs[q],)]) for q in (0, 1))
    u = e["middle"][arc] + np.cos(t)[:, None] * e["e1"][arc] + np.sin(t)[:, None] * e["e2"][arc]
    value = _dot(a[j[arc]], u) + b[j[arc]]
    order = np.argsort(of[arc], kind="stable")
    arc, third, u, value = arc[order], third[order], u[order], value[order]
    whose = of[arc]
    centre, rad = np.array([[r["x"], r["y"], r["z"]] for r in own]).reshape(-1, 3), np.array([r["rad"] for r in own])
    place = centre[whose] + u / value[:, None]
    kept = np.flatnonzero(~cap[k])
    kept = kept[np.argsort(of[kept], kind="stable")]
    further = np.flatnonzero(~empty & (need > 2 * np.array([r["reach"] for r in own])))
    known = np.flatnonzero(np.isin(cell[face], further))
    lists = lambda values, where: pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(n + 1)), pa.int32()), values)
    vec = lambda v: pa.StructArray.from_arrays([pa.array(v[:, q]) for q in range(3)], ["x", "y", "z"])
    end = {c: pa.array(ids[np.maximum(e[c][kept], 0)], mask=(e[c][kept] < 0) | cap[np.maximum(e[c][kept], 0)]) for c in ("end0", "end1")}
    verts = pa.StructArray.from_arrays([*[pa.array(ids[x]) for x in (j[arc], k[arc], third)], *[pa.array(place[:, q]) for q in range(3)], pa.array(1 / value - rad[whose])], ["o1", "o2", "o3", "x", "y", "z", "rad"])
    arcs = pa.StructArray.from_arrays(
        [pa.array(ids[j[kept]]), pa.array(ids[k[kept]]), end["end0"], end["end1"], pa.array(e["end0"][kept] < 0), *[vec(e[c][kept]) for c in ("middle", "e1", "e2")], pa.array(e["start"][kept]), pa.array(e["stop"][kept]), vec(a[j[kept]]), pa.array(b[j[kept]])],
        ["o1", "o2", "end0", "end1", "closed", "middle", "e1", "e2", "start", "stop", "a", "b"],
    )
    corners = pa.array(np.concatenate([np.empty(0), *[bounds_of(*sets[x][:2]) for x in further]]))
    on = np.flatnonzero(np.isin(of, further))
    on = on[of[on].argsort(kind="stable")]
    rim = pa.StructArray.from_arrays([pa.array(v) for v in np.column_stack([e["middle"], e["e1"], e["e2"], e["start"], e["stop"], a[j], b[j]])[on].T], list(RIM))
    bound = np.flatnonzero(cap | np.isin(np.arange(len(b)), face))
    bound = bound[np.isin(cell[bound], further)]
    tops = pa.StructArray.from_arrays([pa.array(v) for v in np.column_stack([a, b])[bound].T], list(TOPS))
    status = np.where(empty, "empty", np.where(beyond, "unbounded", "complete"))
    cols = [
        pa.array([r["ball_id"] for r in own], pa.int64()), pa.array(status.tolist(), pa.string()), pa.array(need), pa.array([r["reach"] for r in own], pa.float64()),
        lists(verts, whose), lists(arcs, of[kept]), lists(pa.array(ids[face]), cell[face]), lists(pa.array(ids[face[direct]]), cell[face[direct]]),
        lists(pa.array(ids[face[known]]), cell[face[known]]), lists(corners, np.repeat(further, len(CORNERS))),
        lists(rim, of[on]), lists(tops, cell[bound]),
    ]
    return pa.RecordBatch.from_arrays(cols, schema=ARROW)


def nudged(balls: DataFrame, by: float) -> DataFrame:
    """Radii made a little larger, each by its own amount from its id, so that no five balls touch one sphere; all cells see the
    same radii, so they agree."""
    share = F.pmod(F.xxhash64("ball_id"), F.lit(1 << 20)) / float(1 << 20)
    return balls.withColumn("rad", F.col("rad") + by * share)


def alpha_births(cells: DataFrame, balls: DataFrame) -> DataFrame:
    """(dim, ids, birth) of every simplex of the additively weighted alpha filtration up to the cells' max_vert: the least
    amount by which all balls must grow (shrink, if negative) until the simplex's balls meet in a point that no other has
    taken. For one ball that is where it vanishes, for four the vertex. Along an edge the touching sphere is least where a . u + b is
    greatest, a point of the arc or one of its ends; on a face it is least between the two centres if that point is in the face, and
    else on one of its edges. Simplices of several vertices or edges are born with the first; covered balls never are."""
    points = cells.where("status <> 'empty'").join(balls.select("ball_id", "rad"), "ball_id")
    points = points.select(F.lit(0).alias("dim"), F.array("ball_id").alias("ids"), (-F.col("rad")).alias("birth"))
    e = cell_edges(cells).join(balls.select(F.col("ball_id").alias("b0"), "rad"), "b0")
    dot = lambda v, w: sum((F.col(f"{v}.{c}") * F.col(f"{w}.{c}") for c in "xyz"), F.lit(0.0))
    x, y, level = dot("a", "e1"), dot("a", "e2"), dot("a", "middle") + F.col("b")
    value = lambda t: x * F.cos(t) + y * F.sin(t)
    top = F.pmod(F.atan2(y, x) - F.col("start"), F.lit(TURN)) + F.col("start")
    most = F.when(F.col("closed") | (top <= F.col("stop")), F.sqrt(x * x + y * y)).otherwise(F.greatest(value(F.col("start")), value(F.col("stop"))))
    edges = e.select("b0", "b1", "b2", (1 / (level + most) - F.col("rad")).alias("birth")).groupBy("b0", "b1", "b2").agg(F.min("birth").alias("birth")).checkpoint()
    pairs = cells.select("ball_id", "direct", F.explode("faces").alias("other")).where("ball_id < other")
    own = lambda c: balls.select(F.col("ball_id").alias(c), F.struct("x", "y", "z", "rad").alias(f"{c}_s"))
    pairs = pairs.join(own("ball_id"), "ball_id").join(own("other"), "other")
    gap = F.sqrt(sum(((F.col(f"ball_id_s.{c}") - F.col(f"other_s.{c}")) * (F.col(f"ball_id_s.{c}") - F.col(f"other_s.{c}")) for c in "xyz"), F.lit(0.0))) - F.col("ball_id_s.rad") - F.col("other_s.rad")
    direct = pairs.where(F.array_contains("direct", F.col("other"))).select(F.array("ball_id", "other").alias("ids"), (gap / 2).alias("birth"))
    around_ = edges.select(F.explode(F.array(F.array("b0", "b1"), F.array("b0", "b2"), F.array("b1", "b2"))).alias("ids"), "birth")
    faces = direct.union(around_).groupBy("ids").agg(F.min("birth").alias("birth")).select(F.lit(1).alias("dim"), "ids", "birth")
    verts = cell_quads(cells).groupBy(F.array("b0", "b1", "b2", "b3").alias("ids")).agg(F.min("rad").alias("birth")).select(F.lit(3).alias("dim"), "ids", "birth")
    return points.union(faces).union(edges.select(F.lit(2), F.array("b0", "b1", "b2"), "birth")).union(verts)


def curved_cells(balls: DataFrame, max_vert: float, start: float = 0.0, nudge: float = 1e-8) -> DataFrame:
    """A row for each ball, as SOLVED says: its cell where that is no further from its surface than max_vert, the largest
    radius of a touching sphere. status: complete, unbounded (beyond max_vert it goes on), or empty.

    A round joins the open balls with those in reach, by grid cells, and cuts their cells; a ball whose cell asks for more
    goes on with twice the reach, or what it asks for if that is less. Inner cells are closed by their neighbours, whatever max_vert
    is. One that asks for still more is sent, of the balls beyond its reach, only those that exceed its greatest function at a corner.
    Each round's cells are kept in the checkpoint folder."""
    count, largest = balls.agg(F.count("*"), F.coalesce(F.max("rad"), F.lit(0.0))).first()
    largest += nudge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            near = b.column(b.schema.get_field_index("near"))
            cuts, values = near.offsets.to_numpy() - near.offsets[0].as_py(), near.flatten()
            ids, rads = values.field("id").to_numpy(zero_copy_only=False), values.field("rad").to_numpy(zero_copy_only=False)
            at = np.column_stack([values.field(c).to_numpy(zero_copy_only=False) for c in "xyz"])
            near = [(ids[x:y], at[x:y], rads[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield solve_cells(b.drop_columns(["near"]).to_pylist(), near, max_vert, largest)

    def cuts(r: dict, at: np.ndarray, rads: np.ndarray) -> np.ndarray:
        d, s = at - np.array([r["x"], r["y"], r["z"]]), rads - r["rad"]
        room = (d * d).sum(1) - s * s
        out = np.where(room > 0, (2 * (d @ CORNERS.T + s[:, None]) > (np.array(r["corners"]) - 1e-9) * room[:, None]).any(1), s >= 0)
        some = np.flatnonzero(out & (room > 0))
        rim, tops = (np.array([[x[c] for c in names] for x in r[name]]).reshape(-1, len(names)) for name, names in (("rim", RIM), ("tops", TOPS)))
        rim = dict(zip(("middle", "e1", "e2", "a0"), (rim[:, i : i + 3] for i in (0, 3, 6, 11)), strict=True)) | dict(zip(("start", "stop", "b0"), rim[:, [9, 10, 14]].T, strict=True))
        out[some] = exceeds(2 * d[some] / room[some, None], 2 * s[some] / room[some], (tops[:, :3], tops[:, 3]), rim)
        return out

    own = nudged(balls.select("ball_id", "x", "y", "z", "rad"), nudge)
    other, found = named(own, "q"), None
    todo = own.withColumn("reach", F.lit(float(start or close_reach(balls, 4 * largest + 1e-6, 30.0))))
    while True:
        solved = gathered(todo, other, count, cuts, ("corners", "rim", "tops")).mapInArrow(run, SOLVED).checkpoint()
        done = solved.where("need <= reach").drop("reach", "known", "corners", "rim", "tops")
        found = done if found is None else found.union(done)
        inner = F.when(F.size("corners") > 0, F.col("reach"))
        still = solved.where("need > reach").select("ball_id", F.least(F.col("need") * (1 + 1e-9), 2 * F.col("reach")).alias("reach"), inner.alias("inner"), "known", "corners", "rim", "tops")
        todo = own.join(still, "ball_id").checkpoint()
        if todo.isEmpty():
            return found


def cell_quads(cells: DataFrame) -> DataFrame:
    """(b0, b1, b2, b3, x, y, z, rad): every vertex once, as its four cells see it; ids ascend."""
    v = cells.select("ball_id", F.explode("verts").alias("v"))
    ids = F.sort_array(F.array("ball_id", "v.o1", "v.o2", "v.o3"))
    return v.where("ball_id < v.o1").select(*[ids[k].alias(f"b{k}") for k in range(4)], "v.x", "v.y", "v.z", "v.rad")


def cell_edges(cells: DataFrame) -> DataFrame:
    """(b0, b1, b2, end0, end1, closed, and the arc's parameters): every edge once, from the ball with the smallest id. An end
    is the fourth ball of its vertex, null where the edge goes on beyond max_vert; closed edges have no end."""
    e = cells.select("ball_id", F.explode("arcs").alias("e")).where("ball_id < e.o1")
    return e.select(F.col("ball_id").alias("b0"), F.col("e.o1").alias("b1"), F.col("e.o2").alias("b2"), *[f"e.{c}" for c in ("end0", "end1", "closed", "middle", "e1", "e2", "start", "stop", "a", "b")])
