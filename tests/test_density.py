"""Work on balls that lie close grows with the balls, not with the pairs within a fixed reach."""

import time

import numpy as np
import pytest

from cellspan.operators import curved_cells, curved_measures, graphs, power_cells, spatial
from cellspan.plans.space import spatial_checkpoints


def dense(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    at, rad = rng.normal(size=(n, 3)) * 3, 1 + 0.05 * rng.integers(0, 10, n)
    spatial_checkpoints(spark)
    return at, rad, spark.createDataFrame([(i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(at, rad, strict=True))], "ball_id long, x double, y double, z double, rad double")


class Seen(Exception):
    pass


@pytest.mark.parametrize("cells", [lambda b: power_cells.power_cells(b, "pow", 40.0), lambda b: curved_cells.curved_cells(b, 40.0)])
def test_first_round_sends_few_neighbours(spark, monkeypatch, cells):
    _, _, b = dense(spark, 3000)

    def look(*args):
        raise Seen(gathered(*args).selectExpr("sum(size(near))").first()[0])

    gathered = spatial.gathered
    for module in (power_cells, curved_cells):
        monkeypatch.setattr(module, "gathered", look)
    with pytest.raises(Seen) as seen:
        cells(b)
    assert 3000 < seen.value.args[0] < 3000 * 200


def test_few_balls_meet_all_others_in_blocks(spark):
    at, rad, b = dense(spark, 300)
    own = spatial.named(b, "q")
    todo = b.where("ball_id % 20 = 3").selectExpr("*", "4.0D AS reach")
    near = {r.ball_id: sorted(q.id for q in r.near) for r in spatial.gathered(todo, own, 300).collect()}
    for i in range(3, 300, 20):
        assert near[i] == [j for j in range(300) if j != i and ((at[i] - at[j]) ** 2).sum() <= 16]


def test_nearest_of_copies_in_one_place(spark):
    at, rad, b = dense(spark, 200)
    at, rad = np.vstack([at, np.repeat(at[:1], 60, 0)]), np.append(rad, np.repeat(rad[:1], 60))
    both = b.union(b.where("ball_id = 0").selectExpr("explode(sequence(200, 259)) AS ball_id", "x", "y", "z", "rad"))
    got = {}
    for r in spatial.nearest(both, 3, 1.0).collect():
        got.setdefault(r.ball_id, {})[r["rank"]] = r.other
    for i in range(260):
        d = np.sqrt(((at - at[i]) ** 2).sum(1)) - rad[i] - rad
        order = [j for j in sorted(range(260), key=lambda j: (round(d[j], 9), j)) if j != i][:3]
        assert [got[i][k] for k in (1, 2, 3)] == order


def crowds(spark):
    """Two crowds, a chain between one of them and beyond, and balls on their own."""
    at, rad, b = dense(spark, 400, 8)
    more = np.random.default_rng(9).uniform(-25, 25, (150, 3))
    at, rad = np.vstack([at / 3, at[:200] / 3 + [22, 0, 0], more]), np.concatenate([rad, rad[:200], np.where(np.arange(150) % 9 == 0, 2.6, 1.1)])
    rows = [(i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(at, rad, strict=True))]
    b = spark.createDataFrame([*rows, (9000, float("nan"), 0.0, 0.0, 1.0), (9001, 0.0, 0.0, None, 1.0)], b.schema)
    near = np.sqrt(((at[:, None] - at) ** 2).sum(2)) - rad[:, None] - rad <= 0.3
    np.fill_diagonal(near, False)
    return near, b


def test_components_from_few_links(spark):
    near, b = crowds(spark)
    links = spatial.component_links(b, 0.3, graphs.components).checkpoint()
    assert all(near[r.a, r.b] for r in links.collect())
    assert links.count() < near.sum() / 2 / 4
    want = np.arange(len(near))
    while True:
        new = np.minimum(want, np.where(near, want, len(near)).min(1))
        if (new == want).all():
            break
        want = new
    got = {r.node: r.component for r in graphs.components(links).collect()}
    assert got == {i: want[i] for i in range(len(near)) if near[i].any()}


def test_layers_list_no_pairs(spark, monkeypatch):
    near, b = crowds(spark)
    monkeypatch.setattr(spatial, "range_join", None)
    got = {r.node: r.layer for r in spatial.layers_within(b, 0.3, b.where("ball_id % 97 = 5 OR ball_id = 9000").selectExpr("ball_id AS node")).collect()}
    want, front, k = {9000: 0}, [i for i in range(len(near)) if i % 97 == 5], 0
    while front:
        want |= dict.fromkeys(front, k)
        k, front = k + 1, [i for i in range(len(near)) if i not in want and near[i, front].any()]
    assert got == want and max(want.values()) > 2


def brute(at, rad, ids, gap):
    """(i, j, distance, gap of surfaces) of all pairs of different ids that are near, i < j."""
    i, j = np.triu_indices(len(at), 1)
    d = np.sqrt(((at[i] - at[j]) ** 2).sum(1))
    on = (d - rad[i] - rad[j] <= gap) & (ids[i] != ids[j])
    return i[on], j[on], d[on], (d - rad[i] - rad[j])[on]


@pytest.mark.parametrize("each", [16, 8192])
def test_sums_over_neighbours_list_no_pairs(spark, monkeypatch, each):
    """Bands of several radii, ids that come twice, blocks of few balls; no pair is joined."""
    at, rad, _ = dense(spark, 500)
    rad[::25], ids = 6.0, np.arange(500)
    ids[1::50] = ids[::50]
    kind = ids % 3
    b = spark.createDataFrame([(int(k), *map(float, p), float(r), int(c)) for k, p, r, c in zip(ids, at, rad, kind, strict=True)], "ball_id long, x double, y double, z double, rad double, kind long")
    b = b.union(spark.sql("SELECT 900L, double(null), 0D, 0D, 1D, 0L UNION ALL SELECT 901L, 0D, 0D, 0D, double(null), 0L UNION ALL SELECT 902L, double('nan'), 0D, 0D, 1D, 0L"))
    monkeypatch.setattr(spatial, "range_join", None)
    fold = spatial.fold_within
    monkeypatch.setattr(spatial, "fold_within", lambda *args: fold(*args, each=each))
    for gap, near in ((1.0, 0.3), (-1.0, -2.0)):
        i, j, d, between = brute(at, rad, ids, gap)
        got = {r.ball_id: r for r in spatial.neighbor_sums(b, gap, near).collect()}
        assert set(got) == set(ids[i]) | set(ids[j])
        for k, r in got.items():
            on = np.concatenate([np.flatnonzero(ids[i] == k), np.flatnonzero(ids[j] == k)])
            assert (r.n, r.n_near) == (len(on), (between[on] <= near).sum())
            assert np.allclose((r.nearest_gap, r.mean_d, r.rmsd), (between[on].min(), d[on].mean(), d[on].std()), rtol=0, atol=1e-7)
        low, high = np.minimum(kind[i], kind[j]), np.maximum(kind[i], kind[j])
        sums = {(r.a_kind, r.b_kind): (r.n, r.overlap) for r in spatial.kind_sums(b, gap, "kind").collect()}
        for a, c in {*zip(low.tolist(), high.tolist(), strict=True), *sums}:
            on = (low == a) & (high == c)
            assert sums[a, c][0] == on.sum() and abs(sums[a, c][1] - np.maximum(-between[on], 0).sum()) < 1e-6


def test_listed_pairs_are_those_of_the_join(spark, monkeypatch):
    """Two bands of radii, ids that come twice; crowded balls are not joined as rows."""
    at, rad, b = dense(spark, 300)
    b = b.selectExpr("CASE WHEN ball_id = 7 THEN 8 ELSE ball_id END AS ball_id", "x", "y", "z", "CASE WHEN ball_id % 25 = 0 THEN 6.0D ELSE rad END AS rad")
    columns = spatial.range_join(b, 1.0).columns
    want = sorted(map(tuple, spatial.range_join(b, 1.0).collect()))
    monkeypatch.setattr(spatial, "range_join", None)
    fold = spatial.fold_within
    for each in (16, 8192):
        monkeypatch.setattr(spatial, "fold_within", lambda *args, each=each: fold(*args, each=each))
        got = sorted(map(tuple, spatial.listed_pairs(b, 1.0).select(columns).collect()))
        assert [r[:-1] for r in got] == [r[:-1] for r in want]
        assert np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=0, atol=1e-12)  # the radii are taken off in either order


def test_many_curved_cells_are_cut_in_little_time(spark):
    """Cells of 300 balls among their 120 nearest, against a sample of each cell's own directions: cutting them one polyhedron at a time took 50 ms each."""
    at, rad, _ = dense(spark, 1500)
    at, rad = at * 3, rad + 1e-8 * np.arange(1500) % 7e-8
    far = np.sqrt(((at[:300, None] - at[None]) ** 2).sum(2))
    order = far.argsort(1)[:, 1:121]
    own = [{"ball_id": i, "x": at[i, 0], "y": at[i, 1], "z": at[i, 2], "rad": rad[i], "reach": far[i, order[i, -1]]} for i in range(300)]
    near = [(o, at[o], rad[o]) for o in order]
    curved_cells.solve_cells(own[:20], near[:20], 40.0, rad.max())
    start = time.process_time()
    got = curved_cells.solve_cells(own, near, 40.0, rad.max()).to_pylist()
    assert time.process_time() - start < 300 * 0.02
    u = np.random.default_rng(1).normal(size=(4000, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for r, (ids, places, rads) in zip(got, near, strict=True):
        i = r["ball_id"]
        a, b, which, swallowed = curved_cells.functions(at[i], rad[i], places, rads)
        assert (r["status"] == "empty") == swallowed
        if not swallowed:
            value = u @ a.T + b
            seen = set(ids[which][np.unique(value.argmax(1)[value.max(1) > 1 / (40 + rad[i])])].tolist())
            assert seen <= set(r["faces"])
            for v in r["verts"]:
                gap = np.linalg.norm(places - [v["x"], v["y"], v["z"]], axis=1) - rads - v["rad"]
                assert gap.min() > -1e-6 and (np.abs(gap) < 1e-6).sum() >= 3


def test_edges_are_summed_as_arrays():
    """Sums along the edges of 20 cells equal those over many plain steps; a row an interval and node in Spark took 60 ms an edge."""
    rng = np.random.default_rng(3)
    at, rad = rng.normal(size=(400, 3)) * 5, rng.uniform(0.5, 1.5, 400)
    far = np.sqrt(((at[:20, None] - at[None]) ** 2).sum(2))
    order = far.argsort(1)[:, 1:200]
    own = [{"ball_id": i, "x": at[i, 0], "y": at[i, 1], "z": at[i, 2], "rad": rad[i], "reach": 1e9} for i in range(20)]
    cells = curved_cells.solve_cells(own, [(o, at[o], rad[o]) for o in order], 40.0, rad.max()).to_pylist()
    arcs = [(r["ball_id"], arc) for r in cells for arc in r["arcs"] if max(arc["a"].values()) < 1e3]
    e = {c: np.array([list(arc[c].values()) for _, arc in arcs]) for c in ("middle", "e1", "e2", "a")} | {c: np.array([arc[c] for _, arc in arcs]) for c in ("start", "stop", "b")}
    e |= {"p0": at[[i for i, _ in arcs]], "p1": at[[arc["o1"] for _, arc in arcs]], "p2": at[[arc["o2"] for _, arc in arcs]]}
    start = time.process_time()
    got = curved_measures.integrals(e, 1e-9, 30)
    assert time.process_time() - start < len(arcs) * 0.02
    steps = 20_000
    t = e["start"][:, None] + (np.arange(steps) + 0.5) / steps * (e["stop"] - e["start"])[:, None]
    for k in range(0, len(arcs), 10):
        want = curved_measures.integrands({c: v[k : k + 1] for c, v in e.items()}, t[k : k + 1])[0].mean(0) * (e["stop"] - e["start"])[k]
        assert np.allclose(got[k], want, rtol=1e-4, atol=1e-6)


def test_contacts_and_caps_between_kinds_list_no_pair(spark, monkeypatch):
    at, rad, b = dense(spark, 300)
    b = b.selectExpr("*", "CAST(ball_id % 3 AS int) AS kind")
    monkeypatch.setattr(spatial, "range_join", None)
    contacts, caps = {}, {}
    for i in range(300):
        for j in range(i + 1, 300):
            d = float(np.sqrt(((at[i] - at[j]) ** 2).sum()))
            gap, kinds = d - rad[i] - rad[j], (i % 3, j % 3)
            if gap <= 0.5 and kinds[0] != kinds[1]:
                s = contacts.setdefault(tuple(sorted(kinds)), [0, 0, 0.0, np.inf])
                s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + (gap < 0), s[2] + max(-gap, 0.0), min(s[3], gap)
            if gap <= 0 and kinds[0] != kinds[1]:
                s = caps.setdefault(kinds, [0, 0.0])
                s[0] += 1
                s[1] += sum(2 * np.pi * x * min(max((y * y - (d - x) ** 2) / (2 * d), 0.0), 2 * x) for x, y in ((rad[i], rad[j]), (rad[j], rad[i])))
    for each in (8192, 16):
        monkeypatch.setattr(spatial, "fold_within", lambda *a, fold=spatial.fold_within, each=each: fold(*a, each=each))
        got = {(r.side_a, r.side_b): [r.n_contacts, r.n_overlaps, r.overlap, r.closest] for r in spatial.contact_sums(b, 0.5, "kind").collect()}
        assert got.keys() == contacts.keys() and all(np.allclose(got[k], contacts[k]) for k in got)
        got = {(r.a_kind, r.b_kind): [r.n_pairs, r.cap_area] for r in spatial.cap_sums(b, "kind").collect()}
        assert got.keys() == caps.keys() and all(np.allclose(got[k], caps[k]) for k in got)
        monkeypatch.undo()
        monkeypatch.setattr(spatial, "range_join", None)


def test_second_neighbours_are_counted_without_pairs(spark, monkeypatch):
    at, rad, b = dense(spark, 700)
    near = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) - rad[:, None] - rad <= -1.0
    np.fill_diagonal(near, False)
    two = (near.astype(int) @ near.astype(int) > 0) & ~near
    np.fill_diagonal(two, False)
    monkeypatch.setattr(spatial, "range_join", None)
    for each in (2048, 20):
        got = {r.ball_id: r.n_second for r in spatial.count_second(b, -1.0, each).collect()}
        assert got == {i: int(n) for i, n in enumerate(two.sum(1)) if n}
