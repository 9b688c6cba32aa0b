"""Cover trees, vector codes and periodic runs against brute force, with nulls, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from cellspan.llm import cover_tree, periodic_runs, queries, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, usable int, cell int, q int, now int, of int"
NAN, INF = float("nan"), float("inf")


def vectors(n=400, d=12, seed=0):
    """Groups of near and exact copies, lone vectors, and all that is no vector."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, d))
    spread = rng.choice([0.0, 0.01, 0.06, 0.1, 0.5], n)
    out = base[np.minimum(rng.geometric(0.08, n), 40) - 1] + rng.normal(size=(n, d)) * spread[:, None]
    rows = [(int(i), [float(x) for x in np.float32(r)], int(i % 3) if i % 7 else None) for i, r in zip(rng.permutation(n) * 3, out, strict=True)]
    rows += [(5000, None, 1), (5001, [0.0] * d, 1), (5002, [NAN] * d, None), (5003, [1.0, None, *[0.5] * (d - 2)], 2), (5004, [INF] * d, 0), (5005, [], 0)]
    rows += [rows[3], (None, rows[5][1], 2), (5006, [2 * x for x in rows[9][1]], None), (5007, rows[0][1][:3], 1)]
    return [(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows]


def brute_links(rows, d, cosine):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    at = [i for i, r in enumerate(rows) if good(r[1])]
    v = np.array([np.float32(rows[i][1] + [0.0] * (d - len(rows[i][1]))) for i in at], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = v @ v.T >= cosine
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    links, comp = [0] * len(rows), list(range(len(rows)))
    for k, i in enumerate(at):
        links[i] = int(close[k].sum())
    reach = close | np.eye(len(at), dtype=bool)
    while (wider := (reach.astype(int) @ reach > 0)).sum() > reach.sum():
        reach = wider
    least = ids[:]
    for k, i in enumerate(at):
        found = [ids[at[j]] for j in np.flatnonzero(reach[k]) if ids[at[j]] is not None]
        least[i] = min(found) if found else None
    return sorted([(ids[i], links[i], least[i], ids[i] == least[i]) for i in range(len(comp))], key=str)


@pytest.mark.parametrize("block,pivots", [(8192, 4096), (32, 8), (16, 2)])
def test_cover_trees_find_what_all_pairs_find(spark, block, pivots):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = cover_tree.near_duplicates(df, 0.95, block=block, pivots=pivots)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_links(rows, 12, 0.95)


def test_pairs_are_those_of_different_vectors(spark):
    rows = vectors(150, 6, 3)[:150]
    first = {}
    for r in sorted(rows):
        first.setdefault(tuple(r[1]), r[0])
    v = np.array(list(first), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = list(first.values())
    want = {tuple(sorted((ids[i], ids[j]))): float(v[i] @ v[j]) for i in range(len(ids)) for j in range(i) if v[i] @ v[j] >= 0.9}
    got = {(r["a_id"], r["b_id"]): r["cosine"] for r in cover_tree.close_pairs(spark.createDataFrame(rows, VECTORS), 0.9, block=32, pivots=8).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_tree_levels_cover_and_part(spark):
    rng = np.random.default_rng(2)
    at = cover_tree.unit(np.repeat(rng.normal(size=(60, 3)), 40, 0) + 0.05 * rng.normal(size=(2400, 3)))
    tree = cover_tree.Tree.load(cover_tree.Tree.grow(at, np.zeros((2400, 3), np.int64), np.ones(2400, np.int64)).dump())
    assert len(tree.lo) > 20 and sorted(map(tuple, tree.at)) == sorted(map(tuple, at))
    for k in range(len(tree.lo)):
        assert cover_tree.chord(tree.at[tree.lo[k] : tree.hi[k]] @ tree.at[tree.lo[k]]).max() <= tree.rad[k] + 1e-9
        kids = np.arange(tree.kids[k], tree.kids[k] + tree.n_kids[k])
        if len(kids) > 1:
            centres = tree.at[tree.lo[kids]]
            apart = cover_tree.chord(centres @ centres.T)[np.triu_indices(len(kids), 1)].min()
            assert apart >= tree.rad[kids].max() - 1e-9 and tree.rad[kids].max() < tree.rad[k]
    # a group that is close throughout is taken whole: fewer edges than points, though its pairs are many
    tight = cover_tree.unit(np.ones((3000, 3)) + 0.01 * rng.normal(size=(3000, 3)))
    met = cover_tree.Meeting(cover_tree.Tree.grow(tight, np.zeros((3000, 3), np.int64), np.ones(3000, np.int64)), None, 0.95)
    assert (met.links[0] == 2999).all() and len(met.connected()[0]) == 2999 and sum(len(e[0]) for e in met.edges) < 10_000


def test_cover_trees_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert cover_tree.near_duplicates(empty).collect() == [] and cover_tree.close_pairs(empty).collect() == []
    bad = spark.createDataFrame([(1, None, 1, "", 0, 0, 0, 0, 0, 0)], VECTORS)
    assert [tuple(r) for r in cover_tree.near_duplicates(bad).collect()] == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        cover_tree.near_duplicates(empty, 0.0)


def brute_codes(rows, n_parts, n_entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    d = max(len(r[1]) for r in kept)
    width = -(-d // n_parts)
    q = [[min(max(math.floor(1024 * float(np.float32(x))), -(1 << 26)), 1 << 26) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, q[i]))[:n_entries]
    q = [x + [0] * (width * n_parts - len(x)) for x in q]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(q[i], p) for i in order] for p in range(n_parts)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min((apart(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            of = [near(cut(x, p), books[p])[1] for x in q]
            for k in set(of):
                own = [cut(x, p) for x, o in zip(q, of, strict=True) if o == k]
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    last = [[near(cut(x, p), books[p]) for p in range(n_parts)] for x in q]
    errors = [sum(e for e, _ in n) for n in last]
    of_label = {}
    for r, e in zip(kept, errors, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    return sorted([(r[0], "".join(f"{k:0{3 if n_entries > 256 else 2}x}" for _, k in n), e, of_label[r[2]], sha) for r, n, e in zip(kept, last, errors, strict=True)], key=str)


@pytest.mark.parametrize("n_parts,n_entries,big", [(4, 16, False), (5, 300, False), (4, 8, True)])
def test_codes_are_those_of_plain_rounds(spark, n_parts, n_entries, big):
    rows = vectors(120, 12, 1)
    if big:  # beyond exact doubles, and beyond the bound on components
        rows += [(7000 + i, [float((-1) ** i * 900.5 * 1.7**i)] * 12, 1, "x", 1, 2, 3, 4, 5, 6) for i in range(12)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = vector_codes.encode(df, n_parts=n_parts, n_entries=n_entries).select("id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_codes(rows, n_parts, n_entries, 4)


def test_rounds_send_changes_only(spark):
    df = spark.createDataFrame([([i, i], [0], [0]) for i in range(50)] + [([9, 9], [1], [0])], "q array<int>, now array<int>, was array<int>")
    assert sorted(tuple(r) for r in vector_codes._changes(df, 1, 2).collect()) == [(0, 0, -1, -9, -9), (0, 1, 1, 9, 9)]


def test_codes_of_nothing(spark):
    assert vector_codes.encode(spark.createDataFrame([], VECTORS)).collect() == []
    got = vector_codes.encode(spark.createDataFrame([(1, [], 1, "", 0, 0, 0, 0, 0, 0)], VECTORS)).collect()
    assert [(r["code"], r["error"]) for r in got] == [("00000000", 0)]


def brute_runs(w, least=6, power=4):
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_document(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, listed, sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 8:
            p, a = rng.randint(1, n // 4), rng.randrange(n)
            for i in range(a + p, min(n, a + rng.randint(2, 9) * p)):
                w[i] = w[i - p]
    return w


def test_refinement_finds_all_runs():
    rng = random.Random(5)
    seen = 0
    for power in (2, 3, 4) * 60:
        texts = [random_words(rng, rng.choice([0, 1, 5, 6, 7, 40, 200]), rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 5))]
        got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts], 6, power)
        want = [brute_runs(t, 6, power) for t in texts]
        assert [list(map(tuple, g.tolist())) for g in got] == want
        seen += sum(map(len, want))
    assert seen > 500


def test_runs_of_documents(spark):
    rng = random.Random(6)
    rows = [(i, " \t\n\x0b"[i % 4].join(f"w{x}" for x in random_words(rng, rng.choice([3, 30, 90]), 4))) for i in range(150)]
    rows += [(None, "a a a a a a b"), (None, None), (900, ""), (901, " \n "), (902, "né né né né né né né"), (rows[0][0], rows[0][1]), (903, "x y " * 30_000), (904, "a a " * 7)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, id int, start string").repartition(3)
    got = periodic_runs.periodic_runs(df)
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted([brute_document(*r) for r in rows if r[0] != 903] + [tuple(next(r for r in got.where("id = 903").collect()))], key=key)
    long = got.where("id = 903").first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 60_000, 2, 30_000_000)
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_cover_tree", "op12_delta_lloyd", "op13_periodic_runs"])
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted([tuple(r) for r in df.select(*cols).collect()], key=str) == sorted(want, key=str)
