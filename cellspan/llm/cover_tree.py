"""Pairs of vectors above a cosine, by dual traversal of cover trees.

Distances are chords between unit vectors, so a cosine is a distance. Vectors are dealt to the nearest of a bounded sample of
pivots, and each pivot's cell, cut into pieces of bounded size, gets cover trees: nested levels of centres whose radii halve, every
node with its true covering radius. A pair of cells, then of nodes, is left out when its centres are further apart than the radii and
the threshold together; it is taken whole when all its points must be close; else its children meet. Lone points of two nodes
meet in one matrix product. Nothing is approximate: what is not ruled out by a bound is compared in doubles."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm import graph
from cellspan.llm.common import materialize, pieces, skewed_join
from cellspan.llm.vectors import dimensions, matrix, usable

#: Rounding of chords never changes what a bound rules out or takes whole; products of floats only pick what doubles then judge.
SLACK, FLOAT_SLACK = 1e-6, 2e-3
SMALLEST = 1e-4
#: Groups of fewer points are no node: these points stand for themselves, as one matrix product costs less than many visits.
NODE = 32
LAST = (1 << 63) - 1


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that squares neither overflow nor vanish."""
    v = v / np.maximum(np.abs(v).max(1, initial=0.0), np.finfo(float).tiny)[:, None]
    return v / np.maximum(np.linalg.norm(v, axis=1), np.finfo(float).tiny)[:, None]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Tree:
    """A cover tree over the rows of `at` (unit vectors, put in the tree's order). Node k has the points lo[k] .. hi[k], the
    first being its centre; kids[k] .. kids[k] + n_kids[k] are its children, and its points from lone[k] on stand for
    themselves. Children's centres are further apart than their level's radius, at most half of the node's level's."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, weight: np.ndarray, nodes: dict[str, np.ndarray]) -> None:
        self.at, self.keys, self.weight = at, keys, weight
        self.lo, self.hi, self.rad, self.kids, self.n_kids, self.lone = (nodes[c] for c in ("lo", "hi", "rad", "kids", "n_kids", "lone"))
        self.rough = at.astype(np.float32)

    @staticmethod
    def net(at: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray]:
        """Points parted into groups within radius of their first member; first members are further apart than that."""
        groups, near = [], 1 - radius * radius / 2
        while len(points):
            open_ = np.ones(len(points), bool)
            close = at[points] @ at[points[:128]].T >= near
            for k in range(close.shape[1]):
                if open_[k]:
                    own = close[:, k] & open_
                    own[k] = open_[k] = False
                    groups.append(np.append(points[k], points[own]))
                    open_ &= ~own
            points = points[open_]
        return groups

    @classmethod
    def grow(cls, at: np.ndarray, keys: np.ndarray, weight: np.ndarray) -> Tree:
        order = np.arange(len(at))
        nodes: dict[str, list] = {c: [] for c in ("lo", "hi", "rad", "kids", "n_kids", "lone")}

        def add(lo: int, hi: int) -> None:
            for c, v in (("lo", lo), ("hi", hi), ("rad", 0.0), ("kids", 0), ("n_kids", 0), ("lone", lo)):
                nodes[c].append(v)

        add(0, len(at))
        todo = [(0, 2.0)]
        while todo:
            k, level = todo.pop()
            lo, hi = nodes["lo"][k], nodes["hi"][k]
            points = order[lo:hi]
            nodes["rad"][k] = rad = float(chord(at[points] @ at[points[0]]).max())
            if len(points) < NODE or rad < SMALLEST:
                continue  # all points are lone
            while level >= rad:  # levels at which the node would be its only child
                level /= 2
            first, *rest = cls.net(at, points, level)
            # the centre's own child comes first and is a node even if it is alone
            if len(first) < NODE:
                rest, first = [*rest, first[1:]], first[:1]
            groups = [first, *sorted((g for g in rest if len(g) >= NODE), key=len, reverse=True)]
            order[lo:hi] = np.concatenate([*groups, *(g for g in rest if len(g) < NODE)])
            nodes["kids"][k], nodes["n_kids"][k] = len(nodes["lo"]), len(groups)
            for g in groups:
                todo.append((len(nodes["lo"]), level))
                add(lo, lo + len(g))
                lo += len(g)
            nodes["lone"][k] = lo
        return cls(at[order], keys[order], weight[order], {c: np.array(v, float if c == "rad" else np.int64) for c, v in nodes.items()})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, at=self.at, keys=self.keys, weight=self.weight, lo=self.lo, hi=self.hi, rad=self.rad, kids=self.kids, n_kids=self.n_kids, lone=self.lone)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        held = np.load(io.BytesIO(data))
        return cls(held["at"], held["keys"], held["weight"], held)


class Meeting:
    """All pairs of points of two trees (or of one tree with itself) at a cosine of at least `cosine`."""

    def __init__(self, a: Tree, b: Tree | None, cosine: float, listed: bool = False) -> None:
        """With listed, pairs() holds every pair; else links and edges hold counts and what connects the points."""
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.cosine, self.reach, self.listed = cosine, float(np.sqrt(max(2 - 2 * cosine, 0))), listed
        self.links = [np.zeros(len(a.at), np.int64)]
        self.links.append(self.links[0] if self.same else np.zeros(len(b.at), np.int64))
        self.shift = 0 if self.same else len(a.at)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.todo: list[tuple] = [("self", 0)] if self.same else []
        if not self.same:
            self._judge(np.zeros(1, np.int64), np.zeros(1, np.int64), a.at[:1] @ b.at[:1].T)
        while self.todo:
            kind, *more = self.todo.pop()
            getattr(self, f"_{kind}")(*more)

    def _linked(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of single points."""
        np.add.at(self.links[0], i, self.b.weight[j])
        np.add.at(self.links[1], j, self.a.weight[i])
        self.edges.append((i, j + self.shift))
        if len(self.edges) > 64:
            self.edges = [forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True)), self.shift + len(self.b.at))]
        if self.listed:
            self.found.append((i, j))

    def _whole(self, a: slice, b: slice) -> None:
        """Every point of a with every one of b, which are apart or the same."""
        if self.same and a == b:
            self.links[0][a] += int(self.a.weight[a].sum()) - self.a.weight[a]
        else:
            self.links[0][a] += int(self.b.weight[b].sum())
            self.links[1][b] += int(self.a.weight[a].sum())
        i, j = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
        self.edges.append((np.append(i, np.full(len(j), a.start)), np.append(np.full(len(i), b.start), j) + self.shift))
        if self.listed:
            x, y = np.repeat(i, len(j)), np.tile(j, len(i))
            keep = x < y if self.same and a == b else slice(None)
            self.found.append((x[keep], y[keep]))

    def _singles(self, i: np.ndarray | slice, j: np.ndarray | slice, half: bool = False, rows: int = 512) -> None:
        """Single points against each other; half: the same points, each pair once."""
        i, j = (np.arange(x.start, x.stop) if isinstance(x, slice) else x for x in (i, j))
        other = self.b.rough[j].T
        for k in range(0, len(i), rows):
            x, y = np.nonzero(self.a.rough[i[k : k + rows]] @ other >= self.cosine - FLOAT_SLACK)
            x, y = i[k + x], j[y]
            if half:
                x, y = x[x < y], y[x < y]
            for c in range(0, len(x), 100_000):
                p, q = x[c : c + 100_000], y[c : c + 100_000]
                sure = (self.a.at[p] * self.b.at[q]).sum(1) >= self.cosine
                if sure.any():
                    self._linked(p[sure], q[sure])

    def _judge(self, i: np.ndarray, j: np.ndarray, cosines: np.ndarray, upper: bool = False) -> None:
        """Nodes i of a against nodes j of b: far ones are left, close ones taken whole, the others meet."""
        d, r = chord(cosines), self.a.rad[i][:, None] + self.b.rad[j][None]
        near = d <= self.reach + r + SLACK
        for x, y in zip(*np.nonzero(np.triu(near, 1) if upper else near), strict=True):
            p, q = i[x], j[y]
            if d[x, y] + r[x, y] <= self.reach - SLACK:
                self._whole(slice(self.a.lo[p], self.a.hi[p]), slice(self.b.lo[q], self.b.hi[q]))
            else:
                self.todo.append(("both", p, q))

    def _points(self, side: int, nodes: np.ndarray, points: np.ndarray) -> None:
        """Nodes of one tree against single points of the other."""
        if not len(nodes) or not len(points):
            return
        t, o = (self.a, self.b) if side == 0 else (self.b, self.a)
        for c in range(0, len(points), 8192):
            part = points[c : c + 8192]
            d = chord(t.at[t.lo[nodes]] @ o.at[part].T)
            whole = d + t.rad[nodes][:, None] <= self.reach - SLACK
            near = (d <= self.reach + t.rad[nodes][:, None] + SLACK) & ~whole
            for k, node in enumerate(nodes):
                for p in part[whole[k]].tolist():
                    of, at = slice(t.lo[node], t.hi[node]), slice(p, p + 1)
                    self._whole(of, at) if side == 0 else self._whole(at, of)
                if near[k].any():
                    self.todo.append(("into", side, node, part[near[k]]))

    def _into(self, side: int, node: int, points: np.ndarray) -> None:
        t = self.a if side == 0 else self.b
        lone = slice(t.lone[node], t.hi[node])
        self._singles(lone, points) if side == 0 else self._singles(points, lone)
        self._points(side, np.arange(t.kids[node], t.kids[node] + t.n_kids[node]), points)

    def _both(self, p: int, q: int) -> None:
        a, b = self.a, self.b
        i, j = np.arange(a.kids[p], a.kids[p] + a.n_kids[p]), np.arange(b.kids[q], b.kids[q] + b.n_kids[q])
        s, t = np.arange(a.lone[p], a.hi[p]), np.arange(b.lone[q], b.hi[q])
        self._singles(s, t)
        self._points(0, i, t)
        self._points(1, j, s)
        if len(i) and len(j):
            self._judge(i, j, a.at[a.lo[i]] @ b.at[b.lo[j]].T)

    def _self(self, p: int) -> None:
        a = self.a
        if 2 * a.rad[p] <= self.reach - SLACK:
            if a.hi[p] - a.lo[p] > 1:
                self._whole(*[slice(a.lo[p], a.hi[p])] * 2)
            return
        i, s = np.arange(a.kids[p], a.kids[p] + a.n_kids[p]), np.arange(a.lone[p], a.hi[p])
        self._singles(s, s, half=True)
        self._points(0, i, s)
        if len(i):
            self._judge(i, i, a.at[a.lo[i]] @ a.at[a.lo[i]].T, upper=True)
        self.todo += [("self", k) for k in i]

    def connected(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of both ends of a forest with the components of all links: fewer edges than points."""
        if not self.edges:
            return self.a.keys[:0], self.a.keys[:0]
        i, j = forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True)), self.shift + len(self.b.at))
        keys = self.a.keys if self.same else np.concatenate([self.a.keys, self.b.keys])
        return keys[i], keys[j]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*self.found, strict=True)) if self.found else [np.empty(0, np.int64)] * 2
        return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of 0 .. n with the same components, one for each point that is not its component's least."""
    least = np.arange(n)
    while True:
        x, y = least[i], least[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(least, high[open_], low[open_])
        while (least[least] != least).any():
            least = least[least]
    moved = np.flatnonzero(least != np.arange(n))
    return moved, least[moved]


KEYS = ("id", "h1", "h2")


def classes_of(rows: DataFrame) -> DataFrame:
    """rows(id, h1, h2, v) to a row for each different vector, w being how many have it and id the smallest of theirs."""
    return rows.groupBy("h1", "h2").agg(F.min(F.coalesce("id", F.lit(LAST))).alias("id"), F.count("*").alias("w"), F.first("v").alias("v"))


def hashed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2, usable): two hashes are 128 bits, so that no two different vectors of any corpus are taken for one."""
    v = F.col(vector_col)
    ok = usable(v) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), F.coalesce(ok, F.lit(False)).alias("usable"))


def _trees(classes: DataFrame, dims: int, block: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(cell, piece, tree) of all classes, and the pairs of pieces (ca, pa, cb, pb) that might have close points, each once."""
    spark = classes.sparkSession
    n = classes.count()
    k = min(pivots, max(1, -(-2 * n // block)))
    sample = classes.orderBy("h1", "h2").limit(k).select("v").toArrow()  # at most `pivots` vectors
    centres = unit(matrix(sample.column("v"), dims))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096, 16_000_000):
            at = unit(matrix(b.column("v"), dims))
            both = at @ centres.T
            cell = both.argmax(1)
            away = chord(both[np.arange(len(at)), cell])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], names=[*b.schema.names, "cell", "away"])

    kind = dict(classes.dtypes)["v"]
    in_cells = classes.mapInArrow(dealt, f"h1 long, h2 long, id long, w long, v {kind}, cell long, away double")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # a row a pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    parts = -(-size // block)
    piece = F.pmod("h2", F.element_at(F.array(*[F.lit(max(1, x)) for x in parts.tolist()]), (F.col("cell") + 1).cast("int"))) if len(parts) else F.lit(0).cast("long")

    def grown(group: pa.Table) -> pa.Table:
        keys = np.column_stack([group.column(c).to_numpy() for c in KEYS])
        tree = Tree.grow(unit(matrix(group.column("v"), dims)), keys, group.column("w").to_numpy())
        return pa.table({"cell": group.column("cell")[:1], "piece": group.column("piece")[:1], "tree": pa.array([tree.dump()], pa.binary())})

    trees = in_cells.withColumn("piece", piece.cast("long")).groupBy("cell", "piece").applyInArrow(grown, "cell long, piece long, tree binary")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in b.column(0).to_pylist():
                others = np.flatnonzero((chord(centres @ centres[a]) <= reach + radius + radius[a] + SLACK) & (parts > 0) & (np.arange(len(parts)) >= a) & (parts[a] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), x)) for x in (a, parts[a])] + [pa.array(others), pa.array(parts[others])], names=["ca", "na", "cb", "nb"])

    def tiles(cosine: float) -> DataFrame:
        nonlocal reach
        reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
        cells = spark.range(len(centres)).mapInArrow(near, "ca long, na long, cb long, nb long")
        of_a = cells.withColumn("pa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)))
        first = F.when(F.col("ca") == F.col("cb"), F.col("pa")).otherwise(F.lit(0).cast("long"))
        return of_a.withColumn("pb", F.explode(F.sequence(first, F.col("nb") - 1))).select("ca", "pa", "cb", "pb")

    reach = 0.0
    return trees, tiles


def _meet(trees: DataFrame, tiles: DataFrame, cosine: float, listed: bool) -> DataFrame:
    """What each pair of pieces finds: counts of links by point and edges that connect, or, with listed, all pairs."""
    tile = ["ca", "pa", "cb", "pb"]
    asked = tiles.select(F.col("ca").alias("cell"), F.col("pa").alias("piece"), F.lit(0).alias("side"), *tile).union(
        tiles.where("ca != cb OR pa != pb").select("cb", "pb", F.lit(1), *tile)
    )
    # rows of trees stream past the hashed requests; a group is one or two of them
    sent = trees.join(asked.hint("shuffle_hash"), ["cell", "piece"]).select(*tile, "side", "tree")

    def run(group: pa.Table) -> pa.Table:
        held = {s: Tree.load(t) for s, t in zip(group.column("side").to_pylist(), group.column("tree").to_pylist(), strict=True)}
        met = Meeting(held[0], held.get(1), cosine, listed)
        if listed:
            i, j = met.pairs()
            return table(met.a.keys[i], met.b.keys[j], (met.a.at[i] * met.b.at[j]).sum(1))
        out = []
        for tree, links in zip((met.a, met.b)[: 1 if met.same else 2], met.links, strict=False):
            own = np.flatnonzero(links)
            out.append(table(tree.keys[own], None, links[own].astype(float)))
        return pa.concat_tables([*out, table(*met.connected(), None)])

    def table(a: np.ndarray, b: np.ndarray | None, value: np.ndarray | None) -> pa.Table:
        columns = [*a.T, *([pa.nulls(len(a), pa.int64())] * 3 if b is None else b.T), pa.nulls(len(a), pa.float64()) if value is None else value]
        return pa.table([pa.array(np.ascontiguousarray(c)) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    names = [f"{s}_{c}" for s in "ab" for c in KEYS] + ["value"]
    return sent.groupBy(*tile).applyInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", value double")


def _found(vectors: DataFrame, cosine: float, block: int, pivots: int, listed: bool) -> tuple[DataFrame, DataFrame]:
    classes = materialize(classes_of(vectors.where("usable")))
    dims = dimensions(classes, "v")
    trees, tiles = _trees(classes, dims, block, pivots)
    return classes, materialize(_meet(materialize(trees), tiles(cosine), cosine, listed))


def close_pairs(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, pivots: int = 4096) -> DataFrame:
    """(a_id, b_id, cosine) of all pairs of different vectors at that cosine or above, a vector being named by the smallest id
    that has it. Rows with the same vector are not paired: membership says which they are. See near_duplicates()."""
    _, found = _found(hashed(vectors, id_col, vector_col), cosine, block, pivots, True)
    a, b = F.col("a_id"), F.col("b_id")
    return found.select(F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id"), F.col("value").alias("cosine"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, pivots: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors: how many other rows are at that cosine (above 0)
    or above, the smallest id that links reach, and whether it is the row's own.

    Vectors that are null or zero, or hold null or non-finite components, link with nothing. Shorter vectors count as
    followed by zeros. Rows with the same vector link with each other, repeated rows too; each counts. A null id is a row
    like any other but names a component only if no other id does. An empty table gives an empty table; other columns are
    not read.

    Equal vectors are one point with a weight, however many they are. The driver holds a sample of at most `pivots`
    vectors and a row for each; a task holds two trees of about `block` points. Groups taken whole give each point a count
    and one edge, so no group's pairs are written out. Trees, counts and edges are kept in the shared folder."""
    if not 0 < cosine <= 1:
        raise ValueError(f"cosine {cosine} is not above 0 and at most 1")
    own = hashed(vectors, id_col, vector_col)
    classes, found = _found(own, cosine, block, pivots, False)
    end = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in KEYS])
    joined = graph.components(found.where("value IS NULL").select(end("a").alias("a"), end("b").alias("b")))
    nothing = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    facts = classes.select("h1", "h2", "w", zero.alias("links"), F.col("id").alias("least"))
    facts = facts.union(found.where("value IS NOT NULL").select("a_h1", "a_h2", zero, F.col("value").cast("long"), nothing))
    facts = facts.union(joined.select("node.h1", "node.h2", zero, zero, "component.id"))
    known = facts.groupBy("h1", "h2").agg(F.sum("w").alias("times"), (F.sum("links") + F.sum("w") - 1).alias("n_links"), F.min("least").alias("least"))
    # hashes of rows that link with nothing are not looked up
    rows = own.where("usable").select("id", "h1", "h2")
    out = skewed_join(rows, materialize(known), ["h1", "h2"], rows.count())
    least = F.when(F.col("least") != LAST, F.col("least"))
    out = out.select(F.col("id").alias("vec_id"), "n_links", least.alias("component_id"))
    out = out.union(own.where("NOT usable").select("id", zero, "id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
t AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
l AS (SELECT DISTINCT u AS node, u AS c FROM t UNION SELECT t.v, l.c FROM l JOIN t ON t.u = l.node WHERE l.c < t.v),
c AS (SELECT node, min(c) AS c FROM l GROUP BY node), n AS (SELECT u, count(*) AS n FROM t GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id))::BIGINT AS component_id,
  e.vec_id <= coalesce(c.c, e.vec_id) AS kept FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
