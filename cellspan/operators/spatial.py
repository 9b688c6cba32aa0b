"""Range joins, neighbours and grids over balls."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.functions import geometry as G


def named(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c.removeprefix('ball_')}") for c in ("ball_id", "x", "y", "z", "rad", *more)])


def cell(prefix: str, size: float | Column) -> list[Column]:
    return [F.floor(F.col(f"{prefix}_{k}" if prefix else k) / size).cast("long").alias(f"c{k}") for k in "xyz"]


def around(df: DataFrame, prefix: str, size: float | Column, reach: int = 1) -> DataFrame:
    """A row for each grid cell at most reach cells away: what lies within size * reach is in one of them."""
    steps = F.array(*[F.lit(i).cast("long") for i in range(-reach, reach + 1)])
    out = df.select("*", *[c.alias(f"o{k}") for k, c in zip("xyz", cell(prefix, size), strict=True)])
    for k in "xyz":
        out = out.withColumn(f"s{k}", F.explode(steps)).withColumn(f"c{k}", F.col(f"o{k}") + F.col(f"s{k}"))
    return out.drop("ox", "oy", "oz", "sx", "sy", "sz")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 200, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches whose rows hold arrays, cut into runs of few rows and, but for a row that is longer by itself, few bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def dealt(df: DataFrame, rows: int, key: str, each: int = 500) -> DataFrame:
    """df dealt by key for work that is heavy for its bytes: so many partitions that each has about that many of the rows, and
    every core at least one. Counts of bytes would put all of it into a few tasks."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism * 4, -(-rows // each)), key)


#: Reaches are told apart by this factor: balls of one level look into grid cells of one size.
STEP = 1.5


def close_reach(balls: DataFrame, most: float, wanted: float = 7.0, steps: int = 12) -> float:
    """A reach of at most `most` within which a ball has some dozens of others where balls lie close: the largest of the tried ones
    whose grid cells hold no more than `wanted` places, as most balls see it. Copies in one place count once."""
    sizes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(most / STEP**k).alias("size")) for k in range(steps)])
    rows = balls.select("x", "y", "z").distinct().select("*", F.explode(sizes).alias("s")).select("*", "s.k", "s.size")
    held = rows.groupBy("k", *cell("", F.col("size"))).agg(F.count("*").alias("n"))
    mean = held.groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n"))
    first = mean.where(F.col("n") <= wanted).agg(F.min("k")).first()[0]
    return most / STEP ** (steps - 1 if first is None else first)


def gathered(todo: DataFrame, other: DataFrame, count: int, cuts: Callable[[dict, np.ndarray, np.ndarray], np.ndarray] | None = None, told: tuple[str, ...] = ("corners",)) -> DataFrame:
    """todo's rows (ball_id, x, y, z, rad, reach), each with near, an array of the other balls (q_id .., `count` of them) within its
    reach. Grid cells are as wide as the ball's own reach asks for, so one that looks far makes no other one do so. If few balls
    look, their cells would hold most of the others: then blocks of them meet blocks of the others instead. One shuffle by ball
    brings both together.

    If todo has inner, known and what cuts are told, then a block takes of the balls beyond inner only those for which cuts(row, places, radii)
    holds, and of those within it the known ids alone; where inner is null it takes all."""
    n, more = todo.count(), [c for c in ("inner", "known", *told) if c in todo.columns]
    own = [c for c in todo.columns if c not in ("ball_id", *more)]
    if n * 8 <= count:
        rows = _meet_in_blocks(todo, n, other, count, cuts)
    else:
        level = F.ceil(F.log(F.greatest(F.col("reach"), F.lit(1e-9))) / math.log(STEP)).cast("int")
        levels = sorted(r[0] for r in todo.select(level.alias("level")).distinct().collect()) or [0]
        size = F.pow(F.lit(STEP), F.col("level")) * (1 + 1e-9)
        a = todo.select(F.col("ball_id").alias("a_id"), level.alias("level"), *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "z", "reach")])
        q = other.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        close = around(a, "a", size).join(q.select("*", *cell("q", size)), ["level", "cx", "cy", "cz"]).where("a_id <> q_id")
        d2 = sum(((F.col(f"a_{c}") - F.col(f"q_{c}")) * (F.col(f"a_{c}") - F.col(f"q_{c}")) for c in "xyz"), F.lit(0.0))
        close = close.where(d2 <= F.col("a_reach") * F.col("a_reach"))
        rows = close.select(F.col("a_id").alias("ball_id"), F.struct(F.col("q_id").alias("id"), *[F.col(f"q_{c}").alias(c) for c in ("x", "y", "z", "rad")]).alias("q"))
    rows = rows.unionByName(todo.select("ball_id", F.struct(*own).alias("own")), allowMissingColumns=True)
    both = dealt(rows, n, "ball_id").groupBy("ball_id").agg(F.first("own", ignorenulls=True).alias("own"), F.collect_list("q").alias("near"))
    return both.select("ball_id", "own.*", "near")


def _meet_in_blocks(todo: DataFrame, n: int, other: DataFrame, count: int, cuts: Callable | None) -> DataFrame:
    """(ball_id, q) of gathered(), from every pair of a block of todo's rows with one of the others."""
    n_a, n_q = n // 50 + 1, count // 8192 + 1
    block = lambda df, key, k, name: df.groupBy(F.pmod(F.xxhash64(key), F.lit(k)).alias(f"{name}_block")).agg(F.collect_list(F.struct(*df.columns)).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            q = batch.column("q").flatten()
            ids, rads = q.field("q_id").to_numpy(zero_copy_only=False), q.field("q_rad").to_numpy(zero_copy_only=False)
            at = np.column_stack([q.field(f"q_{c}").to_numpy(zero_copy_only=False) for c in "xyz"])
            whose, which = [], []
            for r in batch.column("a").flatten().to_pylist():
                d = at - np.array([r["x"], r["y"], r["z"]])
                d2 = (d * d).sum(1)
                on = np.flatnonzero((d2 <= r["reach"] * r["reach"]) & (ids != r["ball_id"]))
                if len(on) and r.get("inner") is not None:
                    beyond = d2[on] > r["inner"] * r["inner"]
                    kept = np.isin(ids[on], r["known"])
                    kept[beyond] = cuts(r, at[on[beyond]], rads[on[beyond]])
                    on = on[kept]
                whose.append(np.full(len(on), r["ball_id"]))
                which.append(on)
            take = np.concatenate(which)
            struct = pa.StructArray.from_arrays([pa.array(ids[take]), *[pa.array(at[take, k]) for k in range(3)], pa.array(rads[take])], ["id", "x", "y", "z", "rad"])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(whose).astype(np.int64)), struct], ["ball_id", "q"])

    both = block(todo, "ball_id", n_a, "a").crossJoin(block(other, "q_id", n_q, "q")).select("a", "q")  # blocks, not balls
    return both.repartition(max(n_a * n_q // 4, 1)).mapInArrow(run, "ball_id long, q struct<id: long, x: double, y: double, z: double, rad: double>")


def pairs_within(balls: DataFrame, reach: float, *more: str) -> DataFrame:
    """Pairs a < b whose centres are at most reach apart, with their distance. An equi-join on grid cells of that size, so
    work is in proportion to the balls near each other; no ball meets those beyond its 27 cells."""
    a = around(named(balls, "a", *more), "a", reach)
    b = named(balls, "b", *more).select("*", *cell("b", reach))
    both = a.join(b, ["cx", "cy", "cz"]).where("a_id < b_id").withColumn("d", G.distance(G.point("a"), G.point("b")))
    return both.where(F.col("d") <= reach).drop("cx", "cy", "cz")


def band(r: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(r), F.lit(1e-9)))).cast("int")


def _levels(balls: DataFrame, gap: float) -> tuple[dict[int, float], Column]:
    """The bands of radii whose balls can be within gap of those of their own or smaller bands, with the side of their grid cells,
    and that side as a column of `level`."""
    # radii of doubles make at most two thousand bands, real ones a handful
    bands = sorted(r[0] for r in balls.where("rad IS NOT NULL").select(band("rad")).distinct().collect())
    sizes = {q: gap + 2.0 ** (q + 2) for q in bands if gap + 2.0 ** (q + 2) > 0} or {0: 1.0}
    return sizes, F.element_at(F.create_map(*[F.lit(x) for q, s in sizes.items() for x in (q, float(s))]), F.col("level"))


def range_join(balls: DataFrame, gap: float, *more: str) -> DataFrame:
    """Pairs a < b whose surfaces are at most gap apart, with d (centres) and gap (surfaces).

    Balls are banded by their radius, a band for each doubling. A ball looks among those of its own and of larger bands, in
    cells of the band's size; so a large ball makes the cells large for large balls only."""
    sizes, size = _levels(balls, gap)
    a = named(balls, "a", *more).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda q: q >= band("a_rad"))))
    a = around(a.withColumn("size", size), "a", F.col("size")).drop("size")
    b = named(balls, "b", *more).withColumn("level", band("b_rad"))
    b = b.withColumn("size", size).where("size IS NOT NULL").select("*", *cell("b", F.col("size"))).drop("size")
    both = a.join(b, ["level", "cx", "cy", "cz"]).withColumn("d", G.distance(G.point("a"), G.point("b")))
    both = both.withColumn("gap", F.col("d") - F.col("a_rad") - F.col("b_rad")).where((F.col("gap") <= gap) & (F.col("a_id") != F.col("b_id")))
    both = both.where((band("a_rad") < F.col("level")) | (F.col("a_id") < F.col("b_id")))
    # a pair of two bands was found from its smaller ball: the lesser id goes first
    turn = F.col("a_id") > F.col("b_id")
    sides = [c.removeprefix("a_") for c in a.columns if c.startswith("a_")]
    ordered = [F.when(turn, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in sides]
    return both.select(*ordered, "d", "gap")


def _held(balls: DataFrame, gap: float) -> tuple[DataFrame, float, float]:
    """The balls that can have neighbours at all, the side of cells whose balls are all within gap of each other (0 if there
    is none), and how far apart the centres of neighbours can be."""
    held = balls.where(" AND ".join(f"abs({c}) < 1e300" for c in ("x", "y", "z", "rad")))  # neither null nor NaN
    least, most = held.agg(F.coalesce(F.min("rad"), F.lit(0.0)), F.coalesce(F.max("rad"), F.lit(0.0))).first()
    return held, max((gap + 2 * least) / math.sqrt(3) * (1 - 1e-9), 0.0), max((gap + 2 * most) * (1 + 1e-9), 1e-9)


def component_links(balls: DataFrame, gap: float, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of balls whose surfaces are at most gap apart, enough of them for the components of all such pairs: work
    grows with the balls, not with their pairs. Balls of one small cell are linked to its first; two of each cell, the outermost,
    are joined by range; and then, of what components(edges) leaves apart, all pairs."""
    held, small, reach = _held(balls, gap)
    if not small:
        return range_join(held, gap).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    keys = ["cx", "cy", "cz"]
    placed = held.select("ball_id", "x", "y", "z", "rad", *cell("", small))
    outer = [F.min_by("ball_id", "x"), F.max_by("ball_id", "x")]
    per = placed.groupBy(*keys).agg(F.min("ball_id").alias("a"), F.array_distinct(F.array(*outer)).alias("picks")).checkpoint()
    stars = placed.join(per.select(*keys, "a"), keys).where("ball_id <> a").select("a", F.col("ball_id").alias("b"))
    picks = held.join(per.select(F.explode("picks").alias("ball_id")), "ball_id", "left_semi")
    links = stars.union(range_join(picks, gap).select("a_id", "b_id")).checkpoint()
    known = held.select("ball_id", "x", "y", "z", "rad").join(components(links).select(F.col("node").alias("ball_id"), "component"), "ball_id", "left")
    known = known.withColumn("component", F.coalesce("component", "ball_id")).checkpoint()
    spots = known.select("component", *[(c * reach).alias(k) for k, c in zip("xyz", cell("", reach), strict=True)]).distinct()
    mixed = around(spots.select("component", *[(F.col(k) + reach / 2).alias(k) for k in "xyz"]), "", reach).groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    apart = known.select("*", *cell("", reach)).join(mixed.where("lo < hi"), keys, "left_semi").drop(*keys)
    rest = range_join(apart, gap, "component").where("a_component <> b_component")
    return links.union(rest.select("a_id", "b_id"))


def _few_links(u: np.ndarray, v: np.ndarray, su: np.ndarray, sv: np.ndarray) -> np.ndarray:
    """Of links u - v between two groups su and sv at most four for each two groups, so that whichever node or link is taken away, two
    groups, and a node and a group, that were linked still are: the first, and one each that shares its u, its v, and neither."""
    order = np.lexsort((v, u, sv, su))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(su[order]) != 0) | (np.diff(sv[order]) != 0)
    group = np.cumsum(new) - 1
    first = order[new][group]
    kind = 2 * (u[order] != u[first]) + (v[order] != v[first])
    return order[np.unique(4 * group + kind, return_index=True)[1]]


def block_links(balls: DataFrame, gap: float) -> DataFrame:
    """Pairs (a, b) of balls whose surfaces are at most gap apart, enough of them for the articulation points, and the bridges, of all
    such pairs: work that follows grows with the balls and the small cells near each other, not with their pairs. All balls of one small
    cell are neighbours: each is linked to its first two, which hang together whichever ball goes. Of the pairs between two cells
    those of _few_links() stay."""
    held, small, _ = _held(balls, gap)
    held, keys = held.select("ball_id", "x", "y", "z", "rad"), ["cx", "cy", "cz"]
    if small:
        placed = held.select("*", *cell("", small))
        placed = placed.join(placed.groupBy(*keys).agg(F.min("ball_id").alias("spot")), keys).drop(*keys).checkpoint()
    else:
        placed = held.withColumn("spot", F.col("ball_id"))
    others = placed.where("ball_id <> spot").select("spot", "ball_id")
    second = others.groupBy("spot").agg(F.min("ball_id").alias("a"))
    inner = others.select("spot", "ball_id").union(others.join(second, "spot").where("ball_id <> a").select("a", "ball_id"))

    def fold(a: dict, b: dict, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        kept, fresh = np.zeros((4, 0), np.int64), []

        def thinned() -> np.ndarray:
            rows = np.concatenate([kept, *fresh], axis=1)
            return rows[:, _few_links(*rows)]

        for on, _, _, pair in tiles:
            i, j = np.nonzero(pair & (a["spot"][on, None] != b["spot"]))
            rows = np.array([a["ball_id"][on][i], b["ball_id"][j], a["spot"][on][i], b["spot"][j]])
            turn = rows[2] > rows[3]
            rows[:, turn] = rows[:, turn][[1, 0, 3, 2]]
            fresh.append(rows[:, _few_links(*rows)])
            if sum(x.shape[1] for x in fresh) > 1_000_000:
                kept, fresh = thinned(), []
        kept = thinned()
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["a", "b"])

    return inner.toDF("a", "b").union(fold_within(placed, gap, fold, "a long, b long", "spot"))


def layers_within(balls: DataFrame, gap: float, start: DataFrame) -> DataFrame:
    """(node, layer): start(node) is layer 0, each next layer the balls within gap of the last that are in none, until there are
    none. A ball that shares a small cell with one of the last layer is next to it; the others look for one, by a semi-join on
    grid cells, so no pair is listed or sent."""
    held, small, reach = _held(balls, gap)
    held = held.select("ball_id", "x", "y", "z", "rad")
    seen = start.select("node", F.lit(0).alias("layer")).distinct().checkpoint()
    on = held["ball_id"] == seen["node"]
    front, todo, layer = held.join(seen, on, "left_semi").checkpoint(), held.join(seen, on, "left_anti").checkpoint(), 0
    while not front.isEmpty():
        layer += 1
        direct = todo.select("ball_id", *cell("", small)).join(front.select(*cell("", small)).distinct(), ["cx", "cy", "cz"], "left_semi").select("ball_id").checkpoint() if small else None
        left = todo.join(direct, "ball_id", "left_anti") if small else todo
        a = around(named(left, "a"), "a", reach).alias("a")
        b = named(front, "b").select("*", *cell("b", reach)).alias("b")
        close = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cz") == F.col("b.cz"))
        near = G.distance(G.point("a"), G.point("b")) - F.col("a_rad") - F.col("b_rad") <= gap
        found = a.join(b, close & near, "left_semi").select(F.col("a_id").alias("ball_id")).distinct()
        found = (found.union(direct) if small else found).checkpoint()
        front, todo = todo.join(found, "ball_id", "left_semi").checkpoint(), todo.join(found, "ball_id", "left_anti").checkpoint()
        seen = seen.union(found.select("ball_id", F.lit(layer))).checkpoint()
    return seen


#: A tile of pairs: rows of the one block, distances of all the other's balls to them, gaps of surfaces (infinite for what another
#: tile has, or is the same ball), which of these are pairs.
Tile = tuple[slice, np.ndarray, np.ndarray, np.ndarray]


def fold_within(balls: DataFrame, gap: float, fold: Callable[[dict, dict, Iterator[Tile]], Iterator[pa.RecordBatch]], schema: str, *more: str, each: int = 8192) -> DataFrame:
    """What fold(a, b, tiles) makes of the pairs of range_join(balls, gap), a row's columns as in schema. No pair is listed or sent: balls
    of a grid cell are dealt to blocks of about `each`, and a block meets those of its own and the cells around, once each, as
    arrays. a and b hold the blocks' columns; the tiles hold all pairs of theirs, each once, whichever has the lesser id."""
    sizes, size = _levels(balls, gap)
    keys, columns = ["level", "own", "cx", "cy", "cz"], ["ball_id", "x", "y", "z", "rad", *more]
    rows = balls.select(*columns, F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda q: q >= band("rad"))).alias("level"))
    rows = rows.where(" AND ".join(f"abs({c}) < double('inf')" for c in "xyz") + " AND rad IS NOT NULL AND NOT isnan(rad)").select("*", (band("rad") == F.col("level")).alias("own"), *cell("", size))
    crowded = rows.groupBy(*keys).count().where(F.col("count") > each).select(*keys, F.ceil(F.col("count") / each).alias("parts"))  # few
    part = F.pmod(F.xxhash64("ball_id"), F.coalesce("parts", F.lit(1).cast("long")))
    blocks = rows.join(F.broadcast(crowded), keys, "left").groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.collect_list(F.struct(*columns)).alias("s")).checkpoint()
    # of two cells of one level, the first in order asks
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{k}") for k, v in zip("xyz", at, strict=True)]) for at in product((-1, 0, 1), repeat=3)])
    still = F.struct(*[F.lit(0).cast("long").alias(f"d{k}") for k in "xyz"])
    a = blocks.select("level", "own", *[F.col(f"c{k}").alias(f"o{k}") for k in "xyz"], F.col("part").alias("pa"), F.col("n").alias("na"), F.col("s").alias("a"), F.explode(steps).alias("step"))
    a = a.where(~F.col("own") | (F.col("step") >= still)).withColumns({f"c{k}": F.col(f"o{k}") + F.col(f"step.d{k}") for k in "xyz"})
    b = blocks.where("own").select("level", "cx", "cy", "cz", F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("s").alias("b"))
    alone = F.col("own") & (F.col("step") == still)
    both = a.join(b, ["level", "cx", "cy", "cz"]).where(~alone | (F.col("pa") <= F.col("pb"))).withColumn("same", alone & (F.col("pa") == F.col("pb")))
    sent = both.agg(F.coalesce(F.sum(F.col("na") + F.col("nb")), F.lit(0))).first()[0]

    def block(at: pa.ListScalar) -> dict:
        held = at.values
        return {c: held.field(c).to_numpy(zero_copy_only=False) for c in columns}

    def tiles(x: dict, y: dict, same: bool) -> Iterator[Tile]:
        # tiles stay in a core's cache, and their arrays are used again by the next
        n, m = len(x["ball_id"]), len(y["ball_id"])
        step = min(n, max(1, 65_536 // m))
        shared = len(np.unique(x["ball_id"])) < n if same else len(np.intersect1d(x["ball_id"], y["ball_id"])) > 0
        far, apart, more, found = np.empty((step, m)), np.empty((step, m)), np.empty((step, m)), np.empty((step, m), bool)
        for k in range(0, n, step):
            on = slice(k, min(k + step, n))
            d, between, t, pair = (v[: on.stop - k] for v in (far, apart, more, found))
            np.square(np.subtract(x["x"][on, None], y["x"], out=d), out=d)
            for c in "yz":
                np.add(d, np.square(np.subtract(x[c][on, None], y[c], out=t), out=t), out=d)
            np.sqrt(d, out=d)
            np.subtract(np.subtract(d, x["rad"][on, None], out=between), y["rad"], out=between)
            if same:
                between[np.arange(k, on.stop)[:, None] >= np.arange(m)] = np.inf
            if shared:
                between[x["ball_id"][on, None] == y["ball_id"]] = np.inf
            yield on, d, between, np.less_equal(between, gap, out=pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x, y = block(x), block(y)
                yield from fold(x, y, tiles(x, y, same))

    n = max(balls.sparkSession.sparkContext.defaultParallelism * 4, sent // (8 * each))
    return both.repartition(n, "level", "own", "ox", "oy", "oz", "step", "pa", "pb").select("a", "b", "same").mapInArrow(run, schema)


def listed_pairs(balls: DataFrame, gap: float) -> DataFrame:
    """range_join(balls, gap) for balls that crowd: blocks of balls are shuffled, and the pairs only leave their task as rows of the
    result, so no task sorts or holds a crowded cell's."""
    sides = [("id", "ball_id"), *[(c, c) for c in ("x", "y", "z", "rad")]]
    kind = dict(balls.dtypes)["ball_id"]
    schema = ", ".join([f"{p}_{c} {kind if c == 'id' else 'double'}" for p in "ab" for c, _ in sides] + ["d double", "gap double"])
    names = [x.split()[0] for x in schema.split(", ")]

    def fold(a: dict, b: dict, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for on, d, _, pair in tiles:
            i, j = np.nonzero(pair)
            turn = a["ball_id"][on][i] > b["ball_id"][j]  # the lesser id goes first
            x, y = ([side[c][at] for _, c in sides] for side, at in ((a, i + on.start), (b, j)))
            first, second = ([np.where(turn, v, u) if p == "a" else np.where(turn, u, v) for u, v in zip(x, y, strict=True)] for p in "ab")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*first, *second, d[i, j], d[i, j] - first[4] - second[4])], names)

    return fold_within(balls, gap, fold, schema)


def neighbor_sums(balls: DataFrame, gap: float, near: float) -> DataFrame:
    """(ball_id, n, n_near, nearest_gap, mean_d, rmsd) of each ball's neighbours, whose surfaces are at most gap apart (near: n_near):
    how many, the least gap, mean and standard deviation of the distances."""

    def fold(a: dict, b: dict, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        sides = [[np.zeros(len(x["ball_id"])), np.zeros(len(x["ball_id"])), np.full(len(x["ball_id"]), np.inf), *np.zeros((2, len(x["ball_id"])))] for x in (a, b)]
        for on, d, between, pair in tiles:
            far, close = np.multiply(d, pair, out=d), pair & (between <= near)
            ones = [np.ones(k) for k in far.shape]
            sums = [(far @ ones[1], between.min(1)), (ones[0] @ far, between.min(0))]
            squares_of = np.square(far, out=far)
            for (n, n_near, nearest, total, squares), where, axis in ((sides[0], on, 1), (sides[1], slice(None), 0)):
                n[where] += np.count_nonzero(pair, axis)
                n_near[where] += np.count_nonzero(close, axis)
                nearest[where] = np.minimum(nearest[where], sums[1 - axis][1])
                total[where] += sums[1 - axis][0]
                squares[where] += squares_of @ ones[1] if axis else ones[0] @ squares_of
        ids, cols = np.concatenate([a["ball_id"], b["ball_id"]]), [np.concatenate(x) for x in zip(*sides, strict=True)]
        has = cols[0] > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[has]), *[pa.array(c[has].astype(np.int64)) for c in cols[:2]], *[pa.array(c[has]) for c in cols[2:]]], ["ball_id", "n", "n_near", "least", "total", "squares"])

    kind = dict(balls.dtypes)["ball_id"]
    parts = fold_within(balls, gap, fold, f"ball_id {kind}, n long, n_near long, least double, total double, squares double")
    sums = parts.groupBy("ball_id").agg(*[F.sum(c).alias(c) for c in ("n", "n_near", "total", "squares")], F.min("least").alias("nearest_gap"))
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("ball_id", "n", "n_near", "nearest_gap", mean.alias("mean_d"), spread.alias("rmsd"))


def kind_sums(balls: DataFrame, gap: float, kind: str) -> DataFrame:
    """(a_kind, b_kind, n, overlap), a_kind <= b_kind: pairs whose surfaces are at most gap apart by the kinds (whole numbers) of both."""

    def fold(a: dict, b: dict, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        (ka, ia), (kb, ib) = (np.unique(x[kind], return_inverse=True) for x in (a, b))
        n, overlap = np.zeros((2, len(ka), len(kb)))
        of = np.eye(len(kb))[ib]
        for on, _, between, pair in tiles:
            np.add.at(n, ia[on], pair.astype(np.float64) @ of)
            np.add.at(overlap, ia[on], np.maximum(np.negative(between, out=between), 0.0, out=between) * pair @ of)
        i, j = np.nonzero(n)
        low, high = np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j])
        yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), pa.array(n[i, j].astype(np.int64)), pa.array(overlap[i, j])], ["a_kind", "b_kind", "n", "overlap"])

    parts = fold_within(balls, gap, fold, "a_kind long, b_kind long, n long, overlap double", kind)
    return parts.groupBy("a_kind", "b_kind").agg(F.sum("n").alias("n"), F.sum("overlap").alias("overlap"))


def contact_sums(balls: DataFrame, gap: float, kind: str) -> DataFrame:
    """(side_a, side_b, n_contacts, n_overlaps, overlap, closest), side_a < side_b: pairs of two kinds (whole numbers) whose surfaces are at
    most gap apart: how many, how many of these overlap, the sum of overlaps and the least gap."""

    def fold(a: dict, b: dict, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        (ka, ia), (kb, ib) = (np.unique(x[kind], return_inverse=True) for x in (a, b))
        n, lap, overlap = np.zeros((3, len(ka), len(kb)))
        closest = np.full((len(ka), len(kb)), np.inf)
        of, groups = np.eye(len(kb))[ib], [np.flatnonzero(ib == q) for q in range(len(kb))]
        for on, _, between, pair in tiles:
            np.add.at(n, ia[on], pair.astype(np.float64) @ of)
            for q, group in enumerate(groups):
                np.minimum.at(closest[:, q], ia[on], between[:, group].min(1))
            under = np.logical_and(pair, between < 0, out=pair)
            np.add.at(lap, ia[on], under.astype(np.float64) @ of)
            np.add.at(overlap, ia[on], np.where(under, -between, 0.0) @ of)
        i, j = np.nonzero((n > 0) & (ka[:, None] != kb))
        rows = [np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j]), n[i, j].astype(np.int64), lap[i, j].astype(np.int64), overlap[i, j], closest[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)

    names = ["side_a", "side_b", "n_contacts", "n_overlaps", "overlap", "closest"]
    kinds = dict(balls.dtypes)[kind]
    whole = balls.where(F.col(kind).isNotNull()).withColumn(kind, F.col(kind).cast("long"))
    parts = fold_within(whole, gap, fold, "side_a long, side_b long, n_contacts long, n_overlaps long, overlap double, closest double", kind)
    sums = parts.groupBy("side_a", "side_b").agg(*[F.sum(c).alias(c) for c in names[2:5]], F.min("closest").alias("closest"))
    return sums.withColumns({c: F.col(c).cast(kinds) for c in names[:2]})


def cap_sums(balls: DataFrame, kind: str, least: float = 1e-9) -> DataFrame:
    """(a_kind, b_kind, n_pairs, cap_area): of overlapping balls of two kinds (whole numbers), those of the lesser id first, with centres more
    than least apart, how many there are and the sum of the areas that either covers of the other's sphere."""

    def fold(a: dict, b: dict, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        kinds = np.unique(np.concatenate([a[kind], b[kind]]))
        ka, kb = (np.searchsorted(kinds, x[kind]) for x in (a, b))
        n, area = np.zeros((2, len(kinds) ** 2))
        cap = lambda r, other, d: 2 * np.pi * r * np.minimum(np.maximum((other * other - (d - r) * (d - r)) / (2 * d), 0.0), 2 * r)
        for on, far, _, pair in tiles:
            i, j = np.nonzero(pair & (far > least) & (ka[on, None] != kb))
            d, i = far[i, j], i + on.start
            turn = a["ball_id"][i] > b["ball_id"][j]
            code = np.where(turn, kb[j], ka[i]) * len(kinds) + np.where(turn, ka[i], kb[j])
            n += np.bincount(code, minlength=len(n))
            area += np.bincount(code, cap(a["rad"][i], b["rad"][j], d) + cap(b["rad"][j], a["rad"][i], d), len(n))
        on = np.flatnonzero(n)
        rows = [kinds[on // len(kinds)], kinds[on % len(kinds)], n[on].astype(np.int64), area[on]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["a_kind", "b_kind", "n_pairs", "cap_area"])

    own = dict(balls.dtypes)[kind]
    whole = balls.where(F.col(kind).isNotNull()).withColumn(kind, F.col(kind).cast("long"))
    parts = fold_within(whole, 0.0, fold, "a_kind long, b_kind long, n_pairs long, cap_area double", kind)
    sums = parts.groupBy("a_kind", "b_kind").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("cap_area").alias("cap_area"))
    return sums.withColumns({c: F.col(c).cast(own) for c in ("a_kind", "b_kind")})


def both_ways(pairs: DataFrame) -> DataFrame:
    """(ball_id, other, d, gap) for either end of each pair."""
    return pairs.select(F.col("a_id").alias("ball_id"), F.col("b_id").alias("other"), "d", "gap").union(pairs.select("b_id", "a_id", "d", "gap"))


def nearest(balls: DataFrame, k: int, start: float) -> DataFrame:
    """The k nearest balls by surface distance of each ball, rank from 1; ties by id. The first range is as short as the balls lie
    close, at most that of surfaces `start` apart. Only the balls that do not have k within it look further, in cells of twice the
    range; each round's result is kept, so no round runs twice. Of equal balls in one place the k + 1 first are enough for all."""
    count, largest = balls.agg(F.count("*"), F.coalesce(F.max("rad"), F.lit(0.0))).first()
    same = W.partitionBy("b_x", "b_y", "b_z", "b_rad").orderBy("b_id")
    others = named(balls, "b").withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy").checkpoint()
    # a ball asks for all others whose surface is so near its centre: no ball beyond reach has one, and its own radius is no matter
    found, todo, reach = None, balls, close_reach(balls, max(start, 0.0) + 2 * largest + 1e-6)
    while True:
        b = others.select("*", *cell("b", reach))
        both = around(named(todo, "a"), "a", reach).join(b, ["cx", "cy", "cz"]).where("a_id <> b_id").withColumn("d", G.distance(G.point("a"), G.point("b")))
        both = both.where(F.col("d") - F.col("b_rad") <= (reach - largest) - 1e-9 * (reach + largest))
        both = both.select(F.col("a_id").alias("ball_id"), F.col("b_id").alias("other"), "d", (F.col("d") - F.col("a_rad") - F.col("b_rad")).alias("gap"))
        near = both.withColumn("rank", F.row_number().over(W.partitionBy("ball_id").orderBy("gap", "other"))).where(F.col("rank") <= k).checkpoint()
        enough = near.groupBy("ball_id").count().where(F.col("count") >= min(k, count - 1)).select("ball_id")
        part = near.join(enough, "ball_id", "left_semi")
        found = part if found is None else found.union(part)
        todo = todo.join(enough, "ball_id", "left_anti").checkpoint()
        if count < 2 or todo.isEmpty():
            return found
        reach *= 2


def second_neighbors(pairs: DataFrame) -> DataFrame:
    """(ball_id, second): neighbours' neighbours that are neither the ball nor its neighbours."""
    one = both_ways(pairs).select("ball_id", "other")
    two = one.join(one.select(F.col("ball_id").alias("other"), F.col("other").alias("second")), "other").where("second <> ball_id").select("ball_id", "second").distinct()
    return two.join(one.select("ball_id", F.col("other").alias("second")), ["ball_id", "second"], "left_anti")


def count_second(balls: DataFrame, gap: float, each: int = 2048) -> DataFrame:
    """(ball_id, n_second): how many balls second_neighbors() has of each ball, for pairs whose surfaces are at most gap apart. No pair is
    listed or sent: the balls of a grid cell, in blocks of about `each`, get those of the 125 cells around as arrays, and which are
    reached over a neighbour is a product of matrices of few balls at a time."""
    if not balls.groupBy("ball_id").count().where("count > 1").isEmpty():  # one id in several places: its neighbours are those of all
        return second_neighbors(range_join(balls, gap)).groupBy("ball_id").agg(F.count("*").alias("n_second"))
    held, _, reach = _held(balls, gap)
    keys, columns = ["cx", "cy", "cz"], ["ball_id", "x", "y", "z", "rad"]
    placed = held.select(*columns, *cell("", reach))
    crowded = placed.groupBy(*keys).count().where(F.col("count") > each).select(*keys, F.ceil(F.col("count") / each).alias("parts"))  # few
    part = F.pmod(F.xxhash64("ball_id"), F.coalesce("parts", F.lit(1).cast("long")))
    blocks = placed.join(F.broadcast(crowded), keys, "left").groupBy(*keys, part.alias("part")).agg(F.collect_list(F.struct(*columns)).alias("s")).checkpoint()
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{k}") for k, v in zip("xyz", at, strict=True)]) for at in product(range(-2, 3), repeat=3)])
    a = blocks.select(*[F.col(k).alias(f"o{k[1]}") for k in keys], F.col("part").alias("pa"), F.explode(steps).alias("step")).withColumns({k: F.col(f"o{k[1]}") + F.col(f"step.d{k[1]}") for k in keys})
    own = (F.col("pa") == F.col("part")) & (F.col("step.dx") == 0) & (F.col("step.dy") == 0) & (F.col("step.dz") == 0)
    both = a.join(blocks, keys).select("ox", "oy", "oz", "pa", own.alias("own"), "s")

    def pairs(x: dict, y: dict) -> np.ndarray:
        d = np.square(x["x"][:, None] - y["x"])
        for c in "yz":
            d += np.square(x[c][:, None] - y[c])
        np.sqrt(d, out=d)
        d -= x["rad"][:, None]
        d -= y["rad"]
        return d <= gap

    def reached(i: dict, others: dict) -> np.ndarray:
        near = lambda x, k: np.logical_and.reduce([(x[c] >= i[c].min() - k * reach) & (x[c] <= i[c].max() + k * reach) for c in "xyz"])
        s = {c: v[near(others, 2 * (1 + 1e-9))] for c, v in others.items()}
        direct = pairs(i, s)
        direct[i["ball_id"][:, None] == s["ball_id"]] = False
        open_, n = ~direct & (i["ball_id"][:, None] != s["ball_id"]), np.zeros(len(i["ball_id"]), np.int64)
        over = np.flatnonzero(direct.any(0))
        over = over[(over * 2654435761 % 4294967296).argsort(kind="stable")]  # mixed, so that the first few reach most
        for at in range(0, len(over), 256):
            j, left = over[at : at + 256], np.flatnonzero(open_.any(0))
            to_j = direct[:, j].astype(np.float32)
            for k in range(0, len(left), 4096):
                some = left[k : k + 4096]
                hit = (to_j @ pairs({c: v[j] for c, v in s.items()}, {c: v[some] for c, v in s.items()}).astype(np.float32) > 0) & open_[:, some]
                n += hit.sum(1)
                open_[:, some] &= ~hit
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("blocks"):
                parts = row.values.field("s")
                is_own = row.values.field("own").to_numpy(zero_copy_only=False)
                take = lambda v: {c: v.field(c).to_numpy(zero_copy_only=False) for c in columns}
                others, mine = take(parts.flatten()), take(parts.filter(pa.array(is_own)).flatten())
                spot = [np.floor(mine[c] / (reach / 2)) for c in "xyz"]
                order = np.lexsort(spot)
                new = np.flatnonzero(np.logical_or.reduce([np.diff(v[order]) != 0 for v in spot])) + 1
                for group in np.split(order, new):
                    for k in range(0, len(group), 512):
                        i = {c: v[group[k : k + 512]] for c, v in mine.items()}
                        n = reached(i, others)
                        yield pa.RecordBatch.from_arrays([pa.array(i["ball_id"][n > 0]), pa.array(n[n > 0])], ["ball_id", "n_second"])

    grouped = both.repartition(max(balls.sparkSession.sparkContext.defaultParallelism * 4, blocks.count()), "ox", "oy", "oz", "pa").groupBy("ox", "oy", "oz", "pa").agg(F.collect_list(F.struct("own", "s")).alias("blocks"))
    return grouped.select("blocks").mapInArrow(run, f"ball_id {dict(balls.dtypes)['ball_id']}, n_second long")


def grid_occupancy(balls: DataFrame, size: float) -> DataFrame:
    return balls.groupBy(*cell("", size)).agg(F.count("*").alias("n_balls"), F.min("ball_id").alias("first_ball"))
