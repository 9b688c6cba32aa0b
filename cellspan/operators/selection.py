"""Selections of atoms, residues and chains, groups, and the set of balls that a network is built from.

Atoms have ball_id, pos (place from 0), name, element, res_name, res_seq, chain and a place in space; names compare without
case and blanks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.functions import chemistry as C


def atoms_where(name: str | None = None, element: str | None = None, between: tuple[int, int] | None = None, res_name: str | None = None, res_seq: int | None = None, chain: str | None = None) -> Column:
    """Atoms that meet all that is given; between has both ends in."""
    parts = [C.tidy(F.col(c)) == v.strip().upper() for c, v in (("name", name), ("element", element), ("res_name", res_name)) if v is not None]
    if chain is not None:
        parts.append(F.trim(F.col("chain").cast("string")) == chain.strip())
    if between is not None:
        parts.append(F.col("pos").between(*between))
    if res_seq is not None:
        parts.append(F.col("res_seq") == res_seq)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def whole_residues(atoms: DataFrame, picked: DataFrame) -> DataFrame:
    """All atoms of the residues that picked has an atom of."""
    key = ["chain", "res_seq", "res_name"]
    return atoms.join(picked.select(*key).distinct(), key, "left_semi").select(*atoms.columns)


def nth(atoms: DataFrame, of: str, first: int, last: int) -> DataFrame:
    """Atoms of the chains ("chain") or residues ("residue") numbered first to last from 0 in order of their first atom.
    Only the rows up to the last one asked for meet in one task."""
    key = ["chain"] if of == "chain" else ["chain", "res_seq", "res_name"]
    firsts = atoms.groupBy(*key).agg(F.min("pos").alias("start")).orderBy("start").limit(last + 1)
    number = F.row_number().over(W.orderBy("start")) - 1
    return atoms.join(F.broadcast(firsts.withColumn("k", number).where(F.col("k").between(first, last)).select(*key)), key, "left_semi").select(*atoms.columns)


def in_category(atoms: DataFrame, word: str) -> DataFrame:
    """Atoms of residues of a category by any of its names; none if it is no category."""
    cls = C.category(word)
    return atoms.where(C.residue_class(F.col("res_name")) == cls) if cls else atoms.where(F.lit(False))


def group(*members: DataFrame) -> DataFrame:
    """(ball_id) of the union of selections, each once."""
    return reduce(lambda a, b: a.union(b), [m.select("ball_id") for m in members]).distinct()


def group_report(groups: DataFrame, atoms: DataFrame) -> DataFrame:
    """Of groups(group_id, ball_id), a row each: atoms, residues, members that are no atoms, and members that other groups have
    too."""
    shared = groups.groupBy("ball_id").agg(F.count_distinct("group_id").alias("in_groups"))
    rows = groups.distinct().join(shared, "ball_id").join(atoms.select("ball_id", F.struct("chain", "res_seq", "res_name").alias("residue")), "ball_id", "left")
    return rows.groupBy("group_id").agg(
        F.count("residue").alias("n_atoms"), F.count_distinct("residue").alias("n_residues"), F.sum(F.col("residue").isNull().cast("long")).alias("n_unknown"),
        F.sum((F.col("in_groups") > 1).cast("long")).alias("n_shared"),
    )


def generator_universe(atoms: DataFrame, mode: str = "molecule_only", retained: DataFrame | None = None) -> DataFrame:
    """The atoms that a network is built from, with is_solvent (false for retained ones): all but water and ions for
    molecule_only, plus the retained(ball_id); all for solvent_context and full_solvent."""
    if mode not in ("molecule_only", "solvent_context", "full_solvent"):
        raise ValueError(f"unknown solvent mode {mode}")
    keep = (retained if retained is not None else atoms.where(F.lit(False))).select("ball_id").distinct().withColumn("kept", F.lit(True))
    rows = atoms.join(keep, "ball_id", "left").withColumn("is_solvent", C.is_solvent(F.col("res_name")) & F.col("kept").isNull())
    return (rows.where(~F.col("is_solvent")) if mode == "molecule_only" else rows).drop("kept")


def cell_targets(universe: DataFrame, mode: str) -> DataFrame:
    """The balls whose cells are asked for: with full_solvent all, else those that are no solvent."""
    return universe if mode == "full_solvent" else universe.where(~F.col("is_solvent"))


def bounds(balls: DataFrame, offset: float = 0.0) -> DataFrame:
    """One row: x0, x1, y0, y1, z0, z1 of the box around the balls, offset further out."""
    return balls.agg(*[x for c in "xyz" for x in ((F.min(F.col(c) - F.col("rad")) - offset).alias(f"{c}0"), (F.max(F.col(c) + F.col("rad")) + offset).alias(f"{c}1"))])


def virtual_shell(balls: DataFrame, offset: float = 2.8, spacing: float = 2.5, rad: float = 1.5, shift: float = 0.02) -> DataFrame:
    """(shell_id, x, y, z, rad): points on the six faces of the box around the balls, at most spacing apart, each moved out
    from the middle by a small share of spacing that follows from its place, so that no four are in one plane.

    The grid grows with the box's surface; it is exploded from one row, on the executors."""
    box, steps = bounds(balls, offset), []
    for c in "xyz":
        n = F.greatest(F.lit(2), F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / spacing).cast("int") + 1)
        box = box.withColumn(f"n{c}", n)
        steps.append(F.explode(F.sequence(F.lit(0), F.col(f"n{c}") - 1)).alias(f"k{c}"))
    faces = None
    for axis in "xyz":
        a, b = (c for c in "xyz" if c != axis)
        face = box.withColumn(f"k{axis}", F.explode(F.array(F.lit(0), F.col(f"n{axis}") - 1)))
        for c in (a, b):
            face = face.withColumn(f"k{c}", F.explode(F.sequence(F.lit(0), F.col(f"n{c}") - 1)))
        face = face.select(*box.columns, "kx", "ky", "kz")
        faces = face if faces is None else faces.union(face)
    p = {c: F.round(F.col(f"{c}0") + F.col(f"k{c}") * (F.col(f"{c}1") - F.col(f"{c}0")) / (F.col(f"n{c}") - 1), 10) for c in "xyz"}
    out = faces.distinct().select(*[p[c].alias(c) for c in "xyz"], *[((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"m{c}") for c in "xyz"])
    far = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0)))
    phase = F.col("x") * 12.9898 + F.col("y") * 78.233 + F.col("z") * 37.719
    by = F.lit(spacing * shift) * (0.5 + 0.5 * F.sin(phase)) / far
    moved = [F.round(F.col(c) + (F.col(c) - F.col(f"m{c}")) * by, 10).alias(c) for c in "xyz"]
    name = F.concat(F.lit("boundary:"), F.concat_ws(",", *[F.col(c).cast("string") for c in "xyz"]))
    return out.select(name.alias("shell_id"), *moved, F.lit(rad).alias("rad"))


def lattice_region(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> tuple[list[float], list[tuple[list[float], float]]]:
    """The middle of a crystal's unit cell and the half-spaces (normal, offset) of the points nearer to it than to its images.

    The lattice is known by the scalar products of its edges. Edges and the opposite of their sum are turned over, one pair at a time,
    until no two of the four form an acute angle; the sums of some but not all of them are then the fourteen images that
    can bound the region, and no other has to be looked at. The products' triangular root gives places in space."""
    size = np.array([a, b, c], float)
    turn = np.cos(np.radians([[0, gamma, beta], [gamma, 0, alpha], [beta, alpha, 0]]))
    products = np.outer(size, size) * turn
    if size.min() <= 0 or np.linalg.eigvalsh(products)[0] <= 1e-12 * size.max() ** 2:
        raise ValueError("lengths must be positive and the angles must make a cell in space")
    four = np.vstack([np.eye(3), -np.ones(3)])
    while True:
        angles = np.triu(four @ products @ four.T, 1)
        i, j = np.unravel_index(np.argmax(angles), (4, 4))
        if angles[i, j] <= 1e-9 * size.max() ** 2:
            break
        others = [k for k in range(4) if k not in (i, j)]
        four[others] += four[i]
        four[i] = -four[i]
    images = [sum(four[k] for k in some) for n in (1, 2, 3) for some in combinations(range(4), n)]
    edges = np.linalg.cholesky(products)
    normals = [v @ edges for v in images]
    return (edges.sum(0) / 2).tolist(), [(n.tolist(), float(n @ n) / 2) for n in normals]


def in_region(middle: list[float], planes: list[tuple[list[float], float]], scale: float = 1.0) -> Column:
    """Whether (x, y, z) is in a region of half-spaces, scaled about its middle."""
    slack = 1e-9 * max(1.0, scale * max(o for _, o in planes))
    d = [F.col(c) - m for c, m in zip("xyz", middle, strict=True)]
    return reduce(lambda p, q: p & q, [d[0] * n[0] + d[1] * n[1] + d[2] * n[2] <= scale * o + slack for n, o in planes])


def spans(keys: DataFrame, ids: list[str], members: DataFrame) -> DataFrame:
    """keys with touches (a ball of any side) and spans (balls of both sides a and b), members(ball_id, side) being the
    sides. Keys are exploded and joined by ball, so no list of members is sent around."""
    rows = keys.select(*ids, F.explode(F.array(*ids)).alias("ball_id")).join(members, "ball_id")
    has = rows.groupBy(*ids).agg(F.max(F.col("side") == "a").alias("in_a"), F.max(F.col("side") == "b").alias("in_b"))
    out = keys.join(has, ids, "left").na.fill(False, ["in_a", "in_b"])
    return out.withColumns({"touches": F.col("in_a") | F.col("in_b"), "spans": F.col("in_a") & F.col("in_b")})


def exposure_bin(share: Column, cuts: tuple[float, float] = (0.1, 0.4)) -> Column:
    """buried up to the first cut, partial up to the second, exposed above; null outside of 0 .. 1."""
    return F.when((share < 0) | (share > 1) | share.isNull(), None).when(share <= cuts[0], "buried").when(share <= cuts[1], "partial").otherwise("exposed")


def condition_beta(power: Column, smaller: Column, most: float = 5.0, slack: float = 1e-9) -> Column:
    """Whether a face stays: the root of its largest vertex power (0 if negative) is at most `most` of the smaller radius."""
    return F.sqrt(F.greatest(power, F.lit(0.0))) / smaller <= most + slack
