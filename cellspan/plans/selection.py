"""Queries over atoms, groups and the keys of a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspan.functions import chemistry as C
from cellspan.operators import selection as S
from cellspan.operators import spatial
from cellspan.plans.space import NEAR, PAIRS, balls, base, r6
from cellspan.sources.balls import RADII, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What the fixture calls its atoms and residues, by number.
NAMES = ("N", "CA", "C", "O", "CB", "CG", "SE", "HG1", "NZ", "FE")
RESIDUES = ("ALA", "LYS", "HOH", "NA", "DA", "U", "LIG", "TRP")
_sql = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
ATOMS = f"{base()}, a AS (SELECT *, ball_id AS pos, ({_sql(NAMES)})[ball_id % 10 + 1] AS name, ({_sql(RESIDUES)})[res_seq % 8 + 1] AS res_name FROM b)"


def atoms(spark, sf_dir):
    """Balls with names of atoms and residues, by turns."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return balls(spark, sf_dir).withColumns({"pos": F.col("ball_id"), "name": pick(NAMES, F.col("ball_id")), "res_name": pick(RESIDUES, F.col("res_seq"))})


def _case(col: str, groups: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in groups.items()) + f" ELSE '{other}' END"


CLASS = _case("res_name", {"protein": C.PROTEIN, "dna": C.DNA, "rna": C.RNA, "water": C.WATER, "ions": C.IONS}, "ligand")
ELEMENT = "CASE WHEN res_name IN ('SOL', 'HOH') AND contains(name, 'O') THEN 'O' WHEN res_name IN ('SOL', 'HOH') AND contains(name, 'H') THEN 'H' WHEN name = 'SE' THEN 'SE' WHEN name[1] IN ('C', 'O', 'H', 'N', 'P', 'S') THEN name[1] ELSE 'H' END"
SOLVENT = "res_name IN (" + ", ".join(map(repr, dict.fromkeys([*C.WATER, *C.SOLVENT_IONS]))) + ")"
E_ATOMS = f"{ATOMS}, e AS (SELECT *, {ELEMENT} AS element, {CLASS} AS cls FROM a)"


def with_elements(spark, sf_dir):
    return atoms(spark, sf_dir).withColumns({"element": C.element_of(F.col("name"), F.col("res_name")), "cls": C.residue_class(F.col("res_name"))})


@query(f"WITH {E_ATOMS} SELECT cls, count(*) AS n_atoms, count(DISTINCT res_seq) AS n_residues FROM e GROUP BY cls")
def residue_class(spark, sf_dir):
    return with_elements(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n_atoms"), F.count_distinct("res_seq").alias("n_residues"))


@query(f"WITH {E_ATOMS} SELECT ball_id, res_name FROM e WHERE cls = 'rna'")
def category_filter(spark, sf_dir):
    return S.in_category(atoms(spark, sf_dir), "Ribonucleic_Acid").select("ball_id", "res_name")


@query(f"WITH {E_ATOMS} SELECT name, res_name, element, count(*) AS n FROM e GROUP BY ALL")
def element_inference(spark, sf_dir):
    return with_elements(spark, sf_dir).groupBy("name", "res_name", "element").agg(F.count("*").alias("n"))


#: Radii of single atoms of residues, as a user would set them.
SPECIALS = {("LYS", "NZ"): 1.5, ("ALA", "C"): 1.8, ("TRP", "CB"): 1.9}
ELEMENT_RADII = {**RADII, "SE": 1.9}
_radii = "CASE element " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ELEMENT_RADII.items()) + " END"


@query(
    f"WITH {E_ATOMS} SELECT ball_id, CASE WHEN res_name = 'LYS' AND name = 'NZ' THEN 1.5::DOUBLE WHEN res_name = 'ALA' AND name[1] = 'C' THEN 1.8::DOUBLE WHEN res_name = 'TRP' AND name = 'CB' THEN 1.9::DOUBLE ELSE {_radii} END AS rad FROM e"
)
def radius_lookup(spark, sf_dir):
    e = with_elements(spark, sf_dir)
    return e.select("ball_id", C.radius_of(F.col("res_name"), F.col("name"), F.col("element"), ELEMENT_RADII, SPECIALS).alias("rad"))


@query(f"WITH {E_ATOMS} SELECT ball_id, round(CASE WHEN element = 'C' THEN 2.0::DOUBLE WHEN element = 'O' THEN 1.6::DOUBLE ELSE rad END, 6) AS rad FROM e")
def radius_assign(spark, sf_dir):
    """New radii for some elements; the others keep theirs."""
    return r6(with_elements(spark, sf_dir).select("ball_id", F.coalesce(C.lookup({"C": 2.0, "O": 1.6}, F.col("element")), "rad").alias("rad")))


UNITED = (
    "CASE WHEN res_name IN ('ALA', 'LYS', 'TRP') AND name = 'N' THEN 1.65 WHEN res_name IN ('ALA', 'LYS', 'TRP') AND name = 'C' THEN 1.76 WHEN res_name IN ('ALA', 'LYS', 'TRP') AND name IN ('CA', 'CB') THEN 1.87 "
    "WHEN res_name = 'LYS' AND name = 'CG' THEN 1.87 WHEN res_name = 'TRP' AND name = 'CG' THEN 1.76 WHEN res_name = 'LYS' AND name = 'NZ' THEN 1.5 WHEN element = 'O' THEN 1.4 WHEN element = 'S' THEN 1.85 ELSE 2.0 END::DOUBLE"
)


@query(f"WITH {E_ATOMS}, u AS (SELECT ball_id, {UNITED} AS r FROM e) SELECT ball_id, r AS united, round(r + 1.4::DOUBLE, 6) AS expanded, round((r + 1.4::DOUBLE) ** 2, 6) AS weight FROM u")
def united_radius(spark, sf_dir):
    r = F.col("united")
    e = with_elements(spark, sf_dir).select("ball_id", C.united_radius(F.col("res_name"), F.col("name"), F.col("element")).alias("united"))
    return r6(e.select("ball_id", "united", C.expanded_radius(r).alias("expanded"), C.power_weight(r).alias("weight")))


ATOM_CLASS = "CASE WHEN cls IN ('water', 'ions') THEN 'excluded' WHEN element IN ('C', 'H') THEN 'nonpolar' ELSE 'other' END"
PAIR_CLASS = "CASE WHEN 'excluded' IN (ca, cb) THEN 'excluded' WHEN ca = 'nonpolar' AND cb = 'nonpolar' THEN 'nonpolar' WHEN 'nonpolar' IN (ca, cb) THEN 'mixed' ELSE 'other' END"


@query(f"WITH {E_ATOMS} SELECT {ATOM_CLASS} AS kind, count(*) AS n FROM e GROUP BY 1")
def nonpolar_atom_class(spark, sf_dir):
    return with_elements(spark, sf_dir).groupBy(C.atom_class(F.col("res_name"), F.col("element")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"WITH {E_ATOMS}, {PAIRS}, k AS (SELECT ball_id, {ATOM_CLASS} AS c FROM e), j AS (SELECT p.*, x.c AS ca, y.c AS cb FROM p JOIN k x ON x.ball_id = a_id JOIN k y ON y.ball_id = b_id WHERE gap <= {NEAR}) "
    f"SELECT {PAIR_CLASS} AS kind, count(*) AS n, round(sum(greatest(-gap, 0.0)), 6) AS overlap FROM j GROUP BY 1"
)
def surface_chemistry_class(spark, sf_dir):
    """Pairs of neighbours by the chemistry of both sides."""
    e = with_elements(spark, sf_dir)
    kinds = e.withColumn("kind", C.atom_class(F.col("res_name"), F.col("element")))
    names = ("excluded", "nonpolar", "other")
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) + 1).cast("int"))
    number = F.array_position(F.array(*map(F.lit, names)), F.col("kind")) - 1
    p = spatial.kind_sums(kinds.withColumn("kind", number), NEAR, "kind").withColumn("kind", C.pair_class(name("a_kind"), name("b_kind")))
    return r6(p.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("overlap").alias("overlap")))


@query(f"WITH {E_ATOMS} SELECT ball_id FROM e WHERE (name = 'CA' AND pos BETWEEN 20 AND 299) OR (res_name = 'LYS' AND name = 'NZ') OR element = 'SE'")
def atom_selector(spark, sf_dir):
    e = with_elements(spark, sf_dir)
    return e.where(S.atoms_where(name=" ca", between=(20, 299)) | S.atoms_where(res_name="lys", name="NZ") | S.atoms_where(element="Se")).select("ball_id")


@query(
    f"WITH {ATOMS}, r AS (SELECT chain, res_seq, res_name, row_number() OVER (ORDER BY min(pos)) - 1 AS k FROM a GROUP BY ALL) SELECT ball_id FROM a JOIN r USING (chain, res_seq, res_name) WHERE k BETWEEN 5 AND 40 OR (res_name = 'TRP' AND res_seq = 7)"
)
def residue_selector(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return S.group(S.nth(a, "residue", 5, 40), a.where(S.atoms_where(res_name="trp", res_seq=7)))


@query(f"WITH {ATOMS}, c AS (SELECT chain, row_number() OVER (ORDER BY min(pos)) - 1 AS k FROM a GROUP BY ALL) SELECT ball_id FROM a JOIN c USING (chain) WHERE k <= 1 OR chain = 7")
def chain_selector(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return S.group(S.nth(a, "chain", 0, 1), a.where(S.atoms_where(chain="7")))


@query(f"WITH {ATOMS} SELECT DISTINCT a.ball_id FROM a JOIN (SELECT DISTINCT chain, res_seq, res_name FROM a WHERE name = 'NZ' AND chain < 3) USING (chain, res_seq, res_name)")
def whole_residue_expansion(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return S.whole_residues(a, a.where((F.col("name") == "NZ") & (F.col("chain") < 3))).select("ball_id")


GROUPS = "g AS (SELECT 'small' AS group_id, ball_id FROM a WHERE chain < 4 UNION SELECT 'named', ball_id FROM a WHERE name = 'CA' UNION SELECT 'named', 1000000 + ball_id FROM a WHERE chain = 9)"


@query(
    f"WITH {ATOMS}, {GROUPS}, s AS (SELECT ball_id, count(DISTINCT group_id) AS k FROM g GROUP BY 1) SELECT group_id, count(a.ball_id) AS n_atoms, count(DISTINCT CASE WHEN a.ball_id IS NOT NULL THEN a.chain || ':' || a.res_seq || ':' || a.res_name END) AS n_residues, "
    "count(*) FILTER (a.ball_id IS NULL) AS n_unknown, count(*) FILTER (k > 1) AS n_shared FROM g JOIN s USING (ball_id) LEFT JOIN a ON a.ball_id = g.ball_id GROUP BY group_id"
)
def group_validation(spark, sf_dir):
    a = atoms(spark, sf_dir)
    part = lambda name, rows, add=0: rows.select(F.lit(name).alias("group_id"), (F.col("ball_id") + add).alias("ball_id"))
    groups = part("small", a.where("chain < 4")).union(part("named", a.where("name = 'CA'"))).union(part("named", a.where("chain = 9"), 1000000))
    return S.group_report(groups, a)


@query(f"WITH {ATOMS} SELECT chain, bool_or({SOLVENT}) AS has_solvent, bool_or(res_name IN ({', '.join(map(repr, C.WATER))})) AS has_water FROM a GROUP BY chain")
def solvent_presence(spark, sf_dir):
    r = F.col("res_name")
    return atoms(spark, sf_dir).groupBy("chain").agg(F.max(C.is_solvent(r)).alias("has_solvent"), F.max(C.is_water(r)).alias("has_water"))


@query(
    f"WITH {E_ATOMS} SELECT chain, CASE WHEN bool_or(cls = 'protein') AND bool_or(cls IN ('dna', 'rna')) THEN 'complex' WHEN bool_or(cls = 'protein') THEN 'protein' WHEN bool_or(cls IN ('dna', 'rna')) THEN 'nucleic' "
    "WHEN bool_or(cls = 'ligand') THEN 'ligand' ELSE 'solvent' END AS kind FROM e GROUP BY chain"
)
def system_type(spark, sf_dir):
    has = lambda *c: F.max(F.col("cls").isin(*c))
    kind = F.when(has("protein") & has("dna", "rna"), "complex").when(has("protein"), "protein").when(has("dna", "rna"), "nucleic").when(has("ligand"), "ligand").otherwise("solvent")
    return with_elements(spark, sf_dir).groupBy("chain").agg(kind.alias("kind"))


UNIVERSE = f"u AS (SELECT *, {SOLVENT} AND ball_id % 40 <> 24 AS is_solvent FROM a)"


@query(
    f"WITH {ATOMS}, {UNIVERSE} SELECT 'molecule_only' AS mode, count(*) AS n_generators, count(*) AS n_targets FROM u WHERE NOT is_solvent UNION ALL SELECT 'solvent_context', count(*), count(*) FILTER (NOT is_solvent) FROM u "
    "UNION ALL SELECT 'full_solvent', count(*), count(*) FROM u"
)
def generator_universe(spark, sf_dir):
    """Balls of the network and cells asked for, by solvent mode, some water being retained."""
    a, out = atoms(spark, sf_dir), None
    for mode in ("molecule_only", "solvent_context", "full_solvent"):
        u = S.generator_universe(a, mode, a.where("ball_id % 40 = 24"))
        targets = S.cell_targets(u, mode).agg(F.count("*").alias("n_targets"))
        row = u.agg(F.lit(mode).alias("mode"), F.count("*").alias("n_generators")).join(targets)  # one row each
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {ATOMS} SELECT DISTINCT ball_id FROM a WHERE chain < 2 OR ball_id % 7 = 0")
def group_add(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return S.group(a.where("chain < 2"), a.where("ball_id % 7 = 0"), a.where("chain = 1"))


@query(f"WITH {base()}, o AS (SELECT min(x) + (max(x) - min(x)) / 4 AS x0, max(x) - (max(x) - min(x)) / 4 AS x1 FROM b) SELECT ball_id, x BETWEEN x0 AND x1 AS inside FROM b, o")
def box_predicate(spark, sf_dir):
    b = balls(spark, sf_dir)
    quarter = (F.max("x") - F.min("x")) / 4
    box = b.agg((F.min("x") + quarter).alias("x0"), (F.max("x") - quarter).alias("x1"))
    return b.join(F.broadcast(box)).select("ball_id", F.col("x").between(F.col("x0"), F.col("x1")).alias("inside"))  # one row


def _region_sql(scale: float) -> str:
    middle, planes = S.lattice_region(12.0, 14.0, 16.0, 90.0, 95.0, 100.0)
    most = 1e-9 * max(1.0, scale * max(o for _, o in planes))
    d = [f"({c} - {m!r}::DOUBLE)" for c, m in zip("xyz", middle, strict=True)]
    return " AND ".join(f"{d[0]} * {n[0]!r}::DOUBLE + {d[1]} * {n[1]!r}::DOUBLE + {d[2]} * {n[2]!r}::DOUBLE <= {scale * o + most!r}::DOUBLE" for n, o in planes)


@query(f"WITH {base()} SELECT ball_id, {_region_sql(1.0)} AS inside, {_region_sql(1.25)} AS inside_scaled FROM b")
def crystal_region(spark, sf_dir):
    """Balls in a unit cell's region around its middle, and in that a quarter larger."""
    middle, planes = S.lattice_region(12.0, 14.0, 16.0, 90.0, 95.0, 100.0)
    return balls(spark, sf_dir).select("ball_id", S.in_region(middle, planes).alias("inside"), S.in_region(middle, planes, 1.25).alias("inside_scaled"))


_each = lambda text: ", ".join(text.format(c=c) for c in "xyz")
SHELL = (
    f"{base()}, o AS (SELECT {_each('min({c} - rad) - 2.8::DOUBLE AS {c}0, max({c} + rad) + 2.8::DOUBLE AS {c}1')} FROM b), n AS (SELECT *, {_each('greatest(2, ceil(({c}1 - {c}0) / 2.5::DOUBLE)::INTEGER + 1) AS n{c}')} FROM o), "
    "g AS (SELECT *, unnest(range(nx)) AS kx FROM n), h AS (SELECT *, unnest(range(ny)) AS ky FROM g), i AS (SELECT *, unnest(range(nz)) AS kz FROM h), "
    f"p AS (SELECT {_each('round({c}0 + k{c} * ({c}1 - {c}0) / (n{c} - 1), 10) AS {c}, ({c}0 + {c}1) / 2 AS m{c}')} FROM i WHERE kx IN (0, nx - 1) OR ky IN (0, ny - 1) OR kz IN (0, nz - 1)), "
    "q AS (SELECT *, 0.05::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * sin(x * 12.9898::DOUBLE + y * 78.233::DOUBLE + z * 37.719::DOUBLE)) / sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS w FROM p)"
)


@query(f"WITH {SHELL} SELECT {_each('round({c} + ({c} - m{c}) * w, 6) + 0.0 AS {c}')}, 1.5::DOUBLE AS rad FROM q")
def virtual_shell(spark, sf_dir):
    return r6(S.virtual_shell(balls(spark, sf_dir)).drop("shell_id"))


#: Keys of four balls from the parts, suppliers, places and orders of lineitem: a network's topology without its geometry.
KEYS = "v AS (SELECT DISTINCT l_partkey % 50 AS b0, 50 + l_suppkey % 50 AS b1, 100 + l_linenumber AS b2, 110 + l_orderkey % 40 AS b3 FROM lineitem)"
SIDES = "m AS (SELECT unnest(range(0, 50, 2)) AS ball_id, 'a' AS side UNION ALL SELECT unnest(range(51, 100, 3)), 'b')"


def keys(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem")
    return k.select((F.col("l_partkey") % 50).alias("b0"), (50 + F.col("l_suppkey") % 50).alias("b1"), (100 + F.col("l_linenumber")).cast("long").alias("b2"), (110 + F.col("l_orderkey") % 40).alias("b3")).distinct()


def sides(spark):
    a = spark.range(0, 50, 2).select(F.col("id").alias("ball_id"), F.lit("a").alias("side"))
    return a.union(spark.range(51, 100, 3).select("id", F.lit("b")))


@query(f"WITH {KEYS}, {SIDES}, t AS (SELECT b0, b1, b2, b3, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b FROM v LEFT JOIN m ON ball_id IN (b0, b1, b2, b3) GROUP BY ALL) SELECT coalesce(in_a, false) AS in_a, coalesce(in_b, false) AS in_b, count(*) AS n FROM t GROUP BY 1, 2")
def interface_vertex_predicate(spark, sf_dir):
    """Vertices by the sides of an interface that their balls are of."""
    out = S.spans(keys(spark, sf_dir), ["b0", "b1", "b2", "b3"], sides(spark))
    return out.groupBy("in_a", "in_b").agg(F.count("*").alias("n"))


@query(f"WITH {KEYS}, {SIDES} SELECT DISTINCT b0, b1, b2, b3 FROM v JOIN m ON ball_id IN (b0, b1, b2, b3) WHERE side = 'a'")
def group_view(spark, sf_dir):
    """Vertices of the network that a group has a ball of."""
    out = S.spans(keys(spark, sf_dir), ["b0", "b1", "b2", "b3"], sides(spark).where("side = 'a'"))
    return out.where("touches").select("b0", "b1", "b2", "b3")


@query(f"WITH {KEYS}, {SIDES} SELECT DISTINCT b0, b1, b2, b3 FROM v WHERE b0 IN (SELECT ball_id FROM m WHERE side = 'a') AND b1 IN (SELECT ball_id FROM m WHERE side = 'b')")
def interface_view(spark, sf_dir):
    return S.spans(keys(spark, sf_dir), ["b0", "b1", "b2", "b3"], sides(spark)).where("spans").select("b0", "b1", "b2", "b3")


EXPOSURE = "x AS (SELECT l_partkey AS unit, avg(l_discount)::DOUBLE * 10 AS share FROM lineitem GROUP BY 1)"


@query(f"WITH {EXPOSURE} SELECT unit, round(share, 6) AS share, CASE WHEN share < 0 OR share > 1 THEN NULL WHEN share <= 0.1 THEN 'buried' WHEN share <= 0.4 THEN 'partial' ELSE 'exposed' END AS bin FROM x")
def exposure_bins(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg((F.avg(F.col("l_discount").cast("double")) * 10).alias("share"))
    return r6(x.withColumn("bin", S.exposure_bin(F.col("share"))))


@query(f"WITH {EXPOSURE} SELECT p_brand, CASE WHEN share IS NULL THEN 'none' WHEN share < 0 OR share > 1 THEN 'outside' WHEN share <= 0.1 THEN 'buried' WHEN share <= 0.4 THEN 'partial' ELSE 'exposed' END AS bin, count(*) AS n FROM part LEFT JOIN x ON unit = p_partkey GROUP BY 1, 2")
def attach_exposure(spark, sf_dir):
    """Every part with its exposure's bin, by brand; parts without one stay."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.avg(F.col("l_discount").cast("double")) * 10).alias("share"))
    j = table(spark, sf_dir, "part").join(x, "p_partkey", "left")
    bin_ = F.when(F.col("share").isNull(), "none").otherwise(F.coalesce(S.exposure_bin(F.col("share")), F.lit("outside")))
    return j.groupBy("p_brand", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT l_linenumber::INTEGER AS l_linenumber, sqrt(greatest(l_discount::DOUBLE * 100 - 3, 0)) / (0.1::DOUBLE + l_tax::DOUBLE * 5) <= 5 + 1e-9::DOUBLE AS keeps, count(*) AS n FROM lineitem GROUP BY 1, 2")
def condition_beta(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    keeps = S.condition_beta(F.col("l_discount").cast("double") * 100 - 3, F.lit(0.1) + F.col("l_tax").cast("double") * 5)
    return l.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber"), keeps.alias("keeps")).agg(F.count("*").alias("n"))
