"""Structure files of many kinds as tables, and tables as lines of such files.

Readers take lines (system_id, block, at, value) in the order of block and at, as read_lines() gives them: files are read in
splits, and what runs over lines (frames, sections) is counted in each split first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellspan.sources.balls import radius

ORDER = ["system_id", "block", "at"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file or folder: the file's name, where its split begins, and their order within it."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_name").alias("system_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def number(expr: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast(trim({expr}) AS {kind})")


def running_section(lines: DataFrame, begins: Column, name: str = "section") -> DataFrame:
    """lines with the number of lines so far in their file, this one included, at which a section begins. Splits are
    counted up by themselves; their sums, one row a split, are put in front."""
    rows = lines.withColumn("__b", F.coalesce(begins.cast("long"), F.lit(0)))
    within = W.partitionBy("system_id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("system_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("system_id", "block").agg(F.sum("__b").alias("__s"))
    ahead = sums.select("system_id", "block", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__ahead"))
    return rows.withColumn("__here", F.sum("__b").over(within)).join(ahead, ["system_id", "block"]).withColumn(name, F.col("__here") + F.col("__ahead")).drop("__b", "__here", "__ahead")


# PDB

#: Fixed values of the PDB format: column, first place, length, type.
PDB = (
    ("record", 1, 6, "string"), ("serial", 7, 5, "bigint"), ("name", 13, 4, "string"), ("alt_loc", 17, 1, "string"), ("res_name", 18, 4, "string"), ("chain", 22, 1, "string"), ("res_seq", 23, 4, "int"),
    ("i_code", 27, 1, "string"), ("x", 31, 8, "double"), ("y", 39, 8, "double"), ("z", 47, 8, "double"), ("occupancy", 55, 6, "double"), ("b_factor", 61, 6, "double"), ("segment", 73, 4, "string"),
    ("element", 77, 2, "string"), ("charge", 79, 2, "string"),
)
CRYSTAL = (("a", 7, 9), ("b", 16, 9), ("c", 25, 9), ("alpha", 34, 7), ("beta", 41, 7), ("gamma", 48, 7))


def hybrid(number: Column, places: int) -> Column:
    """A number in so many places: decimal, then in base 36 with a first letter A to Z, then in small letters; beyond that anew."""
    ten, each = 10**places, 26 * 36 ** (places - 1)
    n = F.pmod(number, F.lit(ten + 2 * each))
    lettered = lambda k: F.conv((n - ten - k * each + 10 * 36 ** (places - 1)).cast("string"), 10, 36)
    return F.when(number < ten, F.format_string(f"%{places}d", number)).when(n < ten, F.format_string(f"%{places}d", n)).when(n < ten + each, lettered(0)).otherwise(F.lower(lettered(1)))


def from_hybrid(text: Column, places: int, kind: str) -> Column:
    ten, each = 10**places, 26 * 36 ** (places - 1)
    value = F.conv(text, 36, 10).cast("long") - 10 * 36 ** (places - 1) + ten
    large = F.when(text.rlike(f"^[A-Z][0-9A-Z]{{{places - 1}}}$"), value).when(text.rlike(f"^[a-z][0-9a-z]{{{places - 1}}}$"), value + each)
    return F.coalesce(F.trim(text).try_cast(kind), large.cast(kind))


def pdb_record(lines: DataFrame) -> DataFrame:
    """The fields of atom lines by place; those that are no numbers are null. Numbers of atoms and residues may go on in base 36
    (hybrid). Massless sites (M, MW) are left out."""
    cut = lambda at, n: f"substring(value, {at}, {n})"
    rows = lines.where(F.trim(F.substring("value", 1, 6)).isin("ATOM", "HETATM"))
    out = rows.select(*[c for c in lines.columns if c != "value"], *[(from_hybrid(F.substring("value", at, n), n, kind) if c in ("serial", "res_seq") else number(cut(at, n), kind)).alias(c) for c, at, n, kind in PDB])
    return out.where(~F.col("name").isin("M", "MW") & ~F.upper("element").isin("M", "MW"))


def pdb_frames(lines: DataFrame) -> DataFrame:
    """Lines with frame, from 1 in order of the file: MODEL, ENDMDL and END part frames, and only frames with atoms count."""
    record = F.trim(F.substring("value", 1, 6))
    rows = running_section(lines, record.isin("MODEL", "ENDMDL", "END"), "__part")
    full = rows.where(record.isin("ATOM", "HETATM")).select("system_id", "__part").distinct()
    frame = F.row_number().over(W.partitionBy("system_id").orderBy("__part"))
    return rows.join(full.withColumn("frame", frame), ["system_id", "__part"]).drop("__part")


def frame_counts(lines: DataFrame) -> DataFrame:
    return pdb_frames(lines).groupBy("system_id").agg(F.max("frame").alias("n_frames"))


def pdb_atoms(lines: DataFrame, first_frame: bool = False, radius_from: str = "element") -> DataFrame:
    """Atoms with frame and turn (how often residue numbers started anew in their chain). Of alternate places of an atom the
    one of the largest occupancy stays, then the first. radius_from: element, or b_factor for systems of plain balls."""
    rows = pdb_record(pdb_frames(lines))
    rows = rows.where("frame = 1") if first_frame else rows
    # what lies beside a blank alternate place is no alternative, so it keeps all its atoms
    atom = W.partitionBy("system_id", "frame", "chain", "res_seq", "i_code", "res_name", "name", F.when(F.col("alt_loc") == "", F.struct("block", "at")))
    rows = rows.withColumn("__k", F.row_number().over(atom.orderBy(F.desc_nulls_last("occupancy"), "block", "at"))).where("__k = 1").drop("__k")
    order = W.partitionBy("system_id", "frame", "chain").orderBy("block", "at")
    fell = F.coalesce((F.col("res_seq") < F.lag("res_seq").over(order)).cast("int"), F.lit(0))
    rows = rows.withColumn("__fell", fell).withColumn("turn", F.sum("__fell").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__fell")
    element = F.upper(F.when(F.length("element") > 0, F.col("element")).otherwise(F.regexp_extract("name", "[A-Za-z]", 0)))
    return rows.withColumn("element", element).withColumn("rad", F.col("b_factor") if radius_from == "b_factor" else radius(element))


def pdb_cells(lines: DataFrame) -> DataFrame:
    """(system_id, a, b, c, alpha, beta, gamma) of CRYST1 lines."""
    return lines.where(F.substring("value", 1, 6) == "CRYST1").select("system_id", *[number(f"substring(value, {at}, {n})").alias(c) for c, at, n in CRYSTAL])


# mmCIF


def cif_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of the _atom_site loop, whatever the order of its columns: quoted values are one, . and ? are null; of alternate
    places the one of the largest occupancy stays."""
    names = lines.where(F.col("value").startswith("_atom_site.")).select("system_id", "block", "at", F.trim(F.substring_index("value", ".", -1)).alias("name"))
    heads = names.groupBy("system_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "name"))), lambda x: x["name"]).alias("head"))
    token = r"""('[^']*'(?=\s|$)|"[^"]*"(?=\s|$)|\S+)"""
    rows = lines.where(F.col("value").rlike("^(ATOM|HETATM)\\s")).withColumn("p", F.regexp_extract_all("value", F.lit(token), F.lit(1))).join(heads, "system_id")
    raw = lambda c: F.get("p", F.array_position("head", F.lit(c)).cast("int") - 1)
    clean = lambda c: F.when(~raw(c).isin(".", "?"), F.regexp_replace(raw(c), "^(['\"])(.*)\\1$", "$2"))
    fields = {
        "serial": ("id", "bigint"), "name": ("label_atom_id", "string"), "alt_loc": ("label_alt_id", "string"), "res_name": ("label_comp_id", "string"), "chain": ("auth_asym_id", "string"), "res_seq": ("auth_seq_id", "int"),
        "x": ("Cartn_x", "double"), "y": ("Cartn_y", "double"), "z": ("Cartn_z", "double"), "occupancy": ("occupancy", "double"), "b_factor": ("B_iso_or_equiv", "double"), "element": ("type_symbol", "string"),
    }
    out = rows.select("system_id", "block", "at", *[clean(c).try_cast(kind).alias(n) for n, (c, kind) in fields.items()])
    atom = W.partitionBy("system_id", "chain", "res_seq", "res_name", "name", F.when(F.col("alt_loc").isNull(), F.struct("block", "at")))
    best = out.withColumn("__k", F.row_number().over(atom.orderBy(F.desc_nulls_last("occupancy"), "block", "at"))).where("__k = 1").drop("__k")
    return best.withColumn("rad", radius(F.upper("element")))


# GRO


def unrolled(rows: DataFrame, name: str, size: int) -> DataFrame:
    """rows (lines in their order, with section) whose number starts anew at `size`: each fall by more than half of that, within a
    section, counts as one turn. Splits are counted up by themselves, as in running_section()."""
    order = W.partitionBy("system_id", "block").orderBy("at")
    here = F.struct("section", name)
    ends = rows.groupBy("system_id", "block").agg(F.max_by(here, "at").alias("__last"))
    ahead = ends.select("system_id", "block", F.lag("__last").over(W.partitionBy("system_id").orderBy("block")).alias("__prior"))
    rows = rows.join(ahead, ["system_id", "block"]).withColumn("__last", F.coalesce(F.lag(here).over(order), "__prior"))
    fell = (F.col("__last.section") == F.col("section")) & (F.col(f"__last.{name}") - F.col(name) > size // 2)
    rows = running_section(rows.withColumn("__fell", fell).drop("__last", "__prior"), F.col("__fell"), "__turn")
    first = rows.groupBy("system_id", "section").agg(F.min("__turn").alias("__first"))
    rows = rows.join(first, ["system_id", "section"]).withColumn(name, F.col(name) + size * (F.col("__turn") - F.col("__first")))
    return rows.drop("__fell", "__turn", "__first")


def gro_whole(lines: DataFrame) -> DataFrame:
    """gro_atoms() with the numbers of atoms and residues that the format's five places have cut off: they go on within a frame,
    and other lines than atoms part frames."""
    kept = lines.columns
    atom = F.col("value").rlike(GRO_LINE)
    rows = gro_atoms(running_section(lines, ~F.coalesce(atom, F.lit(False))))
    for name in ("serial", "res_seq"):
        rows = unrolled(rows.withColumn(name, F.col(name).cast("long")), name, 100000)
    return rows.select(*[c for c in kept if c != "value"], *[c for c in rows.columns if c not in (*kept, "section")])


#: What a line of an atom looks like.
GRO_LINE = r"^[ \d]{4}\d.{10}[ \d]{4}\d( *-?\d+\.\d+){3}"


def gro_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of GRO lines of any precision, in angstrom: the places between the decimal points give the width of a number."""
    rows = lines.where(F.col("value").rlike(GRO_LINE))
    rows = rows.withColumn("__w", F.expr("locate('.', substring(value, 21), locate('.', substring(value, 21)) + 1) - locate('.', substring(value, 21))"))
    at = [(number(f"substring(value, 21 + {k} * __w, __w)") * 10).alias(c) for k, c in enumerate("xyz")]
    element = F.upper(F.regexp_extract(F.trim(F.substring("value", 11, 5)), "[A-Za-z]", 0))
    return rows.select(
        *[c for c in lines.columns if c != "value"], number("substring(value, 16, 5)", "bigint").alias("serial"), number("substring(value, 11, 5)", "string").alias("name"), number("substring(value, 6, 5)", "string").alias("res_name"),
        number("substring(value, 1, 5)", "int").alias("res_seq"), *at, element.alias("element"), radius(element).alias("rad"),
    )


# MOL and SDF


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(system_id, record, value): the molecules of MOL and SDF files, which are parted by $$$$."""
    rows = spark.read.option("lineSep", "$$$$").text(path)
    return rows.select(F.col("_metadata.file_name").alias("system_id"), F.monotonically_increasing_id().alias("record"), F.regexp_replace("value", r"^\r?\n", "").alias("value")).where(F.length(F.trim("value")) > 0)


def _rows(records: DataFrame) -> DataFrame:
    """Records with l, their lines; continued lines of V3000 are one."""
    whole = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"-\nM  V30 ", "")
    return records.withColumn("l", F.split(whole, "\n")).withColumn("v3000", F.get("l", F.lit(3)).contains("V3000"))


def mol_parts(records: DataFrame) -> DataFrame:
    """records' other columns, atoms (atom, element, x, y, z; atom from 1) and bonds (a, b, kind) of V2000 and V3000 molecules, a row
    each: a molecule is read once for both, and nothing is shuffled."""
    count = lambda at: F.coalesce(F.expr(f"try_cast(trim(substring(get(l, 3), {at}, 3)) AS int)"), F.lit(0))
    text = lambda t, at, n: F.trim(F.substring(t, at, n))
    fields = lambda name: F.transform(_block(name), lambda t: F.split(F.trim(F.substring(t, 8, 1 << 30)), r"\s+"))
    old_atom = lambda t, k: F.struct((k + 1).cast("long").alias("atom"), text(t, 32, 3).alias("element"), *[text(t, 1 + 10 * i, 10).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    new_atom = lambda p: F.struct(F.get(p, F.lit(0)).try_cast("long").alias("atom"), F.get(p, F.lit(1)).alias("element"), *[F.get(p, F.lit(2 + i)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    old_bond = lambda t: F.struct(*[text(t, at, 3).try_cast("long").alias(c) for c, at in (("a", 1), ("b", 4), ("kind", 7))])
    new_bond = lambda p: F.struct(*[F.get(p, F.lit(k)).try_cast("long").alias(c) for c, k in (("a", 2), ("b", 3), ("kind", 1))])
    form = lambda new, old: F.when(F.col("v3000"), new).when(~F.col("v3000"), old)
    atoms = form(F.transform(fields("ATOM"), new_atom), F.transform(F.slice("l", F.lit(5), count(1)), old_atom))
    bonds = form(F.when(F.array_contains("l", "M  V30 BEGIN BOND"), F.transform(fields("BOND"), new_bond)), F.transform(F.slice("l", F.lit(5) + count(1), count(4)), old_bond))
    return _rows(records).select(*[c for c in records.columns if c != "value"], atoms.alias("atoms"), bonds.alias("bonds"))


def mol_atoms(records: DataFrame) -> DataFrame:
    """(system_id, record, atom, element, x, y, z, rad) of V2000 and V3000 molecules, atom from 1."""
    return mol_parts(records).select("system_id", "record", F.explode("atoms").alias("t")).select("system_id", "record", "t.*").withColumn("rad", radius(F.upper("element")))


def _block(name: str) -> Column:
    """Lines between a V3000 block's BEGIN and END."""
    return F.expr(f"slice(l, cast(array_position(l, 'M  V30 BEGIN {name}') AS int) + 1, cast(array_position(l, 'M  V30 END {name}') - array_position(l, 'M  V30 BEGIN {name}') AS int) - 1)")


def mol_bonds(records: DataFrame) -> DataFrame:
    """(system_id, record, a, b, kind) of the bonds."""
    return mol_parts(records).select("system_id", "record", F.explode("bonds").alias("t")).select("system_id", "record", "t.*")


# Plain tables and index files


def txt_balls(lines: DataFrame) -> DataFrame:
    """x, y, z, rad of lines of four numbers with blanks or commas between them; others fall out."""
    p = lines.withColumn("p", F.split(F.trim("value"), r"[,\s]+")).where(F.size("p") == 4)
    out = p.select(*[c for c in lines.columns if c != "value"], *[F.expr(f"try_cast(p[{k}] AS double)").alias(c) for k, c in enumerate(("x", "y", "z", "rad"))])
    return out.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND rad IS NOT NULL")


def tangent_vertices(lines: DataFrame) -> DataFrame:
    """b0 .. b3 (in order), x, y, z, rad of lines of four numbers of balls and a sphere."""
    p = lines.withColumn("p", F.split(F.trim("value"), r"\s+")).where(F.size("p") >= 8)
    b = F.sort_array(F.array(*[F.expr(f"try_cast(p[{k}] AS bigint)") for k in range(4)]))
    return p.select(*[b[k].alias(f"b{k}") for k in range(4)], *[F.expr(f"try_cast(p[{4 + k}] AS double)").alias(c) for k, c in enumerate(("x", "y", "z", "rad"))]).where("b0 IS NOT NULL AND rad IS NOT NULL")


def index_groups(lines: DataFrame) -> DataFrame:
    """(system_id, group_id, serial) of index files: [ name ] begins a group, its lines list numbers."""
    title = F.regexp_extract("value", r"^\s*\[\s*(.*?)\s*\]\s*$", 1)
    rows = running_section(lines.withColumn("title", title), F.col("title") != "").where("section > 0")
    names = rows.where("title <> ''").select("system_id", "section", F.col("title").alias("group_id"))
    numbers = rows.where("title = ''").select("system_id", "section", F.explode(F.split(F.trim("value"), r"\s+")).alias("t"))
    return numbers.join(names, ["system_id", "section"]).select("system_id", "group_id", F.expr("try_cast(t AS bigint)").alias("serial")).where("serial IS NOT NULL")


def header(name: Column) -> Column:
    """A column's name in lower case, all between letters and digits one underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")


def log_tables(lines: DataFrame, titles: list[str]) -> DataFrame:
    """(system_id, table, row, fields) of sectioned logs: a line that is one of the titles (whatever its case) begins a
    table, the next names its columns, and each row is a map from tidy names to values; blanks are null."""
    tidy = F.lower(F.trim(F.regexp_replace("value", ",+$", "")))
    begins = tidy.isin(*[t.lower() for t in titles])
    rows = running_section(lines.withColumn("t", tidy), begins).where("section > 0 AND trim(value) <> ''")
    names = rows.where(F.col("t").isin(*[t.lower() for t in titles])).select("system_id", "section", F.col("t").alias("table"))
    body = rows.where(~F.col("t").isin(*[t.lower() for t in titles]))
    place = F.struct("block", "at")
    heads = body.groupBy("system_id", "section").agg(F.min(place).alias("first"), F.min_by("value", place).alias("head"))
    data = body.join(heads, ["system_id", "section"]).where(place != F.col("first")).join(names, ["system_id", "section"])
    head = F.transform(F.split("head", ","), header)
    values = F.transform(F.split("value", ","), lambda v: F.when(F.trim(v) != "", F.trim(v)))
    pad = F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("string"), F.size(head))), F.lit(1), F.size(head))
    row = F.row_number().over(W.partitionBy("system_id", "section").orderBy("block", "at"))
    return data.select("system_id", "table", row.alias("row"), F.map_from_arrays(head, pad).alias("fields"))


# Lines of files


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(value) of atoms in the PDB format; numbers of atoms and residues go on in base 36 where the format has no more places."""
    name = F.when(F.length("name") < 4, F.concat(F.lit(" "), F.rpad("name", 3, " "))).otherwise(F.substring("name", 1, 4))
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in atoms.columns else F.lit(d)
    num = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in atoms.columns else F.lit(d)
    line = F.format_string(
        "ATOM  %5s %s%s%3s %1s%4s%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", hybrid(F.col("serial"), 5), name, F.rpad(text("alt_loc", ""), 1, " "), text("res_name", "UNK"), F.rpad(text("chain", ""), 1, " "),
        hybrid(F.col("res_seq"), 4), F.rpad(text("i_code", ""), 1, " "), F.col("x"), F.col("y"), F.col("z"), num("occupancy", 1.0), num("b_factor", 0.0), text("element", ""),
    )
    return atoms.select(line.alias("value"))


def gro_lines(atoms: DataFrame, decimals: int = 3) -> DataFrame:
    at = f"%{decimals + 5}.{decimals}f"
    line = F.format_string(f"%5d%-5s%5s%5d{at}{at}{at}", F.col("res_seq") % 100000, "res_name", "name", F.col("serial") % 100000, *[F.col(c) / 10 for c in "xyz"])
    return atoms.select(*[c for c in ORDER if c in atoms.columns], line.alias("value"))


def xyzr_lines(balls: DataFrame) -> DataFrame:
    return balls.select(F.format_string("%.6f %.6f %.6f %.6f", "x", "y", "z", "rad").alias("value"))


def cif_lines(atoms: DataFrame) -> DataFrame:
    """Rows of an _atom_site loop with the columns of CIF_HEAD."""
    quoted = F.when(F.col("name").contains("'"), F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.col("name"))
    return atoms.select(F.format_string("ATOM %d %s %s . %s %s %d %.3f %.3f %.3f 1.00 0.00", "serial", "element", quoted, "res_name", F.col("chain").cast("string"), "res_seq", "x", "y", "z").alias("value"))


#: The columns of the loop that cif_lines() writes.
CIF_HEAD = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv".split()


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Writes value as text; with order, ranged over files whose names are in that order and sorted within each."""
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value") if order else lines.select("value")
    rows.write.text(path)


def save_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes a network's tables as Parquet, each under its name, then a manifest of names, rows and digests: a folder without
    a manifest is not whole. Returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    manifest = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        manifest.append((name, *digest(spark.read.parquet(f"{path}/{name}"))))
    out = spark.createDataFrame(manifest, "name string, n_rows long, digest decimal(38,0)")
    out.coalesce(1).write.json(f"{path}/manifest")
    return out


def digest(df: DataFrame) -> tuple:
    """Rows, and a sum of their hashes that does not depend on their order."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved network; an error if one is not as its manifest says."""
    out = {}
    for r in spark.read.schema("name string, n_rows long, digest decimal(38,0)").json(f"{path}/manifest").collect():
        out[r.name] = spark.read.parquet(f"{path}/{r.name}")
        if digest(out[r.name]) != (r.n_rows, r.digest):
            raise ValueError(f"table {r.name} under {path} is not the one that was saved")
    return out


def dangling(tables: dict[str, DataFrame], keys: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """(table, column, n) of references that lead nowhere: keys maps (table, column) to (table, column)."""
    out = None
    for (a, c), (b, d) in keys.items():
        lost = tables[a].where(F.col(c).isNotNull()).join(tables[b].select(F.col(d).alias(c)).distinct(), c, "left_anti")
        part = lost.agg(F.lit(a).alias("table"), F.lit(c).alias("column"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out.where("n > 0")
