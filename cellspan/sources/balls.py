"""Tables of balls: ball_id, x, y, z, rad, chain, res_seq, from vectors or from structure files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_vectors(vectors: DataFrame, scale: float = 20.0) -> DataFrame:
    """The first three components times scale are the centre; the label gives radius and chain; ten balls a residue."""
    at = lambda k: (F.col("embedding")[k].cast("double") * scale).alias("xyz"[k])
    rad = F.lit(1.0) + F.lit(0.05) * F.col("label")
    return vectors.select(F.col("vec_id").alias("ball_id"), at(0), at(1), at(2), rad.alias("rad"), F.col("label").alias("chain"), F.floor(F.col("vec_id") / 10).alias("res_seq"))


#: Fixed values of the PDB format: column, first place, length.
PDB_FIELDS = (("record", 1, 6), ("serial", 7, 5), ("name", 13, 4), ("res_name", 18, 3), ("chain", 22, 1), ("res_seq", 23, 4), ("x", 31, 8), ("y", 39, 8), ("z", 47, 8), ("element", 77, 2))
#: Radii in angstrom of the elements met most, and the one for others.
RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8, "F": 1.47, "CL": 1.75}
OTHER_RADIUS = 1.8
#: Residues of water and ions.
SOLVENT = ("HOH", "WAT", "SOL", "TIP", "NA", "CL", "K", "MG", "CA", "ZN")


def parse_pdb(lines: DataFrame, text_col: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Atoms of PDB lines, by place. Lines of other records are left out; fields that are not numbers are null; an element
    that is not given is the first letter of the atom's name."""
    cut = {c: F.trim(F.substring(F.col(text_col), at, n)) for c, at, n in PDB_FIELDS}
    rows = lines.select(*carry, *[x.alias(c) for c, x in cut.items()]).where(F.col("record").isin("ATOM", "HETATM"))
    element = F.upper(F.when(F.length("element") > 0, F.col("element")).otherwise(F.regexp_extract("name", "[A-Za-z]", 0)))
    rad = radius(element)
    number = {c: F.expr(f"try_cast({c} AS {t})") for c, t in (("serial", "bigint"), ("res_seq", "int"), ("x", "double"), ("y", "double"), ("z", "double"))}
    return rows.select(
        *carry, number["serial"].alias("ball_id"), number["x"].alias("x"), number["y"].alias("y"), number["z"].alias("z"), rad.alias("rad"), "name", element.alias("element"),
        "res_name", "chain", number["res_seq"].alias("res_seq"), F.col("res_name").isin(*SOLVENT).alias("is_solvent"),
    )


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """All atoms of a file or folder of PDB files, with the file's name as system_id."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("system_id"))
    return parse_pdb(lines, carry=("system_id",))


def radius(element: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv]), element), F.lit(OTHER_RADIUS))


#: Fixed values of the GRO format: column, first place, length; lengths are in nanometres. An atom line has numbers in those places.
GRO_FIELDS = (("res_seq", 1, 5), ("res_name", 6, 5), ("name", 11, 5), ("serial", 16, 5), ("x", 21, 8), ("y", 29, 8), ("z", 37, 8))
GRO_ATOM = r"^[ \d]{4}\d.{10}[ \d]{4}\d( *-?\d+\.\d{3}){3}"


def parse_gro(lines: DataFrame, text_col: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Atoms of GRO lines of three decimals, by place, in angstrom. Titles, counts, boxes and null lines fall out as they do
    not match; numbers of atoms and residues start anew after 99,999, as the format has it."""
    cut = {c: F.trim(F.substring(F.col(text_col), at, n)) for c, at, n in GRO_FIELDS}
    rows = lines.where(F.col(text_col).rlike(GRO_ATOM)).select(*carry, *[x.alias(c) for c, x in cut.items()])
    element = F.upper(F.regexp_extract("name", "[A-Za-z]", 0))
    at = [(F.expr(f"try_cast({c} AS double)") * 10).alias(c) for c in "xyz"]
    return rows.select(
        *carry, F.col("serial").cast("bigint").alias("ball_id"), *at, radius(element).alias("rad"), "name", element.alias("element"),
        "res_name", F.col("res_seq").cast("int").alias("res_seq"), F.col("res_name").isin(*SOLVENT).alias("is_solvent"),
    )


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """All atoms of a file or folder of GRO files, with the file's name as system_id."""
    return parse_gro(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("system_id")), carry=("system_id",))


#: Fixed value: what begins a section of a MOL2 file.
MOL2_SECTION = "@<TRIPOS>"


def parse_mol2(sections: DataFrame, text_col: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Atoms of MOL2 sections, a row each without their mark; other sections, and lines without six fields, are left out.
    Fields that are not numbers are null; the element is what the atom type has before its dot."""
    atoms = sections.where(F.col(text_col).rlike(r"^ATOM\s*\n")).select(*carry, F.explode(F.split(text_col, r"\r?\n")).alias("line"))
    rows = atoms.select(*carry, F.split(F.trim("line"), r"\s+").alias("p")).where(F.size("p") >= 6)
    element = F.upper(F.split(F.col("p")[5], r"\.")[0])
    number = [F.expr(f"try_cast(p[{k}] AS {t})").alias(c) for c, k, t in (("ball_id", 0, "bigint"), ("x", 2, "double"), ("y", 3, "double"), ("z", 4, "double"))]
    later = [F.expr(f"try_cast(get(p, {k}) AS {t})").alias(c) for c, k, t in (("res_seq", 6, "int"), ("res_name", 7, "string"), ("charge", 8, "double"))]
    return rows.select(*carry, *number, radius(element).alias("rad"), F.col("p")[1].alias("name"), element.alias("element"), *later)


def read_mol2(spark: SparkSession, path: str) -> DataFrame:
    """All atoms of a file or folder of MOL2 files, with the file's name as system_id. Sections are the reader's records, so
    large files are still read in splits."""
    sections = spark.read.option("lineSep", MOL2_SECTION).text(path).select("value", F.col("_metadata.file_name").alias("system_id"))
    return parse_mol2(sections, carry=("system_id",))


def parse_xyz(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """element, x, y, z, rad of the atom lines of XYZ files; counts and comments fall out as they do not match."""
    parts = F.split(F.trim(text_col), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 4)
    rows = rows.select(F.upper(F.col("p")[0]).alias("element"), *[F.expr(f"try_cast(p[{k}] AS double)").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    rad = radius(F.col("element"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("rad", rad)


def write_xyz_lines(balls: DataFrame) -> DataFrame:
    """A text line for each ball, as spark.write.text takes it."""
    return balls.select(F.format_string("%-2s %12.6f %12.6f %12.6f", "element", "x", "y", "z").alias("value"))
