"""Readers of GRO and MOL2 files."""

from cellspan.plans import structures
from cellspan.sources import balls as source
from cellspan.sources import structures as R

GRO = """Water and an ion, t= 0.0
    2
    1SOL     OW    1   0.126   1.624   1.679  0.1227 -0.0580  0.0434
   12NA      NA    2  -1.190   1.661   0.747
   1.82060   1.82060   1.82060
"""
MOL2 = """# a remark
@<TRIPOS>MOLECULE
two atoms
 2 1 0 0 0
@<TRIPOS>ATOM
      1 C1   1.5000  -2.0000  0.2500 C.3  1  LIG1  -0.0500
      2 CL1  x  0.0  0.0 Cl

@<TRIPOS>BOND
     1     1     2    1 1 1 1
"""


def test_gro(spark, tmp_path):
    (tmp_path / "a.gro").write_text(GRO)
    rows = sorted(source.read_gro(spark, str(tmp_path)).collect(), key=lambda r: r.ball_id)
    assert [(r.system_id, r.ball_id, r.name, r.res_name, r.res_seq, r.is_solvent) for r in rows] == [("a.gro", 1, "OW", "SOL", 1, True), ("a.gro", 2, "NA", "NA", 12, True)]
    assert [round(v, 6) for r in rows for v in (r.x, r.y, r.z)] == [1.26, 16.24, 16.79, -11.9, 16.61, 7.47]


def test_mol2(spark, tmp_path):
    (tmp_path / "a.mol2").write_text(MOL2)
    rows = sorted(source.read_mol2(spark, str(tmp_path)).collect(), key=lambda r: r.ball_id)
    assert [(r.ball_id, r.name, r.element, r.rad, r.x, r.res_seq, r.res_name, r.charge) for r in rows] == [
        (1, "C1", "C", 1.7, 1.5, 1, "LIG1", -0.05), (2, "CL1", "CL", 1.75, None, None, None, None),
    ]


def test_nothing_and_nulls(spark):
    none = spark.createDataFrame([(None,), ("",)], "value string")
    assert source.parse_gro(none).count() == 0
    assert source.parse_mol2(none).count() == 0


def test_xyz(spark):
    lines = spark.createDataFrame([("2",), ("a remark",), ("O 0.0 1.5 -2.0",), ("xx 1 2 3",), (None,)], "value string")
    assert sorted((r.element, r.x, r.y, r.z, r.rad) for r in source.parse_xyz(lines).collect()) == [("O", 0.0, 1.5, -2.0, 1.52), ("XX", 1.0, 2.0, 3.0, 1.8)]


def test_log_reader_cuts_a_file_at_sparks_partitions(spark, monkeypatch):
    """A file's lines are counted up split by split, so a split is what one partition has of the file, not a whole table."""
    table, log_tables, got = structures.table, R.log_tables, []
    monkeypatch.setattr(structures, "table", lambda *a: table(*a).repartition(8))
    monkeypatch.setattr(structures.R, "log_tables", lambda lines, titles: got.append(lines) or log_tables(lines, titles))
    rows = {r.kind: (r.n, r.n_known) for r in structures.log_reader(spark, "/root/testdata/sf0.001").collect()}
    counts = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders")]
    assert rows == {"surfaces": (counts[0].count(), counts[0].where("l_discount > 0.05").count()), "edges": (counts[1].count(),) * 2}
    assert got[0].groupBy("system_id", "block").count().selectExpr("max(count)").first()[0] < counts[0].count() / 4 / 4
