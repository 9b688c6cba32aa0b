"""Readers and writers of structure files, over files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.operators import analysis, matching, selection
from cellspan.sources import structures as R


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def atom(serial, name, x, alt=" ", res="ALA", chain="A", seq=1, occ=1.0, b=0.0, element="C", record="ATOM"):
    return f"{record:<6}{serial:>5} {name:<4}{alt}{res:<3} {chain}{seq:>4}    {x:8.3f}{0:8.3f}{0:8.3f}{occ:6.2f}{b:6.2f}          {element:>2}"


def test_frames_alternates_virtual_sites_and_rollover(spark, tmp_path):
    lines = [
        "CRYST1   10.000   20.000   30.000  90.00  95.50 120.00 P 1", "MODEL        1", atom(1, " CA", 1.0, seq=9998), atom(2, " CB", 2.0, "A", occ=0.3, seq=9999), atom(3, " CB", 3.0, "B", occ=0.7, seq=9999),
        atom(4, " MW", 4.0, element="M"), atom(5, " CA", 5.0, seq=1, b=1.5), "ENDMDL", "REMARK", "MODEL        2", atom(1, " CA", 6.0), "ENDMDL", "END", "",
    ]
    rows = R.read_lines(spark, put(tmp_path, "a.pdb", "\n".join(lines)))
    got = R.pdb_atoms(rows).orderBy("frame", "serial").collect()
    assert [(r.frame, r.serial, r.x, r.turn) for r in got] == [(1, 1, 1.0, 0), (1, 3, 3.0, 0), (1, 5, 5.0, 1), (2, 1, 6.0, 0)]
    assert [r.serial for r in R.pdb_atoms(rows, first_frame=True).orderBy("serial").collect()] == [1, 3, 5]
    assert R.frame_counts(rows).collect()[0].n_frames == 2
    assert {r.serial: r.rad for r in R.pdb_atoms(rows, True, "b_factor").collect()} == {1: 0.0, 3: 0.0, 5: 1.5}
    assert tuple(R.pdb_cells(rows).collect()[0])[1:] == (10.0, 20.0, 30.0, 90.0, 95.5, 120.0)
    assert R.pdb_atoms(R.read_lines(spark, put(tmp_path, "none.pdb", "REMARK\n"))).collect() == []


def test_cif_with_quotes_and_any_order_of_columns(spark, tmp_path):
    head = ["group_PDB", "Cartn_z", "Cartn_x", "Cartn_y", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "occupancy"]
    body = ["ATOM 3 1 2 7 C \"C1'\" . ALA A 4 1.0", "ATOM 3 1 2 8 O 'O x' A ALA A 4 0.4", "HETATM 3 9 2 9 O 'O x' B ALA A 4 0.6", "ATOM ? 1 2 10 N N . GLY B ? 1.0"]
    rows = R.read_lines(spark, put(tmp_path, "a.cif", "data_x\nloop_\n" + "\n".join(f"_atom_site.{c}" for c in head) + "\n" + "\n".join(body) + "\n#\n"))
    got = {r.serial: (r.name, r.x, r.z, r.chain, r.res_seq) for r in R.cif_atoms(rows).collect()}
    assert got == {7: ("C1'", 1.0, 3.0, "A", 4), 9: ("O x", 9.0, 3.0, "A", 4), 10: ("N", 1.0, None, "B", None)}


def test_gro_of_any_precision(spark, tmp_path):
    text = "t\n 2\n    1SOL     OW    1   0.126   1.624   1.679\n    2SOL    HW1    2   0.12634   1.62412   1.67991\n   1.0 1.0 1.0\n"
    got = R.gro_atoms(R.read_lines(spark, put(tmp_path, "a.gro", text))).orderBy("serial").collect()
    assert [(r.serial, r.name, r.res_seq, round(r.x, 4), round(r.z, 4)) for r in got] == [(1, "OW", 1, 1.26, 16.79), (2, "HW1", 2, 1.2634, 16.7991)]


def test_sdf_of_both_forms(spark, tmp_path):
    old = "one\n\n\n  2  1  0  0  0  0            999 V2000\n    1.0000    2.0000    3.0000 C   0  0\n    4.0000    5.0000    6.0000 O   0  0\n  1  2  2  0\nM  END\n$$$$\n"
    new = "two\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 BEGIN ATOM\nM  V30 1 N 7 -\nM  V30 8 9 0\nM  V30 END ATOM\nM  V30 END CTAB\nM  END\n$$$$\n"
    rows = R.read_records(spark, put(tmp_path, "a.sdf", old + new))
    assert sorted((r.atom, r.element, r.x, r.z) for r in R.mol_atoms(rows).collect()) == [(1, "C", 1.0, 3.0), (1, "N", 7.0, 9.0), (2, "O", 4.0, 6.0)]
    assert [(r.a, r.b, r.kind) for r in R.mol_bonds(rows).collect()] == [(1, 2, 2)]


def test_index_files_tables_and_logs(spark, tmp_path):
    rows = R.read_lines(spark, put(tmp_path, "a.ndx", "; note\n[ Protein ]\n1 2 3\n4\n[ Water ]\n  7 8\n\n"))
    assert sorted((r.group_id, r.serial) for r in R.index_groups(rows).collect()) == [("Protein", 1), ("Protein", 2), ("Protein", 3), ("Protein", 4), ("Water", 7), ("Water", 8)]
    rows = R.read_lines(spark, put(tmp_path, "a.txt", "# x y z r\n1, 2, 3, 0.5\n4 5 6 0.7\nbad line here now\n"))
    assert [(r.x, r.rad) for r in R.txt_balls(rows).orderBy("x").collect()] == [(1.0, 0.5), (4.0, 0.7)]
    rows = R.read_lines(spark, put(tmp_path, "a.vta", "4 1 3 2 0.5 0.6 0.7 1.5\nnothing\n"))
    assert [tuple(r) for r in R.tangent_vertices(rows).collect()] == [(1, 2, 3, 4, 0.5, 0.6, 0.7, 1.5)]
    rows = R.read_lines(spark, put(tmp_path, "a.csv", "Atoms\nIndex, Cell  Volume\n0,1.5\n1,\n\nsurfaces,,\nA,B,Area\n1,2\n"))
    got = {(r.table, r.row): r.fields for r in R.log_tables(rows, ["atoms", "surfaces"]).collect()}
    assert got == {("atoms", 1): {"index": "0", "cell_volume": "1.5"}, ("atoms", 2): {"index": "1", "cell_volume": None}, ("surfaces", 1): {"a": "1", "b": "2", "area": None}}


def test_lines_are_written_in_order_and_tables_with_a_manifest(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS at", "cast(id AS string) AS value")
    R.write_lines(df.repartition(3), f"{tmp_path}/lines", ["at"])
    assert [r.value for r in R.read_lines(spark, f"{tmp_path}/lines").orderBy("system_id", "block", "at").collect()] == [str(k) for k in range(100)]
    balls = spark.createDataFrame([(1, 0.5), (2, 0.7)], "ball_id long, rad double")
    surfs = spark.createDataFrame([(1, 2), (1, 9)], "f0 long, f1 long")
    R.save_tables({"balls": balls, "surfs": surfs}, f"{tmp_path}/net")
    back = R.load_tables(spark, f"{tmp_path}/net")
    assert sorted(map(tuple, back["balls"].collect())) == [(1, 0.5), (2, 0.7)]
    lost = R.dangling(back, {("surfs", "f0"): ("balls", "ball_id"), ("surfs", "f1"): ("balls", "ball_id")}).collect()
    assert [(r.table, r.column, r.n) for r in lost] == [("surfs", "f1", 1)]
    balls.limit(1).write.mode("append").parquet(f"{tmp_path}/net/balls")
    with pytest.raises(ValueError):
        R.load_tables(spark, f"{tmp_path}/net")


@pytest.fixture()
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_ranks_and_quantiles_of_ties_nulls_and_small_groups(spark, checkpoints):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    q = {r.k: (r.lo, r.mid) for r in analysis.quantiles(df, ["k"], "v", {"lo": 0.0, "mid": 0.75}).collect()}
    assert q == {"a": (1.0, 2.0), "b": (5.0, 5.0), None: (2.0, 3.5)}
    ranks = {(r.k, r.v): r.p for r in analysis.average_ranks(df, "v", "p", ["k"]).collect()}
    assert ranks == {("a", 1.0): 1.5, ("a", 3.0): 3.0, ("a", None): None, ("b", 5.0): 1.0, (None, 2.0): 1.0, (None, 4.0): 2.0}
    z = {(r.k, r.v): r.z for r in analysis.robust_z(df, ["k"], "v", least=2).collect()}
    assert z["a", 3.0] == 0.0 and z["b", 5.0] is None and z["a", None] is None
    assert analysis.quantiles(df.where("false"), ["k"], "v", {"x": 0.5}).collect() == []


def test_moving_average_mirrors_its_ends(spark):
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate((1, 2, 4, 8))] + [("b", 0, 5.0)], "k string, f int, v double")
    got = {(r.k, r.f): r.moving for r in analysis.moving_average(df, ["k"], "f", "v", 3).collect()}
    assert got == {("a", 0): (2 + 1 + 2) / 3, ("a", 1): 7 / 3, ("a", 2): 14 / 3, ("a", 3): (4 + 8 + 4) / 3, ("b", 0): 5.0}


def test_signs_of_differences_from_the_first_frame(spark):
    df = spark.createDataFrame([("a", 1, -2.0), ("a", 2, -1.0), ("b", 1, 0.0), ("b", 2, 1.0), ("c", 1, None), ("c", 2, 4.0)], "k string, f int, v double")
    got = {(r.k, r.f): r.pct for r in analysis.percent_of_first(df, ["k"], "f", "v").collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 50.0, ("b", 1): None, ("b", 2): None, ("c", 1): None, ("c", 2): 0.0}


def test_shell_lies_around_the_balls(spark):
    balls = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 6.0, 0.0, 0.0, 1.5)], "ball_id long, x double, y double, z double, rad double")
    rows = selection.virtual_shell(balls).collect()
    assert len({r.shell_id for r in rows}) == len(rows) > 50
    assert all(r.x <= -3.7 or r.x >= 10.2 or abs(r.y) >= 4.2 or abs(r.z) >= 4.2 for r in rows)
    with pytest.raises(ValueError):
        selection.lattice_region(1.0, 1.0, 1.0, 90.0, 90.0, 0.0)
    middle, planes = selection.lattice_region(10.0, 10.0, 10.0, 90.0, 90.0, 90.0)
    inside = balls.select("ball_id", selection.in_region(middle, planes).alias("i")).collect()
    assert {r.ball_id: r.i for r in inside} == {0: True, 1: True}


def test_insertion_points_of_values_below_between_and_above(spark, checkpoints):
    values = spark.createDataFrame([(2,), (2,), (5,), (9,)], "v long")
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,), (10,)], "v long")
    assert {r.v: r.place for r in matching.insertion_points(values, asked, "v").collect()} == {1: 0, 2: 0, 3: 2, 9: 3, 10: 4}


def test_lattice_region_is_that_of_all_images():
    """Fourteen half-spaces hold the same points as those of all images in four shells, for slanted and flat cells too."""
    from itertools import product

    rng = np.random.default_rng(3)
    for a, b, c, al, be, ga in ((12, 14, 16, 90, 95, 100), (1, 1, 1, 60, 60, 60), (3, 20, 5, 70, 110, 60), (2, 9, 9, 25, 80, 85), (5, 5, 5, 109.47, 109.47, 109.47)):
        middle, planes = selection.lattice_region(a, b, c, al, be, ga)
        rows = np.linalg.cholesky(np.outer([a, b, c], [a, b, c]) * np.cos(np.radians([[0, ga, be], [ga, 0, al], [be, al, 0]])))
        assert np.allclose(np.linalg.norm(rows, axis=1), [a, b, c]) and np.allclose(middle, rows.sum(0) / 2) and len(planes) == 14
        images = np.array([k for k in product(range(-6, 7), repeat=3) if any(k)]) @ rows
        spots = rng.normal(size=(4000, 3)) * max(a, b, c) / 2
        every = (spots @ images.T <= (images**2).sum(1) / 2 + 1e-9).all(1)
        ours = (spots @ np.array([n for n, _ in planes]).T <= np.array([o for _, o in planes]) + 1e-9).all(1)
        assert (every == ours).all() and every.any()


def test_numbers_beyond_the_places(spark):
    given = [(n, n // 7, n // 1000, n) for n in (1, 99999, 100000, 100001, 1234567, 43770015, 43770016, 43770017)]
    a = spark.createDataFrame(given, "serial long, res_seq long, block long, at long").selectExpr("*", "'CA' AS name", "'ALA' AS res_name", "'A' AS chain", "1.0D AS x", "2.0D AS y", "3.0D AS z", "'one' AS system_id")
    got = R.pdb_record(R.pdb_lines(a.withColumn("res_seq", F.col("res_seq") % 2400000))).orderBy("serial").collect()
    assert [(r.serial, r.res_seq, r.name, r.x) for r in got] == [(n, k % 2400000, "CA", 1.0) for n, k, _, _ in given]
    steps = [(n, n // 7, n // 1000, n) for n in range(1, 260000, 13)]
    a = spark.createDataFrame(steps, "serial long, res_seq long, block long, at long").selectExpr("*", "'CA' AS name", "'ALA' AS res_name", "1.0D AS x", "2.0D AS y", "3.0D AS z", "'one' AS system_id")
    lines = R.gro_lines(a)
    more = lines.selectExpr("system_id", "block + 1000 AS block", "at + 1000000 AS at", "value").where("at < 1100000")
    title = spark.createDataFrame([("one", 999, 0, "a frame")], "system_id string, block long, at long, value string")
    got = R.gro_whole(lines.union(title).union(more)).orderBy("block", "at").select("serial", "res_seq").collect()
    assert [tuple(r) for r in got] == [(n, k) for n, k, _, _ in steps] + [(n, k) for n, k, _, _ in steps if n < 100000]


def test_mol_reader_reads_each_table_once(spark, sf_dir):
    from cellspan.plans.structures import mol_reader

    plan = mol_reader(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate ") == 1 and "Union" not in plan


def test_mol_parts_of_both_forms(spark):
    old = "m\n\n\n  2  1  0  0  0  0  0  0  0999 V2000\n    1.0000    2.0000    3.0000 C   0  0\n    4.0000    5.0000    6.0000 N   0  0\n  1  2  1  0\nM  END\n"
    new = "m\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 BEGIN ATOM\nM  V30 1 C -\nM  V30 1.5 0 x 0\nM  V30 END ATOM\nM  V30 END CTAB\nM  END\n"
    rows = spark.createDataFrame([("f", 1, old), ("f", 2, new), ("f", 3, "m\n"), ("f", 4, None)], "system_id string, record long, value string")
    got = {r.record: r for r in R.mol_parts(rows).collect()}
    assert [(a.atom, a.element, a.x, a.y, a.z) for a in got[1].atoms] == [(1, "C", 1.0, 2.0, 3.0), (2, "N", 4.0, 5.0, 6.0)] and [tuple(b) for b in got[1].bonds] == [(1, 2, 1)]
    assert [(a.atom, a.element, a.x, a.y, a.z) for a in got[2].atoms] == [(1, "C", 1.5, 0.0, None)] and got[2].bonds is None
    assert got[3].atoms is None and got[4].atoms is None
    assert R.mol_atoms(rows).count() == 3 and R.mol_bonds(rows).count() == 1
