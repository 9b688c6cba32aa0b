"""Queries over balls against brute force where the SQL has a cut of its own."""

import numpy as np

from cellspan.plans import registry


def embeddings(spark, tmp_path, at, label):
    rows = [(i, [float(x) for x in p], int(c)) for i, (p, c) in enumerate(zip(at, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_path_length_takes_every_step_of_chains_of_any_length(spark, tmp_path):
    at = np.random.default_rng(1).uniform(0, 1, (13, 3)).astype("f4").astype(float)
    label = [1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4]
    got = {r.chain: (r.n_steps, r.length) for r in registry.QUERIES["path_length"](spark, embeddings(spark, tmp_path, at, label)).collect()}
    want = {}
    for c, n in ((2, 2), (3, 3), (4, 7)):
        p = 20 * at[[k for k in range(13) if label[k] == c]]
        want[c] = (n - 1, float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum()))
    assert got.keys() == want.keys()
    assert all(got[c][0] == want[c][0] and abs(got[c][1] - want[c][1]) < 1e-5 for c in want)


def test_layers_go_on_until_no_ball_is_left(spark, tmp_path):
    # twelve balls in a row, 2.2 apart at scale 60 with radii from 1.0: each touches the next; the last is out of reach
    at = np.array([[k * 2.2 / 60, 0.0, 0.0] for k in range(12)] + [[5.0, 0.0, 0.0]])
    got = registry.QUERIES["layer_bfs"](spark, embeddings(spark, tmp_path, at, [0] + [1] * 12)).collect()
    assert {(r.node, r.layer) for r in got} == {(k, k) for k in range(12)}


def test_alpha_counts_vertices_up_to_the_largest_alpha(spark, tmp_path):
    # four balls of radius 1 with their power vertex at rad 1.98
    at = np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]]) * (2.98 / 3) ** 0.5 / 60
    got = registry.QUERIES["alpha_complex_counts"](spark, embeddings(spark, tmp_path, at, [0] * 4)).collect()
    assert {r.alpha: r.n for r in got if r.dim == 3} == {0.0: 0, 0.5: 0, 1.0: 0, 2.0: 1, 8.0: 1, 64.0: 1}
    assert {r.dim: r.n for r in got if r.alpha == 2.0} == {0: 4, 1: 6, 2: 4, 3: 1}
