"""Goldens and properties that the SQL twins don't cover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.config import EngineConfig, GridConfig
from graphloom.operators import costs, graph, linalg, nn, telemetry, tiling
from graphloom.plans import fixtures, registry
from graphloom.plans.preprocess import preprocess
from graphloom.sources import catalog, text

LOG = """pre gather | Avg Time: 99.000 ms
'epoch 0 | Max Time: 30.000 ms | Avg Time: 25.000 ms'
'gcn conv fwd | Avg Time: 9.000 ms'
'gather | Avg Time: 1.000 ms'
'AGG = A * H | Avg Time: 4.000 ms'
'all-reduce | Avg Time: 2.000 ms'
'OUT = AGG * W | Avg Time: 3.000 ms'
'cross entropy fwd | Avg Time: 0.500 ms'
'epoch 1 | Avg Time: 20.000 ms'
'AGG = A * H and All-Reduce AGG | Avg Time: 5.000 ms'
'reduce-scatter | Avg Time: 2.000 ms'
'cross entropy bwd | Avg Time: 1.000 ms'
Epoch: 001, Train Loss: 3.2100"""


def dense(nodes):
    return np.array([r["h"] for r in nodes.orderBy("id").collect()])


def test_tiny_graph(spark):
    """Forward, loss and gradients of one layer on four nodes, one of them isolated and unlabelled."""
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0)], "src long, dst long, w double")
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 1.0])], "id long, h array<double>")
    y = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, -1)], "id long, y long")
    a = graph.gcn_norm(edges, x.select("id")).cache()
    layer = nn.GCNLayer(np.array([[1.0, -1.0], [0.5, 2.0]]))
    agg = layer.aggregate(a, x)
    assert np.allclose(dense(agg), [[0.5, 0.707107], [2.085604, 1.07735], [1, 1.488034], [1, 1]], atol=1e-6)
    z = layer.forward(a, x)
    assert np.allclose(dense(z), [[0.853553, 0.914214], [2.624279, 0.069096], [1.744017, 1.976068], [1.5, 1]], atol=1e-6)
    rows = nn.loss_rows(z, y, 2, 4)
    assert abs(nn.mean_loss(rows, 4).first()["loss"] - 1.042454) < 1e-6
    cells, grad = layer.backward(a, agg, rows.select("id", F.col("grad").alias("h")))
    assert np.allclose(linalg.collect_matrix(cells, (2, 2)), [[0.279985, -0.279985], [-0.048634, 0.048634]], atol=1e-6)
    assert np.allclose(dense(grad), [[0.035245, -0.026434], [-0.136088, 0.102066], [0.174909, -0.131182], [0, 0]], atol=1e-6)


def test_double_permutation_changes_order_only(spark):
    rng = np.random.default_rng(0)
    n = 11
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 30), rng.integers(0, n, 30), rng.random(30))], "src long, dst long, w double")
    x = spark.createDataFrame([(k, [float(v) for v in rng.random(5)]) for k in range(n)], "id long, h array<double>")
    y = spark.createDataFrame([(k, k % 3) for k in range(n)], "id long, y long")
    g = preprocess(edges, x.select("id"), x, y)
    net = nn.Net.build(2, 5, 4, 3)
    plain = dense(net.forward(lambda _: graph.gcn_norm(edges, x.select("id")), graph.normalize_features(x)))
    perm = {r["old_id"]: r["new_id"] for r in graph.permutation(x.select("id"), 1).collect()}
    mixed = dense(net.forward(g.adjacency, g.nodes))
    assert np.allclose(mixed[[perm[k] for k in range(n)]], plain)
    assert {(r["id"], r["y"]) for r in g.targets(2).collect()} == {(perm[k], k % 3) for k in range(n)}


def test_wide_vectors_sum_in_slices(spark):
    h = np.random.default_rng(1).random((6, 150))
    x = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)], "id long, h array<double>")
    e = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (3, 5, -1.0)], "src long, dst long, w double")
    a = np.zeros((6, 6))
    a[0, 1], a[0, 2], a[3, 5] = 2, 1, -1
    assert np.allclose(dense(linalg.spmm(e, x, 150)), a @ h)


@pytest.mark.parametrize("version,machine,want", [("v1", "perlmutter", [160.05379, 170.51357, 180.366635, 225.301087, 254.860282, 286.239624]), ("v3", "frontier", [2.160561, 2.241645, 2.438706, 4.332713, 4.901159, 5.504608])])
def test_comm_goldens(spark, version, machine, want):
    got = [r["cost"] for r in costs.comm_cost(spark, 4, 100_000, [100, 128, 128, 47], version, machine).orderBy("cost").collect()]
    assert np.allclose(got, want, atol=1e-5)


def test_cost_goldens(spark):
    m = costs.memory_cost(spark, 4, 100_000, 1_000_000, [100, 128, 128, 47]).orderBy("cost").first()
    assert (m["x"], m["y"], m["z"]) == (2, 1, 2) and abs(m["cost"] - 0.28513968) < 1e-7
    assert abs(costs.spmm_cost(spark, 100_000, 10**6, 4, [100, 128, 128]).agg(F.min("cost")).first()[0] - 53665201.67) < 1
    assert [costs.grid_configs(spark, g).count() for g in (1, 2, 4, 8, 64)] == [1, 3, 6, 10, 28]
    with pytest.raises(ValueError):
        costs.grid_configs(spark, 6)


def test_log(spark):
    lines = telemetry.log_lines(spark.createDataFrame([(LOG,)], "value string"))
    times = telemetry.epoch_times(telemetry.log_segments(lines)).cache()
    for warmup, want in ((0, (9.25, 2.5)), (1, (8.0, 2.0))):
        assert tuple(telemetry.epoch_average(times, warmup).first()) == want


def test_shard_golden(spark):
    r = tiling.shard_bounds(spark, GridConfig(2, 1, 2), 10, 5, 3).filter("rx = 1 AND ry = 0 AND rz = 1").orderBy("layer").collect()
    assert [r[0][k] for k in ("node_start", "node_stop", "feat_start", "feat_stop", "depth_start", "depth_stop", "label_start", "label_stop")] == [5, 10, 0, 6, 15, 30, 5, 10]
    assert [tuple(x[k] for k in ("row_start", "row_stop", "col_start", "col_stop")) for x in r] == [(5, 10, 5, 10), (0, 10, 5, 10), (5, 10, 0, 10)]


def test_config_and_catalog():
    with pytest.raises(AssertionError):
        EngineConfig(overlap=True)
    with pytest.raises(AssertionError):
        GridConfig(2, 1, 1).groups(["x", "X"])
    with pytest.raises(ValueError):
        GridConfig().groups(["q"])
    with pytest.raises(ValueError):
        catalog.lookup("nothing")
    assert GridConfig(2, 3, 4).groups(["Z", "y"], (1, 2, 3)) == [("z", 4, 3), ("y", 3, 2)]


def test_symmetric_mtx_file(spark, tmp_path):
    f = tmp_path / "g.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.5\n2 1 0\n3 2 1\n")
    edges, n = text.read_mtx(spark, str(f))
    assert n == 3 and {tuple(r) for r in edges.collect()} == {(0, 0, 1.0), (2, 1, 1.0), (1, 2, 1.0)}


def test_orphan_timer(spark):
    t = spark.createDataFrame([(0, ["a"], 2.0), (1, ["a"], 4.0), (0, ["a", "b"], 1.0), (0, ["x", "y"], 1.0)], "rank int, stack array<string>, ms double")
    tree = telemetry.timer_tree(telemetry.timer_rollup(t, 2))
    assert {tuple(r["stack"]) for r in tree.filter("orphan").collect()} == {("x", "y")}
    with pytest.raises(AssertionError):
        telemetry.format_tree(tree)
    assert len(telemetry.format_tree(tree.filter("NOT orphan"))) == 2


def test_mtx_keeps_an_entry_that_reads_like_the_size_line(spark, tmp_path):
    from graphloom.sources.text import read_mtx, write_mtx

    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 3\n1 2 5\n3 3 3\n2 1 0\n3 3 3\n")
    edges, n = read_mtx(spark, f"file://{tmp_path}/a.mtx", keep_values=True)
    assert n == 3 and sorted(map(tuple, edges.collect())) == [(0, 1, 5.0), (2, 2, 3.0), (2, 2, 3.0)]
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n4 4 2\n2 1\n3 3\n")
    assert sorted(map(tuple, read_mtx(spark, f"file://{tmp_path}/p.mtx")[0].collect())) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    path = write_mtx(edges.repartition(3), f"file://{tmp_path}/out", 3, "some/folder/graph.pt")
    assert path.endswith("/out/graph.mtx")
    lines = (tmp_path / "out" / "graph.mtx").read_text().splitlines()
    assert lines[1] == "3 3 3" and sorted(lines[2:]) == ["1 2 5.0", "3 3 3.0", "3 3 3.0"]


def test_training_equals_numpy(spark):
    """Three epochs of loss, weights and trained features against a dense version."""
    import numpy as np

    from graphloom.operators.nn import AdamW, Net
    from graphloom.plans.train import Trainer
    from graphloom.schema import Graph

    rng = np.random.default_rng(0)
    n, f, c = 12, 5, 3
    a = (rng.random((n, n)) < 0.3) * rng.random((n, n))
    x, y = rng.random((n, f)), rng.integers(-1, c, n)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double")
    nodes = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(n)], "id long, h array<double>")
    labels = spark.createDataFrame([(k, int(y[k]) if y[k] >= 0 else None) for k in range(n)], "id long, y int")
    trainer = Trainer(Graph(edges, nodes, labels, n, f, c), Net.build(3, f, 4, c), AdamW(lr=0.05, weight_decay=0.01))
    got = [r["loss"] for r in trainer.fit(3)]

    w = [layer.weight for layer in Net.build(3, f, 4, c).layers]
    state = [(v, np.zeros_like(v), np.zeros_like(v)) for v in [*w, x]]
    want = []
    for t in range(1, 4):
        *w, h = [s[0] for s in state]
        aggs, zs = [], []
        for k in range(3):
            aggs.append(a @ h)
            zs.append(aggs[-1] @ w[k])
            h = np.maximum(zs[-1], 0)
        p = np.exp(zs[-1] - zs[-1].max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        known = y >= 0
        want.append(-np.log(np.maximum(p[known, y[known]], 1e-9)).sum() / n)
        g = (p - np.eye(c)[np.maximum(y, 0)]) * known[:, None] / n
        grads = [None] * 3
        for k in (2, 1, 0):
            grads[k] = aggs[k].T @ g
            g = a.T @ (g @ w[k].T)
            if k:
                g = g * (zs[k - 1] > 0)
        new = []
        for (v, m, s), d in zip(state, [*grads, g]):
            m, s = 0.9 * m + 0.1 * d, 0.999 * s + 0.001 * d * d
            new.append((v - 0.05 * (m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) + 0.01 * v), m, s))
        state = new
    assert np.allclose(got, want, atol=1e-9)
    for layer, (v, _, _) in zip(trainer.net.layers, state):
        assert np.allclose(layer.weight, v, atol=1e-7)
    for r in trainer.state.collect():
        assert all(np.allclose(r[k], state[3][j][r["id"]], atol=1e-7) for j, k in enumerate(("h", "m", "v")))
    trainer.close()


def test_shards_of_every_rank_and_layer(spark, tmp_path):
    """Blocks of all ranks and layer residues, from the tiled and the plain form, against slices of dense matrices."""
    import numpy as np

    from graphloom.config import GridConfig
    from graphloom.operators.tiling import shard_bounds
    from graphloom.schema import Graph
    from graphloom.sources import store

    rng = np.random.default_rng(3)
    n, f, layers = 10, 6, 4
    a = [(rng.random((n, n)) < 0.4) * rng.integers(1, 9, (n, n)) for _ in range(2)]
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "src long, dst long, w double")
    nodes = spark.createDataFrame([(k, [float(10 * k + j) for j in range(f)]) for k in range(n)], "id long, h array<double>")
    ys = [spark.createDataFrame([(k, (k + d) % 3) for k in range(n)], "id long, y int") for d in range(2)]
    g = Graph(frame(a[0]), nodes, ys[0], n, f, 3, frame(a[1]), ys[1])
    store.save_tiled(g, f"file://{tmp_path}/tiled", 3)
    store.save_graph(g, f"file://{tmp_path}/plain")
    grid = GridConfig(2, 1, 2)
    bounds = {(b["rank"], b["layer"]): b for b in shard_bounds(spark, grid, n, f, layers).collect()}
    for rank in range(4):
        for form in ("tiled", "plain"):
            got = store.load_shard(spark, f"file://{tmp_path}/{form}", grid, rank, layers)
            assert len(got["adjacency"]) == layers
            for layer, (block, back) in enumerate(got["adjacency"]):
                b = bounds[rank, layer]
                part = a[layer % 2][b["row_start"] : b["row_stop"], b["col_start"] : b["col_stop"]]
                want = sorted((int(i), int(j), float(part[i, j])) for i, j in zip(*np.nonzero(part)))
                assert sorted(map(tuple, block.select("src", "dst", "w").collect())) == want
                assert sorted((j, i, w) for i, j, w in back.select("src", "dst", "w").collect()) == want
            if form == "tiled":
                first = {k: sorted(map(str, got[k].collect())) for k in ("features", "labels")}
            else:
                assert first == {k: sorted(map(str, got[k].collect())) for k in ("features", "labels")}


def test_pairs_are_dealt_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    """Adaptive execution would put all of these pairs, and many MB of larger ones, into one task."""
    spark.range(50_000).selectExpr("id % 911 AS l_suppkey", "id % 733 AS l_partkey", "1e0 AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    files = sum(p.stat().st_size for p in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    monkeypatch.setattr(graph, "DEALT_BYTES", files // 20, raising=False)
    edges = fixtures.supplier_part(spark, str(tmp_path))
    for pairs in (edges, graph.coalesce_edges(edges, few=True)):
        each = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(each) >= 40 and max(each) < 3 * sum(each) / len(each)


def test_normalisation_hashes_nodes_and_sorts_no_edges(spark):
    """Existing loops stay, isolated nodes get one, a negative degree counts as 0; without nodes all ends are nodes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(0, 1, 1.0), (0, 1, 2.0), (1, 0, 1.0), (2, 2, 4.0), (0, 2, 1.0), (1, 3, -3.0)]
        edges = spark.createDataFrame(rows, "src long, dst long, w double")
        for n, nodes in ((4, None), (6, spark.range(6))):
            a = np.zeros((n, n))
            for i, j, w in rows:
                a[i, j] += w
            a += np.diag(np.diag(a) == 0)
            deg = a.sum(0)
            s = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
            out = graph.gcn_norm(edges, nodes) if nodes else graph.gcn_norm(edges)
            got = {(r["src"], r["dst"]): r["w"] for r in out.collect()}
            want = {(i, j): s[i] * a[i, j] * s[j] for i, j in zip(*np.nonzero(a))}
            assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flagship_sorts_no_edges(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") >= 3 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_self_loops_of_dealt_pairs(spark, tmp_path, monkeypatch):
    spark.range(50_000).selectExpr("id % 911 AS l_suppkey", "id % 733 AS l_partkey", "1e0 AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(graph, "DEALT_BYTES", sum(p.stat().st_size for p in (tmp_path / "lineitem.parquet").glob("*.parquet")) // 20, raising=False)
    out = registry.add_self_loops(spark, str(tmp_path)).cache()
    each = [r["n"] for r in out.filter("src <> dst").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(each) >= 40 and max(each) < 3 * sum(each) / len(each)
    assert out.filter("src = dst AND w = 1").count() == 911 + 733 == out.filter("src = dst").count()
    out.unpersist()
