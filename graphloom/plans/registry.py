"""Every registered query of the engine, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import GridConfig
from graphloom.functions.scalars import basename, pad_dimension, round6
from graphloom.functions.vectors import one_hot
from graphloom.lineage import scratch
from graphloom.operators import costs as C
from graphloom.operators import graph as G
from graphloom.operators import linalg as L
from graphloom.operators import nn as N
from graphloom.operators import telemetry as M
from graphloom.operators import tiling as T
from graphloom.plans import fixtures as X
from graphloom.plans.fixtures import SQL_NORM, SQL_RING, SQL_SP, SQL_UE, SQL_X, SQL_Y, sql_round
from graphloom.plans.preprocess import preprocess
from graphloom.plans.train import Trainer
from graphloom.schema import Graph
from graphloom.sources import store, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
D, HID, OUT, P = 64, 16, 10, 4
GRID = GridConfig(2, 1, 2)


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: round6(F.col(c)) for c in cols})


def long_form(df: DataFrame, vector: str = "h", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("j", "v")).withColumn("v", round6(F.col("v").cast("double")))


def normed_ring(s, d) -> DataFrame:
    return G.gcn_norm(X.ring(s, d), X.vectors(s, d).select("id"))


# ---- edges and degrees
@query(f"WITH {SQL_UE} SELECT src, dst, sum(w) AS w FROM e GROUP BY 1, 2")
def graph_edges_coalesced(s, d):
    return G.coalesce_edges(X.user_event(s, d))


@query(f"WITH {SQL_SP}, nd AS (SELECT DISTINCT src AS id FROM e) SELECT src, dst, w FROM e UNION ALL SELECT id, id, 1e0 FROM nd WHERE id NOT IN (SELECT src FROM e WHERE src = dst)")
def add_self_loops(s, d):
    e = X.supplier_part(s, d)
    return G.add_self_loops(e, G.node_ids(e))


@query(f"WITH {SQL_RING}, f AS (SELECT * FROM e WHERE src % 3 <> 0) SELECT vec_id AS id, count(f.src) AS deg FROM embeddings LEFT JOIN f ON f.src = vec_id GROUP BY 1")
def out_degree(s, d):
    return G.out_degree(X.ring(s, d).filter("src % 3 <> 0"), X.vectors(s, d))


@query(f"WITH {SQL_SP} SELECT dst AS id, sum(w) AS deg FROM e GROUP BY 1")
def weighted_degree(s, d):
    return G.weighted_degree(X.supplier_part(s, d))


@query(f"WITH {SQL_SP}, {SQL_NORM} SELECT src, dst, {sql_round('w')} AS w FROM g")
def gcn_norm(s, d):
    return r6(G.gcn_norm(X.supplier_part(s, d)), "w")


@query(f"WITH {SQL_RING}, {SQL_NORM} SELECT dst AS src, src AS dst, {sql_round('w')} AS w FROM g")
def gcn_norm_directed(s, d):
    return r6(G.transpose(normed_ring(s, d)), "w")


@query(f"WITH {SQL_RING} SELECT dst AS src, src AS dst, w FROM e")
def transpose(s, d):
    return G.transpose(X.ring(s, d))


@query(f"SELECT c_custkey AS src, c_nationkey::BIGINT + {X.OFFSET} AS dst, 1e0 AS w FROM customer UNION ALL SELECT c_nationkey::BIGINT + {X.OFFSET}, c_custkey, 1e0 FROM customer")
def symmetrize(s, d):
    return X.customer_nation(s, d)


# ---- features, labels, permutations
@query(f"WITH {SQL_X}, m AS (SELECT min(v) AS m FROM x), t AS (SELECT id, greatest(sum(v - m), 1) AS t FROM x, m GROUP BY 1) SELECT id, j::INT AS j, {sql_round('(v - m) / t')} AS v FROM x JOIN t USING (id), m")
def feature_row_normalize(s, d):
    return long_form(G.normalize_features(X.vectors(s, d)))


@query(f"SELECT vec_id AS id, j::INT AS j, {sql_round('((vec_id * 7919 + j * 104729 + 3 * 31337) % 10007) / 10007e0')} AS v FROM embeddings, generate_series(0, 31) t(j)")
def random_features(s, d):
    return long_form(G.random_features(X.vectors(s, d), 32, seed=3))


@query("SELECT doc_id AS id, coalesce(quality, -1)::BIGINT AS y FROM documents LEFT JOIN labels USING (doc_id)")
def label_clean(s, d):
    docs, lab = X.table(s, d, "documents"), X.table(s, d, "labels")
    nan_or_null = F.when(F.col("doc_id") % 2 == 0, F.coalesce(F.col("quality").cast("double"), F.lit(float("nan")))).otherwise(F.col("quality").cast("double"))
    return G.clean_labels(docs.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), nan_or_null.alias("y")))


@query("SELECT max(coalesce(quality, -1))::BIGINT + 1 AS num_classes FROM documents LEFT JOIN labels USING (doc_id)")
def class_count(s, d):
    return G.class_count(label_clean(s, d))


@query(f"WITH {SQL_SP}, c AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1) SELECT id, ntile(32) OVER (ORDER BY deg, id) - 1 AS y FROM c")
def degree_bucket_labels(s, d):
    e = X.supplier_part(s, d)
    return G.degree_bucket_labels(e, G.node_ids(e), 32)


def sql_perm(seed: int, name: str) -> str:
    return f"{name} AS (SELECT vec_id AS old_id, row_number() OVER (ORDER BY md5('{seed}:' || vec_id), vec_id) - 1 AS new_id FROM embeddings)"


def perms(s, d):
    ids = X.vectors(s, d).select("id")
    return G.permutation(ids, 0), G.permutation(ids, 1)


@query(f"WITH {sql_perm(0, 'p')} SELECT old_id, new_id FROM p")
def permutation(s, d):
    return perms(s, d)[0]


@query(f"WITH {SQL_X}, {sql_perm(1, 'p')} SELECT new_id AS id, j::INT AS j, {sql_round('v')} AS v FROM x JOIN p ON old_id = id")
def permute_features(s, d):
    return long_form(G.permute_rows(X.vectors(s, d), perms(s, d)[1]))


@query(f"WITH {SQL_Y}, {sql_perm(0, 'p')}, {sql_perm(1, 'q')} SELECT 0 AS perm_id, new_id AS id, y FROM y JOIN p ON old_id = id UNION ALL SELECT 1, new_id, y FROM y JOIN q ON old_id = id")
def permute_labels(s, d):
    p, q = perms(s, d)
    y = X.vector_labels(s, d)
    return G.permute_rows(y, p).withColumn("perm_id", F.lit(0)).unionByName(G.permute_rows(y, q).withColumn("perm_id", F.lit(1)))


@query(f"WITH {SQL_RING}, {sql_perm(0, 'p')} SELECT a.new_id AS src, b.new_id AS dst, w FROM e JOIN p a ON a.old_id = src JOIN p b ON b.old_id = dst")
def single_perm_edges(s, d):
    p, _ = perms(s, d)
    return G.permute_edges(X.ring(s, d), p, p)


@query(f"WITH {SQL_RING}, {sql_perm(0, 'p')}, {sql_perm(1, 'q')} SELECT 0 AS perm_id, a.new_id AS src, b.new_id AS dst, w FROM e JOIN p a ON a.old_id = src JOIN q b ON b.old_id = dst UNION ALL SELECT 1, a.new_id, b.new_id, w FROM e JOIN q a ON a.old_id = src JOIN p b ON b.old_id = dst")
def double_perm_edges(s, d):
    one, two = G.double_permute(X.ring(s, d), *perms(s, d))
    return one.withColumn("perm_id", F.lit(0)).unionByName(two.withColumn("perm_id", F.lit(1)))


# ---- tiles and shards
SQL_TILES = f"{SQL_RING}, t AS (SELECT least(src // (n // {P}), {P - 1}) AS r, least(dst // (n // {P}), {P - 1}) AS c, count(*) AS k FROM e, n GROUP BY 1, 2), tc AS (SELECT a.i::INT AS row_tile, b.i::INT AS col_tile, coalesce(k, 0)::BIGINT AS nnz FROM generate_series(0, {P - 1}) a(i) CROSS JOIN generate_series(0, {P - 1}) b(i) LEFT JOIN t ON r = a.i AND c = b.i)"
SQL_W = f"((n + {P - 1}) // {P})"


@query(f"WITH {SQL_TILES} SELECT * FROM tc")
def tile_counts(s, d):
    return T.tile_counts(X.ring(s, d), X.vector_count(s, d), P)


@query(f"WITH {SQL_TILES} SELECT min(nnz) AS min_nnz, {sql_round('avg(nnz)')} AS mean_nnz, quantile_disc(nnz, 0.5) AS median_nnz, max(nnz) AS max_nnz, {sql_round('max(nnz) / avg(nnz)')} AS max_over_mean, {sql_round('max(nnz) / nullif(min(nnz), 0)')} AS max_over_min FROM tc")
def tile_skew_stats(s, d):
    return r6(T.tile_skew(tile_counts(s, d)), "mean_nnz", "max_over_mean", "max_over_min")


@query(f"WITH {SQL_RING} SELECT (src // {SQL_W})::INT AS row_tile, (dst // {SQL_W})::INT AS col_tile, src, dst, w FROM e, n")
def tile_edges_2d(s, d):
    return T.tile_edges(X.ring(s, d), X.vector_count(s, d), P)


@query(f"WITH {SQL_X}, n AS (SELECT count(*) AS n FROM embeddings) SELECT id, (id // {SQL_W})::INT AS row_tile, (j // {D // P})::INT AS col_tile, (j % {D // P})::INT AS j, {sql_round('v')} AS v FROM x, n")
def tile_features_2d(s, d):
    return long_form(T.tile_features(X.vectors(s, d), X.vector_count(s, d), D, P), keep=("id", "row_tile", "col_tile"))


@query(f"WITH {SQL_Y}, n AS (SELECT count(*) AS n FROM embeddings) SELECT id, (id // {SQL_W})::INT AS row_tile, y FROM y, n")
def tile_labels(s, d):
    return T.tile_labels(X.vector_labels(s, d), X.vector_count(s, d), P)


def sql_pad(v: str, p: str) -> str:
    return f"((({v}) + ({p}) - 1) // ({p}) * ({p}))"


SQL_BOUNDS = f"""n AS (SELECT count(*) AS n FROM embeddings),
rk AS (SELECT i AS rank, i // {GRID.y * GRID.z} AS rx, i // {GRID.z} % {GRID.y} AS ry, i % {GRID.z} AS rz FROM generate_series(0, {GRID.world - 1}) t(i)),
st AS (SELECT *, {sql_pad('n', str(GRID.x))} // {GRID.x} AS sx, {sql_pad('n', str(GRID.y))} // {GRID.y} AS sy, {sql_pad('n', str(GRID.z))} // {GRID.z} AS sz, {sql_pad(str(D), str(GRID.y * GRID.z))} // {GRID.y} AS fw FROM rk, n),
sb AS (SELECT rank, rx, ry, rz, layer, rx * sx AS node_start, (rx + 1) * sx AS node_stop, ry * fw AS feat_start, (ry + 1) * fw AS feat_stop, rz * (sx * fw // {GRID.z}) AS depth_start, (rz + 1) * (sx * fw // {GRID.z}) AS depth_stop,
rx * sx AS label_start, (rx + 1) * sx AS label_stop,
CASE layer % 3 WHEN 0 THEN rz * sz WHEN 1 THEN ry * sy ELSE rx * sx END AS row_start, CASE layer % 3 WHEN 0 THEN (rz + 1) * sz WHEN 1 THEN (ry + 1) * sy ELSE (rx + 1) * sx END AS row_stop,
CASE layer % 3 WHEN 0 THEN rx * sx WHEN 1 THEN rz * sz ELSE ry * sy END AS col_start, CASE layer % 3 WHEN 0 THEN (rx + 1) * sx WHEN 1 THEN (rz + 1) * sz ELSE (ry + 1) * sy END AS col_stop
FROM st, generate_series(0, 2) t(layer))"""


@query(f"WITH {SQL_BOUNDS} SELECT * FROM sb")
def shard_bounds(s, d):
    return T.shard_bounds(s, GRID, X.vector_count(s, d), D, 3)


@query(f"WITH {SQL_BOUNDS} SELECT rank, layer, r.i::INT AS row_tile, c.i::INT AS col_tile FROM sb, n, generate_series(0, {P - 1}) r(i), generate_series(0, {P - 1}) c(i) WHERE r.i * {SQL_W} < row_stop AND (r.i + 1) * {SQL_W} > row_start AND c.i * {SQL_W} < col_stop AND (c.i + 1) * {SQL_W} > col_start")
def tiles_for_shard(s, d):
    return T.tiles_for_shards(shard_bounds(s, d), X.vector_count(s, d), P)


ROWS, COLS = (100, 350), (50, 400)


@query(f"WITH {SQL_RING} SELECT src - {ROWS[0]} AS src, dst - {COLS[0]} AS dst, w FROM e WHERE src >= {ROWS[0]} AND src < {ROWS[1]} AND dst >= {COLS[0]} AND dst < {COLS[1]}")
def adj_shard(s, d):
    return T.cut_edges(X.ring(s, d), ROWS, COLS)


@query(f"WITH {SQL_X}, g AS (SELECT i AS id, j::INT AS j FROM generate_series(0, 299) a(i), generate_series(0, 39) b(j)) SELECT g.id, g.j, {sql_round('coalesce(v, 0)')} AS v FROM g LEFT JOIN x ON x.id = g.id + 400 AND x.j = g.j + 40")
def feature_shard(s, d):
    return long_form(T.cut_features(X.vectors(s, d), (400, 700), (40, 80), padded=True))


@query(f"WITH {SQL_X} SELECT (id - 100) * 32 + j AS pos, {sql_round('v')} AS v FROM x WHERE id >= 100 AND id < 350 AND j < 32 AND (id - 100) * 32 + j >= 1000 AND (id - 100) * 32 + j < 5000")
def feature_depth_slice(s, d):
    return r6(T.depth_slice(T.cut_features(X.vectors(s, d), ROWS, (0, 32)), 32, 1000, 5000), "v")


@query(f"WITH {SQL_Y} SELECT i AS id, coalesce(y, -1)::BIGINT AS y FROM generate_series(0, 299) t(i) LEFT JOIN y ON y.id = i + 400")
def label_shard(s, d):
    return T.cut_labels(X.vector_labels(s, d), 400, 700, padded=True)


def _graph(s, d) -> Graph:
    return Graph(X.ring(s, d), X.vectors(s, d), X.vector_labels(s, d), X.vector_count(s, d), D, OUT)


@query(f"WITH {SQL_RING}, {SQL_X}, {SQL_Y} SELECT 'edges' AS part, src AS a, dst AS b, {sql_round('w')} AS v FROM e UNION ALL SELECT 'nodes', id, j, {sql_round('v')} FROM x UNION ALL SELECT 'labels', id, y, 0.0 FROM y")
def tile_write_read_roundtrip(s, d):
    path = scratch(s, "tiled")
    store.save_tiled(_graph(s, d), path, P)
    return _parts(store.load_graph(s, path))


def _parts(g: Graph) -> DataFrame:
    row = lambda df, part, a, b, v: df.select(F.lit(part).alias("part"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), round6(v).alias("v"))
    nodes = g.nodes.select("id", F.posexplode("h").alias("j", "x"))
    return row(g.edges, "edges", "src", "dst", F.col("w")).unionByName(row(nodes, "nodes", "id", "j", F.col("x"))).unionByName(row(g.labels, "labels", "id", "y", F.lit(0.0)))


@query(ORACLES["tile_write_read_roundtrip"])
def processed_roundtrip(s, d):
    path = scratch(s, "processed")
    store.save_graph(_graph(s, d), path)
    return _parts(store.load_graph(s, path))


@query(f"WITH {SQL_RING}, {SQL_X}, {SQL_Y} SELECT 'edges' AS part, src - 0 AS a, dst - 0 AS b, {sql_round('w')} AS v FROM e, n WHERE src < n // 2 AND dst < n // 2 UNION ALL SELECT 'nodes', id, j, {sql_round('v')} FROM x, n WHERE id < n // 2 AND j < 64 UNION ALL SELECT 'labels', id, y, 0.0 FROM y, n WHERE id < n // 2")
def load_shard(s, d):
    path = scratch(s, "sharded")
    store.save_tiled(_graph(s, d), path, P)
    got = store.load_shard(s, path, GRID, 0, 3)
    return _parts(Graph(got["adjacency"][0][0], got["features"], got["labels"], got["num_nodes"], D, OUT))


@query(f"WITH {SQL_SP} SELECT src, dst, w FROM e")
def tsv_roundtrip(s, d):
    path = scratch(s, "tsv")
    text.write_tsv(X.supplier_part(s, d), path)
    return text.read_tsv(s, path)


@query(f"WITH {SQL_RING} SELECT src, dst, 1e0 AS w FROM e")
def mtx_roundtrip(s, d):
    path = text.write_mtx(X.ring(s, d), scratch(s, "mtx"), X.vector_count(s, d), "raw/ring.pt")
    return text.read_mtx(s, path)[0]


# ---- matrices
@query(f"WITH {SQL_RING}, ids AS (SELECT unnest(generate_series(0, n)) AS row FROM n), c AS (SELECT src + 1 AS row, count(*) AS c FROM e WHERE src % 3 <> 0 GROUP BY 1) SELECT row, (sum(coalesce(c, 0)) OVER (ORDER BY row))::BIGINT AS ptr FROM ids LEFT JOIN c USING (row)")
def csr_row_pointers(s, d):
    return T.csr_pointers(X.ring(s, d).filter("src % 3 <> 0"), X.vector_count(s, d))


@query(f"WITH {SQL_RING} SELECT src - 100 AS src, dst, w FROM e WHERE src >= 100 AND src < 350")
def csr_row_slice(s, d):
    return L.row_slice(X.ring(s, d), *ROWS)


@query(f"WITH {SQL_SP} SELECT count(*) AS nnz, {sql_round('sqrt(sum(w * w))')} AS frobenius FROM e")
def matrix_stats(s, d):
    return r6(L.matrix_stats(X.supplier_part(s, d)), "frobenius")


@query(f"WITH {SQL_RING}, k AS (SELECT n, (n + 99) // 100 AS c FROM n) SELECT least(src // (n // c), c - 1)::INT AS chunk, count(*) AS nnz FROM e, k GROUP BY 1")
def row_chunks(s, d):
    return X.ring(s, d).groupBy(T.row_chunk(F.col("src"), X.vector_count(s, d), 100).alias("chunk")).agg(F.count("*").alias("nnz"))


SQL_AGG = f"{SQL_RING}, {SQL_NORM}, {SQL_X}, agg AS (SELECT g.src AS id, j, sum(g.w * v) AS v FROM g JOIN x ON x.id = g.dst GROUP BY 1, 2)"
OUT_LONG = f"SELECT id, j::INT AS j, {sql_round('v')} AS v FROM"


@query(f"WITH {SQL_AGG} {OUT_LONG} agg")
def spmm(s, d):
    return long_form(L.spmm(normed_ring(s, d), X.vectors(s, d), D))


@query(ORACLES["spmm"])
def spmm_chunked(s, d):
    """Row blocks of 100; the same result as one product."""
    e, x, n = normed_ring(s, d), X.vectors(s, d), X.vector_count(s, d)
    blocks = e.withColumn("chunk", T.row_chunk(F.col("src"), n, 100))
    joined = blocks.join(x.select(F.col("id").alias("dst"), "h"), "dst")
    keyed = joined.select(F.struct("chunk", "src").alias("k"), "w", "h")
    return long_form(L.weighted_sum(keyed, "k", D).select(F.col("k.src").alias("id"), "h"))


@query(f"WITH {SQL_RING}, {SQL_NORM}, {SQL_X}, agg AS (SELECT g.dst AS id, j, sum(g.w * v) AS v FROM g JOIN x ON x.id = g.src GROUP BY 1, 2) {OUT_LONG} agg")
def spmm_transpose(s, d):
    return long_form(L.spmm_transpose(normed_ring(s, d), X.vectors(s, d), D))


@query(f"WITH {SQL_SP} SELECT (2 * count(*) * {D})::BIGINT AS flops FROM e")
def spmm_flops(s, d):
    return L.spmm_flops(X.supplier_part(s, d), D)


def sql_weight(name: str, rows: int, cols: int, layer: int) -> str:
    return f"{name} AS (SELECT i, k, (((i * 7919 + k * 104729 + {layer * 31337}) % 10007) / 10007e0 * 2 - 1) / sqrt({rows}) AS w FROM generate_series(0, {rows - 1}) a(i), generate_series(0, {cols - 1}) b(k))"


def sql_gemm(name: str, left: str, w: str) -> str:
    return f"{name} AS (SELECT id, k AS j, sum(v * w) AS v FROM {left} JOIN {w} ON i = j GROUP BY 1, 2)"


def sql_relu(name: str, of: str) -> str:
    return f"{name} AS (SELECT id, j, greatest(v, 0) AS v FROM {of})"


def sql_spmm(name: str, of: str) -> str:
    return f"{name} AS (SELECT g.src AS id, j, sum(g.w * v) AS v FROM g JOIN {of} ON {of}.id = g.dst GROUP BY 1, 2)"


W0 = N.init_weight(D, OUT)


@query(f"WITH {sql_weight('w0', D, OUT, 0)} SELECT i, k AS j, {sql_round('w')} AS v FROM w0")
def weight_init(s, d):
    w = s.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(N.init_weight(D, OUT))], "id long, h array<double>")
    return w.select(F.col("id").alias("i"), F.posexplode("h").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), round6(F.col("v")).alias("v"))


@query(f"WITH {SQL_X}, {sql_weight('w0', D, OUT, 0)}, {sql_gemm('z', 'x', 'w0')} {OUT_LONG} z")
def gemm(s, d):
    return long_form(L.gemm(X.vectors(s, d), W0))


SQL_Z = f"{SQL_AGG}, {SQL_Y}, {sql_weight('w0', D, OUT, 0)}, {sql_gemm('z', 'agg', 'w0')}, m AS (SELECT id, max(v) AS m FROM z GROUP BY 1), s AS (SELECT id, sum(exp(v - m)) AS s FROM z JOIN m USING (id) GROUP BY 1), p AS (SELECT id, j, exp(v - m) / s AS v FROM z JOIN m USING (id) JOIN s USING (id)), dz AS (SELECT id, j, CASE WHEN y < 0 THEN 0 ELSE (p.v - CASE WHEN j = y THEN 1 ELSE 0 END) / n END AS v FROM p JOIN y USING (id), n)"


def layer(s, d):
    e, x = normed_ring(s, d), X.vectors(s, d)
    agg = L.spmm(e, x, D)
    return e, agg, L.gemm(agg, W0)


def losses(s, d):
    return N.loss_rows(layer(s, d)[2], X.vector_labels(s, d), OUT, X.vector_count(s, d))


@query(f"WITH {SQL_Z} {OUT_LONG} z")
def gcn_layer_forward(s, d):
    return long_form(N.GCNLayer(W0).forward(normed_ring(s, d), X.vectors(s, d)))


@query(f"WITH {SQL_Z}, {sql_relu('r', 'z')} {OUT_LONG} r")
def relu(s, d):
    return long_form(N.relu_rows(layer(s, d)[2]))


@query(f"WITH {SQL_Z} SELECT p.id, p.j::INT AS j, {sql_round('CASE WHEN z.v > 0 THEN p.v ELSE 0 END')} AS v FROM p JOIN z ON z.id = p.id AND z.j = p.j")
def relu_grad(s, d):
    z = layer(s, d)[2]
    return long_form(N.mask_by_preactivation(losses(s, d).select("id", F.col("p").alias("h")), z))


@query(f"WITH {SQL_Z} {OUT_LONG} p")
def softmax(s, d):
    return long_form(losses(s, d), "p")


@query(f"WITH {SQL_Y} SELECT id, j::INT AS j, (CASE WHEN j = y THEN 1 ELSE 0 END)::INT AS v FROM y, generate_series(0, {OUT - 1}) t(j)")
def one_hot_labels(s, d):
    return X.vector_labels(s, d).select("id", F.posexplode(one_hot(F.col("y"), OUT)).alias("j", "v"))


@query(f"WITH {SQL_Z} SELECT {sql_round('sum(CASE WHEN y < 0 THEN 0 ELSE -ln(greatest(p.v, 1e-9)) END) / max(n)')} AS loss FROM p JOIN y USING (id), n WHERE j = greatest(y, 0)")
def cross_entropy(s, d):
    return r6(N.mean_loss(losses(s, d), X.vector_count(s, d)), "loss")


@query(f"WITH {SQL_Z} {OUT_LONG} dz")
def cross_entropy_grad(s, d):
    return long_form(losses(s, d), "grad")


@query(f"WITH {SQL_Z} SELECT a.j::BIGINT AS i, b.j::BIGINT AS j, {sql_round('sum(a.v * b.v)')} AS v FROM agg a JOIN dz b ON a.id = b.id GROUP BY 1, 2")
def gemm_grad_w(s, d):
    cells = L.gram(layer(s, d)[1], losses(s, d).select("id", F.col("grad").alias("h")))
    return cells.select("i", F.col("j").cast("long").alias("j"), round6(F.col("v")).alias("v"))


@query(f"WITH {SQL_Z}, q AS (SELECT id, i AS j, sum(v * w) AS v FROM dz JOIN w0 ON k = j GROUP BY 1, 2) {OUT_LONG} q")
def gemm_grad_agg(s, d):
    return long_form(L.gemm(losses(s, d).select("id", F.col("grad").alias("h")), W0.T))


@query(f"WITH {SQL_Z}, q AS (SELECT id, i AS j, sum(v * w) AS v FROM dz JOIN w0 ON k = j GROUP BY 1, 2), b AS (SELECT g.dst AS id, j, sum(g.w * v) AS v FROM g JOIN q ON q.id = g.src GROUP BY 1, 2) {OUT_LONG} b")
def gcn_layer_backward(s, d):
    e, agg, _ = layer(s, d)
    return long_form(N.GCNLayer(W0).backward(e, agg, losses(s, d).select("id", F.col("grad").alias("h")))[1])


SQL_NET = ", ".join([SQL_RING, SQL_NORM, SQL_X, sql_weight("w0", D, HID, 0), sql_weight("w1", HID, HID, 1), sql_weight("w2", HID, OUT, 2), sql_spmm("a0", "x"), sql_gemm("z0", "a0", "w0"), sql_relu("h1", "z0"), sql_spmm("a1", "h1"), sql_gemm("z1", "a1", "w1"), sql_relu("h2", "z1"), sql_spmm("a2", "h2"), sql_gemm("z2", "a2", "w2")])


@query(f"WITH {SQL_NET} {OUT_LONG} z2")
def gcn3_forward(s, d):
    e = normed_ring(s, d).cache()
    return long_form(N.Net.build(3, D, HID, OUT).forward(lambda _: e, X.vectors(s, d)))


@query(f"WITH {SQL_Z}, gw AS (SELECT a.j AS i, b.j AS k, sum(a.v * b.v) AS g FROM agg a JOIN dz b ON a.id = b.id GROUP BY 1, 2) SELECT i::BIGINT AS i, k::BIGINT AS j, {sql_round('w - 3e-3 * (g / (sqrt(g * g) + 1e-8) + 0.01 * w)')} AS v FROM w0 JOIN gw USING (i, k)")
def adamw_step(s, d):
    """The first step, where the corrected moments are g and g squared."""
    g = L.collect_matrix(gemm_grad_w_cells(s, d), W0.shape)
    w, _, _ = N.AdamW(weight_decay=0.01).step(W0, np.zeros_like(W0), np.zeros_like(W0), g, 1)
    rows = s.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(w)], "i long, h array<double>")
    return rows.select("i", F.posexplode("h").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), round6(F.col("v")).alias("v"))


def gemm_grad_w_cells(s, d):
    return L.gram(layer(s, d)[1], losses(s, d).select("id", F.col("grad").alias("h")))


@query()
def train_loss_curve(s, d):
    """Three epochs of a two-layer net on the doubly permuted ring; iterative, so it has no SQL twin."""
    lab = X.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))
    g = preprocess(X.ring(s, d), X.vectors(s, d).select("id"), X.vectors(s, d), lab)
    trainer = Trainer(g, N.Net.build(2, g.num_features, HID, g.num_classes))
    records = trainer.fit(3)
    trainer.close()
    return s.createDataFrame([(r["epoch"], float(round(r["loss"], 6)), r["timed"]) for r in records], "epoch long, loss double, timed boolean")


@query(f"WITH {SQL_RING}, {SQL_NORM}, {sql_perm(0, 'p')}, {sql_perm(1, 'q')} SELECT 0 AS perm_id, a.new_id AS src, b.new_id AS dst, {sql_round('w')} AS w FROM g JOIN p a ON a.old_id = dst JOIN q b ON b.old_id = src UNION ALL SELECT 1, a.new_id, b.new_id, {sql_round('w')} FROM g JOIN q a ON a.old_id = dst JOIN p b ON b.old_id = src")
def preprocess_graph(s, d):
    """The whole preparation of a directed, unsupervised graph; its two adjacency views."""
    g = preprocess(X.ring(s, d), X.vectors(s, d).select("id"), directed=True)
    return r6(g.edges.withColumn("perm_id", F.lit(0)).unionByName(g.edges2.withColumn("perm_id", F.lit(1))), "w")


# ---- cost models
PARTS, NODES, NNZ, DIMS = 16, 100_000, 1_000_000, [100, 128, 128, 47]
SQL_CFG = f"cfg AS (SELECT (1 << a)::BIGINT AS x, (1 << b)::BIGINT AS y, (1 << ({PARTS.bit_length() - 1} - a - b))::BIGINT AS z FROM generate_series(0, {PARTS.bit_length() - 1}) t(a), generate_series(0, {PARTS.bit_length() - 1}) u(b) WHERE a + b <= {PARTS.bit_length() - 1})"
SQL_DIMS = "ly(layer, d, e) AS (VALUES " + ", ".join(f"({i}, {v}e0, {DIMS[i + 1] if i + 1 < len(DIMS) else 'NULL'}::DOUBLE)" for i, v in enumerate(DIMS)) + ")"


def sql_turn(a: str, b: str, c: str) -> str:
    return f"CASE layer % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"


def sql_bw(inside: str, own: str, version: str, machine: str) -> str:
    if version == "v1":
        return "1e0"
    if version == "v2":
        return f"CASE WHEN {inside} * {own} <= 4 THEN 200e0 ELSE 100e0 / least(4, {inside}) END"
    if machine == "perlmutter":
        return f"CASE WHEN {own} = 1 THEN 1e0 WHEN {inside} = 1 THEN CASE {own} WHEN 2 THEN 76e0 WHEN 4 THEN 225e0 ELSE 66.59e0 END WHEN {inside} = 2 THEN CASE {own} WHEN 2 THEN 76e0 ELSE 66.59e0 / 2 END ELSE 66.59e0 / 4 END"
    return f"CASE {inside} WHEN 1 THEN CASE {own} WHEN 2 THEN 129e0 WHEN 4 THEN 52e0 WHEN 8 THEN 135e0 ELSE 40e0 END WHEN 2 THEN CASE {own} WHEN 2 THEN 50e0 WHEN 4 THEN 72e0 ELSE 20e0 END WHEN 4 THEN CASE {own} WHEN 2 THEN 36e0 ELSE 10e0 END ELSE 5e0 END"


def sql_comm(version: str, machine: str) -> str:
    bx, by, bz = sql_bw("y", "x", version, machine), sql_bw("1", "y", version, machine), sql_bw("(y * x)", "z", version, machine)
    k = "(4 / 1073741824e0)"
    return f"""WITH {SQL_CFG}, {SQL_DIMS},
b AS (SELECT x, y, z, {bx} AS bx, {by} AS bw_y, {bz} AS bz FROM cfg),
r AS (SELECT x, y, z, layer, d, e, {NODES}e0 AS n, ({sql_turn('x', 'z', 'y')})::DOUBLE AS a, ({sql_turn('y', 'x', 'z')})::DOUBLE AS o, ({sql_turn('z', 'y', 'x')})::DOUBLE AS g, {sql_turn('bx', 'bz', 'bw_y')} AS ba, {sql_turn('bw_y', 'bx', 'bz')} AS bo, {sql_turn('bz', 'bw_y', 'bx')} AS bg FROM b, ly WHERE e IS NOT NULL),
t AS (SELECT x, y, z, layer, (g - 1) / g * n * d / (a * o) * {k} / bg AS gx, (g - 1) / g * d * e / (a * o) * {k} / bg AS gw, 2 * (a - 1) / a * n * d / (g * o) * {k} / ba AS ra, 2 * (o - 1) / o * n * e / (g * a) * {k} / bo AS ro FROM r)
SELECT x, y, z, {sql_round('1000 * sum(CASE WHEN layer = 0 THEN 2 * gx ELSE 2 * gx END + 2 * ra + 3 * gw + ro)')} AS cost FROM t GROUP BY x, y, z"""


@query(f"WITH {SQL_CFG} SELECT * FROM cfg")
def grid_configs(s, d):
    return C.grid_configs(s, PARTS)


for _name, _version, _machine in (("comm_cost_v1", "v1", "perlmutter"), ("comm_cost_v2", "v2", "perlmutter"), ("comm_cost_v3p", "v3", "perlmutter"), ("comm_cost_v3f", "v3", "frontier")):
    query(sql_comm(_version, _machine), _name)(lambda s, d, v=_version, m=_machine: r6(C.comm_cost(s, PARTS, NODES, DIMS, v, m), "cost"))


@query(f"WITH {SQL_CFG}, {SQL_DIMS}, t AS (SELECT x, y, z, sum({NNZ}e0 * d / (x * y * z)) AS f, sum({NODES}e0 * ({sql_turn('y', 'x', 'z')}) / (d * ({sql_turn('x', 'z', 'y')}))) AS fw, sum({NODES}e0 * ({sql_turn('y', 'x', 'z')}) / (d * ({sql_turn('z', 'y', 'x')}))) AS bw FROM cfg, ly WHERE layer < {len(DIMS) - 1} GROUP BY 1, 2, 3) SELECT x, y, z, round(sqrt(f) + sqrt(f) * fw + sqrt(f) * bw, 3) AS cost FROM t")
def spmm_cost(s, d):
    return C.spmm_cost(s, NODES, NNZ, PARTS, DIMS[:-1]).withColumn("cost", F.round("cost", 3))


@query(f"""WITH {SQL_CFG}, {SQL_DIMS}, t AS (SELECT x, y, z, sum(
CASE WHEN layer < 3 THEN 2 * (3 * {NNZ}e0 / (({sql_turn('z', 'y', 'x')}) * ({sql_turn('x', 'z', 'y')})) + 2 * {NODES}e0 / ({sql_turn('z', 'y', 'x')})) ELSE 0 END
+ CASE WHEN layer < {len(DIMS) - 1} THEN 4 * d * e / {PARTS} + 2 * {NODES}e0 * d / ({sql_turn('z * y', 'y * x', 'x * z')}) ELSE 0 END
+ CASE WHEN layer >= 1 THEN 2 * {NODES}e0 * d / ({sql_turn('x * y', 'z * x', 'y * z')}) ELSE 4 * {NODES}e0 * d / {PARTS} + {NODES}e0 * d / (x * y) + d * e / (y * x) END) AS t FROM cfg, ly GROUP BY 1, 2, 3)
SELECT x, y, z, {sql_round(f'(t + 2 * {NODES}e0 / x) * 4 / 1073741824e0')} AS cost FROM t""")
def mem_cost(s, d):
    return r6(C.memory_cost(s, PARTS, NODES, NNZ, DIMS), "cost")


@query(f"SELECT * FROM ({sql_comm('v3', 'perlmutter')}) ORDER BY cost, x, y, z LIMIT 1")
def best_config(s, d):
    return r6(C.cheapest(C.comm_cost(s, PARTS, NODES, DIMS, "v3", "perlmutter")), "cost")


@query("SELECT i AS layer, ['x', 'z', 'y'][i % 3 + 1] AS outer_axis, ['y', 'x', 'z'][i % 3 + 1] AS inner_axis, ['z', 'y', 'x'][i % 3 + 1] AS depth_axis, ['x', 'z', 'y'][i % 3 + 1] AS loss_class_axis, ['y', 'x', 'z'][i % 3 + 1] AS loss_node_axis FROM generate_series(0, 8) t(i)")
def layer_axis_roles(s, d):
    outer, inner, depth = T.layer_roles(F.col("layer"))
    a, b = T.loss_axes(F.col("layer"))
    return s.range(9).withColumnRenamed("id", "layer").select("layer", outer.alias("outer_axis"), inner.alias("inner_axis"), depth.alias("depth_axis"), a.alias("loss_class_axis"), b.alias("loss_node_axis"))


@query("SELECT o_orderkey AS v, (o_orderkey + 11) // 12 * 12 AS padded FROM orders")
def padded_dimension(s, d):
    return X.table(s, d, "orders").select(F.col("o_orderkey").alias("v"), pad_dimension(F.col("o_orderkey"), 4, 3).alias("padded"))


@query("SELECT c_custkey AS id, regexp_extract('/data/' || c_name || '/g_' || c_custkey || '.pt', '([^/]+)\\.pt$', 1) AS base FROM customer")
def file_basename(s, d):
    return X.table(s, d, "customer").select(F.col("c_custkey").alias("id"), basename(F.concat(F.lit("/data/"), "c_name", F.lit("/g_"), "c_custkey", F.lit(".pt"))).alias("base"))


# ---- timers and logs
SQL_TIMERS = "tm AS (SELECT l_linenumber % 4 AS rank, CASE l_linenumber % 3 WHEN 0 THEN ['epoch'] WHEN 1 THEN ['epoch', 'fwd'] ELSE ['epoch', 'fwd', l_returnflag] END AS stack, l_quantity AS ms FROM lineitem)"
SQL_ROLL = f"{SQL_TIMERS}, ru AS (SELECT stack, max(ms) AS max_ms, sum(ms) / 4 AS avg_ms, max(ms) / (sum(ms) / 4) AS imbalance, len(stack)::INT AS depth FROM tm GROUP BY stack)"


def timers(s, d):
    line = F.col("l_linenumber") % 3
    stack = F.when(line == 0, F.array(F.lit("epoch"))).when(line == 1, F.array(F.lit("epoch"), F.lit("fwd"))).otherwise(F.array(F.lit("epoch"), F.lit("fwd"), "l_returnflag"))
    return X.table(s, d, "lineitem").select((F.col("l_linenumber") % 4).alias("rank"), stack.alias("stack"), F.col("l_quantity").alias("ms"))


@query(f"WITH {SQL_ROLL} SELECT array_to_string(stack, '/') AS stack, max_ms, {sql_round('avg_ms')} AS avg_ms, {sql_round('imbalance')} AS imbalance, depth FROM ru")
def timer_rollup(s, d):
    return r6(M.timer_rollup(timers(s, d), 4), "avg_ms", "imbalance").withColumn("stack", F.concat_ws("/", "stack"))


@query(f"WITH {SQL_ROLL} SELECT array_to_string(c.stack, '/') AS stack, c.depth, {sql_round('c.avg_ms')} AS avg_ms, {sql_round('p.avg_ms')} AS parent_ms, (c.depth > 1 AND p.stack IS NULL) AS orphan FROM ru c LEFT JOIN ru p ON p.stack = c.stack[1:c.depth - 1]")
def timer_tree(s, d):
    t = M.timer_tree(M.timer_rollup(timers(s, d), 4))
    return r6(t, "avg_ms", "parent_ms").select(F.concat_ws("/", "stack").alias("stack"), "depth", "avg_ms", "parent_ms", "orphan")


# One log for each customer, spoken by its orders in order of their key: every fifth order opens an epoch.
SQL_LOG = """lg AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS line_no, CASE o_orderkey % 5 WHEN 0 THEN 'epoch 0 | Avg Time: 25.000 ms' WHEN 1 THEN 'all-reduce | Avg Time: ' || (o_orderkey % 97) || '.5 ms' WHEN 2 THEN 'AGG = A * H | Avg Time: ' || (o_orderkey % 89) || '.25 ms' WHEN 3 THEN 'cross entropy fwd | Avg Time: ' || (o_orderkey % 13) || '.125 ms' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Epoch: 001, Train Loss: 3.2100' WHEN o_orderkey % 3 = 0 THEN 'GRAD_W shape | Avg Time: 7.000 ms' ELSE 'GRAD_H = A.T * GRAD_AGG | Avg Time: 3.500 ms' END END AS line FROM orders),
sg AS (SELECT *, CASE WHEN contains(line, 'epoch ') THEN 'epoch' WHEN contains(line, 'gather ') OR contains(line, 'all-reduce ') OR contains(line, 'reduce-scatter ') THEN 'comm' WHEN contains(line, 'AGG = A * H ') OR contains(line, 'OUT = AGG * W ') OR contains(line, 'GRAD_W = AGG.T * GRAD_OUT ') OR contains(line, 'GRAD_AGG = GRAD_OUT * W.T ') OR contains(line, 'GRAD_H = A.T * GRAD_AGG ') THEN 'comp' WHEN contains(line, 'cross entropy') THEN 'loss' END AS kind, coalesce(try_cast(nullif(regexp_extract(line, 'Avg Time: ([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE), 0) AS ms FROM lg),
sq AS (SELECT *, sum(CASE WHEN kind = 'epoch' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS epoch_seq FROM sg),
et AS (SELECT run, epoch_seq, sum(CASE WHEN kind IN ('comm', 'comp', 'loss') THEN ms ELSE 0 END) AS total_ms, sum(CASE WHEN kind = 'comm' THEN ms ELSE 0 END) AS comm_ms FROM sq WHERE epoch_seq > 0 GROUP BY 1, 2)"""


def segments(s, d):
    k = F.col("o_orderkey")
    timed = lambda head, m, tail: F.concat(F.lit(f"{head} | Avg Time: "), (k % m).cast("string"), F.lit(f"{tail} ms"))
    line = F.when(k % 5 == 0, F.lit("epoch 0 | Avg Time: 25.000 ms")).when(k % 5 == 1, timed("all-reduce", 97, ".5")).when(k % 5 == 2, timed("AGG = A * H", 89, ".25")).when(k % 5 == 3, timed("cross entropy fwd", 13, ".125")).when(k % 2 == 0, F.lit("Epoch: 001, Train Loss: 3.2100")).when(k % 3 == 0, F.lit("GRAD_W shape | Avg Time: 7.000 ms")).otherwise(F.lit("GRAD_H = A.T * GRAD_AGG | Avg Time: 3.500 ms"))
    logs = X.table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.struct(k.alias("k"), line.alias("line")).alias("l")).groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("value"))
    return M.log_segments(M.log_lines(logs, "value", ("run",)), ("run",))


@query(f"WITH {SQL_LOG} SELECT run, line_no::INT AS line_no, kind, ms, epoch_seq::BIGINT AS epoch_seq FROM sq")
def log_segments(s, d):
    return segments(s, d).select("run", "line_no", "kind", "ms", "epoch_seq")


@query(f"WITH {SQL_LOG} SELECT run, {sql_round('avg(total_ms)')} AS avg_epoch_ms, {sql_round('avg(comm_ms)')} AS avg_comm_ms FROM et WHERE epoch_seq > 1 GROUP BY 1")
def log_epoch_times(s, d):
    return r6(M.epoch_average(M.epoch_times(segments(s, d), ("run",)), 1, ("run",)), "avg_epoch_ms", "avg_comm_ms")


@query(f"WITH {SQL_LOG} SELECT run, epoch_seq::BIGINT AS epoch_seq, total_ms, comm_ms FROM et WHERE epoch_seq BETWEEN 1 AND 2")
def epoch_window(s, d):
    return M.epoch_window(M.epoch_times(segments(s, d), ("run",)), 1, 2)


@query("WITH t AS (SELECT l_returnflag AS name, l_linenumber::BIGINT AS idx, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) SELECT name, 'v' || arg_min(idx, (m, idx)) AS variant, round(min(m), 3) AS mean_ms FROM t GROUP BY 1")
def gemm_variant_argmin(s, d):
    t = X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").cast("long").alias("idx"), F.concat(F.lit("v"), "l_linenumber").alias("variant"), F.col("l_extendedprice").alias("ms"))
    return M.fastest_variant(t).withColumn("mean_ms", F.round("mean_ms", 3))


@query(f"WITH {SQL_SP}, {SQL_NORM}, f AS (SELECT src AS id, count(*)::DOUBLE AS h0, sum(w) AS h1 FROM e GROUP BY 1) SELECT g.src AS id, {sql_round('sum(g.w * h0)')} AS agg_degree, {sql_round('sum(g.w * h1)')} AS agg_weight FROM g JOIN f ON f.id = g.dst GROUP BY 1")
def flagship(s, d):
    """Normalise the supplier-part graph and aggregate each node's degree and weight over its neighbours."""
    e = X.supplier_part(s, d)
    x = e.groupBy(F.col("src").alias("id")).agg(F.array(F.count("*").cast("double"), F.sum("w")).alias("h"))
    out = L.spmm(G.gcn_norm(e), x.hint("shuffle_hash"), 2, every_row=False)  # two numbers a node are hashed, and no edges sorted
    return out.select("id", round6(F.get("h", F.lit(0))).alias("agg_degree"), round6(F.get("h", F.lit(1))).alias("agg_weight"))
