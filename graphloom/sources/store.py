"""Parquet stores: a processed graph, and its 2-D tiled form with pruned shard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import GridConfig
from graphloom.operators.tiling import cut_edges, cut_features, cut_labels, shard_bounds, storage_width, tile_edges, tile_features, tile_labels
from graphloom.schema import EDGES, LABELS, METADATA, NODES, Graph


def save_graph(g: Graph, path: str) -> None:
    """Edges and labels of both views, features, and a one-row metadata table."""
    views = [(0, g.edges, g.labels)] + ([(1, g.edges2, g.labels2)] if g.edges2 is not None else [])
    for k, edges, labels in views:
        edges.select(EDGES.fieldNames()).write.mode("overwrite").parquet(f"{path}/edges/perm_id={k}")
        labels.select(LABELS.fieldNames()).write.mode("overwrite").parquet(f"{path}/labels/perm_id={k}")
    g.nodes.select(NODES.fieldNames()).write.mode("overwrite").parquet(f"{path}/nodes")
    write_metadata(g, path, 0)


def write_metadata(g: Graph, path: str, n_tiles: int) -> None:
    spark = g.edges.sparkSession
    row = (g.num_nodes, g.num_features, g.num_classes, n_tiles, g.edges2 is not None)
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str):
    rows = spark.read.schema(METADATA).parquet(f"{path}/metadata").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} must hold exactly one graph")
    return rows[0]


def load_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from either form; the metadata says which one it is."""
    m = read_metadata(spark, path)
    edges, labels = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/labels")
    if m["n_tiles"]:
        nodes = spark.read.parquet(f"{path}/nodes").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("col_tile", "h"))).alias("b")).select("id", F.flatten(F.transform("b", lambda b: b["h"])).alias("h"))
    else:
        nodes = spark.read.parquet(f"{path}/nodes")
    view = lambda df, k, cols: df.filter(F.col("perm_id") == k).select(cols)
    second = [view(edges, 1, EDGES.fieldNames()), view(labels, 1, LABELS.fieldNames())] if m["double_perm"] else [None, None]
    return Graph(view(edges, 0, EDGES.fieldNames()), nodes.select("id", "h"), view(labels, 0, LABELS.fieldNames()), m["num_nodes"], m["num_features"], m["num_classes"], *second)


def save_tiled(g: Graph, path: str, p: int) -> None:
    """One pass over each table: rows go straight to their tile's folder."""
    views = [(0, g.edges, g.labels)] + ([(1, g.edges2, g.labels2)] if g.edges2 is not None else [])
    tagged = lambda make: _union([make(e, y).withColumn("perm_id", F.lit(k)) for k, e, y in views])
    tagged(lambda e, _: tile_edges(e, g.num_nodes, p)).write.mode("overwrite").partitionBy("perm_id", "row_tile", "col_tile").parquet(f"{path}/edges")
    tagged(lambda _, y: tile_labels(y, g.num_nodes, p)).write.mode("overwrite").partitionBy("perm_id", "row_tile").parquet(f"{path}/labels")
    tile_features(g.nodes, g.num_nodes, g.num_features, p).write.mode("overwrite").partitionBy("row_tile", "col_tile").parquet(f"{path}/nodes")
    write_metadata(g, path, p)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _tiles(column: str, start: int, stop: int, width: int):
    """Names the tile column, so that the scan prunes folders; Spark can't derive it from the id."""
    return F.col(column).between(start // width, max(start, stop - 1) // width)


def read_tiled_edges(spark: SparkSession, path: str, layer: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A block of the layer's adjacency view, rebased; only overlapping tiles are read."""
    m = read_metadata(spark, path)
    w = storage_width(m["num_nodes"], m["n_tiles"])
    edges = spark.read.parquet(f"{path}/edges").filter(F.col("perm_id") == (layer % 2 if m["double_perm"] else 0))
    return cut_edges(edges.filter(_tiles("row_tile", *rows, w) & _tiles("col_tile", *cols, w)), rows, cols)


def read_tiled_features(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], padded: bool = False) -> DataFrame:
    """A feature block, assembled from the column tiles that it meets."""
    m = read_metadata(spark, path)
    w, cw = storage_width(m["num_nodes"], m["n_tiles"]), storage_width(m["num_features"], m["n_tiles"])
    got = spark.read.parquet(f"{path}/nodes").filter(_tiles("row_tile", *rows, w) & _tiles("col_tile", *cols, cw) & F.col("id").between(rows[0], rows[1] - 1))
    first = (cols[0] // cw) * cw
    whole = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("col_tile", "h"))).alias("b")).select("id", F.flatten(F.transform("b", lambda b: b["h"])).alias("h"))
    return cut_features(whole, rows, (cols[0] - first, cols[1] - first), padded)


def read_tiled_labels(spark: SparkSession, path: str, num_layers: int, rows: tuple[int, int], padded: bool = False) -> DataFrame:
    m = read_metadata(spark, path)
    w = storage_width(m["num_nodes"], m["n_tiles"])
    labels = spark.read.parquet(f"{path}/labels").filter(F.col("perm_id") == ((num_layers - 1) % 2 if m["double_perm"] else 0))
    return cut_labels(labels.filter(_tiles("row_tile", *rows, w)), *rows, padded)


def load_shard(spark: SparkSession, path: str, grid: GridConfig, rank: int, num_layers: int) -> dict:
    """What one rank holds, from either form of a stored graph: a block and its transpose for each layer residue, features,
    labels, and the sizes."""
    m = read_metadata(spark, path)
    residues = min(num_layers, 6 if m["double_perm"] else 3)
    bounds = shard_bounds(spark, grid, m["num_nodes"], m["num_features"], num_layers).filter(F.col("rank") == rank).orderBy("layer").limit(residues).collect()
    b = bounds[0]
    nodes, feats, labels = (b["node_start"], b["node_stop"]), (b["feat_start"], b["feat_stop"]), (b["label_start"], b["label_stop"])
    if m["n_tiles"]:
        blocks = [read_tiled_edges(spark, path, x["layer"], (x["row_start"], x["row_stop"]), (x["col_start"], x["col_stop"])) for x in bounds]
        held = read_tiled_features(spark, path, nodes, feats, padded=True), read_tiled_labels(spark, path, num_layers, labels, padded=True)
    else:
        g = load_graph(spark, path)
        blocks = [cut_edges(g.adjacency(x["layer"]), (x["row_start"], x["row_stop"]), (x["col_start"], x["col_stop"])) for x in bounds]
        held = cut_features(g.nodes, nodes, feats, padded=True), cut_labels(g.targets(num_layers), *labels, padded=True)
    return {
        "adjacency": [(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) for e in blocks],
        "features": held[0],
        "labels": held[1],
        "depth": (b["depth_start"], b["depth_stop"]),
        "num_nodes": m["num_nodes"], "num_features": m["num_features"], "num_classes": m["num_classes"],
    }
