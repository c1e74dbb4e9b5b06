"""Tiles, shard bounds and shard cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import GridConfig
from graphloom.functions.scalars import pad_dimension


def stats_tile(v: Column, n: int, p: int) -> Column:
    """Floor-width tiles; the last takes the remainder, or everything when n < p."""
    width = n // p
    return F.lit(p - 1).cast("int") if width == 0 else F.least(F.floor(v / width), F.lit(p - 1)).cast("int")


def storage_width(n: int, p: int) -> int:
    """Ceil-width tiles of the storage layout; the last may be short."""
    return -(-n // p)


def tile_counts(edges: DataFrame, n: int, p: int) -> DataFrame:
    """Entries in each of the p x p tiles, empty tiles included."""
    spark = edges.sparkSession
    grid = spark.range(p * p).select(F.floor(F.col("id") / p).cast("int").alias("row_tile"), (F.col("id") % p).cast("int").alias("col_tile"))
    got = edges.groupBy(stats_tile(F.col("src"), n, p).alias("row_tile"), stats_tile(F.col("dst"), n, p).alias("col_tile")).agg(F.count("*").alias("nnz"))
    return grid.join(got, ["row_tile", "col_tile"], "left").select("row_tile", "col_tile", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def tile_skew(counts: DataFrame) -> DataFrame:
    """min, mean, lower median, max, max/mean and max/min (null when a tile is empty)."""
    return counts.agg(
        F.min("nnz").alias("min_nnz"), F.avg("nnz").alias("mean_nnz"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY nnz)").cast("long").alias("median_nnz"), F.max("nnz").alias("max_nnz"),
        F.try_divide(F.max("nnz"), F.avg("nnz")).alias("max_over_mean"), F.try_divide(F.max("nnz"), F.min("nnz")).alias("max_over_min"),
    )


def tile_edges(edges: DataFrame, n: int, p: int) -> DataFrame:
    """Edges with their storage tile; ids stay global."""
    w = storage_width(n, p)
    return edges.select(F.floor(F.col("src") / w).cast("int").alias("row_tile"), F.floor(F.col("dst") / w).cast("int").alias("col_tile"), "src", "dst", "w")


def tile_features(nodes: DataFrame, n: int, num_features: int, p: int) -> DataFrame:
    """Each row vector cut into at most p column blocks."""
    w, cw = storage_width(n, p), storage_width(num_features, p)
    used = -(-num_features // cw)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(used - 1)), lambda t: F.struct(t.alias("col_tile"), F.slice(F.col("h"), t * cw + 1, F.lit(cw)).alias("h")))
    return nodes.select("id", F.floor(F.col("id") / w).cast("int").alias("row_tile"), F.explode(cuts).alias("b")).select("id", "row_tile", F.col("b.col_tile").alias("col_tile"), F.col("b.h").alias("h"))


def tile_labels(labels: DataFrame, n: int, p: int) -> DataFrame:
    return labels.select("id", F.floor(F.col("id") / storage_width(n, p)).cast("int").alias("row_tile"), "y")


def tile_span(start: Column, stop: Column, width: int, p: int) -> tuple[Column, Column]:
    """First tile and one past the last tile that meet [start, stop)."""
    return F.least(F.floor(start / width), F.lit(p)).cast("int"), F.least(F.floor((stop - 1) / width) + 1, F.lit(p)).cast("int")


def axis_size(grid: GridConfig, axis: Column) -> Column:
    return F.when(axis == "x", grid.x).when(axis == "y", grid.y).otherwise(grid.z)


def layer_roles(layer: Column) -> tuple[Column, Column, Column]:
    """(outer, inner, depth) axis letters, rotating with period 3."""
    turn = F.pmod(layer, F.lit(3))
    pick = lambda a, b, c: F.when(turn == 0, a).when(turn == 1, b).otherwise(c)
    return pick("x", "z", "y"), pick("y", "x", "z"), pick("z", "y", "x")


def loss_axes(num_layers: Column) -> tuple[Column, Column]:
    """(class axis, node axis) of the loss after that many layers."""
    turn = F.pmod(num_layers, F.lit(3))
    return F.when(turn == 1, "z").when(turn == 2, "y").otherwise("x"), F.when(turn == 1, "x").when(turn == 2, "z").otherwise("y")


def rank_table(spark: SparkSession, grid: GridConfig) -> DataFrame:
    xyz = F.struct(F.floor(F.col("id") / (grid.y * grid.z)).alias("rx"), (F.floor(F.col("id") / grid.z) % grid.y).alias("ry"), (F.col("id") % grid.z).alias("rz"))
    return spark.range(grid.world).select(F.col("id").alias("rank"), xyz.alias("r")).select("rank", "r.rx", "r.ry", "r.rz")


def shard_bounds(spark: SparkSession, grid: GridConfig, n: int, num_features: int, num_layers: int) -> DataFrame:
    """For each rank and layer: feature rows, columns and flat depth, label rows, adjacency rows and columns."""
    ranks = rank_table(spark, grid)
    layers = spark.range(num_layers).select(F.col("id").alias("layer"))

    def span(axis: Column, total: Column) -> tuple[Column, Column]:
        part, of = F.when(axis == "x", F.col("rx")).when(axis == "y", F.col("ry")).otherwise(F.col("rz")), axis_size(grid, axis)
        step = (pad_dimension(total, of) / of).cast("long")
        return (part * step).cast("long"), ((part + 1) * step).cast("long")

    x, y, z, nodes = F.lit("x"), F.lit("y"), F.lit("z"), F.lit(n).cast("long")
    rows = span(x, nodes)
    width = (pad_dimension(F.lit(num_features).cast("long"), grid.y, grid.z) / grid.y).cast("long")
    cols = ((F.col("ry") * width).cast("long"), ((F.col("ry") + 1) * width).cast("long"))
    flat = ((rows[1] - rows[0]) * width / grid.z).cast("long")
    out = span(loss_axes(F.lit(num_layers))[0], nodes)
    turn = F.pmod(F.col("layer"), F.lit(3))
    row_axis, col_axis = F.when(turn == 0, z).when(turn == 1, y).otherwise(x), F.when(turn == 0, x).when(turn == 1, z).otherwise(y)
    a_rows, a_cols = span(row_axis, nodes), span(col_axis, nodes)
    named = {
        "node_start": rows[0], "node_stop": rows[1], "feat_start": cols[0], "feat_stop": cols[1], "depth_start": (F.col("rz") * flat).cast("long"), "depth_stop": ((F.col("rz") + 1) * flat).cast("long"),
        "label_start": out[0], "label_stop": out[1], "row_start": a_rows[0], "row_stop": a_rows[1], "col_start": a_cols[0], "col_stop": a_cols[1],
    }
    return ranks.crossJoin(layers).select("rank", "rx", "ry", "rz", "layer", *[c.alias(k) for k, c in named.items()])


def tiles_for_shards(bounds: DataFrame, n: int, p: int) -> DataFrame:
    """Which storage tiles each shard's adjacency block meets."""
    w = storage_width(n, p)
    (r0, r1), (c0, c1) = tile_span(F.col("row_start"), F.col("row_stop"), w, p), tile_span(F.col("col_start"), F.col("col_stop"), w, p)
    keep = bounds.withColumns({"_r0": r0, "_r1": r1, "_c0": c0, "_c1": c1}).filter("_r1 > _r0 and _c1 > _c0")
    return keep.select("rank", "layer", F.explode(F.sequence("_r0", F.col("_r1") - 1)).alias("row_tile"), "_c0", "_c1").select("rank", "layer", "row_tile", F.explode(F.sequence("_c0", F.col("_c1") - 1)).alias("col_tile"))


def cut_edges(edges: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The block's edges with ids rebased to it. Its transpose is a projection, so it's never stored."""
    inside = (F.col("src") >= rows[0]) & (F.col("src") < rows[1]) & (F.col("dst") >= cols[0]) & (F.col("dst") < cols[1])
    return edges.filter(inside).select((F.col("src") - rows[0]).alias("src"), (F.col("dst") - cols[0]).alias("dst"), "w")


def cut_features(nodes: DataFrame, rows: tuple[int, int], cols: tuple[int, int], padded: bool = False) -> DataFrame:
    """Rows and columns of a block, rebased; ``padded`` adds zero rows and columns beyond the data."""
    width = cols[1] - cols[0]
    got = nodes.filter((F.col("id") >= rows[0]) & (F.col("id") < rows[1])).select((F.col("id") - rows[0]).alias("id"), F.slice(F.col("h"), cols[0] + 1, width).alias("h"))
    if not padded:
        return got
    every = nodes.sparkSession.range(rows[1] - rows[0]).select("id")
    blank = F.array_repeat(F.lit(0.0), width)
    return every.join(got, "id", "left").select("id", F.slice(F.concat(F.coalesce("h", blank), blank), 1, width).alias("h"))


def depth_slice(block: DataFrame, width: int, start: int, stop: int) -> DataFrame:
    """Entries [start, stop) of a block laid out row by row."""
    flat = block.select("id", F.posexplode("h").alias("j", "v")).select((F.col("id") * width + F.col("j")).alias("pos"), "v")
    return flat.filter((F.col("pos") >= start) & (F.col("pos") < stop))


def cut_labels(labels: DataFrame, start: int, stop: int, padded: bool = False) -> DataFrame:
    """Labels of a row range, rebased; padded rows are unlabelled, so they never count in a loss."""
    got = labels.filter((F.col("id") >= start) & (F.col("id") < stop)).select((F.col("id") - start).alias("id"), "y")
    return got if not padded else labels.sparkSession.range(stop - start).join(got, "id", "left").select("id", F.coalesce("y", F.lit(-1)).alias("y"))


def csr_pointers(edges: DataFrame, n: int, buckets: int = 64) -> DataFrame:
    """Row pointers 0..n. Prefix sums run inside id ranges, with range totals as offsets: no single-task window over n rows."""
    from pyspark.sql import Window

    width = max(1, -(-n // buckets))
    ids = edges.sparkSession.range(n + 1).withColumn("b", F.floor(F.col("id") / width))
    counts = ids.join(edges.groupBy((F.col("src") + 1).alias("id")).agg(F.count("*").alias("c")), "id", "left").select("id", "b", F.coalesce("c", F.lit(0)).alias("c"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("b").agg(F.sum("c").alias("t")).select("b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    run = F.sum("c").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("run", run).join(base, "b").select(F.col("id").alias("row"), (F.col("run") + F.col("base")).cast("long").alias("ptr"))


def row_chunk(src: Column, n: int, limit: int = 1_000_000) -> Column:
    """The aggregation block of a row: ceil(n/limit) blocks of equal width, the last takes the rest."""
    chunks = max(1, -(-n // limit))
    return F.least(F.floor(src / max(1, n // chunks)), F.lit(chunks - 1)).cast("int")
