"""Sparse and dense products on tables.

A sparse product is a join and a wide sum: the vector travels as one array, the sums as one aggregate
row, so partial aggregation leaves one row for each node and task. Dense weights are small (features x
features), live on the driver and travel with the plan; row blocks multiply in numpy over Arrow, as
whole-stage code has no matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = 64  #: sums in one aggregate that stay in generated code; wider vectors are summed in slices


def matrix(col: pa.Array) -> np.ndarray:
    """An Arrow list column as rows x width."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def as_lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def weighted_sum(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Sum of w * h for each key."""
    agg = [F.sum(F.col("w") * F.get("h", F.lit(j))).alias(f"s{j}") for j in range(width)]
    if width <= WIDE:
        return rows.groupBy(key).agg(*agg).select(key, F.array(*[f"s{j}" for j in range(width)]).alias("h"))
    parts = F.transform(F.sequence(F.lit(0), F.lit((width - 1) // WIDE)), lambda t: F.struct(t.alias("t"), F.slice("h", t * WIDE + 1, F.lit(WIDE)).alias("h")))
    sliced = rows.select(key, "w", F.explode(parts).alias("b")).select(key, "w", "b.t", "b.h")
    summed = sliced.groupBy(key, "t").agg(*agg[:WIDE]).select(key, F.struct("t", F.filter(F.array(*[f"s{j}" for j in range(WIDE)]), lambda v: v.isNotNull()).alias("h")).alias("b"))
    return summed.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["h"])).alias("h"))  # width/WIDE items each


def spmm(edges: DataFrame, nodes: DataFrame, width: int, every_row: bool = True) -> DataFrame:
    """A . H: for each row the weighted sum of its columns' vectors. Rows without entries are zeros."""
    joined = edges.join(nodes.select(F.col("id").alias("dst"), "h"), "dst").select("src", "w", "h")
    out = weighted_sum(joined, "src", width).withColumnRenamed("src", "id")
    if not every_row:
        return out
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("h", F.array_repeat(F.lit(0.0), width)).alias("h"))


def spmm_transpose(edges: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """A' . G, without storing the transpose."""
    return spmm(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), nodes, width)


def gemm(nodes: DataFrame, weight: np.ndarray) -> DataFrame:
    """H . W for a driver-side weight of features x features size."""
    w = np.ascontiguousarray(weight, dtype=np.float64)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), as_lists(matrix(b.column(1)) @ w)], ["id", "h"])

    return nodes.select("id", "h").mapInArrow(block, "id long, h array<double>")


def gram(left: DataFrame, right: DataFrame) -> DataFrame:
    """L' . R over nodes as (i, row): one partial matrix from each task, then a sum of those."""
    both = left.select("id", F.col("h").alias("a")).join(right.select("id", F.col("h").alias("b")), "id")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(1)).T @ matrix(b.column(2))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), as_lists(total)], ["i", "h"])

    parts = both.mapInArrow(partial, "i long, h array<double>")
    return parts.select("i", F.posexplode("h").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def collect_matrix(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Cells (i, j, v) of a weight-sized matrix on the driver; its size is the model's, not the data's."""
    out = np.zeros(shape)
    for r in cells.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def matrix_stats(edges: DataFrame) -> DataFrame:
    """Stored entries (explicit zeros too) and the Frobenius norm."""
    return edges.agg(F.count("*").alias("nnz"), F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("frobenius"))


def row_slice(edges: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows [start, stop), rebased."""
    return edges.filter((F.col("src") >= start) & (F.col("src") < stop)).select((F.col("src") - start).alias("src"), "dst", "w")


def spmm_flops(edges: DataFrame, width: int) -> DataFrame:
    return edges.agg((F.count("*") * 2 * width).cast("long").alias("flops"))
