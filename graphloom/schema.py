"""Table schemas of a graph and the container that holds them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", T.DoubleType())])
NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.ArrayType(T.DoubleType()))])
LABELS = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.LongType())])
METADATA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("num_nodes", "num_features", "num_classes", "n_tiles")] + [T.StructField("double_perm", T.BooleanType())]
)


@dataclass(frozen=True)
class Graph:
    """Edges ``(src, dst, w)`` (row = src, column = dst), features ``(id, h)``, labels ``(id, y)`` with -1 for none.

    ``edges2``/``labels2`` are the second permutation's views; ``None`` for a singly permuted graph.
    """

    edges: DataFrame
    nodes: DataFrame
    labels: DataFrame
    num_nodes: int
    num_features: int
    num_classes: int
    edges2: DataFrame | None = None
    labels2: DataFrame | None = None

    def adjacency(self, layer: int) -> DataFrame:
        """Odd layers read the second view of a doubly permuted graph."""
        return self.edges2 if self.edges2 is not None and layer % 2 else self.edges

    def targets(self, num_layers: int) -> DataFrame:
        """The label order that matches the last layer's output rows."""
        return self.labels2 if self.labels2 is not None and (num_layers - 1) % 2 else self.labels
