"""Raw graph to a normalised, labelled, permuted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.lineage import cut
from graphloom.operators import graph as G
from graphloom.schema import Graph


def preprocess(edges: DataFrame, node_ids: DataFrame, features: DataFrame | None = None, labels: DataFrame | None = None, double_perm: bool = True, directed: bool = False, num_features: int = 128, num_classes: int = 32, seed: int = 0) -> Graph:
    """Normalise features, normalise the adjacency, label, permute. Without features or labels, both are made up.

    ``node_ids`` must be 0..N-1. A directed graph aggregates over its in-edges. Degrees for made-up labels are taken after normalisation, loops included.
    """
    n = node_ids.count()
    nodes = G.normalize_features(features) if features is not None else G.random_features(node_ids, num_features, seed)
    adjacency = cut(G.gcn_norm(edges, node_ids))
    y = G.clean_labels(labels) if labels is not None else G.degree_bucket_labels(adjacency, node_ids, num_classes)
    if directed:
        adjacency = G.transpose(adjacency)
    width = nodes.selectExpr("size(h) AS f").first()["f"]
    classes = G.class_count(y).first()["num_classes"] if labels is not None else num_classes
    p = cut(G.permutation(node_ids, seed))
    if not double_perm:
        return Graph(G.permute_edges(adjacency, p, p), G.permute_rows(nodes, p), G.permute_rows(y, p), n, width, classes)
    p2 = cut(G.permutation(node_ids, seed + 1))
    first, second = G.double_permute(adjacency, p, p2)
    return Graph(first, G.permute_rows(nodes, p2), G.permute_rows(y, p), n, width, classes, second, G.permute_rows(y, p2))
