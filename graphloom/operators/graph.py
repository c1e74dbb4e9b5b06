"""Edge lists: coalescing, loops, degrees, symmetric normalisation, labels, features, permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_uniform, shuffle_key
from graphloom.functions.vectors import row_normalize
from graphloom.operators.ordering import array_split_bucket, global_rank


DEALT_BYTES = 8 << 20  #: of the files below a plan for each partition that :func:`dealt` makes


def dealt(edges: DataFrame) -> DataFrame:
    """Edges by pair in partitions whose number grows with the files that they are read from.

    The shuffle of an aggregate is coalesced to 64 MB of compressed pairs, which are millions of rows and a GB of hash tables in
    one task. Parallel edges of a pair meet in one task without being summed before; they take no memory there.
    """
    leaves = edges._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(b for b in sizes if b < 1 << 60)  # what has neither files nor statistics counts as 8 EB
    return edges.repartition(max(edges.sparkSession.sparkContext.defaultParallelism, -(-known // DEALT_BYTES)), "src", "dst")


def coalesce_edges(edges: DataFrame, few: bool = False) -> DataFrame:
    """Parallel edges become one, with summed weight. ``few``: most pairs have one edge, so summing before the shuffle is no use."""
    return (dealt(edges) if few else edges).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.unionByName(transpose(edges))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def add_self_loops(edges: DataFrame, nodes: DataFrame, weight: float = 1.0) -> DataFrame:
    """A loop for each node that has none; existing loops keep their weight.

    Loops come from one union and one aggregation over the loop rows only, so the edges don't shuffle.
    """
    own = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    new = nodes.select("id").join(own, "id", "left_anti")
    return edges.unionByName(new.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).alias("w")))


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row counts, zero-degree nodes included."""
    return nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")), "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def weighted_degree(edges: DataFrame, key: str = "dst") -> DataFrame:
    return edges.groupBy(F.col(key).alias("id")).agg(F.sum("w").alias("deg"))


def gcn_norm(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Self-loops, then w / sqrt(deg(src) * deg(dst)) with in-degrees by weight; 0 where a degree is 0.

    Without ``nodes``, every end of an edge is a node.
    One aggregate gives the degrees and finds who needs a loop. The joins hash the nodes and let the edges pass, so no task sorts
    edges, and partitions of hubs can be split.
    """
    pairs = coalesce_edges(edges, few=True)
    end = lambda id, w, own, node: F.struct(F.col(id).alias("id"), w.cast("double").alias("w"), own.alias("own"), F.lit(node).alias("node"))
    into = end("dst", F.col("w"), F.col("src") == F.col("dst"), 0)
    if nodes is None:
        ends = pairs.select(F.inline(F.array(into.withField("node", F.lit(1)), end("src", F.lit(None), F.lit(False), 1))))
        need = F.max("node")
    else:
        ends = pairs.select(into.alias("end")).select("end.*").unionByName(nodes.select(end("id", F.lit(None), F.lit(False), 1).alias("end")).select("end.*"))
        need = F.sum("node")
    degrees = ends.groupBy("id").agg(F.sum("w").alias("deg"), F.when(F.coalesce(F.max("own"), F.lit(False)), F.lit(0)).otherwise(need).cast("int").alias("loops"))
    deg = F.coalesce("deg", F.lit(0.0)) + F.col("loops")
    scale = degrees.select("id", F.when(deg > 0, 1 / F.sqrt(deg)).otherwise(F.lit(0.0)).alias("s"), "loops")
    left, right = scale.select(F.col("id").alias("src"), F.col("s").alias("s1")), scale.select(F.col("id").alias("dst"), F.col("s").alias("s2"))
    joined = pairs.join(left.hint("shuffle_hash"), "src", "left").join(right.hint("shuffle_hash"), "dst", "left")
    loops = scale.filter("loops > 0").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.when(F.col("id").isNotNull(), F.col("s") * F.col("s")).otherwise(F.lit(0.0)).alias("w"), F.explode(F.sequence(F.lit(1), F.col("loops"))).alias("k"))
    return joined.select("src", "dst", (F.coalesce("s1", F.lit(0.0)) * F.col("w") * F.coalesce("s2", F.lit(0.0))).alias("w")).unionByName(loops.drop("k"))


def normalize_features(nodes: DataFrame, shift_to_zero: bool = True) -> DataFrame:
    """Rows scaled to sum 1 after the table's minimum moves to 0; a sum below 1 counts as 1."""
    if not shift_to_zero:
        return nodes.withColumn("h", row_normalize(F.col("h")))
    low = nodes.agg(F.min(F.array_min("h")).cast("double").alias("_low"))  # one row: bounded, so safe to broadcast
    return nodes.crossJoin(F.broadcast(low)).withColumn("h", row_normalize(F.col("h"), F.col("_low"))).drop("_low")


def random_features(nodes: DataFrame, num_features: int, seed: int = 0) -> DataFrame:
    """Uniform [0, 1) features; the same for any partitioning."""
    return nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(num_features - 1)), lambda j: hash_uniform(F.col("id"), j, seed)).alias("h"))


def clean_labels(labels: DataFrame) -> DataFrame:
    """NULL and NaN become -1; the rest become integers."""
    return labels.select("id", F.coalesce(F.nanvl(F.col("y").cast("double"), F.lit(None).cast("double")), F.lit(-1.0)).cast("long").alias("y"))


def degree_bucket_labels(edges: DataFrame, nodes: DataFrame, num_classes: int = 32) -> DataFrame:
    """Pseudo-labels: nodes in order of degree (ties by id) cut into equal buckets."""
    ranked = global_rank(out_degree(edges, nodes), F.col("deg"), F.col("id"))
    return ranked.select("id", array_split_bucket(F.col("rank"), ranked.count(), num_classes).cast("long").alias("y"))


def class_count(labels: DataFrame) -> DataFrame:
    return labels.agg((F.coalesce(F.max("y"), F.lit(-1)) + 1).cast("long").alias("num_classes"))


def permutation(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """A seeded bijection (old_id, new_id) onto 0..N-1."""
    return global_rank(nodes.select("id", shuffle_key(seed, F.col("id")).alias("_key")), F.col("_key"), F.col("id"), name="new_id").select(F.col("id").alias("old_id"), "new_id")


def permute_rows(table: DataFrame, perm: DataFrame) -> DataFrame:
    """Features or labels keyed by ``id`` move to their new ids."""
    return table.join(perm, table["id"] == perm["old_id"]).select(F.col("new_id").alias("id"), *[c for c in table.columns if c != "id"])


def permute_edges(edges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Row ids by one permutation and column ids by another: two relabelling joins, no matrix product."""
    r = rows.select(F.col("old_id").alias("src"), F.col("new_id").alias("_r"))
    c = cols.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_c"))
    return edges.join(r, "src").join(c, "dst").select(F.col("_r").alias("src"), F.col("_c").alias("dst"), "w")


def double_permute(edges: DataFrame, p: DataFrame, p2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The views for even layers (rows by p, columns by p2) and odd layers (the reverse)."""
    return permute_edges(edges, p, p2), permute_edges(edges, p2, p)
