"""The graphs that the registered queries run on, built from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G

OFFSET = 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supplier_part(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts, joined by the quantity shipped."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + OFFSET).alias("dst"), F.col("l_quantity").alias("w"))
    return G.symmetrize(G.coalesce_edges(li, few=True))


def user_event(spark: SparkSession, sf: str) -> DataFrame:
    """Users and event types, one parallel edge for each event."""
    ev = table(spark, sf, "events")
    kinds = ev.select("event_type").distinct().groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # a handful of types
    named = ev.crossJoin(F.broadcast(kinds)).select(F.col("user_id").alias("src"), (F.array_position("kinds", F.col("event_type")) - 1 + OFFSET).alias("dst"), F.lit(1.0).alias("w"))
    return G.symmetrize(named)


def customer_nation(spark: SparkSession, sf: str) -> DataFrame:
    return G.symmetrize(table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey").cast("long") + OFFSET).alias("dst"), F.lit(1.0).alias("w")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("h"))


def vector_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth vector is unlabelled."""
    return G.clean_labels(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 != 9, F.col("label")).alias("y")))


def vector_count(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "embeddings").count()


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector points at two others; directed."""
    n = vector_count(spark, sf)
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("src"))
    return ids.select("src", F.explode(F.array((F.col("src") * 7 + 1) % n, (F.col("src") + 1) % n)).alias("dst"), F.lit(1.0).alias("w"))


# DuckDB twins, as common table expressions
SQL_SP = f"sp AS (SELECT l_suppkey AS u, l_partkey + {OFFSET} AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), e AS (SELECT u AS src, v AS dst, w FROM sp UNION ALL SELECT v, u, w FROM sp)"
SQL_UE = f"k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 + {OFFSET} AS i FROM (SELECT DISTINCT event_type FROM events)), ue AS (SELECT user_id AS u, i AS v FROM events JOIN k USING (event_type)), e AS (SELECT u AS src, v AS dst, 1e0 AS w FROM ue UNION ALL SELECT v, u, 1e0 FROM ue)"
SQL_RING = "n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id AS src, (vec_id * 7 + 1) % n AS dst, 1e0 AS w FROM embeddings, n UNION ALL SELECT vec_id, (vec_id + 1) % n, 1e0 FROM embeddings, n)"
SQL_NORM = """nd AS (SELECT DISTINCT src AS id FROM e UNION SELECT dst FROM e),
c AS (SELECT src, dst, sum(w) AS w FROM e GROUP BY 1, 2),
l AS (SELECT * FROM c UNION ALL SELECT id, id, 1e0 FROM nd WHERE id NOT IN (SELECT src FROM c WHERE src = dst)),
d AS (SELECT dst AS id, sum(w) AS d FROM l GROUP BY 1),
g AS (SELECT l.src, l.dst, coalesce(CASE WHEN a.d > 0 THEN 1 / sqrt(a.d) ELSE 0 END, 0) * l.w * coalesce(CASE WHEN b.d > 0 THEN 1 / sqrt(b.d) ELSE 0 END, 0) AS w FROM l LEFT JOIN d a ON a.id = l.src LEFT JOIN d b ON b.id = l.dst)"""
SQL_X = "x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
SQL_Y = "y AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 9 THEN -1 ELSE label END::BIGINT AS y FROM embeddings)"


def sql_round(x: str) -> str:
    return f"round({x}, 6) + 0.0"
