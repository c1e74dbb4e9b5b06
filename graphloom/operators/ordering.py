"""Global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.lineage import cut


def global_rank(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with a dense 0-based position in the given total order.

    Rows are range partitioned, so each task numbers one slice; the slices' sizes, one row for each
    partition, give the offsets. The cut pins the sampled ranges: both readers see the same slices.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return sliced.withColumn("_inside", inside).join(offsets, "_part").withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long")).drop("_part", "_inside", "_offset")


def array_split_bucket(rank: Column, n: int, buckets: int) -> Column:
    """The bucket of a 0-based rank when n rows are cut in ``buckets`` runs, the first n % buckets one longer."""
    small, longer = divmod(n, buckets)
    head = longer * (small + 1)
    if small == 0:
        return rank.cast("int")
    return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(longer + F.floor((rank - head) / small)).cast("int")
