"""Text formats: tab-separated edges and MatrixMarket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import EDGES


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``src<tab>dst<tab>weight`` lines, no header; surrounding blanks are trimmed."""
    return spark.read.csv(path, sep="\t", schema=EDGES, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def write_tsv(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "w").write.csv(path, sep="\t", mode="overwrite")


def write_mtx(edges: DataFrame, folder: str, n: int, source: str = "matrix") -> str:
    """Write one MatrixMarket file, named after ``source`` without its folders and ending, and return its path.

    Entries have 1-based ids. They are written in parallel as parts; the driver then only strings the parts together, in
    blocks, with the store's own streams.
    """
    spark = edges.sparkSession
    path = f"{folder.rstrip('/')}/{source.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.mtx"
    parts = f"{path}-parts"
    rows = edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, F.col("w")))
    rows.write.mode("overwrite").text(parts)
    count = spark.read.text(parts).count()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(f"%%MatrixMarket matrix coordinate real general\n{n} {n} {count}\n".encode()))
        for f in sorted((x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts))), key=lambda x: x.getName()):
            if f.getName().startswith("part-"):
                part = fs.open(f)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)
    return path


def read_mtx(spark: SparkSession, path: str, keep_values: bool = False) -> tuple[DataFrame, int]:
    """(edges, rows of the matrix) of one MatrixMarket file. Stored values are dropped for 1.0, and explicit zeros go.

    A ``symmetric`` banner adds the mirrored entries; entries of a ``pattern`` have no value. An entry that reads like the
    size line is kept: of equal lines, all but one are entries.
    """
    lines = spark.read.text(path)
    banner = lines.filter(F.col("value").startswith("%%MatrixMarket")).first()["value"].lower()
    plain = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = plain.first()["value"]  # a text file is read in order, so this is its first plain line
    like = plain.filter(F.col("value") == size).count() - 1
    body = plain.filter(F.col("value") != size).unionByName(spark.range(like).select(F.lit(size).alias("value")))
    parts = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if "pattern" in banner else F.get(parts, F.lit(2)).cast("double")
    edges = body.select((F.get(parts, F.lit(0)).cast("long") - 1).alias("src"), (F.get(parts, F.lit(1)).cast("long") - 1).alias("dst"), value.alias("w")).filter("w <> 0")
    if "symmetric" in banner:
        edges = edges.unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return (edges if keep_values else edges.withColumn("w", F.lit(1.0))), int(size.split()[0])
