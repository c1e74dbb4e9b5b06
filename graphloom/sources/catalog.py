"""Named raw graphs and the switches each one implies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.text import read_mtx, read_tsv


@dataclass(frozen=True)
class Dataset:
    """``directed`` graphs aggregate over in-edges; ``unsupervised`` ones get made-up features and labels."""

    name: str
    directed: bool = False
    unsupervised: bool = False
    single_file: bool = False


DATASETS = {
    d.name: d
    for d in (
        Dataset("reddit"), Dataset("ogbn-products"), Dataset("ogbn-papers100M", directed=True), Dataset("europe_osm", unsupervised=True),
        Dataset("protein", unsupervised=True, single_file=True), Dataset("amazon", unsupervised=True, single_file=True),
    )
}


def lookup(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    return DATASETS[name]


def read_raw(spark: SparkSession, name: str, path: str) -> tuple[Dataset, DataFrame, DataFrame | None, DataFrame | None]:
    """(dataset, edges, features, labels). A supervised graph is a folder with edges, nodes and labels tables;
    an unsupervised one is an edge table, or a .tsv or .mtx file."""
    d = lookup(name)
    if path.endswith(".tsv"):
        edges = read_tsv(spark, path)
    elif path.endswith(".mtx"):
        edges = read_mtx(spark, path)[0]
    else:
        edges = spark.read.parquet(path if d.single_file else f"{path}/edges")
    if d.unsupervised:
        return d, edges, None, None
    return d, edges, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/labels")
