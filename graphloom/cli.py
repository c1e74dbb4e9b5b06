"""Command line: prepare a graph, tile it, train on it, read a training log, compare layouts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import costs, telemetry, tiling
from graphloom.operators.nn import AdamW, Net
from graphloom.plans.preprocess import preprocess
from graphloom.plans.train import Trainer, report_lines
from graphloom.sources import catalog, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="raw graph to processed graph")
    a.add_argument("name")
    a.add_argument("source")
    a.add_argument("out")
    a.add_argument("--nodes", type=int, help="number of nodes; counted from the features if left out")
    a.add_argument("--single-perm", action="store_true")
    a.add_argument("--features", type=int, default=128)
    a.add_argument("--classes", type=int, default=32)
    a.add_argument("--tiles", type=int, default=0, help="write the tiled form with so many tiles a side")
    a.add_argument("--seed", type=int, default=0)
    a = sub.add_parser("skew", help="entries by tile of a processed graph")
    a.add_argument("path")
    a.add_argument("--tiles", type=int, default=16)
    a = sub.add_parser("train")
    a.add_argument("path")
    for flag, kind, default in (("--epochs", int, 2), ("--layers", int, 3), ("--hidden", int, 128), ("--lr", float, 3e-3), ("--weight-decay", float, 0.0), ("--seed", int, 0)):
        a.add_argument(flag, type=kind, default=default)
    a = sub.add_parser("log", help="average epoch and communication time of a training log")
    a.add_argument("path")
    a.add_argument("--warmup", type=int, default=0)
    a = sub.add_parser("layouts", help="communication cost of every layout")
    a.add_argument("parts", type=int)
    a.add_argument("nodes", type=int)
    a.add_argument("dims", type=int, nargs="+")
    a.add_argument("--version", default="v3")
    a.add_argument("--machine", default="perlmutter")
    return p


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"graphloom-{o.command}").getOrCreate()
    if o.command == "prepare":
        d, edges, features, labels = catalog.read_raw(spark, o.name, o.source)
        ids = features.select("id") if features is not None else spark.range(o.nodes if o.nodes else edges.agg(F.max(F.greatest("src", "dst")) + 1).first()[0])
        g = preprocess(edges, ids, features, labels, not o.single_perm, d.directed, o.features, o.classes, o.seed)
        store.save_tiled(g, o.out, o.tiles) if o.tiles else store.save_graph(g, o.out)
    elif o.command == "skew":
        g = store.load_graph(spark, o.path)
        tiling.tile_skew(tiling.tile_counts(g.edges, g.num_nodes, o.tiles)).show()
    elif o.command == "train":
        g = store.load_graph(spark, o.path)
        net = Net.build(o.layers, g.num_features, o.hidden, g.num_classes, o.seed)
        print("\n".join(report_lines(Trainer(g, net, AdamW(o.lr, o.weight_decay)).fit(o.epochs))))
    elif o.command == "log":
        lines = telemetry.log_lines(spark.read.text(o.path, wholetext=True))
        telemetry.epoch_average(telemetry.epoch_times(telemetry.log_segments(lines)), o.warmup).show()
    else:
        costs.comm_cost(spark, o.parts, o.nodes, o.dims, o.version, o.machine).orderBy("cost", "x", "y", "z").show(100, False)


if __name__ == "__main__":
    main()
