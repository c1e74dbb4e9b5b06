"""Full-batch training as a driver loop over lazy epochs."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut
from graphloom.operators.nn import AdamW, GCNLayer, Net, loss_rows, mean_loss
from graphloom.schema import Graph


@dataclass
class Trainer:
    """Weights live on the driver; features, which train too, live in a table with their moments."""

    graph: Graph
    net: Net
    optimizer: AdamW = field(default_factory=AdamW)
    train_features: bool = True

    def __post_init__(self) -> None:
        self.moments = [(np.zeros_like(x.weight), np.zeros_like(x.weight)) for x in self.net.layers]
        zeros = F.transform("h", lambda _: F.lit(0.0))
        self.state = self.graph.nodes.select("id", F.transform("h", lambda v: v.cast("double")).alias("h"), zeros.alias("m"), zeros.alias("v"))
        views = range(2 if self.graph.edges2 is not None else 1)
        # Laid out once for each direction, so that in every epoch only vectors shuffle to meet them.
        self.by_dst = [self.graph.adjacency(k).repartition("dst").persist() for k in views]
        self.by_src = [self.graph.adjacency(k).repartition("src").persist() for k in views]
        self.t = 0

    def adjacency(self, layer: int) -> DataFrame:
        """For A . H, which joins on dst."""
        return self.by_dst[layer % len(self.by_dst)]

    def transposed(self, layer: int) -> DataFrame:
        """The same edges for A' . G, which joins on src."""
        return self.by_src[layer % len(self.by_src)]

    def close(self) -> None:
        for df in (*self.by_dst, *self.by_src):
            df.unpersist()

    def epoch(self) -> float:
        """One forward pass, backward pass and step; returns the loss before the step.

        What the backward pass needs again is persisted, and made again if an executor that held it is lost; lineage is
        cut once, with the state of the features.
        """
        g, self.t = self.graph, self.t + 1
        held: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        kept = self.net.forward_kept(self.adjacency, self.state.select("id", "h"), keep)
        rows = keep(loss_rows(kept[-1][1], g.targets(len(self.net.layers)), g.num_classes, g.num_nodes))
        loss = mean_loss(rows, g.num_nodes).first()["loss"]
        grads, grad_x = self.net.backward(self.transposed, kept, rows.select("id", F.col("grad").alias("h")), keep)
        layers = []
        for k, (layer, dw) in enumerate(zip(self.net.layers, grads)):
            w, *self.moments[k] = self.optimizer.step(layer.weight, *self.moments[k], dw, self.t)
            layers.append(GCNLayer(w, k))
        self.net = Net(layers)
        if self.train_features:
            both = self.state.join(grad_x.select("id", F.col("h").alias("g")), "id")
            h, m, v = self.optimizer.columns(F.col("h"), F.col("m"), F.col("v"), F.col("g"), self.t)
            self.state = cut(both.select("id", h.alias("h"), m.alias("m"), v.alias("v")))
        for df in held:
            df.unpersist()
        return loss

    def fit(self, epochs: int, start: int = 0, stop: int | None = None) -> list[dict]:
        """One record for each epoch; ``timed`` marks those between start and stop, both included."""
        out = []
        for i in range(epochs):
            began = time.perf_counter()
            loss = self.epoch()
            out.append({"epoch": i, "loss": loss, "ms": (time.perf_counter() - began) * 1000, "timed": start <= i <= (epochs - 1 if stop is None else stop)})
        return out


def report_lines(records: list[dict]) -> list[str]:
    return [f"Epoch: {r['epoch']:03d}, Train Loss: {r['loss']:.4f}" for r in records]
