"""Graph convolution layers, loss and optimiser steps on tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vectors import logit_grad, node_loss, relu, relu_grad, softmax
from graphloom.operators.linalg import collect_matrix, gemm, gram, spmm, spmm_transpose


def init_weight(fan_in: int, fan_out: int, layer: int = 0, seed: int = 0, fan: str = "in") -> np.ndarray:
    """Uniform in (-b, b) with b = 1/sqrt(fan), from integer hashes, so any engine can rebuild it.

    ``fan`` picks which dimension sets the bound: the input width, or the output width.
    """
    i, j = np.meshgrid(np.arange(fan_in), np.arange(fan_out), indexing="ij")
    unit = ((i * 7919 + j * 104729 + seed + layer * 31337) % 10007) / 10007.0
    return (unit * 2 - 1) / np.sqrt(fan_in if fan == "in" else fan_out)


@dataclass(frozen=True)
class GCNLayer:
    """One convolution: aggregate over the layer's adjacency view, then combine. No bias."""

    weight: np.ndarray
    index: int = 0

    def aggregate(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return spmm(edges, nodes, self.weight.shape[0])

    def forward(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """(A . H) . W, or A . (H . W) where that shuffles narrower rows; equal up to rounding."""
        if self.weight.shape[1] < self.weight.shape[0]:
            return spmm(edges, gemm(nodes, self.weight), self.weight.shape[1])
        return gemm(self.aggregate(edges, nodes), self.weight)

    def backward(self, edges: DataFrame, aggregated: DataFrame, grad_out: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(gradient of W as cells, gradient of the layer's input)."""
        grad_w = gram(aggregated, grad_out)
        grad_h = spmm_transpose(edges, gemm(grad_out, self.weight.T), self.weight.shape[0])
        return grad_w, grad_h


def relu_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", relu(F.col("h")).alias("h"))


def mask_by_preactivation(grad: DataFrame, z: DataFrame) -> DataFrame:
    return grad.join(z.select("id", F.col("h").alias("_z")), "id").select("id", relu_grad(F.col("h"), F.col("_z")).alias("h"))


def loss_rows(logits: DataFrame, labels: DataFrame, num_classes: int, num_nodes: int) -> DataFrame:
    """(id, y, p, loss, grad): softmax, cross entropy and its gradient; unlabelled rows have 0 for both."""
    y = F.coalesce("y", F.lit(-1))
    rows = logits.join(labels, "id", "left").select("id", y.alias("y"), softmax(F.col("h")).alias("p"))
    return rows.select("id", "y", "p", node_loss(F.col("p"), F.col("y")).alias("loss"), logit_grad(F.col("p"), F.col("y"), num_classes, num_nodes).alias("grad"))


def mean_loss(rows: DataFrame, num_nodes: int) -> DataFrame:
    """Sum over labelled rows divided by all nodes, unlabelled ones included."""
    return rows.agg((F.coalesce(F.sum("loss"), F.lit(0.0)) / F.lit(float(num_nodes))).alias("loss"))


@dataclass(frozen=True)
class AdamW:
    lr: float = 3e-3
    weight_decay: float = 0.0
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    def step(self, w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One update of a driver-side weight; t counts from 1."""
        m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
        return w - self.lr * (m / (1 - self.beta1**t) / (np.sqrt(v / (1 - self.beta2**t)) + self.eps) + self.weight_decay * w), m, v

    def columns(self, w: Column, m: Column, v: Column, g: Column, t: int) -> tuple[Column, Column, Column]:
        """The same update on vector columns, for trainable features."""
        m2 = F.zip_with(m, g, lambda a, b: a * self.beta1 + b * (1 - self.beta1))
        v2 = F.zip_with(v, g, lambda a, b: a * self.beta2 + b * b * (1 - self.beta2))
        rate = F.zip_with(m2, v2, lambda a, b: (a / (1 - self.beta1**t)) / (F.sqrt(b / (1 - self.beta2**t)) + self.eps))
        return F.zip_with(w, rate, lambda a, r: a - (r + a * self.weight_decay) * self.lr), m2, v2


@dataclass
class Net:
    """A stack of layers with ReLU between them."""

    layers: list[GCNLayer]

    @classmethod
    def build(cls, num_layers: int, width_in: int, hidden: int, width_out: int, seed: int = 0) -> Net:
        dims = [width_in, *[hidden] * (num_layers - 1), width_out]
        return cls([GCNLayer(init_weight(a, b, i, seed), i) for i, (a, b) in enumerate(zip(dims, dims[1:]))])

    def forward(self, adjacency, nodes: DataFrame) -> DataFrame:
        """``adjacency`` maps a layer's index to its edges."""
        h = nodes
        for k, layer in enumerate(self.layers):
            z = layer.forward(adjacency(k), h)
            h = relu_rows(z) if k + 1 < len(self.layers) else z
        return h

    def forward_kept(self, adjacency, nodes: DataFrame, keep) -> list[tuple[DataFrame, DataFrame]]:
        """(aggregate, pre-activation) of each layer, each passed through ``keep`` for the backward pass."""
        out, h = [], nodes
        for k, layer in enumerate(self.layers):
            agg = keep(layer.aggregate(adjacency(k), h))
            z = keep(gemm(agg, layer.weight))
            out.append((agg, z))
            h = relu_rows(z)
        return out

    def backward(self, adjacency, kept, grad: DataFrame, keep) -> tuple[list[np.ndarray], DataFrame]:
        """Gradients of the weights, and of the input features."""
        grads: list[np.ndarray] = []
        for k in range(len(self.layers) - 1, -1, -1):
            cells, grad_h = self.layers[k].backward(adjacency(k), kept[k][0], grad)
            grads.append(collect_matrix(cells, self.layers[k].weight.shape))
            grad = keep(mask_by_preactivation(grad_h, kept[k - 1][1]) if k else grad_h)
        return grads[::-1], grad
