"""A small causal self-attention model in numpy: forward, backward, Adam.

It predicts the class of the next subword from the symbols so far. A sequence is cut in blocks; the queries of a block
see the keys of the block before and of their own up to themselves, so context windows of two blocks overlap by one,
and every position is scored once. There are no absolute positions, only a learnt bias by distance; keys and values
depend on the symbol alone, so overlapping windows share them.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

from graphloom.llm.common import keep_heap

NAMES = ("emb", "wq", "wk", "wv", "dist", "out", "bias")
MASKED = np.float32(-30.0)


@dataclass(frozen=True)
class Shape:
    symbols: int
    classes: int
    width: int = 16
    block: int = 16

    def sizes(self) -> dict[str, tuple[int, ...]]:
        d = self.width
        return {"emb": (self.symbols, d), "wq": (d, d), "wk": (d, d), "wv": (d, d), "dist": (2 * self.block,), "out": (d, self.classes), "bias": (self.classes,)}

    def init(self, seed: int = 3) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        scale = {"emb": 0.3, "dist": 0.0, "bias": 0.0}
        return {k: (rng.standard_normal(s) * scale.get(k, 1 / np.sqrt(self.width))).astype(np.float32) for k, s in self.sizes().items()}

    def pack(self, w: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([w[k].ravel() for k in NAMES]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.sizes().items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return out


def distance_bias(dist: np.ndarray, block: int) -> np.ndarray:
    """(query, key) scores by distance; later keys are masked."""
    q, k = np.arange(block)[:, None] + block, np.arange(2 * block)[None, :]
    gap = q - k
    return np.where(gap >= 0, dist[np.clip(gap, 0, 2 * block - 1)], MASKED).astype(np.float32)


class Scorer:
    """Scores of whole batches with the weights folded into tables by symbol, one each for states, queries, keys and values."""

    def __init__(self, shape: Shape, w: dict[str, np.ndarray]) -> None:
        keep_heap()
        d = shape.width
        self.shape = shape
        tables = w["emb"], w["emb"] @ w["wq"] / np.sqrt(d), w["emb"] @ w["wk"], w["emb"] @ w["wv"]
        self.tables = [np.ascontiguousarray(t, np.float32) for t in tables]
        self.near = np.ascontiguousarray(distance_bias(w["dist"], shape.block).T)
        self.out, self.bias, self.by = w["out"], w["bias"], np.exp(w["bias"])

    def __call__(self, symbols: np.ndarray, first: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target class. All three have one row for each block: symbols and targets are
        blocks x length, ``first`` marks blocks that begin a text and so see no earlier one."""
        b, d = self.shape.block, self.shape.width
        n = len(symbols)
        x, t, line = symbols.ravel(), targets.ravel(), 4 * d

        def pairs(table: np.ndarray) -> np.ndarray:
            rows = np.empty(((n + 1) * b, d), np.float32)
            rows[:b] = 0
            np.take(table, x, axis=0, out=rows[b:], mode="clip")  # else numpy makes a second copy
            return np.ndarray((n, 2 * b, d), rows.dtype, rows, 0, (b * line, line, 4))

        h, q = (np.take(table, x, axis=0, mode="clip") for table in self.tables[:2])
        k, v = map(pairs, self.tables[2:])
        s = np.matmul(k, np.ascontiguousarray(q.reshape(n, b, d).transpose(0, 2, 1)))  # keys x queries
        s += self.near
        s[first, :b] = MASKED
        np.exp(s, out=s)
        o = np.matmul(s.transpose(0, 2, 1), v)
        o /= (np.ones(2 * b, s.dtype) @ s).reshape(n, b, 1)
        h += o.reshape(n * b, d)
        z = h @ self.out
        hit = np.take(z.ravel(), np.arange(0, z.size, z.shape[1]) + t) + np.take(self.bias, t)
        np.exp(z, out=z)
        return (hit - np.log(z @ self.by)).reshape(n, b)


def gradient(shape: Shape, w: dict[str, np.ndarray], x: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss, gradients) on windows of symbols x (batch, 2 * block) and classes: x is a pair (symbols, targets), target < 0 is not scored,
    nor is a window's first block."""
    sym, tgt = x
    n, b = len(sym), shape.block
    return block_gradient(shape, w, sym.reshape(2 * n, b), np.where(np.arange(2 * b) < b, -1, tgt).reshape(2 * n, b))


def block_gradient(shape: Shape, w: dict[str, np.ndarray], sym: np.ndarray, tgt: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss, gradients) on consecutive blocks of symbols and of target classes: each sees the block before it, and the first, which
    sees none, is context only. Targets < 0 are not scored. Without ``with_loss`` the loss is nan.

    Keys and values are made once for the two windows that share a block. Attention lies keys x queries, so that no product has its
    right operand transposed, and stays unnormalised; sums, biases and scales over short axes go into products, and large arrays
    are changed in place.
    """
    n, b, d, classes = len(sym) - 1, shape.block, shape.width, shape.classes
    kind = w["emb"].dtype
    scale = kind.type(1 / np.sqrt(d))
    wq = w["wq"] * scale
    e = np.take(w["emb"], sym.ravel(), axis=0)
    q = (e[b:] @ wq).reshape(n, b, d)
    values = np.empty((len(e), d + 4), kind)  # and ones; rows of whole 16 bytes are multiplied faster, what is behind the ones is never read
    np.matmul(e, w["wv"], out=values[:, :d])
    values[:, d] = 1
    k, pairs = (as_strided(x, (n, 2 * b, x.shape[1]), (b * x.strides[0], *x.strides)) for x in (e @ w["wk"], values))
    v = pairs[..., :d]
    gap, seen = _gaps(b)
    near = np.where(seen, w["dist"][gap], kind.type(MASKED)).T.copy()
    qt = q.transpose(0, 2, 1).copy()
    a = k @ qt
    a += near
    with np.errstate(over="ignore"):
        np.exp(a, out=a)
    norm = np.ones(2 * b, kind) @ a
    if not np.isfinite(norm).all():  # far above any score that occurs; exp stays finite
        a = np.exp(np.minimum(k @ qt + near, 60))
        norm = np.ones(2 * b, kind) @ a
    share = np.repeat((1 / norm).ravel(), d).reshape(n * b, d)
    o = (a.transpose(0, 2, 1) @ v).reshape(n * b, d)
    o *= share
    h = np.empty((n * b, d + 1), kind)
    np.add(e[b:], o, out=h[:, :d])
    h[:, d] = 1
    p = np.concatenate([w["out"].T, w["bias"][:, None]], axis=1) @ h.T  # classes x places
    if not 0 <= (top := p.max()) < 60:
        p -= top
    t = tgt[1:].ravel()
    scored = np.flatnonzero(t >= 0)
    m = max(1, len(scored))
    at = t[scored] * (n * b) + scored
    hit = p.ravel()[at] if with_loss else None
    np.exp(p, out=p)
    total = np.ones(classes, kind) @ p
    loss = float(-(hit - np.log(total[scored])).sum() / m) if with_loss else np.nan
    weight = np.zeros(n * b, kind)
    weight[scored] = 1 / m
    p *= weight / total
    p.ravel()[at] -= kind.type(1 / m)  # now the gradient of the logits
    by = (p @ h).T
    g = {"out": by[:d], "bias": by[d]}
    dh = p.T @ w["out"].T.copy()
    dn = dh * share
    across = np.empty((n, d + 1, b), kind)  # with the sum of a * da in each row, which the products with the ones take off
    across[:, :d] = dn.reshape(n, b, d).transpose(0, 2, 1)
    across[:, d] = -((dn * o) @ np.ones(d, kind)).reshape(n, b)
    ds = pairs[..., : d + 1] @ across
    ds *= a
    by_place = (np.ones(n, kind) @ ds.reshape(n, -1)).reshape(2 * b, b).T
    g["dist"] = np.bincount(gap[seen], weights=by_place[seen], minlength=2 * b)
    dq = (ds.transpose(0, 2, 1) @ k).reshape(n * b, d)
    dk, dv = _joined(ds @ q), _joined(a @ dn.reshape(n, b, d))
    g["wq"], g["wk"], g["wv"] = e[b:].T @ dq * scale, e.T @ dk, e.T @ dv
    de = dk @ w["wk"].T.copy()
    de += dv @ w["wv"].T.copy()
    de[b:] += dh
    de[b:] += dq @ wq.T.copy()
    g["emb"] = _sum_rows(sym.ravel(), de, shape.symbols)
    return loss, g


@functools.cache
def _gaps(block: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, whether not a later key) by query and key."""
    gap = np.arange(block)[:, None] + block - np.arange(2 * block)[None, :]
    return np.maximum(gap, 0), gap >= 0


def _joined(x: np.ndarray) -> np.ndarray:
    """Rows for each block from windows x (2 * block) x width: what the two windows that share a block have for it, added up."""
    n, length, d = x.shape
    halves, out = x.reshape(n, 2, -1), np.empty((n + 1, length // 2 * d), x.dtype)
    out[0] = 0
    out[1:] = halves[:, 1]
    out[:-1] += halves[:, 0]
    return out.reshape(-1, d)


@functools.cache
def _places(size: int, width: int) -> np.ndarray:
    return np.arange(size * width).reshape(size, width)


def _sum_rows(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each index, ``size`` x width."""
    at = np.take(_places(size, rows.shape[1]), index, axis=0).ravel()
    return np.bincount(at, weights=rows.ravel(), minlength=size * rows.shape[1]).reshape(size, -1)


class Adam:
    """All weights stand in one vector, of which ``w`` holds views."""

    def __init__(self, shape: Shape, w: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.flat = shape.pack(w).astype(np.float32)
        self.m, self.v, self.x, self.y = (np.zeros_like(self.flat) for _ in range(4))
        self.w, at = {}, 0
        for k, size in shape.sizes().items():
            n = int(np.prod(size))
            self.w[k] = self.flat[at : at + n].reshape(size)
            at += n

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        x, y = self.x, self.y
        np.concatenate([g[k].ravel() for k in NAMES], out=x, casting="same_kind")
        np.subtract(x, self.m, out=y)
        y *= 0.1
        self.m += y
        x *= x
        x -= self.v
        x *= 0.01
        self.v += x
        np.multiply(self.v, 1 / (1 - 0.99**self.t), out=x)
        np.sqrt(x, out=x)
        x += 1e-8
        np.multiply(self.m, self.rate / (1 - 0.9**self.t), out=y)
        y /= x
        self.flat -= y


RUN = 16  #: blocks that stay together in a batch, behind the one before them


def train(shape: Shape, w: dict[str, np.ndarray], symbols: np.ndarray, targets: np.ndarray, rate: float, epochs: int = 1, batch: int = 128, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of runs of consecutive blocks; the first block is context only, and so is any without targets."""
    keep_heap()
    opt, rng = Adam(shape, w, rate), np.random.default_rng(seed)
    starts, span = np.arange(0, len(symbols) - 1, RUN), np.arange(RUN + 1)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(starts), max(1, len(starts) * RUN // batch)):
            if len(part):
                at = (part[:, None] + span).ravel()
                lead = np.tile(span == 0, len(part)) | (at >= len(symbols))
                at[at >= len(symbols)] = 0
                t = targets[at]
                t[lead] = -1  # scored in the run before
                opt.step(block_gradient(shape, opt.w, symbols[at], t, False)[1])
    return opt.w
