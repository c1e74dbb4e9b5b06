"""Expressions on row vectors (``ARRAY<DOUBLE>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec_sum(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, v: a + v)


def row_normalize(h: Column, shift: Column | float = 0.0, floor: float = 1.0) -> Column:
    """Shift every entry, then divide by the row sum, which counts as ``floor`` at least."""
    moved = F.transform(h, lambda v: v.cast("double") - shift)
    return F.transform(moved, lambda v: v / F.greatest(vec_sum(moved), F.lit(floor)))


def relu(h: Column) -> Column:
    return F.transform(h, lambda v: F.greatest(v, F.lit(0.0)))


def relu_grad(g: Column, z: Column) -> Column:
    """The gradient ``g`` where the pre-activation ``z`` was positive, else 0."""
    return F.zip_with(g, z, lambda a, b: F.when(b > 0, a).otherwise(F.lit(0.0)))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / vec_sum(e))


def one_hot(y: Column, num_classes: int) -> Column:
    """All zeros for a label outside the classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda c: F.when(c == y, 1).otherwise(0))


def node_loss(p: Column, y: Column, floor: float = 1e-9) -> Column:
    """Cross entropy of one row; 0 for an unlabelled one."""
    return F.when(y >= 0, -F.log(F.greatest(F.element_at(p, (y + 1).cast("int")), F.lit(floor)))).otherwise(F.lit(0.0))


def logit_grad(p: Column, y: Column, num_classes: int, num_nodes: int) -> Column:
    """(softmax - one hot) / N; a row of zeros for an unlabelled node."""
    hit = F.zip_with(p, one_hot(y, num_classes), lambda a, b: (a - b) / F.lit(float(num_nodes)))
    return F.when(y >= 0, hit).otherwise(F.transform(p, lambda _: F.lit(0.0)))
