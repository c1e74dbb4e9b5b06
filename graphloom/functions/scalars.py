"""Scalar helpers: padding, portable hashing, log-line parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timer names that a training log uses, with their significant trailing spaces.
COMM_KEYS = ("gather ", "all-reduce ", "reduce-scatter ")
COMP_KEYS = ("AGG = A * H ", "OUT = AGG * W ", "GRAD_W = AGG.T * GRAD_OUT ", "GRAD_AGG = GRAD_OUT * W.T ", "GRAD_H = A.T * GRAD_AGG ")
LOSS_KEY = "cross entropy"
EPOCH_KEY = "epoch "


def pad_dimension(v: Column, parts: Column | int, parts2: Column | int = 1) -> Column:
    """Round ``v`` up to a multiple of ``parts * parts2``."""
    step = (parts if isinstance(parts, Column) else F.lit(parts)) * (parts2 if isinstance(parts2, Column) else F.lit(parts2))
    return v + F.pmod(-v, step)


def hash_uniform(*keys: Column | int, modulus: int = 10007) -> Column:
    """A value in [0, 1) from integer keys. Independent of partitioning, and the same in any SQL engine."""
    primes = (7919, 104729, 31337, 15485863)
    terms = [(k if isinstance(k, Column) else F.lit(k)).cast("long") * F.lit(p).cast("long") for k, p in zip(keys, primes)]
    return F.pmod(reduce(lambda a, b: a + b, terms), F.lit(modulus).cast("long")).cast("double") / F.lit(float(modulus))


def shuffle_key(seed: int, key: Column) -> Column:
    """Order by this for a seeded random permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def basename(path: Column, suffix: str = "pt") -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def extract_avg_time(line: Column) -> Column:
    """The number after ``Avg Time:``, else 0."""
    got = F.regexp_extract(line, r"Avg Time: ([0-9]*\.?[0-9]+)", 1)
    return F.coalesce(F.when(got != "", got).try_cast("double"), F.lit(0.0))


def classify_line(line: Column) -> Column:
    """First match wins: epoch, comm, comp, loss; null for anything else. Case and inner spaces matter, those around the line don't."""
    line = F.btrim(line, F.lit(" \t\n\r\f\x0b"))
    any_of = lambda keys: reduce(lambda a, b: a | b, [line.contains(k) for k in keys])
    return (
        F.when(line.contains(EPOCH_KEY), "epoch")
        .when(any_of(COMM_KEYS), "comm")
        .when(any_of(COMP_KEYS), "comp")
        .when(line.contains(LOSS_KEY), "loss")
    )


def round6(c: Column) -> Column:
    """Round for comparison across engines; adding zero removes a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
