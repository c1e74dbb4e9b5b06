"""Closed-form cost models over three-axis layouts: communication, sparse products, memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 4 / 1024**3  #: GiB for each element
GPUS_PER_NODE = {"perlmutter": 4, "frontier": 8}

# Measured bandwidths by (parts inside this axis, this axis' size); None is any other size.
PERLMUTTER = {1: {2: 76.0, 4: 225.0, None: 66.59}, 2: {2: 76.0, None: 66.59 / 2}, None: {None: 66.59 / 4}}
FRONTIER = {1: {2: 129.0, 4: 52.0, 8: 135.0, None: 80 / 2}, 2: {2: 50.0, 4: 72.0, None: 40 / 2}, 4: {2: 36.0, None: 20 / 2}, None: {None: 10 / 2}}


def _choose(key: Column, options: dict, render) -> Column:
    picked = render(options[None])
    for k in reversed([k for k in options if k is not None]):
        picked = F.when(key == k, render(options[k])).otherwise(picked)
    return picked


def bandwidth(inside: Column, own: Column, version: str, machine: str) -> Column:
    """Bandwidth of a group of ``own`` parts whose members lie ``inside`` parts apart."""
    if machine not in GPUS_PER_NODE:
        raise ValueError(f"unknown machine {machine!r}")
    per_node = GPUS_PER_NODE[machine]
    if version == "v1":
        return F.lit(1.0)
    if version == "v2":
        if machine != "perlmutter":
            raise ValueError("v2 is known for perlmutter only")
        return F.when(inside * own <= per_node, F.lit(200.0)).otherwise(F.lit(100.0) / F.least(F.lit(per_node), inside))
    if version != "v3":
        raise ValueError(f"unknown version {version!r}")
    table = PERLMUTTER if machine == "perlmutter" else FRONTIER
    measured = _choose(inside, table, lambda sizes: _choose(own, sizes, lambda v: F.lit(float(v))))
    return F.when(own == 1, F.lit(1.0)).otherwise(measured) if machine == "perlmutter" else measured


def grid_configs(spark: SparkSession, parts: int) -> DataFrame:
    """All (x, y, z) of powers of two whose product is ``parts``."""
    if parts < 1 or parts & (parts - 1):
        raise ValueError("the number of parts must be a power of two")
    k = parts.bit_length() - 1
    a = spark.range(k + 1).select(F.col("id").alias("a"))
    both = a.select("a", F.explode(F.sequence(F.lit(0), F.lit(k) - F.col("a"))).alias("b"))
    return both.select(*[F.call_function("shiftleft", F.lit(1).cast("long"), e.cast("int")).alias(n) for n, e in (("x", F.col("a")), ("y", F.col("b")), ("z", k - F.col("a") - F.col("b")))])


def _layers(spark: SparkSession, dims: list[int]) -> DataFrame:
    rows = [(i, float(d), float(dims[i + 1]) if i + 1 < len(dims) else None) for i, d in enumerate(dims)]
    return spark.createDataFrame(rows, "layer long, d double, e double")


def _turn(*three: Column) -> Column:
    t = F.pmod(F.col("layer"), F.lit(3))
    return F.when(t == 0, three[0]).when(t == 1, three[1]).otherwise(three[2])


def comm_cost(spark: SparkSession, parts: int, n: int, dims: list[int], version: str = "v1", machine: str = "perlmutter") -> DataFrame:
    """Milliseconds of communication in one epoch for each layout."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    one = F.lit(1).cast("long")
    bw = {"y": bandwidth(one, F.col("y"), version, machine), "x": bandwidth(F.col("y"), F.col("x"), version, machine), "z": bandwidth(F.col("y") * F.col("x"), F.col("z"), version, machine)}
    rows = grid_configs(spark, parts).crossJoin(_layers(spark, dims).filter("e IS NOT NULL"))
    a, o, g = _turn(x, z, y), _turn(y, x, z), _turn(z, y, x)
    ba, bo, bg = _turn(bw["x"], bw["z"], bw["y"]), _turn(bw["y"], bw["x"], bw["z"]), _turn(bw["z"], bw["y"], bw["x"])
    d, e, first = F.col("d"), F.col("e"), F.col("layer") == 0
    gather_x = (g - 1) / g * n * d / (a * o) * K / bg
    gather_w = (g - 1) / g * d * e / (a * o) * K / bg
    reduce_agg = 2 * (a - 1) / a * n * d / (g * o) * K / ba
    reduce_out = 2 * (o - 1) / o * n * e / (g * a) * K / bo
    forward = F.when(first, gather_x).otherwise(F.lit(0.0)) + reduce_agg + gather_w + reduce_out
    backward = gather_w * 2 + reduce_agg + F.when(first, gather_x).otherwise(gather_x * 2)
    return rows.withColumn("term", forward + backward).groupBy("x", "y", "z").agg((F.sum("term") * 1000).alias("cost"))


def spmm_cost(spark: SparkSession, n: int, nnz: int, parts: int, dims: list[int], coef: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A relative cost of the sparse products; ``dims`` leaves out the class count."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    rows = grid_configs(spark, parts).crossJoin(_layers(spark, dims))
    d, tall = F.col("d"), _turn(y, x, z)
    terms = rows.select("x", "y", "z", (F.lit(float(nnz)) * d / (x * y * z)).alias("flops"), (F.lit(float(n)) * tall / (d * _turn(x, z, y))).alias("fwd"), (F.lit(float(n)) * tall / (d * _turn(z, y, x))).alias("bwd"))
    s = terms.groupBy("x", "y", "z").agg(*[F.sum(c).alias(c) for c in ("flops", "fwd", "bwd")])
    root = F.sqrt("flops")
    return s.select("x", "y", "z", (root * coef[0] + root * F.col("fwd") * coef[1] + root * F.col("bwd") * coef[2]).alias("cost"))


def memory_cost(spark: SparkSession, parts: int, n: int, num_edges: int, dims: list[int]) -> DataFrame:
    """GiB for each part."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    last, i, d, e = len(dims) - 1, F.col("layer"), F.col("d"), F.col("e")
    nf, ef = F.lit(float(n)), F.lit(float(num_edges))
    rows = grid_configs(spark, parts).crossJoin(_layers(spark, dims))
    p, q = _turn(z, y, x), _turn(x, z, y)
    only = lambda cond, v: F.when(cond, v).otherwise(F.lit(0.0))
    terms = [
        only(i < 3, (ef * 3 / (p * q) + nf * 2 / p) * 2),
        only(i < last, d * e * 4 / parts),
        only(i < last, nf * d * 2 / _turn(z * y, y * x, x * z)),
        only(i >= 1, nf * d * 2 / _turn(x * y, z * x, y * z)),
        only(i == 0, nf * d * 4 / parts + nf * d / (x * y) + d * e / (y * x)),
    ]
    labels = nf * 2 / {0: y, 1: x, 2: z}[len(dims) % 3]
    s = rows.withColumn("term", reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])).groupBy("x", "y", "z").agg(F.sum("term").alias("t"))
    return s.select("x", "y", "z", ((F.col("t") + labels) * F.lit(K)).alias("cost"))


def cheapest(costs: DataFrame) -> DataFrame:
    """The best layout; ties keep enumeration order."""
    return costs.orderBy("cost", "x", "y", "z").limit(1)
