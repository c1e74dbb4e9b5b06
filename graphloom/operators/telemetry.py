"""Timer roll-ups and training-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import classify_line, extract_avg_time


def timer_rollup(timers: DataFrame, world: int) -> DataFrame:
    """(rank, stack, ms) to max, average over the whole world, and imbalance, for each call stack."""
    avg = F.sum("ms") / F.lit(float(world))
    return timers.groupBy("stack").agg(F.max("ms").alias("max_ms"), avg.alias("avg_ms"), F.try_divide(F.max("ms"), avg).alias("imbalance"), F.size(F.first("stack")).alias("depth"))


def timer_tree(rollup: DataFrame) -> DataFrame:
    """Each stack beside its parent's average; a stack whose parent has no timer is an orphan."""
    parent = rollup.select(F.col("stack").alias("parent"), F.col("avg_ms").alias("parent_ms"))
    child = rollup.withColumn("_up", F.slice("stack", 1, F.col("depth") - 1))
    joined = child.join(parent, child["_up"] == parent["parent"], "left")
    return joined.select("stack", "depth", "max_ms", "avg_ms", "imbalance", "parent_ms", ((F.col("depth") > 1) & F.col("parent").isNull()).alias("orphan"))


def format_tree(tree: DataFrame) -> list[str]:
    """Indented lines, parents first; a report of one line for each timer name."""
    if tree.filter("orphan").limit(1).count():
        raise AssertionError("a timer's parent was never timed")
    rows = tree.orderBy("stack").collect()
    return [f"{'  ' * (r['depth'] - 1)}{r['stack'][-1]} | Max Time: {r['max_ms']:.3f} ms | Avg Time: {r['avg_ms']:.3f} ms | Imbalance: {r['imbalance']:.3f}" for r in rows]


def log_lines(text: DataFrame, column: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line of each whole-text row, with its number."""
    return text.select(*keys, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def log_segments(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines with kind, time and epoch number (1-based; 0 before the first epoch line)."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = classify_line(F.col("line"))
    return lines.withColumns({"kind": kind, "ms": extract_avg_time(F.col("line")), "epoch_seq": F.sum(F.when(kind == "epoch", 1).otherwise(0)).over(w)})


def epoch_times(segments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total (communication, computation, loss) and communication of each epoch."""
    inside = segments.filter("epoch_seq > 0")
    ms = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("ms")).otherwise(F.lit(0.0)))
    return inside.groupBy(*keys, "epoch_seq").agg(ms("comm", "comp", "loss").alias("total_ms"), ms("comm").alias("comm_ms"))


def epoch_average(times: DataFrame, warmup: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Averages after the warm-up epochs."""
    return times.filter(F.col("epoch_seq") > warmup).groupBy(*keys).agg(F.avg("total_ms").alias("avg_epoch_ms"), F.avg("comm_ms").alias("avg_comm_ms"))


def epoch_window(times: DataFrame, start: int, stop: int) -> DataFrame:
    """Epochs from start to stop, both included."""
    return times.filter(F.col("epoch_seq").between(start, stop))


def fastest_variant(trials: DataFrame) -> DataFrame:
    """(name, idx, variant, ms) trials to each name's variant with the least mean; the first wins ties."""
    mean = trials.groupBy("name", "idx", "variant").agg(F.avg("ms").alias("mean_ms"))
    return mean.groupBy("name").agg(F.min_by("variant", F.struct("mean_ms", "idx")).alias("variant"), F.min("mean_ms").alias("mean_ms"))
