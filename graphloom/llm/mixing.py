"""Mixing sources to target weights by Pareto order sampling (Rosen 1997).

Every source has a target in words. A document is first allocated the whole copies that the source's
ratio of target to size makes certain. What remains is a fixed-size sample, with the size counted in
words: inclusion odds follow a document's size (capped at certainty), documents are ranked by random
odds divided by inclusion odds, and the smallest ranks are taken up to the remaining words. Later rounds
spend what the first document past the cut would have overshot, in the same order, on documents that fit.

The whole decision boils down to a few numbers for each source, so it applies to a document on its own, and the answer is
the same for any partitioning. Rows that agree in id, source and text are counted and numbered, so that each draws a random
number of its own. Where a cut falls is found from sums over ever finer slices of the order, so no task sorts a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.lineage import Workspace
from graphloom.llm.common import WORD, fresh, read


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  #: given to the sources in order of name, repeating
    max_copies: int = 3
    seed: int = 17
    rounds: int = 4  #: cuts in Pareto order; each spends what the one before left over
    slices: int = 4096  #: a power of two; a source's order is cut in so many, and the slice that holds the cut again
    levels: int = 2  #: times over; what is left after that is sorted
    few: int = 10_000  #: a table of so many sources is broadcast
    run: int = 1000  #: repeats of a row that one task unfolds
    bins: int = 8  #: size classes for each doubling, from which the inclusion odds are solved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, idx, source_size, target), one row for each source; a missing name is a source of its own, the last.

    Targets fill like water: a source stops at ``max_copies`` times its size, and the others rise by weight
    until all words are shared. Sorted by the level at which each one stops, that is one running sum.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("idx", F.row_number().over(order) - 1)
    t = named.withColumn("weight", F.get(weights, F.col("idx") % len(p.weights))).withColumn("cap", F.col("source_size") * float(p.max_copies))
    level = Window.orderBy("stop", "idx")
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("stop", F.col("cap") / F.col("weight")).withColumns({"total": F.sum("source_size").over(every), "all_w": F.sum("weight").over(every)})
    full = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("water", (F.col("total") - full) / (F.col("all_w") - gone))  # the level if this source and all later ones don't stop
    holds = F.col("water") <= F.col("stop")
    reached = F.min_by(F.when(holds, F.col("water")), F.when(holds, F.struct("stop", "idx"))).over(every)
    return t.select("source", "idx", "source_size", F.when(F.col("source_size") > 0, F.least("cap", reached * F.col("weight"))).otherwise(F.lit(0.0)).alias("target"))


def _plan(targets: DataFrame) -> DataFrame:
    """Whole copies for all documents of a source, and the words left for the sample."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12)
    return targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))


def _odds_scale(sizes: DataFrame, plan: DataFrame, p: MixParams) -> DataFrame:
    """kappa for each source: inclusion min(1, kappa * size) makes the expected sample ``rest`` words.

    Solved on size classes: with the classes above one certain, kappa = (rest - their words) / (squares below);
    the largest class with kappa * (its largest size) <= 1 is right. The lowest class beyond that holds the border of
    certainty, so it is solved once more size by size, which makes kappa exact.
    """
    rows = sizes.filter("size > 0").select("idx", "size", F.floor(F.log2("size") * p.bins).alias("b"))
    border = _classes(rows, plan, "b").filter(F.col("kappa") * F.col("top") > 1).groupBy("idx").agg(F.min("b").alias("border"))
    fine = rows.join(border, "idx", "left").withColumn("one", F.when(F.col("b") == F.col("border"), F.col("size")))
    k = _classes(fine, plan, "b", "one")
    fits = (F.col("kappa") >= 0) & (F.col("kappa") * F.col("top") <= 1 + 1e-9)
    return k.groupBy("idx").agg(F.coalesce(F.max_by(F.when(fits, F.col("kappa")), F.when(fits, F.col("top"))), F.lit(0.0)).alias("kappa"))


def _classes(rows: DataFrame, plan: DataFrame, *by: str) -> DataFrame:
    """For each class its largest size, and kappa if the classes above it are certain."""
    classes = rows.groupBy("idx", *by).agg(F.sum("size").alias("s"), F.sum(F.col("size").cast("double") * F.col("size")).alias("s2"), F.max("size").alias("top"))
    down, up = Window.partitionBy("idx").orderBy(F.col("top").desc()), Window.partitionBy("idx").orderBy("top")
    above = F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("s2").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return classes.withColumns({"above": above, "below": below}).join(plan.select("idx", "rest"), "idx").withColumn("kappa", (F.col("rest") - F.col("above")) / F.col("below"))


def pareto_key(size: Column, kappa: Column, seed: int, *of: Column) -> Column:
    """Random odds, drawn by ``of``, over inclusion odds, as q/(1+q) in [0, 1); certain documents get 0."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double")
    u = (bits + 0.5) / float(1 << 53)
    lam = F.least(kappa * size, F.lit(1.0))
    return F.when(lam >= 1, F.lit(0.0)).otherwise(u * (1 - lam) / (u * (1 - lam) + lam * (1 - u)))


def _picked(rounds: Column, key: Column, size: Column) -> Column:
    """Whether a document is in the sample: the cut of any round lets it in and it fits that round's words."""
    return F.exists(rounds, lambda r: (size > 0) & (size <= r["left"]) & ((key <= r["cut"]) | (key < r["low"])))


def _unfold(groups: DataFrame, times: str, number: str, run: int) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1. Long runs are dealt out before they unfold."""
    part = fresh("part", [*groups.columns, number])
    least = (F.col(part) * run + 1, F.least(F.col(times), (F.col(part) + 1) * run))
    short = groups.filter(F.col(times).between(1, run)).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    long = groups.filter(F.col(times) > run).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / run))))
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = long.repartition(n, F.xxhash64(*groups.columns, part)).withColumn(number, F.explode(F.sequence(*least))).drop(part)
    return short.unionByName(long)


def _meet(rows: DataFrame, table: DataFrame, few: bool, on) -> DataFrame:
    """Rows with what their source's row of ``table`` holds: broadcast if its sources are few, else by a join that can be split."""
    return rows.join(F.broadcast(table) if few else table, on)


def _few(table: DataFrame, few: bool) -> DataFrame:
    """A table of a row for each source, in few parts if the sources are few."""
    return table.coalesce(8) if few else table


@dataclass(frozen=True)
class Mix:
    """What was decided: units (doc_id, source, size, h, i, idx, key) for each row; sources (source, idx, source_size, target, whole, rest, kappa, rounds)."""

    units: DataFrame
    sources: DataFrame
    few: bool


def decide(docs: DataFrame, p: MixParams = MixParams(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Mix:
    ws = Workspace(docs.sparkSession, "mixing")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("h"))
    groups = ws.cut(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")))
    targets = ws.cut(_plan(source_targets(groups.select("source", (F.col("size") * F.col("m")).alias("size")), p)))
    few = targets.count() <= p.few
    units = _unfold(groups, "m", "i", p.run).drop("m")
    named = targets.select(F.col("source").alias("s"), "idx")
    units = ws.cut(_meet(units, named, few, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    kappas = _odds_scale(units, targets, p)
    per_source = ws.cut(targets.join(kappas, "idx", "left").withColumn("kappa", F.coalesce("kappa", F.lit(0.0))))
    key = pareto_key(F.col("size"), F.col("kappa"), p.seed, F.col("doc_id"), F.col("h"), F.col("i"))
    keyed = ws.cut(_meet(units, per_source.select("idx", "kappa"), few, "idx").withColumn("key", key).drop("kappa"))
    ws.drop(groups, units)
    state = per_source.select("idx", F.col("rest").alias("left"), F.expr("CAST(array() AS array<struct<`left`: bigint, `cut`: double, `low`: double>>)").alias("rounds"))
    for _ in range(p.rounds):
        state = _cut_once(keyed, ws.cut(_few(state, few)), few, p, ws)
    return Mix(keyed, ws.cut(_few(per_source.join(state.select("idx", "rounds"), "idx"), few)), few)


def _cut_once(keyed: DataFrame, state: DataFrame, few: bool, p: MixParams, ws: Workspace) -> DataFrame:
    """The largest key at which all candidates up to it (equal keys together) still fit the words left."""
    free = _meet(keyed, state, few, "idx").filter((F.col("size") > 0) & (F.col("size") <= F.col("left")) & ~_picked(F.col("rounds"), F.col("key"), F.col("size")))
    free = free.select("idx", "key", "size", "left")
    none = F.lit(0).cast("long")
    # Slice by slice: ``low`` is where the slice with the cut begins, ``base`` the words before it. Certain documents come first.
    certain = free.filter("key = 0").groupBy("idx").agg(F.sum("size").alias("base"))
    at = state.select("idx", F.col("left").alias("room")).join(certain, "idx", "left").select("idx", "room", F.lit(0.0).alias("low"), F.coalesce("base", none).alias("base"))
    at = ws.cut(_few(at.filter("base <= room"), few))
    wide = 1.0
    upto = Window.partitionBy("idx").orderBy("slice")
    for _ in range(p.levels):
        inside = _meet(free, at, few, "idx").filter((F.col("key") > 0) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + wide))
        wide /= p.slices
        sums = inside.groupBy("idx", "room", "base", F.floor((F.col("key") - F.col("low")) / wide).alias("slice")).agg(F.sum("size").alias("s"))
        sums = sums.withColumn("before", F.sum("s").over(upto) - F.col("s"))
        over = F.col("base") + F.col("before") + F.col("s") > F.col("room")
        found = at.join(sums.groupBy("idx").agg(F.min(F.when(over, F.struct("slice", "before"))).alias("f"), F.sum("s").alias("all")), "idx", "left")
        past = F.when(F.col("f").isNotNull(), F.col("f.slice")).when(F.col("all").isNotNull(), F.lit(p.slices)).otherwise(F.lit(0))
        found = found.select("idx", "room", (F.col("low") + past * wide).alias("low"), (F.col("base") + F.coalesce("f.before", "all", none)).alias("base"))
        at, old = ws.cut(_few(found, few)), at
        ws.drop(old)
    inside = _meet(free, at, few, "idx").filter((F.col("key") > 0) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + wide))
    total = F.col("base") + F.sum("size").over(Window.partitionBy("idx").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("total", total).filter("total <= room").groupBy("idx").agg(F.max("total").alias("used"), F.max("key").alias("cut"))
    got = at.join(last, "idx", "left").select("idx", F.coalesce("used", "base").alias("used"), F.coalesce("cut", F.lit(0.0)).alias("cut"), "low")
    grown = F.when(F.col("low").isNotNull(), F.concat("rounds", F.array(F.struct("left", "cut", "low")))).otherwise(F.col("rounds"))
    return state.join(got, "idx", "left").select("idx", (F.col("left") - F.coalesce("used", none)).alias("left"), grown.alias("rounds"))


def _copies(size: Column, key: Column) -> Column:
    """How often a row is taken, from its source's numbers."""
    return F.when(size > 0, F.col("whole") + F.when(_picked(F.col("rounds"), key, size), 1).otherwise(0)).otherwise(F.lit(0)).cast("long")


def mix_report(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row.

    Null text has size 0 and is never taken, as is an empty one. A null source is a source of its own, the last. Rows with
    null or equal ids draw numbers of their own, by their text and, where that is equal too, by their count. An empty table
    gives an empty result. Other columns, of whatever name, don't matter.
    """
    mix = decide(docs, p)
    rows = _meet(mix.units, mix.sources.drop("source"), mix.few, "idx").withColumn("copies", _copies(F.col("size"), F.col("key")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus: every document as often as it was taken, with the input's own columns.

    The sources' numbers meet the documents by source, so texts don't shuffle by id. Odd rows are treated as in
    :func:`mix_report`; of rows that agree in id, source and text, one stands for all and occurs as often as all were taken.
    """
    mix = decide(docs, p)
    ws = Workspace(docs.sparkSession, "mixed")
    own = [F.col(f"`{c}`") for c in docs.columns]
    row, part = fresh("row", docs.columns), fresh("part", docs.columns)
    same = ["doc_id", "source", "size", "h"]
    counted = _meet(mix.units.filter("size > 0"), mix.sources.drop("source"), mix.few, "idx").withColumn("copies", _copies(F.col("size"), F.col("key")))
    repeated = ws.cut(counted.groupBy(*same).agg(F.count("*").alias("m"), F.sum("copies").alias("copies")).filter("m > 1").drop("m"))
    facts = mix.sources.select(F.col("source").alias("s"), "whole", "kappa", "rounds")
    rows = docs.select(F.struct(*own).alias(row), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h")).filter("size > 0")
    many = repeated.limit(1).count() > 0
    single = rows
    if many:
        alike = [rows[c].eqNullSafe(repeated[c]) for c in same]
        single = rows.join(repeated, alike, "left_anti")
    single = _meet(single, facts, mix.few, F.col("source").eqNullSafe(F.col("s")))
    key = pareto_key(F.col("size"), F.col("kappa"), p.seed, F.col("doc_id"), F.col("h"), F.lit(1).cast("long"))
    taken = single.withColumn("copies", _copies(F.col("size"), key)).select(row, "copies")
    out = taken.filter("copies > 0").withColumn(part, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(f"{row}.*")
    if many:
        once = rows.join(repeated, alike, "left_semi").groupBy(*same).agg(F.min(row).alias(row)).alias("a")
        met = once.join(repeated.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]).select(F.col(f"a.{row}").alias(row), "copies")
        out = out.unionByName(_unfold(met, "copies", part, p.run).select(f"{row}.*"))
    return out


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mix_report` of all ``documents``; its docstring says what becomes of odd rows."""
    r = mix_report(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return r.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
