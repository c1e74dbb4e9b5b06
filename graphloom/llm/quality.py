"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets a few ratios. Their quartiles are kept as KLL sketches for every language and source;
sketches merge upwards to the language and to the corpus, and a small group borrows the first level with
enough documents. Fences around the quartiles replace fixed cutoffs, and the verdict is a join with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import Workspace
from graphloom.llm.common import ASCII_SPACE, SPACE, fresh, read

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """A value fails above q3 + spread * (q3 - q1) + slack, or (two-sided) below the mirror of that."""

    spread: float
    slack: float
    both: bool = False


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    sketch_k: int = 400
    min_group: int = 200  #: documents that a group needs for thresholds of its own
    few: int = 10_000  #: thresholds of so many groups are broadcast
    fences: tuple[tuple[str, Fence], ...] = (
        ("symbol_ratio", Fence(3.0, 0.08)),
        ("word_length", Fence(4.0, 1.5, True)),
        ("dup_line_ratio", Fence(3.0, 0.4)),
    )


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated a single time; array functions would repeat it wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(a: Column, k: int) -> Column:
    """Each hash joined with the one k places on."""
    n = F.size(a) - k
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(a, F.lit(k + 1), F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of eight that occur twice or more in the text, the first occurrence included.

    Windows are told apart by 64-bit hashes, built by doubling (1, 2, 4, 8 words). Only a text in which some hash
    repeats goes on to sort its windows; covered words are counted from the gaps between repeated starts.
    """
    if window != 8:
        raise ValueError("windows are built by doubling, for eight words")

    def repeats(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(starts, lambda i: F.get(s, i)["i"]))

    def width(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g)

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        count = _once(_once(tagged, repeats), width)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(count)

    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = lambda two: _once(_doubled(two, 2), lambda four: _once(_doubled(four, 4), covered))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(_once(one, lambda h: _once(_doubled(h, 1), eight)))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: Column) -> Column:
    """A struct of raw measures, from which :func:`metrics_of` makes the metrics; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    none = F.length(F.translate(t, ASCII_SPACE, ""))
    split = F.split(F.btrim(t, F.lit(ASCII_SPACE)), SPACE)
    words = _once(split, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = _once(F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.struct(words.alias("w"), none.alias("c"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("s"), lines.alias("d"))


def metrics_of(m: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    found = (F.when(m["c"] > 0, m["w"]["n"]).otherwise(F.lit(0)), m["c"], m["s"], m["d"], m["w"]["r"])
    return {k: c.cast("long") for k, c in zip(METRICS, found)}


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics."""
    name = fresh("measured", docs.columns)
    return docs.withColumn(name, measure(F.col(f"`{text}`"))).withColumns(metrics_of(F.col(name))).drop(name)


def base_failed(m: dict[str, Column], p: QualityParams) -> Column:
    return (m["n_words"] < p.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * p.repeat_percent)


def ratios(m: dict[str, Column]) -> dict[str, Column]:
    c = {k: v.cast("double") for k, v in m.items()}
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {"symbol_ratio": share(c["n_symbols"], c["word_chars"]), "word_length": share(c["word_chars"], c["n_words"]), "dup_line_ratio": share(c["n_dup_lines"] * 8, c["n_words"])}


def thresholds(metrics: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, fences), one row for each group, from merged sketches; ``metrics`` has lang, source and the metrics.

    ``fences`` is a struct of <ratio>_low and <ratio>_high.
    """
    names = [k for k, _ in p.fences]
    r = ratios({k: F.col(k) for k in METRICS})
    ws = Workspace(metrics.sparkSession, "fences")
    rows = metrics.select("lang", "source", *[r[k].alias(k) for k in names])
    group = ws.cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(k, F.lit(p.sketch_k)).alias(k) for k in names]))
    merged = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, F.lit(p.sketch_k)).alias(k) for k in names])
    lang = merged(group, "lang")
    every = merged(lang)
    tag = lambda df, t: df.select(*[F.col(c).alias(f"{t}_{c}") for c in df.columns])
    j = group.join(tag(lang, "l"), F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(tag(every, "e"))  # one row on the right
    out = []
    for k, f in p.fences:
        sketch = F.when(F.col("n") >= p.min_group, F.col(k)).when(F.col("l_n") >= p.min_group, F.col(f"l_{k}")).otherwise(F.col(f"e_{k}"))
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        reach = (q3 - q1) * f.spread + f.slack
        out += [(q1 - reach if f.both else F.lit(float("-inf"))).alias(f"{k}_low"), (q3 + reach).alias(f"{k}_high")]
    return ws.cut(j.select("lang", "source", F.struct(*out).alias("fences")))


def verdict(m: dict[str, Column], fences: Column, p: QualityParams) -> Column:
    """Kept: the base rules hold and every ratio is inside its fence."""
    ok = ~base_failed(m, p)
    r = ratios(m)
    for k, _ in p.fences:
        ok = ok & r[k].between(fences[f"{k}_low"], fences[f"{k}_high"])
    return ok


def _fenced(rows: DataFrame, measured: str, p: QualityParams) -> tuple[DataFrame, str]:
    """(rows, each with its group's fences; that column's name). Rows meet them by a broadcast if the groups are few, so they
    don't shuffle, else by a join that can be split."""
    t = thresholds(rows.select("lang", "source", *[c.alias(k) for k, c in metrics_of(F.col(measured)).items()]), p)
    names = [fresh(k, [*rows.columns, "lang_", "source_"]) for k in ("group_lang", "group_source", "fences")]
    few = t.count() <= p.few
    t = t.toDF(*names)
    on = F.col("lang").eqNullSafe(F.col(names[0])) & F.col("source").eqNullSafe(F.col(names[1]))
    return rows.join(F.broadcast(t) if few else t, on), names[2]


def judge(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, lang, source, the metrics, base_failed and kept, one row for each row of ``docs``.

    A null text counts as empty and fails for want of words; null languages and sources are groups of their own;
    repeated rows are judged alike; an empty table gives an empty result. Other columns, of whatever name, don't matter.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.cut(docs.select("doc_id", "lang", "source", measure(F.col("text")).alias("measured")))
    m = metrics_of(F.col("measured"))
    rows, fences = _fenced(rows, "measured", p)
    return rows.select("doc_id", "lang", "source", *[c.alias(k) for k, c in m.items()], base_failed(m, p).alias("base_failed"), verdict(m, F.col(fences), p).alias("kept"))


def keep_documents(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names; odd rows fare as in :func:`judge`.

    Texts are measured once: they are written beside their measures, as thresholds must be known before any can be dropped.
    """
    ws = Workspace(docs.sparkSession, "quality")
    name = fresh("measured", docs.columns)
    rows = ws.cut(docs.withColumn(name, measure(F.col("text"))))
    rows, fences = _fenced(rows, name, p)
    return rows.filter(verdict(metrics_of(F.col(name)), F.col(fences), p)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`judge` of all ``documents``; its docstring says what becomes of odd rows."""
    return judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
