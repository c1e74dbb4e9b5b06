"""Licence scans: ordered signature rules behind a keyword filter.

Texts become lower-case words. A text without any keyword is done. Otherwise the rules of its keywords run over the
words joined by blanks, and their places, as word intervals, compete: higher priority first, then the longer one, then
the rule written first; a place contained in one already accepted is suppressed. Base rules are counted before that.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import lowered, map_batches, read
from graphloom.llm.license_rules import RULES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, first: long, last: long, priority: int>>"


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    base: bool
    keyword: str
    label: str
    regex: re.Pattern


@dataclass(frozen=True)
class Place:
    start: int
    stop: int
    rule: Rule


@lru_cache(maxsize=1)
def rules() -> dict[str, tuple[Rule, ...]]:
    """The rules by keyword, in the order written; a rule with several keywords stands under each."""
    found: dict[str, list[Rule]] = {}
    for k, line in enumerate(x for x in RULES.splitlines() if x.strip()):
        priority, keywords, label, regex = (x.strip() for x in line.split("|", 3))
        compiled = re.compile(rf"(?<![^ ])(?:{regex})(?![^ ])")
        for keyword in keywords.split("/"):
            found.setdefault(keyword, []).append(Rule(k, int(priority.rstrip("!")), priority.endswith("!"), keyword, label, compiled))
    return {k: tuple(v) for k, v in found.items()}


class Cover:
    """The furthest end of accepted intervals that start at or before a point: a Fenwick tree of maxima."""

    def __init__(self, n: int) -> None:
        self.best = [0] * (n + 1)

    def add(self, start: int, stop: int) -> None:
        k = start + 1
        while k < len(self.best):
            if self.best[k] < stop:
                self.best[k] = stop
            k += k & -k

    def reach(self, start: int) -> int:
        k, most = start + 1, 0
        while k:
            most = max(most, self.best[k])
            k &= k - 1
        return most


def suppress(places: list[Place]) -> list[Place]:
    """The places that no stronger accepted place contains, by start. n log n in the number of places."""
    at = {s: k for k, s in enumerate(sorted({p.start for p in places}))}
    cover, kept = Cover(len(at)), []
    for p in sorted(places, key=lambda p: (-p.rule.priority, p.start - p.stop, p.start, p.rule.order)):
        if cover.reach(at[p.start]) < p.stop:
            cover.add(at[p.start], p.stop)
            kept.append(p)
    return sorted(kept, key=lambda p: (p.start, p.stop, p.rule.order))


def places(words: list[str], by_keyword: dict[str, tuple[Rule, ...]]) -> list[Place]:
    """All places of the rules whose keyword is among the words."""
    present = by_keyword.keys() & set(words)
    if not present:
        return []
    line = " ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    out = []
    for _, rule in sorted({r.order: r for k in present for r in by_keyword[k]}.items()):
        for m in rule.regex.finditer(line):
            out.append(Place(bisect_left(starts, m.start()), bisect_left(starts, m.end()), rule))
    return out


def scan(text: str) -> tuple:
    """A row without its id; ``text`` is lower-case."""
    words = WORDS(text)
    by_keyword = rules()
    if by_keyword.keys().isdisjoint(words):
        return len(words), 0, None, None, "", "", 0.0, []
    found = places(words, by_keyword)
    base = [p for p in found if p.rule.base]
    kept = suppress(found)
    named = {p.rule.label for p in base}
    labels = named | {p.rule.label for p in kept}
    score = max((p.rule.priority for p in kept), default=0) / 9
    detections = [{"label": p.rule.label, "first": p.start, "last": p.stop - 1, "priority": p.rule.priority} for p in kept]
    first, last = (min(p.start for p in base), max(p.start for p in base)) if base else (None, None)
    return len(words), len(base), first, last, ",".join(sorted(named)), ",".join(sorted(labels)), score, detections


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``. A null or empty text has no words and no labels; labels are '' then, and
    first_word and last_word null. Repeated rows repeat. ``score`` is the strongest detection's priority over 9."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32())]))]
    names = [x.split()[0] for x in SCHEMA.split(", ")[:9]]

    def make():
        def each(b: pa.RecordBatch):
            cols = zip(*map(scan, lowered(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

        return each

    return map_batches(docs.select(doc_id, text), SCHEMA, make, text)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
