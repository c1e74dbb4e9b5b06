"""What the operators share: word rules, Arrow helpers, batch bounds."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def lowered(column: pa.Array) -> list[str]:
    """Texts with A-Z lowered and nothing else changed; null is empty."""
    return pc.ascii_lower(pc.fill_null(column, "")).to_pylist()


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def words_of(text: str) -> list[str]:
    """Words between the six ASCII white-space characters; other white space is part of a word.

    ``str.split()`` also cuts at the control characters 0x1c-0x1f and at Unicode spaces, so it serves only texts without them.
    """
    if text.isascii() and not _odd_ascii(text):
        return text.split()
    return _FIND(text)


def _odd_ascii(text: str) -> bool:
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


_FIND = re.compile(WORD).findall


def slices(batch: pa.RecordBatch, text_index: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ``limit`` bytes of text (one text at least), which bounds what Python holds at once."""
    col = batch.column(text_index)
    if col.nbytes <= limit or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    yield batch.slice(start)


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, or the like, that none of ``columns`` has; Spark doesn't tell names apart by case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
_MALLOPT = getattr(ctypes.CDLL(None), "mallopt", None)


def tidy() -> None:
    """Hand memory that is no longer used back to the system. Python workers outlive their tasks, and idle ones would else
    hold on to the most that any task needed, beside the workers and the JVM of the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def keep_heap() -> None:
    """Let this process keep up to 64 MB of freed memory between array operations. Else glibc returns arrays of over 128 KB to
    the system at once, and a loop over mid-sized arrays spends as long on page faults as on numbers. :func:`tidy` gives it back."""
    if _MALLOPT:
        _MALLOPT(-3, 32 << 20)  # M_MMAP_THRESHOLD, at its largest
        _MALLOPT(-1, 64 << 20)  # M_TRIM_THRESHOLD


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], text: str | None = None, limit: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once for each task and returns what maps a batch."""
    index = df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            for part in slices(b, index, limit) if index is not None else [b]:
                yield from each(part)
        del each
        tidy()

    return df.mapInArrow(run, schema)
