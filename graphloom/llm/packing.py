"""Token ids packed into fixed rows by best-fit decreasing.

Each task tokenises its documents and packs them in blocks of bounded size. A document longer than a row
is split into consecutive pieces, so nothing is lost. Pieces go longest first into the row with the least
room that still holds them; a segment tree over the room left finds that row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import read, slices, texts, tidy

SCHEMA = "n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<int>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass(frozen=True)
class PackParams:
    row: int = 2048  #: ids in a row
    end_id: int = 50256  #: closes every document, and fills a row's free end
    block: int = 1 << 21  #: ids packed together; bounds a task's memory
    vocabulary: str = ""  #: path of a tiktoken rank file; the installed byte-level vocabulary if empty

    def __post_init__(self) -> None:
        if not 1 < self.row <= 65536 or not 0 <= self.end_id < 65536:
            raise ValueError("rows and ids are stored in 16 bits")


class Encoder:
    """Byte-level BPE. The public split pattern looks ahead only to treat runs of white space, so texts without
    such runs take a pattern without that, which runs faster and cuts the same pieces."""

    # The public split pattern of this vocabulary, with possessive repeats, and the same without the look-ahead.
    FULL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

    def __init__(self, path: str = "") -> None:
        import tiktoken

        with open(path or default_vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full, plain = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", self.FULL), ("plain", self.PLAIN)))
        self._full, self._plain, self.decode, self.piece = full.encode_ordinary, plain.encode_ordinary, full.decode, full.decode_single_token_bytes
        self._run = re.compile(r"\s\s").search

    def __call__(self, text: str) -> list[int]:
        return self._full(text) if self._run(text) else self._plain(text)


class Room:
    """Rows by the room they have left: a segment tree over 0..capacity answers "least room >= n" in log time."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k, count = room + self.base, self.count
        while k:
            count[k] += 1
            k >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with room for n, removed; None if there is none."""
        k, count = n + self.base, self.count
        if not count[k]:
            while True:  # up until a right sibling has rows
                if k == 1:
                    return None
                if not k & 1 and count[k + 1]:
                    k += 1
                    break
                k >>= 1
            while k < self.base:
                k <<= 1
                if not count[k]:
                    k += 1
        room = k - self.base
        row = self.rows[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row; every length is in 1..capacity. Equal lengths keep their order."""
    rows: list[list[int]] = []
    room = Room(capacity)
    sizes = lengths.tolist()
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[k]
        found = room.take(n)
        if found is None:
            left, row = capacity, len(rows)
            rows.append([])
        else:
            left, row = found
        rows[row].append(k)
        if left > n:
            room.add(left - n, row)
    return rows


def pack_block(ids: list[np.ndarray], doc_ids: list, p: PackParams) -> pa.RecordBatch:
    """The rows of one block: ids padded to the row length, segment bounds, positions that restart in each segment.

    ``starts`` is a segment's first position in its document, so a document's pieces join up again.
    """
    piece = [(k, s) for k, x in enumerate(ids) for s in range(0, len(x), p.row)]
    lengths = np.array([min(p.row, len(ids[k]) - s) for k, s in piece], dtype=np.int64)
    rows = best_fit_decreasing(lengths, p.row)
    matrix = np.full((len(rows), p.row), p.end_id, dtype="<u2")
    place = np.zeros((len(rows), p.row), dtype="<u2")
    line = np.arange(p.row, dtype="<u2")
    bounds, owners, starts, used = [], [], [], []
    for r, members in enumerate(rows):
        at, cu = 0, [0]
        for m in members:
            k, s = piece[m]
            n = int(lengths[m])
            matrix[r, at : at + n] = ids[k][s : s + n]
            place[r, at : at + n] = line[:n]
            at += n
            cu.append(at)
        bounds.append(cu)
        used.append(at)
        owners.append([doc_ids[piece[m][0]] for m in members])
        starts.append([piece[m][1] for m in members])
    binary = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
    cols = [pa.array(used, pa.int32()), pa.array([len(m) for m in rows], pa.int32()), binary(matrix), pa.array(bounds, pa.list_(pa.int32())), binary(place), pa.array(owners, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, p: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of all documents: every id of every document is in exactly one row.

    A null or empty text is the end id alone. A null document id stays null in ``doc_ids``. Repeated rows are packed
    as often as they occur. An empty table gives no rows. Which documents share a row depends on the partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(p.vocabulary)
        ids: list[np.ndarray] = []
        owners: list = []
        total = 0
        for b in batches:
            for part in slices(b, 1):
                for owner, t in zip(part.column(0).to_pylist(), texts(part.column(1))):
                    got = encode(t)
                    got.append(p.end_id)
                    ids.append(np.array(got, dtype="<u2"))
                    owners.append(owner)
                    total += len(got)
                    if total >= p.block:
                        yield from _pieces(pack_block(ids, owners, p))
                        ids, owners, total = [], [], 0
        if ids:
            yield from _pieces(pack_block(ids, owners, p))
        del encode, ids, owners
        tidy()

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA)


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def write_packed(packed: DataFrame, uri: str, row: int = 2048) -> DataFrame:
    """Binary shards below ``uri`` (any file system that Arrow knows), and their manifest (path, rows, tokens).

    For each task: ``.ids`` and ``.pos`` are little-endian 16-bit matrices of ``row`` columns, ``.seg`` holds per row a 32-bit
    count followed by the cumulative lengths. A task writes under a name of its own attempt, so a retry never touches
    a file in use, and only the manifest's shards count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path, recursive=True)
        stem, rows, tokens = f"{path}/shard-{uuid.uuid4().hex}", 0, 0
        with where.open_output_stream(f"{stem}.ids") as a, where.open_output_stream(f"{stem}.pos") as c, where.open_output_stream(f"{stem}.seg") as s:
            for b in batches:
                d = b.to_pydict()
                for n, x, y, cu in zip(d["n_tokens"], d["input_ids"], d["position_ids"], d["cu_seqlens"]):
                    a.write(x)
                    c.write(y)
                    s.write(np.array([len(cu), *cu], dtype="<i4").tobytes())
                    rows, tokens = rows + 1, tokens + n
        yield pa.RecordBatch.from_pydict({"path": [stem], "n_rows": pa.array([rows], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return packed.mapInArrow(run, "path string, n_rows long, n_tokens long")


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
