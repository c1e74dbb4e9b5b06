"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages and document windows are TF-IDF vectors over the benchmark's terms. Document frequencies come from
all documents. Terms fall in two spaces, the rarer ones and the common ones, so that a copy that keeps little but common
words isn't outweighed by the rare ones that it lost. In each space a randomised SVD of the passages and of all windows
of all documents, whose products run on the executors, gives latent vectors; every window of every document is compared
with every passage there by cosine. Candidates are then settled on the words: the longest common subsequence with the
passage, and for near misses its rarest words, the answer terms. Words are runs of letters and digits in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import Workspace
from graphloom.llm.common import keep_heap, read, slices, tidy
from graphloom.llm.shingles import Lookup, word_hashes


@dataclass(frozen=True)
class DecontamParams:
    passage: int = 64  #: words of a benchmark passage at most; longer items are cut in passages
    block: int = 16  #: windows start at multiples of this
    rank: int = 96  #: latent dimensions of the rarer terms
    common_rank: int = 48  #: latent dimensions of the common terms
    extra: int = 16  #: additional random directions of the SVD
    powers: int = 1  #: extra power iterations
    weight: float = 0.01  #: a passage counts in the SVD as so many windows for each document, 30 at least
    common: float = 0.05  #: terms in more than this share of documents are common
    cosine: float = 0.45  #: candidates reach this in the space of the rarer terms
    common_cosine: float = 0.6  #: or this in the space of the common ones, if those make up near_share of the passage
    share: float = 0.6  #: of a passage's words in common order: contaminated
    near_share: float = 0.4  #: enough if the answer terms are there too
    answers: int = 4  #: rarest terms of a passage that count as its answer
    items: int = 4096  #: passages compared in one pass; more make more passes


STEP = 1 << 20  #: bytes of text that are compared at once


@dataclass(frozen=True)
class Bench:
    """The passages of one pass: owners, words as term numbers, windows (in blocks) that each one needs, hashes of the terms."""

    item: np.ndarray
    words: list[np.ndarray]
    blocks: np.ndarray
    terms: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], p: DecontamParams) -> Bench:
        hashes, at = word_hashes(pa.array([t for _, t in rows], pa.large_string()), punctuation=False)
        terms, numbers = np.unique(hashes, return_inverse=True)
        owner, words, blocks = [], [], []
        for (item, _), a, b in zip(rows, at.tolist(), at[1:].tolist()):
            parts = max(1, -(-(b - a) // p.passage))
            size = max(1, -(-(b - a) // parts))
            for k in range(a, b, size):
                part = numbers[k : min(b, k + size)]
                words.append(part)
                owner.append(item)
                blocks.append(-(-len(part) // p.block) + 1)  # a passage that starts anywhere in a block is whole in so many
        return cls(np.array(owner, dtype=np.int64), words, np.array(blocks), terms)


def coded(docs: DataFrame, bench: Bench, p: DecontamParams) -> DataFrame:
    """(counts, ids) of every document: its words that are terms, as 32-bit numbers, and how many each window of three blocks holds, in 16 bits."""
    terms, span = bench.terms, p.block * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Lookup(terms)
        for b in batches:
            for part in slices(b, 0, STEP):
                hashes, at = word_hashes(part.column(0), punctuation=False)
                ids, words = number(hashes), np.diff(at)
                windows = np.r_[0, np.cumsum(-(-words // span))]
                known = np.flatnonzero(ids >= 0)
                place = known - np.repeat(at[:-1], words)[known]
                counts = np.bincount(np.repeat(windows[:-1], words)[known] + place // span, minlength=int(windows[-1]))
                yield pa.RecordBatch.from_arrays([_binary(counts.astype("<u2"), windows), _binary(ids[known].astype("<i4"), np.searchsorted(known, at))], ["counts", "ids"])
        tidy()

    return docs.select("text").mapInArrow(run, "counts binary, ids binary")


def _binary(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of the numbers between offsets, a value each."""
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * numbers.itemsize).astype(np.int64)), pa.py_buffer(numbers)])
    return wide.cast(pa.binary())


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all values, offsets of each value's): :func:`_binary` undone."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.copy().view(kind), (o - o[0]) // np.dtype(kind).itemsize


def document_frequency(codes: DataFrame, bench: Bench) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over all documents."""
    width = len(bench.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width + 1, np.int64)
        for b in batches:
            for part in slices(b, 0, STEP):
                ids, at = _numbers(part.column(0), "<i4")
                once = np.unique(np.repeat(np.arange(part.num_rows), np.diff(at)) * width + ids)
                seen[1:] += np.bincount(once % width, minlength=width)
                seen[0] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(seen)], ["k", "n"])
        tidy()

    got = codes.select("ids").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # one row for each benchmark term
    out = np.zeros(width + 1, np.int64)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out[1:], int(out[0])


def weigh(df: np.ndarray, n: int, p: DecontamParams) -> list[np.ndarray]:
    """Weights of the terms in the space of the rarer ones and in that of the common ones."""
    rare = df <= max(p.common * n, 3)
    idf = np.log((n + 1) / (df + 1))
    return [np.where(rare, idf + 1, 0), np.where(rare, 0, idf + 0.1)]


def block_rows(ids: np.ndarray, idf: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, term) of every weighing word."""
    at = np.flatnonzero(idf[ids] > 0) if len(ids) and ids.min() >= 0 else np.flatnonzero((ids >= 0) & (idf[ids] > 0))
    return at // block, ids[at]


def gram_products(codes: DataFrame, bench: Bench, idfs: list[np.ndarray], bases: list[np.ndarray], times: float) -> list[np.ndarray]:
    """(A'A) . basis for each space, where the rows of A are the windows of all documents and, ``times`` over, the benchmark
    passages; partial sums on the executors."""
    width = len(bench.terms)
    weighted = [(idf[:, None] * basis).astype(np.float32) for idf, basis in zip(idfs, bases)]
    edges = np.r_[0, np.cumsum([b.shape[1] for b in bases])]
    k, rows_each = int(edges[-1]), 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        out = np.zeros((width, k))
        for b in batches:
            for part in slices(b, 1, STEP):
                counts, _ = _numbers(part.column(0), "<u2")
                cols, _ = _numbers(part.column(1), "<i4")
                rows = np.repeat(np.arange(len(counts)), counts)
                for s, (idf, w) in enumerate(zip(idfs, weighted)):
                    weighs = idf[cols] > 0
                    _add(out[:, edges[s] : edges[s + 1]], rows[weighs], cols[weighs], idf, w)
        starts = np.arange(0, width, rows_each)
        parts = [(a, out[a : a + rows_each].astype(np.float32)) for a in starts.tolist()]
        parts = [(a, x.tobytes()) for a, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["t", "v"])
        del out, parts
        tidy()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, np.float32) for v in pdf["v"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"t": pdf["t"].iloc[:1], "v": [total.tobytes()]})

    sums = codes.mapInArrow(run, "t long, v binary").groupBy("t").applyInPandas(add, "t long, v binary")
    total = np.zeros((width, k))
    for r in sums.collect():  # benchmark terms x directions, 16 terms a row
        block = np.frombuffer(r["v"]).reshape(-1, k)
        total[r["t"] : r["t"] + len(block)] = block
    out = [total[:, a:b] for a, b in zip(edges, edges[1:])]
    cols = np.concatenate(bench.words)
    rows = np.repeat(np.arange(len(bench.words)), [len(w) for w in bench.words])
    for idf, w, own in zip(idfs, weighted, out):
        weighs = idf[cols] > 0
        _add(own, rows[weighs], cols[weighs], idf, w, times)
    return out


PIECE = 1 << 15  #: words whose products are taken at once


def _add(out: np.ndarray, rows: np.ndarray, cols: np.ndarray, idf: np.ndarray, weighted: np.ndarray, times: float = 1.0) -> None:
    """out += times * A' (A basis) for unit-length rows of A given by (row, term) pairs, in order of rows."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    squares, used = idf**2, np.flatnonzero(idf > 0)
    place = np.cumsum(idf > 0) - 1
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        first, last = starts[at], starts[to] if to < len(starts) else len(rows)
        term, begin = cols[first:last], starts[at:to] - first
        owner = np.repeat(np.arange(to - at), np.diff(np.r_[begin, len(term)]))
        norm = np.add.reduceat(squares[term], begin)[:, None].astype(np.float32)
        if (to - at) * len(used) <= 32 * len(term):  # few terms: dense products are quicker
            dense = np.bincount(owner * len(used) + place[term], minlength=(to - at) * len(used)).reshape(to - at, len(used)).astype(np.float32)
            here, sums = used, dense.T @ (dense @ weighted[used] / norm)
        else:
            image = _sums(weighted, term, begin) / norm
            order = np.argsort(term, kind="stable")
            run = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0])
            here, sums = term[order][run], _sums(image, owner[order], run)
        out[here] += times * idf[here][:, None] * sums
        at = to


def _sums(table: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``table[at]`` over the runs that begin at ``starts``: the first of each run, then the second, and so on."""
    length = np.diff(np.r_[starts, len(at)])
    order = np.argsort(-length, kind="stable")
    begin, less = starts[order], -length[order]
    sums = np.take(table, at[begin], axis=0)
    many = int(np.searchsorted(less, -64))  # longer runs are summed one by one
    for k in range(many):
        sums[k] = np.take(table, at[begin[k] : begin[k] - less[k]], axis=0).sum(axis=0)
    for j in range(1, int(-less[many]) if many < len(less) else 0):
        to = int(np.searchsorted(less, -j))  # those with more than j
        sums[many:to] += np.take(table, at[begin[many:to] + j], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def latent_bases(codes: DataFrame, bench: Bench, idfs: list[np.ndarray], times: float, p: DecontamParams) -> list[np.ndarray]:
    """Leading right singular vectors (terms x rank) of each space by randomised subspace iteration (Halko, Martinsson, Tropp 2011)."""
    width, rng = len(bench.terms), np.random.default_rng(5)
    ranks = [p.rank, p.common_rank]
    bases = [np.linalg.qr(rng.standard_normal((width, min(r + p.extra, width))))[0] for r in ranks]
    for _ in range(p.powers):
        bases = [np.linalg.qr(x)[0] for x in gram_products(codes, bench, idfs, bases, times)]
    out = []
    for basis, image, rank in zip(bases, gram_products(codes, bench, idfs, bases, times), ranks):
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        out.append(basis @ vectors[:, np.argsort(-values)[:rank]])
    return out


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of ``a`` (Hyyro 2004)."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _places(words: np.ndarray, answer: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.uint64]]:
    """(terms, bits of the places where each stands, those of the answer) for every 52 words of a passage: so many bits a float64 sums exactly."""
    out = []
    for k in range(0, len(words), 52):
        terms, which = np.unique(words[k : k + 52], return_inverse=True)
        bits = np.zeros(len(terms), np.uint64)
        np.bitwise_or.at(bits, which, np.uint64(1) << np.arange(len(which), dtype=np.uint64))
        out.append((terms, bits, np.bitwise_or.reduce(bits[np.isin(terms, answer)])))
    return out


class Space:
    """The latent vectors of terms and passages in one space."""

    def __init__(self, bench: Bench, members: np.ndarray, idf: np.ndarray, basis: np.ndarray, cosine: float) -> None:
        self.idf, self.cosine = idf, cosine
        self.vectors = (idf[:, None] * basis).astype(np.float32)
        latent = np.array([self.vectors[bench.words[m]].sum(axis=0) for m in members], dtype=np.float32).reshape(len(members), basis.shape[1])
        norm = np.linalg.norm(latent, axis=1)
        self.members, self.latent = members[norm > 0], latent[norm > 0] / norm[norm > 0, None]
        self.sets = [(int(b), np.flatnonzero(bench.blocks[self.members] == b)) for b in np.unique(bench.blocks[self.members])]

    def candidates(self, ids: np.ndarray, block: int, room: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(blocks of a window, first blocks, passages, cosines) of windows that reach the cosine."""
        rows, cols = block_rows(ids, self.idf, block)
        if not len(rows) or not len(self.members):
            return
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        used = rows[starts]
        sums = np.zeros((len(ids) // block + room, self.vectors.shape[1]), np.float32)
        sums[used] = _sums(self.vectors, cols, starts)
        most = self.sets[-1][0]
        mark = np.zeros(len(sums), bool)
        for k in range(most):
            mark[used - k] = True
        begin = np.flatnonzero(mark)
        window, done = np.zeros((len(begin), sums.shape[1]), np.float32), 0
        for size, of in self.sets:  # ascending, so each adds to the one before
            for k in range(done, size):
                window += sums[begin + k]
            done = size
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            near = window @ self.latent[of].T
            w, m = np.divmod(np.flatnonzero(near >= (self.cosine * np.where(norm > 1e-6, norm, np.inf))[:, None]), len(of))
            yield size, begin[w], self.members[of[m]], near[w, m] / norm[w]


class Search:
    """All passages of a pass against the windows of many documents at once."""

    def __init__(self, bench: Bench, idfs: list[np.ndarray], bases: list[np.ndarray], p: DecontamParams) -> None:
        self.bench, self.p, self.number = bench, p, Lookup(bench.terms)
        every = np.array([m for m, w in enumerate(bench.words) if len(w)], dtype=np.int64)
        # A passage with so many common words that a copy may keep only those is compared in their space too.
        plain = np.array([m for m in every if (idfs[0][bench.words[m]] == 0).sum() >= p.near_share * len(bench.words[m])], dtype=np.int64)
        self.spaces = [Space(bench, every, idfs[0], bases[0], p.cosine), Space(bench, plain, idfs[1], bases[1], p.common_cosine)]
        self.lists = [w.tolist() for w in bench.words]
        self.answers = [set(w[np.argsort(-(idfs[0] + idfs[1])[w], kind="stable")[: p.answers]].tolist()) for w in bench.words]
        self.places = [_places(w, np.array(sorted(a))) for w, a in zip(bench.words, self.answers)]

    def __call__(self, documents: pa.Array) -> list[list[tuple[int, float, float, bool]]]:
        """For each text its hits (item, share of the passage's words in order, cosine, answer terms present), the best window each."""
        block, gap = self.p.block, int(self.bench.blocks.max(initial=1)) + 1
        hashes, at = word_hashes(documents, punctuation=False)
        words = np.diff(at)
        blocks = -(-words // block)
        # Every text starts at a block of its own, with room before it for windows that begin earlier.
        first = gap * np.arange(1, len(words) + 1) + np.r_[0, np.cumsum(blocks)[:-1]]
        ids = np.full((int(blocks.sum()) + gap * (len(words) + 1)) * block, -1, np.int32)
        ids[np.repeat(first * block - at[:-1], words) + np.arange(len(hashes))] = self.number(hashes)
        found: list[dict[int, tuple[float, float, bool]]] = [{} for _ in words]
        postings = self._postings(ids)
        for space in self.spaces:
            for size, begin, passage, cosine in space.candidates(ids, block, 2 * gap):
                keep = self._enough(ids, postings, begin, size, passage)
                begin, passage, cosine = begin[keep], passage[keep], cosine[keep]
                owner = np.maximum(np.searchsorted(first, begin + size - 1, side="right") - 1, 0)
                for w, m, c, d in zip(begin.tolist(), passage.tolist(), cosine.tolist(), owner.tolist()):
                    self._settle(ids, w, size, m, c, found[d])
        return [[(k, *v) for k, v in sorted(f.items())] for f in found]

    def _enough(self, ids: np.ndarray, postings: tuple[np.ndarray, list[int]], begin: np.ndarray, size: int, passage: np.ndarray) -> np.ndarray:
        """Whether a window holds so many of the passage's words that those in common order may suffice."""
        out = np.zeros(len(begin), bool)
        order = np.argsort(passage, kind="stable")
        table = np.zeros(len(self.bench.terms) + 1, np.uint64)  # the last stands for -1
        blocks, span = len(ids) // self.p.block, np.arange(size * self.p.block)
        for part in np.split(order, np.flatnonzero(np.diff(passage[order])) + 1):
            if len(part):
                m = int(passage[part[0]])
                first, held, answered = begin[part], np.zeros(len(part), np.int64), np.ones(len(part), bool)
                for terms, bits, answer in self.places[m]:
                    if 2 * len(part) * size < blocks:  # few windows are looked through one by one
                        table[terms] = bits
                        there = np.bitwise_or.reduce(table[ids[first[:, None] * self.p.block + span]], axis=1)
                        table[terms] = 0
                    else:
                        holders, at = postings
                        runs = [holders[at[t] : at[t + 1]] for t in terms.tolist()]
                        # A block has each term once and no two terms share a bit, so the sum is their union.
                        one = np.bincount(np.concatenate(runs), weights=np.repeat(bits.astype(float), [len(x) for x in runs]), minlength=blocks).astype(np.uint64)
                        there = one.copy()
                        for k in range(1, size):
                            there[:-k] |= one[k:]
                        there = there[first]
                    held += np.bitwise_count(there)
                    answered &= there & answer == answer
                out[part] = held >= np.where(answered, self.p.near_share, self.p.share) * len(self.bench.words[m])
        return out

    def _postings(self, ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(blocks that hold each term, once each, by term; where each term's begin)."""
        known, blocks = np.flatnonzero(ids >= 0), len(ids) // self.p.block
        key = np.sort(ids[known].astype(np.int64) * blocks + known // self.p.block)
        term, block = np.divmod(key[np.r_[True, key[1:] != key[:-1]][: len(key)]], blocks)
        return block, np.searchsorted(term, np.arange(len(self.bench.terms) + 1)).tolist()

    def _settle(self, ids: np.ndarray, start: int, size: int, m: int, cosine: float, found: dict) -> None:
        passage = self.lists[m]
        window = ids[start * self.p.block : (start + size) * self.p.block]
        present = set(window.tolist())
        answered = self.answers[m] <= present
        if sum(map(present.__contains__, passage)) < (self.p.near_share if answered else self.p.share) * len(passage):
            return  # no subsequence can be longer than that
        share = lcs(self.bench.words[m], window) / len(passage)
        if share < self.p.near_share:
            return
        if share >= self.p.share or answered:
            item = int(self.bench.item[m])
            if item not in found or found[item][0] < share:
                found[item] = (share, cosine, answered)


def benches(benchmark: DataFrame, p: DecontamParams) -> Iterator[Bench]:
    """Passes of at most ``items`` rows, read in order of id; the driver holds one pass at a time."""
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    held: list[tuple[int, str]] = []
    for r in rows:
        held.append((r["item_id"], r["text"]))
        if len(held) == p.items:
            yield Bench.build(held, p)
            held = []
    if held:
        yield Bench.build(held, p)


def searches(docs: DataFrame, benchmark: DataFrame, p: DecontamParams) -> Iterator[tuple[Bench, list[np.ndarray], list[np.ndarray]]]:
    ws = Workspace(docs.sparkSession, "decontam")
    for bench in benches(benchmark, p):
        if not len(bench.terms):
            continue
        codes = ws.cut(coded(docs, bench, p))  # read three times, and much smaller than the texts
        df, n = document_frequency(codes, bench)
        idfs = weigh(df, n, p)
        found = latent_bases(codes, bench, idfs, max(30.0, p.weight * n), p)
        ws.drop(codes)
        yield bench, idfs, found


def contaminated(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """(doc_id, item_id, share, cosine, answered) for each document and benchmark item found in it.

    Null and empty texts hold nothing; null item ids and texts are no items; repeated rows are searched alike. An empty
    benchmark or an empty corpus gives no rows. Items that share an id count as one.
    """
    out = None
    schema = "doc_id long, item_id long, share double, cosine double, answered boolean"
    for found in searches(docs, benchmark, p):
        out_one = docs.select("doc_id", "text").mapInArrow(_finder(found, p), schema)
        out = out_one if out is None else out.unionByName(out_one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _finder(found: tuple, p: DecontamParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*found, p)
        for b in batches:
            for part in slices(b, 1, STEP):
                rows = [(d, *hit) for d, hits in zip(part.column(0).to_pylist(), search(part.column(1))) for hit in hits]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "share", "cosine", "answered"])
        del search
        tidy()

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """The documents in which no item is found, with their own columns. Rows are dropped where they lie; nothing joins or shuffles.

    Null and empty texts stay, whatever their id; repeated rows stay or go alike; an empty benchmark drops nothing, and an
    empty corpus stays empty. Other columns, of whatever name, pass through.
    """
    out = docs
    for found in searches(docs, benchmark, p):
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            search = Search(*found, p)
            for b in batches:
                for part in slices(b, at, STEP):
                    yield part.filter(pa.array([not hits for hits in search(part.column(at))], pa.bool_()))
            del search
            tidy()

        out = out.mapInArrow(run, out.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`contaminated` of all ``documents``; its docstring says what becomes of odd rows."""
    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
