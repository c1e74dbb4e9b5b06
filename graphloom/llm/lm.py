"""Language-model scores of documents.

The model is causal self-attention over subword ids, trained in numpy (:mod:`attention`). It predicts the class of the
next subword from its window; inside its class a subword's probability follows counts given the class before, gathered from all training
documents. Windows of two blocks overlap by one, so every subword is scored once and the score is the log10
probability of the text. Beside it stands a unigram word score whose counts also cover all training documents.

Word counts are grouped by word. The most frequent words, a fixed number, travel with their ids and counts and are summed up in place;
only the others shuffle to meet their counts, so neither the vocabulary nor a frequent word ends up in one place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import parquet_cut
from graphloom.llm.attention import Scorer, Shape, train
from graphloom.llm.common import read, slices, tidy, words_of
from graphloom.llm.packing import Encoder

END = " "  #: stands for the end of a text among words, which never hold a blank
VOCABULARY = 50257
END_ID = 50256


@dataclass(frozen=True)
class LmParams:
    folds: int = 10  #: a document is held out if crc32 of its id has remainder 0
    head: int = 1 << 18  #: words whose counts travel with the plan
    add: float = 0.1  #: added to every count
    symbols: int = 992  #: most frequent subwords with embeddings of their own; others share one for their class
    bands: int = 10  #: frequency bands of each kind of subword; kinds x bands are the classes
    warm_documents: int = 1500  #: documents, about, by hash of their id, on which the weights start; the whole of every training document then takes part
    warm_epochs: int = 6
    window_chars: int = 256  #: the stretch of each of those documents, at a place drawn by its id
    rate: float = 0.01
    vocabulary: str = ""


def held_out(doc_id: Column, folds: int) -> Column:
    """A null id counts as the empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == 0


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which outlives its tasks."""
    return Encoder(path)


# ---- words


@dataclass(frozen=True)
class Words:
    """Words of many texts as numbers: ``codes`` are places in ``distinct``, one for each word of each text in turn."""

    distinct: pa.Array
    codes: np.ndarray
    edges: np.ndarray  #: where each text begins among the codes, and the end of the last

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        """The words of texts whose A-Z are lowered first; null is empty. Arrow cuts at the same six characters as :func:`words_of`,
        and leaves an empty word where a text begins or ends with them."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
        coded = cut.flatten().dictionary_encode()
        codes, edges = coded.indices.to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())]
        if (empty := pc.index(coded.dictionary, "").as_py()) >= 0:
            kept = codes != empty
            codes, edges = codes[kept], np.r_[0, np.cumsum(kept)][edges]
        return cls(coded.dictionary.cast(pa.string()), codes, edges)

    @classmethod
    def listed(cls, texts: list[list[str]]) -> Words:
        """The same from lists of words."""
        coded = pa.array(chain.from_iterable(texts), pa.string()).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(), np.cumsum([0, *map(len, texts)]))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.edges)

    def parts(self, sizes: list[int]) -> Iterator[Words]:
        """The words of runs of so many texts."""
        at = 0
        for n in sizes:
            edges = self.edges[at : at + n + 1]
            yield Words(self.distinct, self.codes[edges[0] : edges[-1]], edges - edges[0])
            at += n


def grouped(parts: Iterator[pa.RecordBatch], text_index: int, limit: int = 8 << 20) -> Iterator[tuple[list[pa.RecordBatch], Words]]:
    """Runs of batches of at most ``limit`` bytes of text (one batch at least), with the words of all their texts."""

    def done() -> tuple[list[pa.RecordBatch], Words]:
        return held, Words.of(pa.concat_arrays([x.column(text_index) for x in held]))

    held, total = [], 0
    for part in parts:
        n = part.column(text_index).nbytes
        if held and total + n > limit:
            yield done()
            held, total = [], 0
        held.append(part)
        total += n
    if held:
        yield done()


def strings(words: pa.Array) -> list[str]:
    """Words as a list; decoded as one text unless the end is among them, which is faster than one by one."""
    if not len(words) or pc.index(words, END).as_py() >= 0:
        return words.to_pylist()
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ")


# ---- counts


def word_counts(rows: DataFrame, limit: int = 400_000) -> DataFrame:
    """(word, c) over all texts, ends included. Each task hands out sums whenever it holds ``limit`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = ends = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for b in batches:
            for part in slices(b, 0):
                words = Words.of(part.column(0))
                found = np.bincount(words.codes, minlength=len(words.distinct))
                used = np.flatnonzero(found)  # all but the empty word
                held.append(pa.table([words.distinct.take(pa.array(used)), pa.array(found[used])], ["word", "c"]))
                size, ends = size + len(used), ends + part.num_rows
                if size > 2 * limit:
                    held = [summed()]
                    size = held[0].num_rows
                if size > limit and len(held) == 1:
                    yield from held[0].to_batches(50_000)
                    held, size = [], 0
        if ends:
            held.append(pa.table([pa.array([END]), pa.array([ends])], ["word", "c"]))
            yield from summed().to_batches(50_000)
        tidy()

    return rows.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---- subword classes


def kind_of(piece: bytes) -> int:
    """0 starts a word, 1 goes on with letters, 2 is neither."""
    if piece[:1] == b" ":
        return 0 if piece[1:2].isalnum() or piece[1:2] >= b"\x80" else 2
    return 1 if piece[:1].isalnum() or piece[:1] >= b"\x80" else 2


@dataclass(frozen=True)
class Subwords:
    """What ids mean to the model: class and symbol of each id, and log probabilities inside a class given the class before."""

    cls: np.ndarray
    symbol: np.ndarray
    inside: np.ndarray  #: classes x vocabulary, natural logs
    shape: Shape

    @classmethod
    def build(cls, counts: np.ndarray, pairs: np.ndarray, classes: np.ndarray, symbols: int, add: float) -> Subwords:
        k = int(classes.max()) + 1
        mass = counts + add
        share = mass / np.bincount(classes, weights=mass, minlength=k)[classes]
        # Witten-Bell style: the class before speaks as loudly as it has been heard
        heard = np.zeros((k, k))
        for c in range(k):
            heard[c] = np.bincount(classes, weights=pairs[c], minlength=k)
        strength = 200.0
        inside = np.log((pairs + strength * share[None, :]) / (heard[:, classes] + strength)).astype(np.float32)
        order = np.argsort(-counts, kind="stable")[:symbols]
        symbol = symbols + classes.astype(np.int64)
        symbol[order] = np.arange(len(order))
        return cls(classes.astype(np.int32), symbol.astype(np.int32), inside, Shape(symbols + k, k))


def class_of_ids(counts: np.ndarray, pieces: list[bytes], bands: int) -> np.ndarray:
    """Kinds of subwords, each cut in bands of equal mass by frequency; the end is a class of its own."""
    out = np.zeros(VOCABULARY, np.int64)
    kinds = np.array([kind_of(x) for x in pieces])
    at = 1
    for kind in range(3):
        members = np.flatnonzero(kinds == kind)
        members = members[members != END_ID]
        members = members[np.argsort(-counts[members], kind="stable")]
        mass = np.cumsum(counts[members] + 0.1)
        width = bands if kind < 2 else 3
        out[members] = at + np.minimum((mass / mass[-1] * width).astype(int), width - 1)
        at += width
    out[END_ID] = 0
    return np.unique(out, return_inverse=True)[1]


def plain_words(words: list[str]) -> list[int]:
    """Places of the words, none empty, that hold no white space of any kind."""
    if " ".join(words).split() == words:
        return [*range(len(words))]
    return [k for k, w in enumerate(words) if w.split() == [w]]


@functools.lru_cache(1)
def begins(encode: Encoder) -> np.ndarray:
    """Which ids begin with a blank."""
    return np.array([encode.piece(k)[:1] == b" " for k in range(VOCABULARY - 1)])


class Pieces:
    """Ids of many words at once, each encoded as behind a blank."""

    def __init__(self, encode: Encoder) -> None:
        self.encode, self.begins = encode, begins(encode)

    def together(self, words: list[str], plain: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of the word of each) of the words at ``plain``, encoded together: as they hold no white space, none but the
        first piece of each begins with a blank."""
        ids = np.array(self.encode(" " + " ".join(words if len(plain) == len(words) else [words[k] for k in plain])) if plain else [], np.int32)
        at = np.flatnonzero(self.begins[ids])
        return ids, np.repeat(np.array(plain, np.int64), np.diff(np.r_[at, len(ids)]))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of the word of each); empty words have none."""
        plain = plain_words(words)
        ids, owner = self.together(words, plain)
        if len(plain) < len(words):
            for k in sorted(set(range(len(words))) - set(plain)):
                if words[k]:
                    more = self.encode(" " + words[k])
                    ids, owner = np.r_[ids, np.array(more, np.int32)], np.r_[owner, np.full(len(more), k)]
        return ids, owner


@dataclass(frozen=True)
class Coded:
    """Ids of words: ``length`` of them from ``start`` in ``flat``; -1 of them for words that hold Unicode white space."""

    words: pa.Array
    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, pieces: Pieces) -> Coded:
        listed = strings(words)
        flat, owner = pieces.together(listed, plain_words(listed))
        length = np.bincount(owner, minlength=len(listed))
        return cls(words, flat, np.cumsum(length) - length, np.where(length, length, -1))

    def __add__(self, more: Coded) -> Coded:
        return Coded(pa.concat_arrays([self.words, more.words]), np.r_[self.flat, more.flat], np.r_[self.start, more.start + len(self.flat)], np.r_[self.length, more.length])


NONE = Coded(pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))


class WordIds:
    """Ids of many texts at once. Those of ``head`` are given, other words' ids are looked up once and kept, up to ``limit`` words; a
    text in which Unicode white space is part of a word, where pieces may reach across words, is encoded whole."""

    def __init__(self, encode: Encoder, limit: int = 1 << 18, head: Coded = NONE) -> None:
        self.pieces, self.limit, self.head, self.known = Pieces(encode), limit, head, head

    def numbers(self, texts: Words) -> np.ndarray:
        """The number of each distinct word; words of the head have their places there."""
        if len(self.known.words) > len(self.head.words) + self.limit:
            self.known = self.head
        numbers = pc.index_in(texts.distinct, value_set=self.known.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.known.words) + np.arange(len(new))
            self.known += Coded.of(texts.distinct.take(pa.array(new)), self.pieces)
        return numbers

    def __call__(self, texts: Words | list[list[str]], numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); ``numbers`` are those of the distinct words."""
        texts = texts if isinstance(texts, Words) else Words.listed(texts)
        numbers = self.numbers(texts) if numbers is None else numbers
        words, ends = numbers[texts.codes], texts.edges
        lengths = self.known.length[words]
        whole = np.add.reduceat(np.r_[lengths < 0, False], ends[:-1]) * (np.diff(ends) > 0) if len(ends) > 1 else np.empty(0)
        lengths = np.maximum(lengths, 0)
        begin = np.r_[0, np.cumsum(lengths)]
        ids = self.known.flat[np.repeat(self.known.start[words] - begin[:-1], lengths) + np.arange(begin[-1])]
        at = begin[ends]
        if not whole.any():
            return ids, np.diff(at)
        text = lambda k: " ".join(texts.distinct.take(pa.array(texts.codes[ends[k] : ends[k + 1]])).to_pylist())
        parts = [ids[a:b] if not odd else np.array(self.pieces.encode(" " + text(k)), np.int32) for k, (a, b, odd) in enumerate(zip(at, at[1:], whole))]
        return np.concatenate(parts), np.array([len(x) for x in parts])


def subword_counts(words: DataFrame, path: str) -> np.ndarray:
    """Count of each subword in all training texts, from the words' counts; a row for each id comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = Pieces(encoder(path)), np.zeros(VOCABULARY)
        for b in batches:
            words, times = strings(b.column(0)), b.column(1).to_numpy()
            if (at := pc.index(b.column(0), END).as_py()) >= 0:
                total[END_ID] += times[at]
                words[at] = ""
            ids, owner = pieces(words)
            total += np.bincount(ids, weights=times[owner], minlength=VOCABULARY)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["k", "c"])

    out = np.zeros(VOCABULARY)
    for r in words.mapInArrow(run, "k long, c double").groupBy("k").agg(F.sum("c").alias("c")).collect():
        out[r["k"]] = r["c"]
    return out


def subword_pairs(words: DataFrame, classes: np.ndarray, path: str) -> np.ndarray:
    """Counts of (class before, id) inside words of all training texts, classes x vocabulary."""
    k = int(classes.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = Pieces(encoder(path)), np.zeros((k, VOCABULARY))
        for b in batches:
            ids, owner = pieces([w if w != END else "" for w in strings(b.column(0))])
            first = np.flatnonzero(owner[:-1] == owner[1:])
            pair, which = np.unique(classes[ids[first]] * VOCABULARY + ids[first + 1], return_inverse=True)
            total.ravel()[pair] += np.bincount(which, weights=b.column(1).to_numpy()[owner[first]], minlength=len(pair))
        at = np.flatnonzero(total)
        for s in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 50_000]), pa.array(total.ravel()[at[s : s + 50_000]])], ["k", "c"])

    out = np.zeros(k * VOCABULARY)
    for b in words.mapInArrow(run, "k long, c double").groupBy("k").agg(F.sum("c").alias("c")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out.reshape(k, VOCABULARY)


# ---- the network's weights


def blocks_of(ids: np.ndarray, counts: np.ndarray, sub: Subwords, open_ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, target classes) of texts given as in :class:`WordIds`, in blocks; before each text stands a block of ends, which
    is context only. Every subword and every end is a target once, but for the ends of ``open_ends``."""
    b = sub.shape.block
    blocks = -(-(counts + 1) // b) + 1
    start = (np.cumsum(blocks) - blocks + 1) * b  # of each text, behind its block of ends
    at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
    x = np.full(int(blocks.sum()) * b, sub.symbol[END_ID], np.int32)
    y = np.full(len(x), -1, np.int32)
    x[at + 1] = sub.symbol[ids]  # never past the text's blocks, which have room for the end too
    y[at], y[start + counts] = sub.cls[ids], sub.cls[END_ID]
    if open_ends is not None:
        y[(start + counts)[open_ends]] = -1
    return x.reshape(-1, b), y.reshape(-1, b)


def stretches(texts: list[str], seeds: list[int], sub: Subwords, encode: Encoder, p: LmParams) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of one stretch of each text; the start of the weights."""
    pieces, opens = [], []
    for t, seed in zip(texts, seeds):
        start = seed % max(1, len(t) - p.window_chars) if len(t) > p.window_chars else 0
        piece = words_of(t[start : start + p.window_chars])
        piece = piece[1:] if start else piece
        if piece:
            pieces.append(piece)
            opens.append(start + p.window_chars < len(t))  # the end counts only where the text ends
    return blocks_of(*WordIds(encode)(pieces), sub, np.array(opens, bool))


def all_windows(texts: Words | list[str], sub: Subwords, encode: Encoder | WordIds, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, target classes) of whole texts, in blocks as :func:`blocks_of` lays them; with the block before, each is a window."""
    ids = encode if isinstance(encode, WordIds) else WordIds(encode)
    return blocks_of(*ids(texts if isinstance(texts, Words) else Words.of(pa.array(texts, pa.string())), numbers), sub)


def fit(rows: DataFrame, count: int, sub: Subwords, p: LmParams, head: Broadcast | None = None) -> dict[str, np.ndarray]:
    """Weights from a bounded start on the driver, then one round in which every task trains on the whole of each of its
    training documents and the results are averaged by windows. ``rows`` has (doc_id, seed, text) of training documents; ``head`` holds the ids of frequent words."""
    shape = sub.shape
    path = p.vocabulary
    share = max(1, count // p.warm_documents)
    some = rows.filter(F.col("seed") % share == 0).select("seed", F.substring("text", 1, 4 * p.window_chars).alias("text")).limit(2 * p.warm_documents).collect()
    encode = Encoder(path)
    some_texts = [(r["text"] or "").encode().lower().decode() for r in some]
    x, y = stretches(some_texts, [r["seed"] for r in some], sub, encode, p)
    w = train(shape, shape.init(), x, y, p.rate, p.warm_epochs) if len(x) else shape.init()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, now, seen = WordIds(encoder(path), head=head.value if head else NONE), w, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def learn() -> None:
            nonlocal now, seen, held, count
            xs, ys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            now = train(shape, now, xs, ys, p.rate / 5)
            seen, held, count = seen + int((ys >= 0).any(axis=1).sum()), [], 0

        for b in batches:
            for parts, words in grouped(slices(b, 0, 1 << 20), 0):
                numbers = encode.numbers(words)
                for texts in words.parts([x.num_rows for x in parts]):
                    held.append(all_windows(texts, sub, encode, numbers))
                    count += len(held[-1][0])
                    if count > 20_000:
                        learn()
        if held:
            learn()
        if seen:
            flat = shape.pack(now)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], ["k", "v", "n"])
        tidy()

    got = rows.select("text").mapInArrow(run, "k long, v double, n long").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).collect()  # one row for each weight
    if not got:
        return w
    flat = np.zeros(len(shape.pack(w)))
    for r in got:
        flat[r["k"]] = r["v"]
    return shape.unpack(flat)


class TextScorer:
    """log10 probabilities of texts, many at a time."""

    def __init__(self, sub: Subwords, weights: dict[str, np.ndarray], path: str, blocks: int = 400, head: Coded = NONE) -> None:
        self.sub, self.scorer, self.encode, self.blocks = sub, Scorer(sub.shape, weights), WordIds(encoder(path), head=head), blocks

    def __call__(self, texts: Words, numbers: np.ndarray) -> np.ndarray:
        """``numbers`` are those of the distinct words."""
        b, sub = self.sub.shape.block, self.sub
        ids, counts = self.encode(texts, numbers)
        blocks = -(-(counts + 1) // b)
        start = (np.cumsum(blocks) - blocks) * b
        at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
        prev, real = np.full(int(blocks.sum()) * b, END_ID, np.int32), np.zeros(int(blocks.sum()) * b, bool)
        cur = prev.copy()
        prev[at + 1] = ids
        cur[at], real[at], real[start + counts] = ids, True, True
        prev, cur, real = prev.reshape(-1, b), cur.reshape(-1, b), real.reshape(-1, b)
        owner, first, logs = np.repeat(np.arange(len(counts)), blocks), np.zeros(len(cur), bool), np.empty(len(cur))
        first[start // b] = True
        inside = sub.inside.ravel()
        for s in range(0, len(prev), self.blocks):
            e = min(s + self.blocks, len(prev))
            lead = int(not first[s])  # bring the block before along, for its keys
            x, y, opens = prev[s - lead : e], cur[s - lead : e], first[s - lead : e].copy()
            opens[0] = True
            cls = np.take(sub.cls, x[lead:])
            own = self.scorer(np.take(sub.symbol, x), opens, np.take(sub.cls, y))[lead:] + np.take(inside, cls * VOCABULARY + y[lead:])
            logs[s:e] = (own * real[s:e]).sum(axis=1)
        total = np.bincount(owner, weights=logs, minlength=len(counts))
        return total / np.log(10)


# ---- scores


def score_documents(docs: DataFrame, p: LmParams = LmParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    A null or empty text is its end alone. Repeated rows are scored, and learnt from, as often as they occur; a null id is held out.
    Without training documents every count is 0 and the weights are the initial ones.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), p.folds).alias("held_out"), F.col(text).alias("text"))
    learn = rows.filter(~F.col("held_out"))
    counts = parquet_cut(word_counts(learn), "words")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, floor = size["n"], size["n"] + p.add * (size["v"] + 1)
    often = counts.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(p.head).toArrow().combine_chunks()
    ends = (counts.filter(F.col("word") == END).first() or {"c": 0})["c"]
    encode = Encoder(p.vocabulary)
    found = often.column("c").to_numpy()
    head = Coded.of(pa.concat_arrays(often.column("word").chunks).cast(pa.string()) if len(found) else NONE.words, Pieces(encode))
    known = spark.sparkContext.broadcast(head)
    head_logs = spark.sparkContext.broadcast(np.log10((found + p.add) / floor))

    pieces = [encode.piece(k) for k in range(VOCABULARY - 1)] + [b""]
    id_counts = subword_counts(counts, p.vocabulary)
    classes = class_of_ids(id_counts, pieces, p.bands)
    sub = Subwords.build(id_counts, subword_pairs(counts, classes, p.vocabulary), classes, p.symbols, p.add)
    seed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    weights = fit(learn.select(seed.alias("seed"), "text"), ends, sub, p, known)
    model = spark.sparkContext.broadcast((sub, weights))
    end_log = float(np.log10((ends + p.add) / floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(*model.value, p.vocabulary, head=known.value)
        uid = TaskContext.get().partitionId() << 40
        kinds = {"word": pa.string(), "uid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "times": pa.int64()}

        def batches_of(**columns: pa.Array | np.ndarray | list[str]) -> Iterator[pa.RecordBatch]:
            """In batches; columns that aren't given are null."""
            size = len(columns["uid"])
            arrays = [pa.nulls(size, t) if k not in columns else c.cast(t) if isinstance(c := columns[k], pa.Array) else pa.array(c, t) for k, t in kinds.items()]
            for s in range(0, size, 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(s, 50_000) for x in arrays], [*kinds])

        for b in batches:
            for parts, every in grouped(slices(b, 2, 2 << 20), 2):
                numbers = scorer.encode.numbers(every)
                by_word = np.full(len(numbers), np.nan)
                frequent = numbers < len(head_logs.value)
                by_word[frequent] = head_logs.value[numbers[frequent]]
                for own, words in zip(parts, every.parts([x.num_rows for x in parts])):
                    size, scores = own.num_rows, scorer(words, numbers)
                    logs, owner = by_word[words.codes], np.repeat(np.arange(size), words.counts)
                    unknown = np.isnan(logs)
                    base = np.bincount(owner, weights=np.where(unknown, 0, logs), minlength=size)
                    n_known = words.counts - np.bincount(owner[unknown], minlength=size) + (ends > 0)
                    uids = uid + 1 + np.arange(size)
                    uid += size
                    yield from batches_of(word=[f" {u}" for u in uids.tolist()], uid=uids, doc_id=own.column(0), held_out=own.column(1), n_tokens=words.counts + 1, n_known=n_known, base=base + end_log, score=scores)
                    rest, times = np.unique(owner[unknown] * len(words.distinct) + words.codes[unknown], return_counts=True)
                    if len(rest):
                        yield from batches_of(word=words.distinct.take(pa.array(rest % len(words.distinct))), uid=uids[rest // len(words.distinct)], times=times)
        tidy()

    schema = "word string, uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, times long"
    told = rows.mapInArrow(run, schema).join(counts, "word", "left")
    rest = F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + p.add) / floor)
    one = told.select("uid", "doc_id", "held_out", "n_tokens", F.coalesce("n_known", F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("n_known"), F.coalesce("base", rest).alias("base"), "score")
    by = one.groupBy("uid").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "score")], F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"))
    return by.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
