"""N-gram Jaccard join: all links of 80 percent or more between the shingle sets of documents, and their components.

Exact, in three steps. (1) Equal sets become one class. (2) Prefix filtering: two sets that link share one of their
first n - ceil(0.8 n) + 1 shingles in any common order. Shingles are counted over all classes and ordered by bands of
their frequency, so that those of no other set come first and those of widespread passages last; unrelated sets with a
passage in common thus drop out. Sets that share a prefix shingle form a star for each band of sizes, and neighbouring
bands join at their centres, which costs about one edge a row however often a shingle occurs; the components of these
edges are the clusters. (3) T-occurrence search inside each cluster by DivideSkip (Li, Lu, Lu 2008): merge the short
inverted lists with a heap, probe the long ones by bisection, keep sets that reach the required overlap. The most
typical sets ask first; what they connect needs no search of its own, so a dense group of near copies costs about as
much as its size. A large cluster is searched in blocks: each by itself first, together with a few pivots of the
cluster, and then only sets outside its largest component visit the other blocks.

Shingle sets are made from the texts wherever they are needed; stored, they would take several times the input.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import Workspace
from graphloom.llm.common import fresh, map_batches, read, slices, tidy
from graphloom.llm.shingles import shingle_sets


@dataclass(frozen=True)
class JaccardParams:
    width: int = 5  #: words of a shingle
    percent: int = 80  #: 100 * intersection >= percent * union
    bits: int = 30  #: bitmaps have eight bits for each member, but 2**bits (128 MB) at most; fuller ones order worse and lose nothing
    block: int = 1500  #: sets of a cluster that one task searches; larger clusters are searched in blocks
    block_shingles: int = 4_000_000  #: shingles of those sets, about
    pivots: int = 4  #: of each large cluster


STEP = 1 << 20  #: bytes of text whose shingles are made at once
LOW = 29  #: bits of a shingle that are kept behind those that name its bucket
FREQUENCIES = (2, 4, 16, 64, 256, 1024)  #: a shingle's band is the number of these that its count reaches


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def required(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m that links them."""
    return -(-percent * (n + m) // (100 + percent))


# ---- inside one cluster


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def divide_skip(holders: np.ndarray, start: np.ndarray, of: np.ndarray, need: int, wanted=None, heap: int = 256, long: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(numbers that occur in at least ``need`` of the lists ``of``, in how many), ascending; list j is holders[start[j]:start[j + 1]].

    The longest lists, fewer than ``need`` of them and none of under ``long`` numbers, are put aside. The others are
    merged, with a heap or, where they hold more than ``heap`` numbers, by counting in an array; numbers that can still
    reach ``need`` are looked up in the long lists by bisection. ``wanted`` maps candidates to a mask of those of interest.
    """
    size = start[of + 1] - start[of]
    if need < 1 or np.count_nonzero(size) < need:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(-size, kind="stable")
    skip = min(need - 1, int(need / (np.log2(size.max() + 1) + 1)), int((size >= long).sum()))
    aside, short, size = of[order[:skip]], of[order[skip:]], size[order[skip:]]
    if size.sum() <= heap:
        runs = [(k, len(list(g))) for k, g in groupby(heapq.merge(*[holders[start[j] : start[j + 1]].tolist() for j in short]))]
        number, count = np.array([k for k, _ in runs], dtype=np.int64), np.array([c for _, c in runs], dtype=np.int64)
        keep = count >= need - skip
        number, count = number[keep], count[keep]
    else:
        ends = np.cumsum(size)
        counts = np.bincount(holders[np.repeat(start[short] - ends + size, size) + np.arange(ends[-1])])
        number = np.flatnonzero(counts >= max(1, need - skip))
        count = counts[number]
    if wanted is not None and len(number):
        keep = wanted(number)
        number, count = number[keep], count[keep]
    for left, j in zip(range(skip, 0, -1), aside):
        keep = count + left >= need
        number, count = number[keep], count[keep]
        if not len(number):
            break
        x = holders[start[j] : start[j + 1]]
        at = np.searchsorted(x, number)
        at[at == len(x)] = 0
        count = count + (x[at] == number)
    keep = count >= need
    return number[keep], count[keep]


def search(sets: list[np.ndarray], queries: np.ndarray, labels: np.ndarray, p: JaccardParams) -> list[tuple[int, int]]:
    """Links (a, b) that, with the given labels, connect the sets exactly as all links would.

    Every set is indexed; ``queries`` marks those searched for. Sets with equal labels are known to be connected.
    """
    n = len(sets)
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[k] for k in order]
    asked, marks = queries[order], labels[order]
    union, first = Union(n), {}
    for k, m in enumerate(marks.tolist()):
        if m >= 0:
            union.join(first.setdefault(m, k), k)
    sizes = [len(x) for x in sets]
    links: list[tuple[int, int]] = []
    if n == 0:
        return links
    # Inverted lists, one after the other: the sets that hold shingle j are holders[start[j]:start[j + 1]], ascending.
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    _, number, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(number, kind="stable")]
    start = np.r_[0, np.cumsum(df)]

    def ask(k: int, skip: set[int]) -> None:
        """Links set k with all partners that it isn't connected with yet, but for those in ``skip``."""
        mine = number[bounds[k] : bounds[k + 1]]
        own = union.find(k)

        def wanted(c: np.ndarray) -> np.ndarray:
            return np.array([x != k and x not in skip and union.find(x) != own for x in c.tolist()], dtype=bool)

        least = required(sizes[k], -(-p.percent * sizes[k] // 100), p.percent)
        for c, o in zip(*(x.tolist() for x in divide_skip(holders, start, mine[df[mine] > 1], min(least, sizes[k]), wanted))):
            if 100 * o >= p.percent * (sizes[k] + sizes[c] - o) and union.join(k, c):
                links.append((int(order[k]), int(order[c])))

    # In a group of many sets the most typical ones, which ask first, connect nearly all of it.
    whole = bool(queries.all())
    if whole and n > 24:
        typical = np.add.reduceat(df[number], bounds[:-1]) / np.array(sizes)
        for _ in range(6):
            roots = np.array([union.find(k) for k in range(n)])
            home = Counter(roots.tolist()).most_common(1)[0][0]
            free = np.flatnonzero(roots != home) if links else np.arange(n)
            if not len(free):
                break
            k = int(free[np.argmax(typical[free])])
            typical[k] = -1
            ask(k, set())
    roots = [union.find(k) for k in range(n)]
    if len(set(roots)) == 1:
        return links
    # Of two sets in different components, one at least lies outside the largest: those ask, each pair from one side.
    home = Counter(roots).most_common(1)[0][0]
    asking = [k for k in range(n) if asked[k] and (roots[k] != home or not whole)]
    later = set(asking)
    for k in asking:
        later.discard(k)
        ask(k, later)
    return links


def search_groups(groups: DataFrame, p: JaccardParams) -> DataFrame:
    """(cluster, block, id, label, ask, shingles) rows to connecting links (a, b).

    Groups are dealt by cluster and block, and each task reads its groups one after the other. A number of partitions
    keeps them from being merged by bytes; time goes by pairs.
    """
    cols = ["cluster", "block", "id", "label", "ask", "shingles"]

    def settle(held: list[tuple]) -> pa.RecordBatch:
        ids, labels, asks, sets = zip(*held)
        got = search([np.frombuffer(x, np.uint64) for x in sets], np.array(asks, dtype=bool), np.array(labels, dtype=np.int64), p)
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in got], pa.int64()), pa.array([ids[y] for _, y in got], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for part in slices(b, 5, 16 << 20):
                c = [x.to_pylist() for x in part.columns]
                for now, row in zip(zip(c[0], c[1]), zip(*c[2:])):
                    if now != key and held:
                        yield settle(held)
                        held = []
                    key = now
                    held.append(row)
        if held:
            yield settle(held)
        del held
        tidy()

    n = 2 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select(*cols).repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(run, "a long, b long")


# ---- components of a graph


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of every id in (a, b), by large-star and small-star steps (Kiveris et al. 2014).

    Every step is an aggregation and a join on one column, written in the shared folder; a hub's rows can be split by
    the join. Tables of earlier steps are deleted.
    """
    e = ws.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = max(8, e.count() // 200_000)  # rows never get more than they are now
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")
        if not open_.agg(F.count("*")).first()[0]:  # stars: each id has one centre, which has none
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ws.cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        new = ws.cut(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        ws.drop(e, large)
        e = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# ---- shingle sets of all documents, or of some


def _bits(members: int, p: JaccardParams) -> int:
    return min(p.bits, max(16, (8 * members).bit_length()))


def _bitmaps(positions: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """Bytes of bitmaps of 2**bits[map] with the given (map, pos) set."""
    x = F.col("pos") + 1
    found = positions.groupBy("map", F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("b"))
    out = [np.zeros(1 << (k - 3), np.uint8) for k in bits]
    for r in found.collect():  # as many bytes as the bitmaps have, at most
        part, start, to = np.frombuffer(r["b"], np.uint8), (r["k"] - 1) * 4096, out[r["map"]]
        to[start : start + len(part)] = part[: len(to) - start]
    return out


def _has(bitmap: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bitmap[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 > 0


class SomeSets:
    """Shingle sets of the documents whose ids are in ``ids``, and of a few others that share their place in a bitmap."""

    def __init__(self, docs: DataFrame, ids: DataFrame, p: JaccardParams) -> None:
        """``ids`` has the column id."""
        self.p, bits = p, _bits(ids.count(), p)
        place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
        self.wanted: Broadcast = docs.sparkSession.sparkContext.broadcast(_bitmaps(ids.select(F.lit(0).alias("map"), place("id").alias("pos")), [bits])[0])
        self.rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), place("doc_id").alias("pos"), "text")

    def done(self) -> None:
        self.wanted.destroy()

    def map(self, schema: str, make) -> DataFrame:
        """``make()`` gives a function from (ids, set bounds, shingles) and from None, at the end of a task, to record batches."""
        wanted, width = self.wanted, self.p.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = make()
            for whole in batches:
                keep = whole.filter(pa.array(_has(wanted.value, whole.column(1).to_numpy(zero_copy_only=False))))
                for b in slices(keep, 2, STEP):
                    flat, at = shingle_sets(b.column(2), width)
                    yield from each((b.column(0), at, flat))
            yield from each(None)
            del each
            tidy()

        return self.rows.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """(doc_id, n, f1, f2): set size and a 128-bit name of the set."""

    def make():
        def each(b: pa.RecordBatch):
            flat, at = shingle_sets(b.column(1), p.width)
            ends = at.tolist()
            name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(flat[x:y]) for x, y in zip(ends, ends[1:])), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (np.diff(at), name[:, 0], name[:, 1]))], ["doc_id", "n", "f1", "f2"])

        return each

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n long, f1 long, f2 long", make, "text", STEP)


def whole_sets(some: SomeSets) -> DataFrame:
    """(id, shingles): each set's sorted hashes as bytes."""

    def make():
        def each(found):
            if found:
                ids, at, flat = found
                data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([ids, data], ["id", "shingles"])

        return each

    return some.map("id long, shingles binary", make)


# ---- how often shingles occur


def pack(values: np.ndarray) -> tuple[bytes, bool]:
    """Ascending numbers below 2**32 as 16-bit steps, where 65535 carries on, or plainly where that would be longer."""
    steps = np.diff(values, prepend=0)
    carries = steps // 65535
    if carries.sum() > len(values):
        return values.astype(np.uint32).tobytes(), True
    ends = np.cumsum(carries + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 65535, np.uint16)
    out[ends - 1] = steps % 65535
    return out.tobytes(), False


def unpack(data: bytes, plain: bool) -> np.ndarray:
    if plain:
        return np.frombuffer(data, np.uint32).astype(np.int64)
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def shared_shingles(some: SomeSets, total: int, chunk: int = 2_000_000, bucket: int = 4_000_000) -> tuple[DataFrame, int]:
    """((pos, band) of the shingles that occur in two or more of the sets, bits of pos).

    Tasks deal their shingles by leading bits, each value once for a chunk with its count there (255 at most, which only
    concerns the order); so a frequent shingle adds one number a chunk, and the number of buckets grows with the total.
    What looks shared only because its kept bits are those of another shingle comes later in the order, which costs a
    little pruning and loses nothing.
    """
    k = max(6, (max(1, total) // bucket).bit_length())
    schema = "bucket long, low binary, plain boolean, times binary"

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        v, c = np.unique(np.concatenate(held) >> np.uint64(64 - LOW - k), return_counts=True)
        at = np.searchsorted(v >> np.uint64(LOW), np.arange((1 << k) + 1, dtype=np.uint64))
        low, times = (v & np.uint64((1 << LOW) - 1)).astype(np.int64), np.minimum(c, 255).astype(np.uint8)
        used = np.flatnonzero(at[1:] > at[:-1])
        packed = [pack(low[at[x] : at[x + 1]]) for x in used]
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed]), pa.array([times[at[x] : at[x + 1]].tobytes() for x in used], pa.binary())], ["bucket", "low", "plain", "times"])

    def make():
        held: list[np.ndarray] = []

        def each(found):
            if found:
                held.append(found[2])
            if held and (found is None or sum(map(len, held)) >= chunk):
                yield deal(held)
                held.clear()

        return each

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([unpack(x, y) for x, y in zip(pdf["low"], pdf["plain"])])
        c = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["times"]]).astype(np.int64)
        order = np.argsort(v, kind="stable")
        v = v[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        band = np.searchsorted(FREQUENCIES, np.add.reduceat(c[order], first), side="right")
        return pd.DataFrame({"pos": v[first][band > 0] | (int(pdf["bucket"].iloc[0]) << LOW), "band": band[band > 0]})

    return some.map(schema, make).groupBy("bucket").applyInPandas(count, "pos long, band long"), k + LOW


class Bands:
    """The band of each shingle: one bitmap for each band, of the shingles in it or above."""

    def __init__(self, shared: DataFrame, bits: int, p: JaccardParams) -> None:
        counts = {r["band"]: r["count"] for r in shared.groupBy("band").count().collect()}
        self.bits = [min(bits, _bits(sum(n for b, n in counts.items() if b >= band), p)) for band in range(1, max(counts, default=0) + 1)]
        down = ", ".join(str(bits - own) for own in self.bits) or "0"
        every = shared.withColumn("map", F.explode(F.sequence(F.lit(0).cast("long"), F.col("band") - 1)))
        self.maps = _bitmaps(every.select("map", F.expr(f"shiftright(pos, element_at(array({down}), CAST(map AS int) + 1))").alias("pos")), self.bits)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.int8)
        among = np.arange(len(shingles))
        for bits, bitmap in zip(self.bits, self.maps):
            among = among[_has(bitmap, (shingles[among] >> np.uint64(64 - bits)).astype(np.int64))]
            out[among] += 1
        return out


def rare_first(some: SomeSets, bands: Broadcast) -> DataFrame:
    """(h, id, n): the shared shingles in each set's prefix, where shingles come by band and then by hash."""
    percent = some.p.percent

    def make():
        def each(found):
            if not found:
                return
            ids, at, flat = found
            band = bands.value(flat)
            common = np.r_[0, np.cumsum(band > 0)]
            hs, owners, ns = [], [], []
            for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                take = prefix_length(b - a, percent) - (b - a - int(common[b] - common[a]))
                if take > 0:
                    own = np.flatnonzero(band[a:b])
                    hs.append(flat[a:b][own[np.argsort(band[a:b][own], kind="stable")[:take]]].view(np.int64))
                    owners.append(np.full(len(hs[-1]), ids[k].as_py()))
                    ns.append(np.full(len(hs[-1]), b - a))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, owners, ns)], ["h", "id", "n"])

        return each

    return some.map("h long, id long, n long", make)


def starred(postings: DataFrame, p: JaccardParams, ws: Workspace) -> DataFrame:
    """(a, b): edges that connect all sets (h, id, n) that share h and may link by their sizes.

    Sizes fall in bands a little wider than the ratio that links, so sets that link lie in one band or in neighbouring
    ones. In each band of h all sets meet the one with the least id, which takes an aggregate and a join that can be split.
    """
    rows = postings.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / p.percent * 1.0001))))
    heads = ws.cut(rows.groupBy("h", "size").agg(F.min("id").alias("b"), F.min("n").alias("low"), F.max("n").alias("high")))
    star = rows.join(heads, ["h", "size"]).select(F.col("id").alias("a"), "b")
    above = heads.select("h", (F.col("size") - 1).alias("size"), F.col("b").alias("a"), F.col("low").alias("next"))
    chain = heads.join(above, ["h", "size"]).filter(F.col("high") * 100 >= F.col("next") * p.percent).select("a", "b")
    edges = ws.cut(star.unionByName(chain).filter("a <> b").distinct())
    ws.drop(heads)
    return edges


# ---- the join


def link_components(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Null and empty texts have empty sets and link with nothing. A null id takes part in no link and has a null component.
    Rows that share an id are one document: what any of them links with, all do. An empty table gives an empty result.
    Columns other than doc_id and text don't matter.
    """
    docs = docs.select("doc_id", "text")
    ws = Workspace(docs.sparkSession, "jaccard")
    prints = ws.cut(fingerprints(docs, p))
    known = prints.filter("n > 0 AND doc_id IS NOT NULL")
    own = ["f1", "f2", "n"]
    classes = ws.cut(known.groupBy(*own).agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"), "n")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = SomeSets(docs, reps, p)
    shared, bits = shared_shingles(some, total)
    shared = ws.cut(shared)
    bands = docs.sparkSession.sparkContext.broadcast(Bands(shared, bits, p))
    postings = ws.cut(rare_first(some, bands))
    bands.destroy()
    some.done()
    ws.drop(shared)
    edges = starred(postings, p, ws)
    ws.drop(postings)
    clusters = components(edges, ws)
    links = _search(docs, clusters, reps, p, ws)
    several = known.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")  # ids that may stand for several texts
    same = known.select("doc_id", *own).join(several, "doc_id", "left_semi").join(classes, own).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same), ws)
    named = prints.join(classes, own, "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    out = named.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def _search(docs: DataFrame, clusters: DataFrame, reps: DataFrame, p: JaccardParams, ws: Workspace) -> DataFrame:
    """Connecting links (a, b) inside all clusters (id, component); ``reps`` has (id, n)."""
    weight = clusters.join(reps, "id").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("weight") / p.block_shingles)).cast("int")
    placed = clusters.join(weight.select("component", blocks.alias("blocks")), "component").withColumnRenamed("component", "cluster")
    placed = ws.cut(placed.select("id", "cluster", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    if not placed.limit(1).count():
        return placed.select(F.col("id").alias("a"), F.col("id").alias("b"))
    big = placed.filter("blocks > 1")
    # First every block by itself, with the cluster's pivots as guests that tie the blocks together.
    slot = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(p.pivots))
    pivots = big.groupBy("cluster", slot.alias("slot")).agg(F.min_by("id", F.xxhash64("id", F.lit(3))).alias("id")).select("id", F.lit(True).alias("pivot"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = placed.join(pivots, "id", "left").withColumn("block", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("block"))))
    alone = at.select("id", "cluster", "block", F.lit(-1).cast("long").alias("label"), F.lit(True).alias("ask"))
    star = _searched(docs, alone, p, ws)
    if not big.limit(1).count():
        return star
    # Then what isn't in a cluster's largest component visits the other blocks, in parties of a block's size.
    marks = components(star.join(big.select(F.col("id").alias("a")), "a", "left_semi"), ws).withColumnRenamed("component", "label")
    labelled = ws.cut(big.join(marks, "id", "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))))
    count = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster")
    known = F.col("label") >= 0
    homes = count.agg(F.max_by(F.when(known, F.col("label")), F.when(known, F.struct("n", "label"))).alias("home"), F.sum("n").alias("all"), F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("at_home"))
    homes = homes.select("cluster", "home", F.ceil((F.col("all") - F.col("at_home")) / p.block).cast("int").alias("parties")).filter("parties > 0")
    homed = labelled.join(homes, "cluster")
    stray = homed.filter(F.col("home").isNull() | (F.col("label") != F.col("home"))).withColumns({"ask": F.lit(True), "party": F.pmod(F.xxhash64("id", F.lit(1)), F.col("parties")).cast("int")})
    stray = stray.withColumn("to", F.explode(every)).filter("to <> block").withColumn("block", F.col("to"))
    resident = homed.withColumns({"ask": F.lit(False), "party": F.explode(F.sequence(F.lit(0), F.col("parties") - 1))})
    cols = ["id", "cluster", (F.col("party") * F.col("blocks") + F.col("block")).alias("block"), "label", "ask"]
    return star.unionByName(_searched(docs, stray.select(*cols).unionByName(resident.select(*cols)), p, ws))


def _searched(docs: DataFrame, places: DataFrame, p: JaccardParams, ws: Workspace) -> DataFrame:
    """Links found in the groups of ``places`` (id, cluster, block, label, ask)."""
    places = ws.cut(places)
    some = SomeSets(docs, places.select("id").distinct(), p)
    links = ws.cut(search_groups(whole_sets(some).join(places, "id"), p))
    some.done()
    ws.drop(places)
    return links


def drop_near_copies(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with the columns of ``docs``.

    Documents without an id stay, as do empty texts, which link with nothing. Of rows that share an id, exact repeats of
    the text go and different texts stay. An empty table gives an empty result.
    """
    found = link_components(docs, p)
    ws = Workspace(docs.sparkSession, "copies")
    gone = ws.cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = ws.cut(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return kept
    row = fresh("row", docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once.select(f"{row}.*"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`link_components` of all ``documents``; its docstring says what becomes of odd rows."""
    return link_components(read(spark, sf_dir, "documents", "doc_id", "text"))
