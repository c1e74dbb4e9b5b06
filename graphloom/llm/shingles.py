"""Word shingles of whole Arrow columns, hashed without a loop over words.

A word's hash is the sum, modulo 2**64, of one table entry for each of its bytes, drawn by the byte and its place
(additive tabulation); a shingle's hash mixes its words' hashes in order. All steps are array operations on the bytes of
many texts; only the sorting of each set is a call of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 64  #: table rows; places further on use them again, times an odd number


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(table of places x bytes, whether a byte belongs to a word). A-Z count as a-z; white space adds nothing."""
    t = np.random.default_rng(20).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
    t[:, 65:91] = t[:, 97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    t[:, space] = 0
    return t.ravel(), ~space


TABLE, IN_WORD = _tables()
#: Letters and digits, and whatever isn't ASCII.
LETTER = np.array([k >= 128 or chr(k).isalnum() for k in range(256)])


def stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, o - o[0]


def _unpunctuated(raw: np.ndarray) -> np.ndarray:
    """Whether a byte of UTF-8 belongs to a word of letters and digits: not ASCII signs, nor U+0080-00BF, U+2000-207F, U+3000-303F."""
    inside = LETTER[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    for first, second, length in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        k = lead[raw[lead] == first]
        if second is not None:
            k = k[np.isin(raw[k + 1], second)]
        for j in range(length):
            inside[k + j] = False
    return inside


def word_hashes(column: pa.Array, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words). Words lie between the six ASCII white-space characters.

    Without ``punctuation``, words are runs of letters and digits, in lower case also beyond ASCII.
    """
    if not punctuation:
        column = pc.utf8_lower(column)
    raw, at = _bytes_of(column)
    inside = IN_WORD[raw] if punctuation else _unpunctuated(raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]  # a text's first byte begins a word, whatever stands before it
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    bound = np.r_[starts[1:], len(raw)]
    place = np.arange(starts[0], len(raw), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), bound - starts)
    v = TABLE[((place & (PLACES - 1)) << 8) + raw[starts[0] :]]
    if not punctuation:
        v[~inside[starts[0] :]] = 0
    if place.max(initial=0) >= PLACES:
        v *= (place.astype(np.uint64) >> np.uint64(6) << np.uint64(1)) | np.uint64(1)
    return stir(np.add.reduceat(v, starts - starts[0])), np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one text after the other; offsets of the texts).

    Fewer words than the width are one shingle, no words none.
    """
    w, at = word_hashes(column)
    n = np.diff(at)
    h = np.full(max(0, len(w) - width + 1), np.uint64(width))
    for j in range(width):
        h = stir(h + w[j : j + len(h)])
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.r_[0, np.cumsum(sizes)]
    flat = h[np.repeat(at[:-1] - out[:-1], sizes) + np.arange(out[-1])] if n.min(initial=width) >= width else np.empty(out[-1], np.uint64)
    if n.min(initial=width) < width:
        long = n >= width
        which = np.repeat(long, sizes)
        flat[which] = h[(np.repeat(at[:-1] - out[:-1], sizes) + np.arange(out[-1]))[which]]
        for k in np.flatnonzero((n > 0) & ~long).tolist():
            one = np.full(1, np.uint64(n[k]))
            for x in w[at[k] : at[k + 1]]:
                one = stir(one + x)
            flat[out[k]] = one[0]
    for a, b in zip(out[:-1].tolist(), out[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    first = out[:-1][sizes > 0]
    keep[first] = True
    ends = np.r_[0, np.cumsum(keep)]
    return flat[keep], ends[out]


class Lookup:
    """Numbers of hashes among sorted distinct ``keys``, -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.bits = keys, max(10, (16 * len(keys)).bit_length())
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(hashes), -1, np.int32)
        among = np.flatnonzero(at < end)
        while len(among):
            here = at[among]
            hit = self.keys[here] == hashes[among]
            out[among[hit]] = here[hit]
            at[among] += 1
            among = among[~hit]
            among = among[at[among] < end[among]]
        return out
