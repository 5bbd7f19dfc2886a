"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words whose words ``q`` apart are identical, at least
``max(least, 2 * q)`` words long, that no neighbouring word extends. All runs of
a text are found in time n log n, however periodic it is:

- Prefix doubling sorts the suffixes of a slice of texts (the text comes first in
  the key, so nothing matches across texts). The rank of a suffix after round k
  names its first 2**k words; equal names are one interval of the suffix array.
- For every length B = 2**k blocks are taken at regular places. A run with a period
  from 2 * B - 1 to 4 * B - 2 holds a block whole, and the same words again one
  period on. A wavelet matrix over the suffix array says, for all blocks at once, how
  many occurrences lie in a neighbouring window of at most B starts, and which are
  the first, second and last of them (range successor).
- Three or more occurrences in such a window are an arithmetic progression; its
  difference is a candidate period, as are the distances between the ends and the
  starts of the two progressions of equal words; only where these touch are all members
  candidates (each is then a run of its own).
- A candidate is verified by the longest common extensions in both directions,
  read from the names of all rounds. Equal stretches keep their least period.

Only the words that start a repeated stretch of four enter the wavelet matrix,
so ordinary prose costs little more than the first sort. A text is one row and is
searched by one task; slices of many texts are bounded by characters.

Defined results: null and empty texts have no words and no runs; repeated rows
and null ids are searched like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quadrille.llm.common import bound_batches, with_row

# A run has at least so many words.
LEAST = 12
# Characters of text searched at once; a longer text is a slice of its own.
SLICE = 1 << 20
# The shortest blocks, 2 ** FIRST words, and the distance between them: any 6 words hold one.
FIRST, STRIDE = 2, 3


class Suffixes:
    """Suffix array of numbered words with the names of all dyadic substrings.

    ``ranks[k][i]`` is the first slot of the suffixes that share their first 2**k
    words with suffix i; a suffix that ends sooner shares with none.
    """

    def __init__(self, words: np.ndarray, text_of: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.n = n
        key = text_of.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        self.array = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.full(n + 1, n, np.int32)
        pos, group = self._grouped(self.array, key[self.array], np.arange(n), rank)
        self.ranks = [rank.copy()]
        h = 1
        while len(pos):
            follows = pos + h
            second = np.where(follows < ends[text_of[pos]], rank[np.minimum(follows, n)], -1)
            key = group.astype(np.int64) * (n + 2) + second + 1
            order = np.argsort(key, kind="stable")
            pos, key = pos[order], key[order]
            # The members of a group keep its slots.
            first = np.r_[True, group[1:] != group[:-1]]
            start = np.flatnonzero(first)
            slots = group + (np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])))
            self.array[slots] = pos
            pos, group = self._grouped(pos, key, slots, rank)
            h *= 2
            if len(pos):
                self.ranks.append(rank.copy())

    @staticmethod
    def _grouped(pos: np.ndarray, key: np.ndarray, slots: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set the ranks of sorted suffixes; those that still share theirs, and their group's first slot."""
        if not len(pos):
            return pos, slots
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[start, len(pos)])
        group = np.repeat(slots[start], sizes)
        rank[pos] = group
        shared = np.repeat(sizes > 1, sizes)
        return pos[shared], group[shared]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal those before ``j``, for i < j."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            fits = i >= 1 << k
            low = np.where(fits, i - (1 << k), 0)
            step = (fits & (self.ranks[k][low] == self.ranks[k][j - (1 << k) * fits])).astype(np.int64) << k
            i -= step
            j -= step
        return begin - i


class WaveletMatrix:
    """Counts and selects values in ranges of a permutation, many queries at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, len(values).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.r_[values[zero], values[~zero]]

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in slots low to high are less than ``bound``."""
        low, high, found = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            one = (bound >> bit & 1) == 1
            a, b = before[low], before[high]
            found += np.where(one, b - a, 0)
            low = np.where(one, before[-1] + low - a, a)
            high = np.where(one, before[-1] + high - b, b)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value with ``nth`` smaller ones in slots low to high."""
        low, high, nth, value = low.copy(), high.copy(), nth.copy(), np.zeros(len(low), np.int64)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = before[low], before[high]
            one = nth >= b - a
            nth -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << bit
            low = np.where(one, before[-1] + low - a, a)
            high = np.where(one, before[-1] + high - b, b)
        return value


def _candidates(s: Suffixes, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, period) that hold the least period of every run."""
    base = s.ranks[FIRST]
    count = np.bincount(base[:s.n], minlength=s.n)
    # Slots and places of what occurs more than once, four words at least.
    shared = count[base[:s.n]] > 1
    places = np.flatnonzero(shared)
    slots = np.flatnonzero(shared[s.array])
    number = np.zeros(s.n + 1, np.int64)
    np.cumsum(shared, out=number[1:])
    slot_number = np.zeros(s.n + 1, np.int64)
    np.cumsum(shared[s.array], out=slot_number[1:])
    matrix = WaveletMatrix(number[s.array[slots]])
    begin = np.repeat(starts, sizes)
    for k in range(FIRST, len(s.ranks)):
        size = 1 << k
        names = s.ranks[k]
        count = np.bincount(names[:s.n], minlength=s.n)
        stride = STRIDE if k == FIRST else size
        b = places[(count[names[places]] > 1) & ((places - begin[places]) % stride == 0)]
        windows = ((1, 4), (5, 8), (9, 12), (13, 14)) if k == FIRST else ((2 * size - 1, 3 * size - 2), (3 * size - 1, 4 * size - 2))
        low = slot_number[names[b]]
        high = slot_number[names[b] + count[names[b]]]
        for near, far in windows:
            below = matrix.below(low, high, number[np.minimum(b + near, s.n)])
            n = matrix.below(low, high, number[np.minimum(b + far + 1, s.n)]) - below
            has = n > 0
            at, l, r, c, n = b[has], low[has], high[has], below[has], n[has]
            first = places[matrix.smallest(l, r, c)]
            few = n < 3
            yield at, first - at
            last = places[matrix.smallest(l[few], r[few], c[few] + n[few] - 1)]
            yield at[few], last - at[few]
            many = ~few
            at, first, n = at[many], first[many], n[many]
            step = places[matrix.smallest(l[many], r[many], c[many] + 1)] - first
            yield at, step
            # The stretches of period ``step`` around the block and around its occurrences.
            s1, e1 = at - s.behind(at, at + step), at + step + s.ahead(at, at + step)
            s2, e2 = first - s.behind(first, first + step), first + step + s.ahead(first, first + step)
            apart = s1 != s2
            yield at[apart], (s2 - s1)[apart]
            yield at[apart], (e2 - e1)[apart]
            touch = apart & (e1 >= s2)
            times = n[touch]
            member = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(at[touch], times), np.repeat((first - at)[touch], times) + member * np.repeat(step[touch], times)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and least period of all runs of texts laid side by side, by start, then period; ``words`` are numbers."""
    none = np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    if not len(words):
        return none, none, none
    s = Suffixes(words, np.repeat(np.arange(len(sizes)), sizes), ends)
    if len(s.ranks) <= FIRST:
        return none, none, none
    found = []
    for at, period in _candidates(s, ends - sizes, sizes):
        good = period > 0
        at, period = at[good].astype(np.int64), period[good].astype(np.int64)
        other = at + period
        inside = other < s.n
        at, period, other = at[inside], period[inside], other[inside]
        start, end = at - s.behind(at, other), other + s.ahead(at, other)
        whole = end - start >= np.maximum(least, 2 * period)
        found.append((start[whole], end[whole], period[whole]))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _slice(texts: pa.Array, least: int) -> list[pa.Array]:
    """Columns n_words, runs and collapsed of a slice of texts."""
    split = pc.ascii_split_whitespace(texts)
    flat, bounds = split.values, split.offsets.to_numpy().astype(np.int64)
    flat, bounds = flat[int(bounds[0]):int(bounds[-1])], bounds - bounds[0]
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(filled)]
    offsets = before[bounds]
    words = flat.filter(pa.array(filled))
    sizes = np.diff(offsets)
    start, end, period = find_runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), sizes, least)
    # Words a run contains after its first period go.
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    kept = np.cumsum(depth)[:-1] == 0
    left = np.r_[0, np.cumsum(kept)][offsets]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), " ")
    text_of = np.searchsorted(offsets, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - offsets[text_of]), pa.array(end - start), pa.array(period)], fields=list(RUN))
    by_text = np.searchsorted(text_of, np.arange(len(sizes) + 1))
    return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), runs), collapsed]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most SLICE bytes, or one row."""
    begin = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and held + n > SLICE:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), n_words, ``runs`` by start, then period, and ``collapsed``.

    ``collapsed`` is the text with each run reduced to its first period, words joined by one space.
    """
    bound_batches(docs.sparkSession)
    rows = with_row(docs, text, drop_text=True)
    schema = StructType([rows.schema["row"], *StructType.fromDDL(ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column("row")[a:b], *_slice(texts[a:b], least)],
                                                 names=["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)
