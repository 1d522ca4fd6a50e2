"""Maximal periodic runs of words, by internal pattern matching.

The words of a slice of documents form one sequence with a separator of its own
after each document. Prefix doubling sorts it into a suffix array and, on the
way, numbers every dyadic block (length 2^k at multiples of 2^k): the suffixes
that begin with a block are one interval of the array. A wavelet matrix over the
array answers range successor queries: the next place at or behind x in an
interval. So each block walks through its occurrences in the window behind it;
close ones form arithmetic progressions, taken as a whole. The distances are
candidate periods, extended to both sides by hashes of word sequences.

Why all runs are found: a run of period q and length L >= 2q holds a block of
length 2^k in its first L - q words once 2^(k+1) - 1 <= L - q. For the largest
such k, the block occurs again q <= 2^(k+2) - 2 words later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.spans import U64, Hasher, flat, mix, slices

#: words of the shortest run
SHORTEST = 12
PIECE = 1 << 20

_COLUMNS = {
    "n_words": pa.int64(),
    "n_runs": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "period": pa.int64(),
    "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(),
    "collapsed_sha256": pa.string(),
    "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
    "collapsed": pa.string(),
}


class Blocks:
    """Suffix array of a word sequence, and the interval of every dyadic block in it."""

    def __init__(self, ids: np.ndarray, longest: int) -> None:
        n = len(ids)
        self.sa = np.argsort(ids, kind="stable")
        ordered = ids[self.sa]
        opens = np.ones(n, bool)
        opens[1:] = ordered[1:] != ordered[:-1]
        slot = np.arange(n)
        # the number of a class is the first slot of its suffixes
        rank = np.empty(n, np.int64)
        rank[self.sa] = np.maximum.accumulate(np.where(opens, slot, 0))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = 1
        while True:
            counts = np.bincount(rank, minlength=n)
            lo = rank[::size]
            self.levels.append((lo, lo + counts[lo]))
            if 4 * size - 1 > longest:
                break
            # classes of one suffix are settled; only the others are sorted again
            slots = np.flatnonzero(counts[rank[self.sa]] > 1)
            if not len(slots):
                break
            own = self.sa[slots]
            behind = np.where(own + size < n, rank[np.minimum(own + size, n - 1)] + 1, 0)
            key = rank[own] * (n + 1) + behind
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            self.sa[slots] = own
            new = np.ones(len(own), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
            size *= 2


class Successor:
    """Wavelet matrix: the next value in a range of a permutation."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            sums = np.zeros(self.n + 1, np.int32)
            np.cumsum(one, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(self.n - int(sums[-1]))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` in each range, or ``n``."""
        below = self._below(lo, hi, least)
        found = np.full(len(lo), self.n)
        some = np.flatnonzero(lo + below < hi)
        found[some] = self._nth(lo[some], hi[some], below[some])
        return found

    def _below(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        lo, hi, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            a, b = ones[lo], ones[hi]
            up = (least >> (self.bits - 1 - k)) & 1 == 1
            count += np.where(up, (hi - b) - (lo - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return np.where(least >= self.n, self.n, count)

    def _nth(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        value = np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            low = (hi - b) - (lo - a)
            up = nth >= low
            nth = np.where(up, nth - low, nth)
            value = 2 * value + up
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return value


class Extension:
    """How many words agree from two places on, and before them."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        self._hash = Hasher(mix(ids.astype(U64) + U64(1)))

    def _grown(self, one: np.ndarray, other: np.ndarray, same, room: np.ndarray) -> np.ndarray:
        """Longest agreement up to ``room``: doubled while it holds, then refined."""
        done = np.zeros(len(one), np.int64)
        open_, step = np.arange(len(one)), 1
        while len(open_):
            fits = open_[done[open_] + step <= room[open_]]
            fits = fits[same(one[fits], other[fits], done[fits], step)]
            done[fits] += step
            open_, step = fits, step * 2
        while step > 1:
            step //= 2
            fits = np.flatnonzero(done + step <= room)
            fits = fits[same(one[fits], other[fits], done[fits], step)]
            done[fits] += step
        return done

    def behind(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        def same(a, b, k, step):
            return self._hash(a + k, a + k + step) == self._hash(b + k, b + k + step)

        return self._grown(one, other, same, self.n - other)

    def before(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        def same(a, b, k, step):
            return self._hash(a - k - step, a - k) == self._hash(b - k - step, b - k)

        return self._grown(one, other, same, one)


def candidates(
    blocks: Blocks, successor: Successor, extension: Extension, shortest: int
) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of blocks and their later occurrences nearby."""
    places, distances = [], []
    for k, (first, last) in enumerate(blocks.levels):
        size = 1 << k
        if 4 * size - 1 <= -(-shortest // 2):
            # every run holds a block of twice this size as well
            continue
        block = np.flatnonzero(last - first > 1)
        lo, hi, block = first[block], last[block], block * size
        at, limit = block, np.minimum(block + 4 * size - 2, successor.n - 1)
        while len(block):
            found = successor(lo, hi, at + 1)
            near = found <= limit
            lo, hi, block, at, limit, found = (x[near] for x in (lo, hi, block, at, limit, found))
            places.append(block)
            distances.append(found - block)
            step = found - at
            # two occurrences that overlap by half begin a progression of the block's period
            close = np.flatnonzero(2 * step <= size)
            if len(close):
                d = step[close]
                reach = extension.behind(at[close], found[close])
                members = np.minimum((d + reach - size) // d, (limit[close] - at[close]) // d)
                # the progression from the block itself: its multiples have the period, too
                later = np.flatnonzero((at[close] > block[close]) & (members > 1))
                more = members[later] - 1
                row = np.repeat(later, more)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more) + 2
                places.append(block[close][row])
                distances.append((at[close] - block[close])[row] + nth * d[row])
                found[close] = at[close] + members * d
            at = found
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


def find_runs(ids: np.ndarray, longest: int, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and period; equal neighbours never cross a unique id."""
    if longest < shortest:
        return (np.zeros(0, np.int64),) * 3
    blocks = Blocks(ids, longest)
    extension = Extension(ids)
    place, q = candidates(blocks, Successor(blocks.sa), extension, shortest)
    end = place + q + extension.behind(place, place + q)
    start = place - extension.before(place, place + q)
    whole = end - start >= np.maximum(shortest, 2 * q)
    start, end, q = start[whole], end[whole], q[whole]
    # one stretch found with several periods has the smallest
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _report(shortest: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                yield _of_slice(batch, shortest, texts)

    return run


def _of_slice(batch: pa.RecordBatch, shortest: int, texts: bool) -> pa.RecordBatch:
    data, at = flat(batch.column("text"))
    known: dict[bytes, int] = {}
    words, numbers = [], []
    for row in range(batch.num_rows):
        own = data[at[row] : at[row + 1]].tobytes().split()
        words.append(own)
        numbers += [known.setdefault(w, len(known)) for w in own]
        numbers.append(-1)
    ids = np.array(numbers, np.int64)
    size = np.array([len(w) for w in words])
    apart = np.flatnonzero(ids < 0)
    ids[apart] = len(known) + np.arange(len(apart))
    base = np.concatenate(([0], np.cumsum(size + 1)))
    start, end, period = find_runs(ids, int(size.max(initial=0)), shortest)
    bounds = np.searchsorted(start, base)
    out: dict[str, list] = {name: [] for name in _COLUMNS}
    for row, own in enumerate(words):
        s, e, q = (x[bounds[row] : bounds[row + 1]] for x in (start, end, period))
        s, e = s - base[row], e - base[row]
        length = e - s
        if len(s):
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, s + q, 1)
            np.add.at(edge, e, -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            best = int(np.lexsort((q, s, -length))[0])
            figures = [int(x[best]) for x in (s, length, q)]
            figures.append(1000 * figures[1] // figures[2])
        else:
            figures = [None] * 4
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), length.tolist(), q.tolist(), strict=True))
        collapsed = b" ".join(own)
        values = [
            size[row], len(s), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()
        ]
        if texts:
            values.append([{"start": a, "length": b, "period": c} for a, b, c in zip(s, length, q, strict=True)])
            values.append(collapsed.decode())
        for name, value in zip(out, values, strict=False):
            out[name].append(value)
    arrays = [pa.array(v, _COLUMNS[k]) for k, v in out.items() if texts or k not in ("runs", "collapsed")]
    return pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *list(out)[: len(arrays)]])


def collapse_runs(
    docs: DataFrame, shortest: int = SHORTEST, texts: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with its periodic runs of words, and without their repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of
    words with smallest period q (words q apart are identical) and at least
    ``max(shortest, 2 q)`` words that no neighbouring word extends. A word is
    dropped if some run contains it behind that run's first q words.

    Returns the id, ``n_words``, ``n_runs``; ``start``, ``length``, ``period``
    and ``exponent_milli`` (1000 length / period, rounded down) of the longest
    run, the earliest of equally long ones, null where there is none; digests of
    the list of runs (``start,length,period`` lines by start, then period) and of
    the kept words joined by one space; with ``texts`` also ``runs`` and
    ``collapsed`` themselves.

    Rows are judged one by one, so repeated ids, null ids and equal texts need
    no rule; a null or empty text has no words and no runs. An empty table gives
    no rows; other columns are not read. No row leaves its task: a text of a
    megabyte is worked on alone, smaller ones together. Words are compared as
    they are, sequences of words by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    named = {k: v for k, v in _COLUMNS.items() if texts or k not in ("runs", "collapsed")}
    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    run = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = ", ".join([f"id {id_type}", *(f"{k} {kinds.get(v, run)}" for k, v in named.items())])
    return rows.mapInArrow(_report(shortest, texts), schema).withColumnRenamed("id", id_col)
