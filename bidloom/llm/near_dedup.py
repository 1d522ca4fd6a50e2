"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on full sets.

A signature has one value of 16 bits for each hash function; the distance of two
signatures is the number of values in which they differ. The signature is cut
into chunks. If two signatures differ in fewer than two values a chunk on
average, some chunk has at most one error (pigeonhole), so each chunk is indexed
once for every way to leave one of its values out. Equal keys then find every
pair under the threshold. The number of chunks follows from the similarity, so
that a pair just similar enough stays under the threshold but for one in a
million.

Buckets are worked in three steps, so that no bucket emits all its pairs:
nearest candidates in blocks of a bucket (two rounds, each followed by merging
what was confirmed), then all remaining pairs between different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.components import components
from bidloom.llm.rows import numbered
from bidloom.llm.spans import LOWER, U64, Hasher, flat, grouped, mix, slices, word_spans
from bidloom.sources.staging import stage_table

CHUNK = 5
ERRORS = 1
BLOCK = 256
#: bins of the second, finer sketch that is compared before full sets are; a power of two
BINS = 512
#: share of pairs exactly at the similarity whose signatures may differ in more values than the index allows
MISSED = 1e-6

_seeds = np.random.default_rng(7)
_XOR = _seeds.integers(0, 1 << 63, 512, dtype=np.uint64)
_TIMES = _seeds.integers(0, 1 << 63, 512, dtype=np.uint64) | U64(1)


@dataclass(frozen=True)
class Layout:
    """Chunks of a signature; a pair under ``most`` has a chunk with at most ``ERRORS`` errors."""

    chunks: int

    @property
    def parts(self) -> int:
        return self.chunks * CHUNK

    @property
    def most(self) -> int:
        return self.chunks * (ERRORS + 1) - 1

    @property
    def per_chunk(self) -> int:
        return comb(CHUNK, ERRORS)

    def kept(self) -> list[np.ndarray]:
        """The values each key keeps: a chunk without ``ERRORS`` of its values."""
        inner = list(combinations(range(CHUNK), CHUNK - ERRORS))
        return [np.array([c * CHUNK + i for i in own]) for c in range(self.chunks) for own in inner]

    @classmethod
    def covering(cls, percent: int) -> Layout:
        """The smallest layout that misses at most ``MISSED`` of the pairs at a similarity of ``percent``."""
        p = 1 - percent / 100
        for chunks in range(4, len(_XOR) // CHUNK):
            own = cls(chunks)
            k = own.parts
            if sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(own.most + 1, k + 1)) <= MISSED:
                return own
        raise ValueError(f"no signature is long enough for a similarity of {percent} %")


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and where each row's begin."""
    data, at = flat(column)
    data = LOWER[data]
    start, end, per_row = word_spans(data, at)
    words = Hasher(data)(start, end)
    first = np.concatenate(([0], np.cumsum(per_row)))
    n = np.where(per_row >= width, per_row - width + 1, np.minimum(per_row, 1))
    # the whole sequence of a short text differs from any shingle of full width by its length
    total = len(words)
    rolled = np.full(total, U64(width))
    for k in range(min(width, total)):
        rolled[: total - k] = mix(rolled[: total - k] * U64(0x9FB21C651E98DF25) + words[k:])
    sets, ends = [], [0]
    for row in range(len(per_row)):
        a = first[row]
        if per_row[row] >= width:
            own = np.unique(rolled[a : a + n[row]])
        elif per_row[row]:
            value = np.array([per_row[row]], U64)
            for w in words[a : a + per_row[row]]:
                value = mix(value * U64(0x9FB21C651E98DF25) + w)
            own = value
        else:
            own = np.zeros(0, U64)
        sets.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.array(ends)


def signatures(hashes: np.ndarray, ends: np.ndarray, parts: int) -> np.ndarray:
    """One row of 16-bit values for each set; zeros for an empty one."""
    out = np.zeros((len(ends) - 1, parts), np.uint16)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        for j in range(parts):
            low = np.minimum.reduceat((hashes ^ _XOR[j]) * _TIMES[j], ends[:-1][full])
            out[full, j] = (mix(low) >> U64(48)).astype(np.uint16)
    return out


def binned(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``BINS`` values of 8 bits for each sorted set: the smallest hash of each bin, 0 for an empty bin."""
    out = np.zeros((len(ends) - 1, BINS), np.uint8)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    bins = (hashes >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
    out[row[first], bins[first]] = mix(hashes[first]) % U64(255) + U64(1)
    return out


def bin_limit(filled: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of the ``filled`` bins may differ in a pair that is similar enough.

    ``sizes`` are the sums of both set sizes, which bound the union. The smallest
    elements of the filled bins are drawn from the union without replacement, so
    their differences are hypergeometric; five deviations and two more are above
    all but one in a million. More filled bins than the union holds rule a pair out.
    """
    apart = 1 - percent / 100
    union = np.floor(sizes * 100 / (100 + percent))
    left = np.maximum(union - filled, 0) / np.maximum(union - 1, 1)
    most = np.floor(filled * apart + 5 * np.sqrt(filled * apart * (1 - apart) * left) + 2)
    return np.where(filled <= union, most, -1)


def _as_matrix(column: pa.Array, kind: type = np.uint16) -> np.ndarray:
    data, at = flat(column)
    return data.view(kind).reshape(len(at) - 1, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def sketch(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """(id, doc, n, digest, sig, bins) of every row of (id, doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, ends = shingle_sets(batch.column("text"), width)
                view = memoryview(hashes.tobytes())
                digests = [
                    hashlib.blake2b(view[8 * a : 8 * b], digest_size=16).digest()
                    for a, b in zip(ends[:-1], ends[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("doc"),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(digests, pa.binary()),
                        _binary(signatures(hashes, ends, parts)),
                        _binary(binned(hashes, ends)),
                    ],
                    ["id", "doc", "n", "digest", "sig", "bins"],
                )

    return rows.mapInArrow(run, "id bigint, doc bigint, n bigint, digest binary, sig binary, bins binary")


def _keys_of(layout: Layout, which: list[int]):
    """Turns (rep, sig) rows into one (key, rep, k) row for each index k in ``which``."""
    kept = layout.kept()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, sig = batch.column("rep").to_numpy(), _as_matrix(batch.column("sig")).astype(U64)
            for k in which:
                key = np.full(len(rep), U64(k + 1))
                for part in kept[k]:
                    key = mix(key * U64(0x9FB21C651E98DF25) + sig[:, part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(rep), pa.array(np.full(len(rep), k, np.int32))],
                    ["key", "rep", "k"],
                )

    return run


def index(reps: DataFrame, layout: Layout, which: list[int]) -> DataFrame:
    """(key, rep, k, size): the members of every bucket with at least two."""
    rows = reps.select("rep", "sig").mapInArrow(_keys_of(layout, which), "key bigint, rep bigint, k int")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "key")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of one block and another."""
    out = np.zeros((len(a), len(b)), np.int16)
    for j in range(a.shape[1]):
        out += a[:, j, None] != b[None, :, j]
    return out


def _nearest(layout: Layout):
    """For each member of a block its nearest member of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in grouped(batches, ["key", "block"]):
            rep, root = batch.column("rep").to_numpy(), batch.column("root").to_numpy()
            sig = _as_matrix(batch.column("sig"))
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2 or (root[a:b] == root[a]).all():
                    continue
                far = _distances(sig[a:b], sig[a:b])
                far[root[a:b, None] == root[None, a:b]] = layout.parts + 1
                near = far.argmin(axis=1)
                least = far[np.arange(b - a), near]
                ok = np.flatnonzero(least <= layout.most)
                found.append((rep[a:b][ok], rep[a:b][near[ok]], least[ok]))
            if found:
                one, other, dist = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(other), pa.array(dist.astype(np.int64))], ["rep", "near", "dist"]
                )

    return run


def _remaining(layout: Layout, percent: int):
    """Pairs of different components under both distances, each in the first bucket that has both."""
    kept = layout.kept()

    def alike(one: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), bool)
        for start in range(0, len(one), 16384):
            a, b = one[start : start + 16384], other[start : start + 16384]
            most = bin_limit(((a | b) != 0).sum(axis=1), sizes[start : start + 16384], percent)
            out[start : start + 16384] = (a != b).sum(axis=1) <= most
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in grouped(batches, ["key", "block", "probe"]):
            rep, root, role = (batch.column(c).to_numpy() for c in ("rep", "root", "role"))
            k, sig = batch.column("k").to_numpy(), _as_matrix(batch.column("sig"))
            bins, n = _as_matrix(batch.column("bins"), np.uint8), batch.column("n").to_numpy()
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, probes = (a + np.flatnonzero(role[a:b] == r) for r in (0, 1))
                if not len(own) or not len(probes):
                    continue
                ok = _distances(sig[own], sig[probes]) <= layout.most
                ok &= root[own, None] != root[None, probes]
                x, y = np.nonzero(ok)
                x, y = own[x], probes[y]
                for earlier in kept[: k[a]]:
                    if not len(x):
                        break
                    seen = (sig[x][:, earlier] == sig[y][:, earlier]).all(axis=1)
                    x, y = x[~seen], y[~seen]
                near = alike(bins[x], bins[y], n[x] + n[y])
                x, y = x[near], y[near]
                found.append((np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _confirm(width: int, percent: int):
    """Keeps the pairs whose full sets are similar enough, and marks the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 19):
                left, left_at = shingle_sets(batch.column("text_a"), width)
                right, right_at = shingle_sets(batch.column("text_b"), width)
                linked = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    one, other = left[left_at[i] : left_at[i + 1]], right[right_at[i] : right_at[i + 1]]
                    both = len(one) + len(other)
                    merged = np.sort(np.concatenate((one, other)))
                    shared = int((merged[1:] == merged[:-1]).sum())
                    linked[i] = 100 * shared >= percent * (both - shared)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"]
                )

    return run


class _Links:
    """The classes, what is confirmed about them so far, and their components."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> None:
        self.docs, self.reps, self.width, self.percent = docs, reps, width, percent
        self.checked: DataFrame | None = None
        self.roots: DataFrame | None = None

    def rooted(self, members: DataFrame) -> DataFrame:
        if self.roots is None:
            return members.withColumn("root", F.col("rep"))
        named = self.roots.select(F.col("node").alias("rep"), F.col("root").alias("_root"))
        return members.join(named, "rep", "left").withColumn("root", F.coalesce("_root", "rep")).drop("_root")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of new pairs (a < b) and merge what they link."""
        pairs = pairs.where("a <> b").distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        texts = self.docs
        with_both = (
            stage_table(pairs, "near-pairs")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        )
        checked = with_both.mapInArrow(_confirm(self.width, self.percent), "a bigint, b bigint, linked boolean")
        checked = stage_table(checked, "near-checked")
        self.checked = checked if self.checked is None else stage_table(self.checked.unionByName(checked), "near-checked")
        self.roots = components(self.checked.where("linked").select("a", "b"))


def near_components(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    unique: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id, kept): near-duplicate components of all documents.

    A document's set is its distinct ``width``-word shingles after lower-casing
    A to Z; a text with fewer words has its whole sequence as the one element.
    Documents whose sets have 100 * intersection >= ``percent`` * union are
    linked, and ``component_id`` is the smallest id a document reaches, itself
    included; ``kept`` marks that document.

    A null or blank text has an empty set and is linked with nothing. Rows are
    told apart by a number of their own, so an id on several rows is several
    documents, each judged by its text. A null id is never the smallest: a
    component without any other id is null, and its rows are kept. With
    ``unique`` the ids are known to be unique and not null, and stand for the
    numbers. An empty table gives no rows. Other columns are not read.

    Finding: documents with equal sets form a class, its smallest id stands for
    it; classes are compared through the index of this module with the limits
    named there.
    """
    layout = Layout.covering(percent)
    kept, row = (docs, id_col) if unique else numbered(docs)
    rows = kept.select(
        F.col(row).cast("bigint").alias("id"), F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")
    )
    sketched = stage_table(sketch(rows, width, layout.parts), "near-sketches")
    full = sketched.where("n > 0")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"), F.min("doc").alias("low"))
    classes = classes.select(F.col("digest").alias("_d"), "rep", "low")
    reps = stage_table(
        full.join(classes, (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep"))).select(
            "rep", "low", "sig", "bins", "digest", "n"
        ),
        "near-classes",
    )
    texts = rows.select("id", "text")
    links = _Links(texts, reps, width, percent)
    signed = reps.select("rep", "sig")

    def spread(which: list[int]) -> DataFrame:
        members = links.rooted(index(reps, layout, which))
        block = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("size") / BLOCK))
        return members.withColumn("block", block.cast("long"))

    for turn in range(2):
        # one key of each chunk: similar sets share most of them
        blocks = spread([c * layout.per_chunk + turn for c in range(layout.chunks)]).join(signed, "rep")
        laid = blocks.select("key", "block", "rep", "root", "sig").repartition("key", "block")
        near = laid.sortWithinPartitions("key", "block").mapInArrow(_nearest(layout), "rep bigint, near bigint, dist bigint")
        if not turn:
            near = near.groupBy("rep").agg(F.min_by("near", "dist").alias("near"))
        links.confirm(near.select(F.least("rep", "near").alias("a"), F.greatest("rep", "near").alias("b")))

    members = links.rooted(index(reps, layout, list(range(layout.chunks * layout.per_chunk))))
    members = stage_table(members, "near-members")
    counts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = (
        counts.groupBy("key")
        .agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots"), F.sum("n").alias("size"), F.max("n").alias("most"))
        .where("roots > 1")
        .select("key", "main", (F.col("size") - F.col("most")).alias("others"))
    )
    mixed = stage_table(mixed, "near-mixed")
    open_rows = members.join(mixed, "key").join(reps.select("rep", "sig", "bins", "n"), "rep")
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    n_probes = F.ceil(F.col("others") / (8 * BLOCK)).cast("int")
    own_block = F.pmod(F.xxhash64("rep", "key"), n_blocks).cast("long")
    own_probe = F.pmod(F.xxhash64("key", "rep"), n_probes).cast("long")
    many = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("long"))
    cells = F.transform(many(n_probes), lambda p: F.struct(own_block.alias("block"), p.alias("probe"), F.lit(0).alias("role")))
    probes = F.transform(many(n_blocks), lambda b: F.struct(b.alias("block"), own_probe.alias("probe"), F.lit(1).alias("role")))
    placed = open_rows.select(
        "key", "k", "rep", "root", "sig", "bins", "n",
        F.explode(F.when(F.col("root") == F.col("main"), cells).otherwise(F.concat(cells, probes))).alias("_c"),
    ).select("key", "_c.*", "k", "rep", "root", "sig", "bins", "n")
    laid = placed.repartition("key", "block", "probe").sortWithinPartitions("key", "block", "probe")
    links.confirm(laid.mapInArrow(_remaining(layout, percent), "a bigint, b bigint"))

    named = links.rooted(reps.select("rep", "digest", "low"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("digest", "component_id")
    plain = sketched.select("doc", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    own = F.col("component_id")
    return plain.join(named, "digest", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, own).otherwise(F.col("doc")).alias("component_id"),
        ((F.col("n") == 0) | own.isNull() | F.coalesce(F.col("doc") == own, F.lit(False))).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, the first of equal ids, null behind every other; all columns kept."""
    rows, row = numbered(docs)
    groups = near_components(rows, width, percent, row, text_col, unique=True).select(row, "component_id")
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col(row).alias("row"))).alias("first")
    kept = groups.join(rows.select(row, id_col), row).groupBy("component_id").agg(first).select(F.col("first.row").alias("_kept"))
    return rows.join(kept, F.col(row) == F.col("_kept"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
