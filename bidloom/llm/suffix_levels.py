"""Removing repeated passages with a logarithmic family of suffix arrays.

A suffix array of all bytes would take many times the text. What is indexed is
sampled: the suffixes at *anchors*, the positions whose hash is the smallest in
some stretch of windows. Equal windows pick equal anchors, and an anchor lies so
that ``core`` bytes of the window follow it, so any two places with ``length``
equal bytes have anchors whose suffixes agree in at least ``core`` bytes.

The suffixes of each batch form a sorted level (by the hash of their first
``core`` bytes). A new batch is scanned against the levels there are; suffixes
that meet another one are seeds. Two levels of one size merge into one of twice
the size, so a suffix is rewritten as often as the logarithm of the number of
batches. The windows around seeds are then compared over their full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.spans import U64, Hasher, flat, grouped, mix, slices
from bidloom.llm.rows import numbered
from bidloom.sources.staging import stage_table

LENGTH = 400
CORE = 128
GRAM = 16
BATCHES = 4
#: variants of one passage compared in one task
TOGETHER = 2000
PIECE = 1 << 20

SUFFIXES = "key bigint, id bigint, pos bigint, lo int, hi int, span bigint"


def _pieces(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of overlapping pieces of long rows, so that memory stays bounded."""
    for row in range(len(at) - 1):
        start, end = int(at[row]), int(at[row + 1])
        while end - start >= length:
            stop = min(end, start + PIECE)
            yield row, start, stop
            if stop == end:
                break
            start = stop - length + 1


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Anchors of one flat text of at least ``length`` bytes.

    Returns the positions, the first and last window start each stands for, the
    hash of its core and the hash of everything its windows span.
    """
    gram = min(GRAM, core)
    width = length - core + 1
    hasher = Hasher(data)
    grams = hasher.every(gram)[: len(data) - core + 1]
    # the hash above, the place below: the minimum is the leftmost of the smallest
    packed = (grams & ~U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=U64)
    at = (_sliding_minimum(packed, width) & U64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    lo, hi = change, np.concatenate((change[1:], [len(at)])) - 1
    pos = at[change]
    # the span's hash holds where the anchor lies in it, so equal spans mean equal windows
    span = mix(hasher(lo, hi + length) + (pos - lo).astype(U64) * U64(0x9E3779B97F4A7C15))
    return pos, lo, hi, hasher(pos, pos + core), span


def suffixes(docs: DataFrame, length: int, core: int) -> DataFrame:
    """One row per anchor of every document of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                data, at = flat(batch.column("text"))
                ids = batch.column("id").to_numpy()
                found = []
                for row, start, end in _pieces(at, length):
                    pos, lo, hi, key, span = anchors(data[start:end], length, core)
                    base = start - int(at[row])
                    found.append((key, np.full(len(pos), ids[row]), pos + base, pos - lo, hi - pos, span))
                if found:
                    key, one, pos, lo, hi, span = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(one),
                            pa.array(pos),
                            pa.array(lo.astype(np.int32)),
                            pa.array(hi.astype(np.int32)),
                            pa.array(span.view(np.int64)),
                        ],
                        ["key", "id", "pos", "lo", "hi", "span"],
                    )

    return docs.select("id", "text").mapInArrow(run, SUFFIXES)


@dataclass
class Levels:
    """Sorted suffix tables of doubling size; a batch of documents is the smallest."""

    tables: dict[int, DataFrame] = field(default_factory=dict)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch; returns the keys of suffixes that meet another one, in it or in a level."""
        run = self._sorted(batch)
        seeds = self.scan(run)
        size = 0
        while size in self.tables:
            run = self._sorted(self.tables.pop(size).unionByName(run))
            size += 1
        self.tables[size] = run
        return seeds

    @staticmethod
    def _sorted(suffixes: DataFrame) -> DataFrame:
        """A written level in key order; a key that a third of all suffixes share spreads over ranges by place."""
        order = ["key", "id", "pos"]
        return stage_table(suffixes.repartitionByRange(*order).sortWithinPartitions(*order), "suffix-level")

    def scan(self, batch: DataFrame) -> DataFrame:
        """Merge a batch's keys with those of all levels; what comes together with another is a seed."""
        met = None
        for table, new in [(batch, True), *[(t, False) for t in self.tables.values()]]:
            # counted inside each split first: a key that a third of all suffixes share moves as a few rows
            counts = table.groupBy("key").agg(F.count("*").alias("n")).withColumn("new", F.lit(new))
            met = counts if met is None else met.unionByName(counts)
        merged = met.groupBy("key").agg(F.sum("n").alias("n"), F.bool_or("new").alias("new"))
        return merged.where("n > 1 and new").select("key")


def _cut_contexts(length: int):
    """The bytes that each seed's windows span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                data, at = flat(batch.column("text"))
                seeds = batch.column("seeds")
                first = seeds.offsets.to_numpy() - seeds.offsets[0].as_py()
                each = seeds.flatten()
                key, span, pos, lo, hi = (each.field(c).to_numpy() for c in ("key", "span", "pos", "lo", "hi"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                start = at[row] + pos - lo
                end = at[row] + pos + hi + length
                context = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(span), pa.array(lo), pa.array(hi), pa.array(context, pa.binary())],
                    ["key", "span", "lo", "hi", "context"],
                )

    return run


def _window_hashes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset of the anchor in the window, and hash of every window of a batch of contexts."""
    data, at = flat(batch.column("context"))
    lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    n = lo + hi + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = at[row] + step
    return row, lo[row] - step, Hasher(data)(start, start + length)


def _compare(length: int):
    """Windows of one passage that occur in two contexts, and those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _ in grouped(batches, ["key", "salt"]):
            # a window counts within its passage and salt, at one distance from the anchor
            row, offset, window = _window_hashes(whole, length)
            key = whole.column("key").to_numpy().view(U64)
            salt = whole.column("salt").to_numpy().view(U64)
            own = mix(key ^ mix(salt))[row]
            place = mix(window ^ mix(own + offset.astype(U64)))
            _, inverse, count = np.unique(place, return_inverse=True, return_counts=True)
            twice = count[inverse] > 1
            # one row per context: the outermost repeated windows
            lo, hi = whole.column("lo").to_numpy(), whole.column("hi").to_numpy()
            left, right = np.full(len(lo), -(1 << 30)), np.full(len(lo), -(1 << 30))
            np.maximum.at(left, row[twice], offset[twice])
            np.maximum.at(right, row[twice], -offset[twice])
            split = whole.column("salts").to_numpy() > 1
            # windows of a passage that is split over salts meet once more: one row for each distinct one
            first = np.zeros(len(row), bool)
            first[np.unique(place, return_index=True)[1]] = True
            sent = first & split[row]
            spans = whole.column("span").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((whole.column("key").to_numpy(), whole.column("key").to_numpy()[row[sent]]))),
                    pa.array(np.concatenate((spans, spans[row[sent]]))),
                    pa.array(np.concatenate((left, offset[sent])).astype(np.int32)),
                    pa.array(np.concatenate((right, -offset[sent])).astype(np.int32)),
                    pa.array(np.concatenate((np.zeros(len(lo), np.int64), mix(window + mix(offset.astype(U64)))[sent].view(np.int64)))),
                    pa.array(np.concatenate((np.zeros(len(lo), bool), np.ones(int(sent.sum()), bool)))),
                ],
                ["key", "span", "lo", "hi", "window", "open"],
            )

    return run


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes covered bytes and counts maximal runs."""
    for whole in batches:
        for batch in slices(whole, "text", 4 * PIECE):
            data, at = flat(batch.column("text"))
            gone, spans, kept, texts = [], [], [], []
            runs = batch.column("runs")
            first = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            each = runs.flatten()
            a_all, b_all = each.field("a").to_numpy(), each.field("b").to_numpy()
            for row in range(batch.num_rows):
                own = data[at[row] : at[row + 1]]
                a, b = a_all[first[row] : first[row + 1]], b_all[first[row] : first[row + 1]]
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    opens = np.concatenate(([True], a[1:] > b[:-1]))
                    a, b = a[opens], b[np.concatenate((np.flatnonzero(opens)[1:], [len(opens)])) - 1]
                    edge = np.zeros(len(own) + 1, np.int8)
                    edge[a] += 1
                    edge[b] -= 1
                    own = own[np.cumsum(edge[:-1], dtype=np.int8) == 0]
                gone.append(int((b - a).sum()))
                spans.append(len(a))
                rest = own.tobytes()
                kept.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(at)),
                    pa.array(gone, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(texts, pa.binary()),
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
            )


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    core: int = CORE,
    batches: int = BATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document without the bytes that a repeated ``length``-byte string covers.

    Texts are taken as UTF-8 bytes. A byte goes when some string of ``length``
    bytes that covers it also starts anywhere else, in another document or the
    same one; overlapping occurrences count, strings do not cross documents and
    are judged on the input. Returns the id, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept_bytes``
    (binary: a cut may fall inside a character).

    A null text counts as empty. Rows are told apart by a number of their own:
    rows that repeat an id and rows with a null id are documents like any other,
    and two rows with one text repeat each other's strings. An empty table gives
    no rows. Other columns are not read. Equality of strings is that
    of 64-bit hashes under one anchor.

    A passage that thousands of documents share is one row for each distinct
    surrounding before any text moves; the variants of one anchor are split over
    salts of about ``TOGETHER`` and their distinct windows meet in a second step.
    """
    kept, row = numbered(docs)
    rows = kept.select(
        F.col(row).alias("id"), F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")
    )
    family = Levels()
    seeds = None
    indexed = stage_table(
        suffixes(rows, length, core).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))), "suffixes"
    )
    for number in range(batches):
        met = family.add(indexed.where(F.col("batch") == number).drop("batch"))
        seeds = met if seeds is None else seeds.unionByName(met)
    keys = stage_table(seeds.distinct(), "suffix-seeds")
    hits = None
    for table in family.tables.values():
        own = table.join(keys, "key", "left_semi")
        hits = own if hits is None else hits.unionByName(own)
    hits = stage_table(hits, "suffix-hits")

    # seeds with equal surroundings are one variant; two of them already repeat every window
    variants = hits.groupBy("key", "span", "lo", "hi").agg(
        F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "pos")).alias("id"), F.min_by("pos", F.xxhash64("id", "pos")).alias("pos")
    )
    variants = stage_table(variants, "suffix-variants")
    many = variants.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1")
    salts = F.ceil(F.col("variants") / TOGETHER).cast("long")
    compared = variants.join(many, "key").select(
        "id", F.struct("key", "span", "pos", "lo", "hi").alias("seed")
    ).groupBy("id").agg(F.collect_list("seed").alias("seeds"))
    contexts = (
        rows.join(compared, "id")
        .select("text", "seeds")
        .mapInArrow(_cut_contexts(length), "key bigint, span bigint, lo int, hi int, context binary")
        .join(many, "key")
        .withColumn("salts", salts)
        .withColumn("salt", F.pmod(F.xxhash64("span", "key"), salts))
        .drop("variants")
    )
    laid = contexts.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = stage_table(
        laid.mapInArrow(_compare(length), "key bigint, span bigint, lo int, hi int, window bigint, open boolean"),
        "suffix-windows",
    )
    # a window sent by two salts of one passage repeats; equal windows in one salt were counted there
    sent = found.where("open")
    across = sent.groupBy("key", "window").agg(F.count("*").alias("n")).where("n > 1").select("key", "window")
    columns = ["key", "span", "lo", "hi"]
    repeated = (
        found.where("not open")
        .select(*columns)
        .unionByName(sent.join(across, ["key", "window"]).select(*columns))
        .unionByName(variants.where("n > 1").select(*columns))
        .groupBy("key", "span")
        .agg(F.max("lo").alias("_left"), F.max("hi").alias("_right"))
        .where("_left + _right >= 0")
    )
    # every window of a seed contains its anchor, so what they cover is one run
    runs = (
        hits.join(stage_table(repeated, "suffix-repeats"), ["key", "span"])
        .select("id", F.struct((F.col("pos") - F.col("_left")).alias("a"), (F.col("pos") + F.col("_right") + length).alias("b")).alias("run"))
        .groupBy("id")
        .agg(F.collect_set("run").alias("runs"))
    )
    nothing = F.array().cast("array<struct<a:bigint,b:bigint>>")
    cut = rows.join(runs, "id", "left").select(F.col("doc").alias("id"), "text", F.coalesce("runs", nothing).alias("runs"))
    kind = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary"
    return cut.mapInArrow(_cut_text, kind).withColumnRenamed("id", id_col)
