"""Removing passages that an earlier document has, by super-k-mers.

A *window* is ``width`` consecutive words. Its *minimiser* is the run of ``gram``
words in it with the smallest hash. Consecutive windows that share one minimiser
form a super-k-mer and travel as one string to the bucket of that minimiser;
equal windows have equal minimisers, so a bucket sees all of their occurrences.
In the bucket the windows are sorted by their words and counted exactly.

Before any text moves, buckets whose documents all have one id are left out, and
equal super-k-mers become one row with the smallest id. A bucket with many
different super-k-mers is split over salts; its windows meet once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.spans import U64, Hasher, flat, grouped, mix, slices, word_spans
from bidloom.sources.staging import stage_table

WIDTH = 50
GRAM = 12
#: different super-k-mers of one bucket that are sorted in one task
TOGETHER = 2000
#: bytes of text, or words, worked on at once
PIECE = 1 << 20
#: order of a null id: behind every other
LAST = (1 << 63) - 1

_PLACES = "r1 bigint, r2 bigint, ord bigint, start int, n int, bucket bigint, digest bigint"


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a flat text, and the number of words of each row."""
    start, end, per_row = word_spans(data, at)
    out = np.empty(len(start), U64)
    for first in range(0, len(start), PIECE // 8):
        a, b = start[first : first + PIECE // 8], end[first : first + PIECE // 8]
        out[first : first + len(a)] = Hasher(data[a[0] : b[-1]])(a - a[0], b - a[0])
    return out, per_row


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` neighbours, the leftmost of equal ones, by doubling spans."""
    best = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        one, other = best[: len(best) - step], best[step:]
        best = np.where(values[other] < values[one], other, one)
        span += step
    return best


def minimised(words: np.ndarray, per_row: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of all rows: row, first window, number of windows, hash of the minimiser, digest of the words."""
    empty = np.zeros(0, np.int64)
    if len(words) < width:
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    found = []
    first = np.concatenate(([0], np.cumsum(per_row)))
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    for begin in range(0, len(words) - width + 1, PIECE):
        own = words[begin : begin + PIECE + width - 1]
        hasher = Hasher(own)
        grams = hasher.every(gram)
        least = _sliding_least(grams, width - gram + 1)
        row = row_of[begin : begin + len(least)]
        inside = row == row_of[begin + width - 1 : begin + width - 1 + len(least)]
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(change)
        n = np.diff(np.append(start, len(least)))
        whole = inside[start]
        start, n = start[whole], n[whole]
        digest = mix(hasher(start, start + n + width - 1) + U64(0x8CB92BA72F3D8DD7))
        found.append((row[start], begin + start - first[row[start]], n, grams[least[start]], digest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _split(width: int, gram: int):
    """One row for each super-k-mer of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                words, per_row = _word_hashes(*flat(batch.column("text")))
                row, start, n, bucket, digest = minimised(words, per_row, width, gram)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(rows) for c in ("r1", "r2", "ord")),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(bucket.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                    ],
                    ["r1", "r2", "ord", "start", "n", "bucket", "digest"],
                )

    return run


def _pack(width: int):
    """The words of each chosen super-k-mer, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                data, at = flat(batch.column("text"))
                chosen = batch.column("chosen")
                first = chosen.offsets.to_numpy() - chosen.offsets[0].as_py()
                each = chosen.flatten()
                start, n = (each.field(c).to_numpy() for c in ("start", "n"))
                packed = []
                for row in range(batch.num_rows):
                    words = data[at[row] : at[row + 1]].tobytes().split()
                    packed += [
                        b" ".join(words[start[k] : start[k] + n[k] + width - 1]) for k in range(first[row], first[row + 1])
                    ]
                names = ["bucket", "digest", "n", "low", "high", "salts"]
                yield pa.RecordBatch.from_arrays(
                    [*(each.field(c) for c in names), pa.array(packed, pa.binary())], [*names, "packed"]
                )

    return run


def window_ranks(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` neighbours, equal only for equal windows, by sorting pairs of halves."""
    rank, span = ids.astype(np.int64), 1
    while span < width:
        step = min(span, width - span)
        left, right = rank[: len(rank) - step], rank[step:]
        rank = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        span += step
    return rank


def _count(width: int):
    """Stretches of equal least id of each super-k-mer's windows; single windows where a bucket is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _ in grouped(batches, ["bucket", "salt"]):
            texts = whole.column("packed").to_pylist()
            known: dict[bytes, int] = {}
            ids, sizes = [], []
            for text in texts:
                words = text.split()
                ids += [known.setdefault(w, len(known)) for w in words]
                sizes.append(len(words))
            size = np.array(sizes)
            rank = window_ranks(np.array(ids), width)
            n = size - width + 1
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place = (np.cumsum(size) - size)[row] + offset
            own = rank[place]
            low = np.full(int(own.max()) + 1, LAST)
            np.minimum.at(low, own, whole.column("low").to_numpy()[row])
            low = low[own]
            high = whole.column("high").to_numpy()[row]
            split = (whole.column("salts").to_numpy() > 1)[row]
            # windows of an unsplit bucket: stretches; of a split one: each, with the hash of its words
            change = np.ones(len(row), bool)
            change[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | split[1:]
            a = np.flatnonzero(change)
            b = np.append(a[1:], len(row)) - 1
            wanted = split[a] | (low[a] < high[a])
            a, b = a[wanted], b[wanted]
            joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
            words, _ = _word_hashes(joined, np.array([0, len(joined)]))
            window = Hasher(words)(place[a], place[a] + width)
            rows = pa.array(row[a])
            yield pa.RecordBatch.from_arrays(
                [
                    *(whole.column(c).take(rows) for c in ("bucket", "digest", "n", "high")),
                    pa.array(offset[a].astype(np.int32)),
                    pa.array(offset[b].astype(np.int32)),
                    pa.array(low[a]),
                    pa.array(split[a]),
                    pa.array(window.view(np.int64)),
                ],
                ["bucket", "digest", "n", "high", "a", "b", "low", "open", "window"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops covered words."""
    for whole in batches:
        for batch in slices(whole, "text", 4 * PIECE):
            data, at = flat(batch.column("text"))
            runs = batch.column("runs")
            first = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            each = runs.flatten()
            a, b = each.field("a").to_numpy(), each.field("b").to_numpy()
            counts, gone, texts = [], [], []
            for row in range(batch.num_rows):
                words = data[at[row] : at[row + 1]].tobytes().split()
                counts.append(len(words))
                if first[row] < first[row + 1]:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, a[first[row] : first[row + 1]], 1)
                    np.add.at(edge, b[first[row] : first[row + 1]], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                gone.append(counts[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def remove_earlier_passages(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document without the words of passages that a document with a smaller id has too.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes when some window of
    ``width`` words that covers it also starts in a document with a smaller id;
    windows are judged on the input. Returns the id, ``n_words``, ``n_removed``,
    ``kept_sha256`` and ``kept_text`` (kept words joined by one space).

    A null text has no words; a text of fewer than ``width`` words is kept whole,
    and so is the first document that has a passage, however often it repeats it.
    Rows of one id are one document: none is earlier than another, so they never
    remove each other's words, while each is judged on its own text. A null id is
    later than every other id (than all but the largest long) and no null id is
    earlier than another. An empty table gives no rows; other columns are not read.

    Rows are told apart by (id, two hashes of the text), super-k-mers by the
    hash of their minimiser, a hash of their words and their length; windows of
    a bucket are compared word by word, those of a bucket split over salts
    between salts by hash.
    """
    kind = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = kind.select(
        "id",
        "text",
        F.coalesce("id", F.lit(LAST)).alias("ord"),
        F.xxhash64("id", F.isnull("id"), "text").alias("r1"),
        F.xxhash64(F.lit("second"), "id", F.isnull("id"), "text").alias("r2"),
    )
    places = stage_table(rows.select("r1", "r2", "ord", "text").mapInArrow(_split(width, gram), _PLACES), "super-kmers")
    # a bucket of one id alone removes nothing; most of a corpus ends here
    spread = places.groupBy("bucket").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high")
    # written, so that the join reads two plain sides and a hot bucket is split
    shared = stage_table(spread.select("bucket"), "super-kmer-shared")
    hits = stage_table(places.join(shared, "bucket", "left_semi"), "super-kmer-hits")

    named = ["bucket", "digest", "n"]
    variants = hits.groupBy(*named).agg(
        F.min("ord").alias("low"),
        F.max("ord").alias("high"),
        F.min_by(F.struct("r1", "r2", "start"), F.xxhash64("r1", "r2", "start")).alias("at"),
    )
    variants = stage_table(variants, "super-kmer-variants")
    sizes = stage_table(variants.groupBy("bucket").agg(F.count("*").alias("variants")), "super-kmer-sizes")
    salts = F.ceil(F.col("variants") / TOGETHER).cast("long")
    sized = variants.join(sizes, "bucket").withColumn("salts", salts)
    # the windows of a bucket's only super-k-mer occur where it does
    alone = sized.where("variants = 1 and low < high").select(
        *named, F.lit(0).alias("a"), (F.col("n") - 1).alias("b"), "low"
    )
    several = stage_table(sized.where("variants > 1"), "super-kmer-several")
    chosen = several.groupBy("at.r1", "at.r2").agg(
        F.collect_list(F.struct(*named, F.col("at.start").alias("start"), "low", "high", "salts")).alias("chosen")
    )
    # rows that repeat an id and text stand for the same words: one of them is enough
    packed = (
        rows.join(chosen, ["r1", "r2"])
        .select("text", "chosen")
        .mapInArrow(
            _pack(width), "bucket bigint, digest bigint, n int, low bigint, high bigint, salts bigint, packed binary"
        )
        .groupBy(*named, "low", "high", "salts")
        .agg(F.first("packed").alias("packed"))
    )
    laid = (
        packed.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")))
        .repartition("bucket", "salt")
        .sortWithinPartitions("bucket", "salt")
    )
    counted = stage_table(
        laid.mapInArrow(
            _count(width),
            "bucket bigint, digest bigint, n int, high bigint, a int, b int, low bigint, open boolean, window bigint",
        ),
        "super-kmer-windows",
    )
    opened = counted.where("open").drop("low")
    least = counted.where("open").groupBy("bucket", "window").agg(F.min("low").alias("low"))
    across = opened.join(least, ["bucket", "window"]).where("low < high")
    verdicts = stage_table(
        alone.unionByName(counted.where("not open").select(*named, "a", "b", "low")).unionByName(
            across.select(*named, "a", "b", "low")
        ),
        "super-kmer-verdicts",
    )
    covered = F.struct(
        (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + width).alias("b")
    )
    runs = (
        hits.join(verdicts, named)
        .where("low < ord")
        .select("r1", "r2", covered.alias("run"))
        .groupBy("r1", "r2")
        .agg(F.collect_set("run").alias("runs"))
    )
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    cut = rows.join(runs, ["r1", "r2"], "left").select("id", "text", F.coalesce("runs", nothing).alias("runs"))
    kinds = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    return cut.mapInArrow(_cut, kinds).withColumnRenamed("id", id_col)
