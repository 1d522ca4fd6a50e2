"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds
cut the score: P(grade <= j) = logistic(threshold_j - score). The expected grade
ranks documents, and the probability of reaching a grade selects them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.spans import LOWER, U64, Hasher, flat, mix, slices, word_spans

BITS = 20
#: bytes at the start of a word that are features: a toxic stem is common with many endings, each of them rare
HEADS = (5, 7, 8)
#: labelled rows that a model is fitted on at most
SAMPLE = 8000
#: parts of the ratings that are held out in turn to find the cut
FOLDS = 5
#: gradient steps, their length, strength of the prior, and the share of good rows that the cut keeps
ROUNDS, RATE, PRIOR, CLEAN = 300, 0.05, 25.0, 0.993

_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of every row, and where each row's begin.

    A row's features are its words after lower-casing A to Z and without one
    closing mark, the first five, seven and eight (``HEADS``) and the last three
    bytes of each word, and the share of words that repeat the one before, in tenths rounded up.
    """
    data, at = flat(column)
    data = LOWER[data]
    start, end, per_row = word_spans(data, at)
    hasher = Hasher(data)
    bare = end - (_CLOSING[data[end - 1]] & (end - start > 1))
    words = hasher(start, bare)
    tails = mix(hasher(np.maximum(start, end - 3), end) + U64(1))
    heads = [mix(hasher(start, np.minimum(bare, start + k)) + U64(95 + k)) for k in HEADS]
    row = np.repeat(np.arange(len(per_row)), per_row)
    again = row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])]
    times = np.bincount(again, minlength=len(per_row))
    tenths = -(-10 * times // np.maximum(per_row, 1))
    repeat = mix(tenths.astype(U64) + U64(2))
    mask = U64((1 << bits) - 1)
    number = np.concatenate((words, *heads, tails, repeat)) & mask
    owner = np.concatenate((*[row] * (len(heads) + 2), np.arange(len(per_row)))).astype(U64)
    pairs = np.unique((owner << U64(bits)) | number)
    ends = np.searchsorted(pairs, np.arange(len(per_row) + 1, dtype=np.int64).astype(U64) << U64(bits))
    return (pairs & mask).astype(np.int32), ends


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ends[1:]] - total[ends[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights by feature number, ascending thresholds between grades, and the score from which a grade is granted."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int
    cuts: np.ndarray

    def score(self, number: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _sums(self.weights[number], ends)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """One column for each grade above the lowest: the probability of reaching it."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def evidence(number: np.ndarray, ends: np.ndarray, grade: np.ndarray, grades: int, bits: int) -> np.ndarray:
    """How strongly each feature speaks for a lower grade than the highest, about in standard errors.

    The signed root of the likelihood ratio of each lower grade against the
    highest, less the 1 that chance alone gives; the strongest grade counts. It
    is exact enough for words in a handful of documents, where a mean grade is
    ruled by the lowest one. A feature of one row alone cannot be told from that row.
    """
    of = np.repeat(grade.astype(np.int8), np.diff(ends))
    counts = [np.bincount(number[of == g], minlength=1 << bits).astype(np.float64) for g in range(grades)]
    sizes = np.bincount(grade, minlength=grades)
    best = np.zeros(1 << bits)
    for low in range(grades - 1):
        if not sizes[low] or not sizes[-1]:
            continue
        base = sizes[low] / (sizes[low] + sizes[-1])
        bad, good = counts[low], counts[-1]
        share = np.clip(bad / np.maximum(bad + good, 1), 1e-12, 1 - 1e-12)
        ratio = bad * np.log(share / base) + good * np.log((1 - share) / (1 - base))
        best = np.maximum(best, np.where(share > base, np.sqrt(2 * np.maximum(ratio, 0)), 0))
    return np.where(sum(counts) > 1, np.maximum(best - 1, 0), 0)


def _climb(
    number: np.ndarray,
    ends: np.ndarray,
    grade: np.ndarray,
    part: np.ndarray,
    grades: int,
    bits: int,
    rounds: int,
    rate: float,
    prior: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all features and thresholds; ``part`` is how much each row counts, 1 on average."""
    n = max(len(grade), 1)
    rows = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(ends))
    scale = evidence(number, ends, grade, grades, bits)
    used = np.flatnonzero(scale)
    # features are numbered densely; those without evidence are gone before anything is computed
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    own = place[number]
    own, rows = own[own >= 0], rows[own >= 0]
    value = scale[used][own]
    cuts = np.searchsorted(rows, np.arange(len(grade) + 1))
    split = len(used)
    share = np.bincount(grade, weights=part, minlength=grades)[:-1].cumsum() / n
    share = np.clip(share, 0.01, 0.99) if len(grade) else np.full(grades - 1, 0.5)
    first = np.log(share / (1 - share))
    first = np.maximum.accumulate(first + 1e-3 * np.arange(grades - 1))
    # the free values: scaled weights, the lowest threshold and the logs of the gaps above it
    free = np.concatenate((np.zeros(split), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    mean, square = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, rounds + 1):
        thresholds = np.cumsum(np.concatenate((free[split : split + 1], np.exp(free[split + 1 :]))))
        score = _sums(free[own] * value, cuts)
        edge = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper, lower = _logistic(edge[grade + 1] - score), _logistic(edge[grade] - score)
        likely = np.maximum(upper - lower, 1e-9)
        up, down = part * upper * (1 - upper) / likely, part * lower * (1 - lower) / likely
        slope = np.zeros_like(free)
        slope[:split] = np.bincount(own, weights=(up - down)[rows] * value, minlength=split) / n + prior / n * free[:split]
        by_edge = np.zeros(grades + 1)
        np.subtract.at(by_edge, grade + 1, up / n)
        np.add.at(by_edge, grade, down / n)
        above = np.cumsum(by_edge[1:-1][::-1])[::-1]
        slope[split] = above[0]
        slope[split + 1 :] = above[1:] * np.exp(free[split + 1 :])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        free -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        free[:split] = np.minimum(free[:split], 0)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = free[:split] * scale[used]
    return weights, np.cumsum(np.concatenate((free[split : split + 1], np.exp(free[split + 1 :]))))


def fit_arrays(
    number: np.ndarray,
    ends: np.ndarray,
    grade: np.ndarray,
    grades: int,
    bits: int = BITS,
    rounds: int = ROUNDS,
    rate: float = RATE,
    prior: float = PRIOR,
    clean: float = CLEAN,
    part: np.ndarray | None = None,
    fold: np.ndarray | None = None,
) -> OrdinalModel:
    """Maximum likelihood with a normal prior, by gradient steps with per-weight scaling.

    Every feature with some ``evidence`` gets a weight in units of it, never above
    0: what speaks for a document is that nothing speaks against it, however
    short it is. Each row is scored by a model of the other ``fold`` numbers,
    and a grade is granted from the score that ``clean`` of the rows of this grade
    or a higher one reach there, so that the cut follows from what the ratings can
    tell. ``part`` is how many rated rows each row stands for.
    """
    part = np.ones(len(grade)) if part is None else part / max(part.mean(), 1e-9)
    fold = np.arange(len(grade)) % FOLDS if fold is None else fold
    settings = (grades, bits, rounds, rate, prior)
    held = np.zeros(len(grade))
    for k in np.unique(fold):
        held[fold == k] = _held_out(number, ends, grade, part, fold == k, *settings)
    weights, thresholds = _climb(number, ends, grade, part, *settings)
    return OrdinalModel(weights, thresholds, bits, _cuts(held, grade, grades, clean))


def _held_out(number, ends, grade, part, out, grades, bits, *settings) -> np.ndarray:
    """Scores of the rows ``out`` by a model of the others."""
    sizes = np.diff(ends)
    train = np.repeat(~out, sizes)
    ends_in, ends_out = (np.concatenate(([0], np.cumsum(sizes[m]))) for m in (~out, out))
    weights, _ = _climb(number[train], ends_in, grade[~out], part[~out], grades, bits, *settings)
    return _sums(weights[number[~train]], ends_out)


def _cuts(held: np.ndarray, grade: np.ndarray, grades: int, clean: float) -> np.ndarray:
    cuts = np.zeros(grades - 1)
    for g in range(1, grades):
        reached = np.sort(held[grade >= g])
        # from the first row that need not be lost; a score of 0 always stays
        cuts[g - 1] = min(reached[int((1 - clean) * len(reached))], 0.0) if len(reached) else 0.0
    return cuts


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for the stages behind this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# kinds of rows that a fitting task returns
_HELD, _WEIGHT, _THRESHOLD = range(3)
_FITTED = "kind int, place bigint, value double"


def _fit_part(grades: int, bits: int, stands_for: np.ndarray):
    """One fold's held-out scores, or for the number behind the last fold the model of all rows."""
    settings = (grades, bits, ROUNDS, RATE, PRIOR)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return fitted(key[0].as_py(), table.sort_by([("id", "ascending")]).combine_chunks())
        finally:
            _give_back()

    def fitted(k: int, table: pa.Table) -> pa.Table:
        lists = table.column("number").combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        number, ends = lists.flatten().to_numpy(), ends - ends[0]
        grade = table.column("grade").to_numpy().astype(np.int64)
        part = stands_for[grade]
        part = part / max(part.mean(), 1e-9)
        fold = (mix(table.column("id").to_numpy().astype(U64)) % U64(FOLDS)).astype(np.int64)
        if k < FOLDS:
            out = fold == k
            rows = [(_HELD, grade[out], _held_out(number, ends, grade, part, out, *settings))]
        else:
            weights, thresholds = _climb(number, ends, grade, part, *settings)
            used = np.flatnonzero(weights)
            rows = [(_WEIGHT, used, weights[used]), (_THRESHOLD, np.arange(grades - 1), thresholds)]
        kind = np.concatenate([np.full(len(a), name, np.int32) for name, a, _ in rows])
        place = np.concatenate([a.astype(np.int64) for _, a, _ in rows])
        value = np.concatenate([b.astype(np.float64) for *_, b in rows])
        return pa.table({"kind": kind, "place": place, "value": value})

    return run


def rating(quality: Column, toxic: Column, toxic_null_as: int = 0) -> Column:
    """Grade of a labelled document: 0 poor, 1 toxic, 2 good; null without a quality."""
    return F.when(quality == 0, F.lit(0)).when(
        quality.isNotNull(), F.when(F.coalesce(toxic, F.lit(toxic_null_as)) == 1, F.lit(1)).otherwise(F.lit(2))
    )


def shared_out(counts: dict[int, int], total: int) -> dict[int, int]:
    """At most ``total`` rows dealt evenly to grades of these sizes, none getting more than it has."""
    out, left = {}, total
    for nth, (grade, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[grade] = min(n, left // (len(counts) - nth))
        left -= out[grade]
    return out


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    grades: int = 3,
    sample: int = SAMPLE,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents, of each grade those whose ids have the smallest hashes.

    Grades share the sample evenly; what a rare one leaves goes to the others. A
    document counts as many times as it stands for, so probabilities are those of
    all ratings.

    ``ratings`` has the id and ``grade`` (0 to ``grades`` - 1); null ids and
    grades are left out, an id rated more than once counts with its highest
    grade, and of texts repeated under one id the smallest counts. Without any
    rated document every weight is 0.

    The folds and the model of all rows are fitted in a task each, which holds
    the sample: sets of feature numbers, one row for each id. The driver gets
    weights, thresholds and one held-out score a row.
    """
    rated = (
        ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(F.col("grade").cast("int")).alias("grade"))
    )
    # one number for each grade
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    quota = shared_out(counts, sample)
    picked = [rated.where(F.col("grade") == g).orderBy(F.xxhash64("_id"), "_id").limit(n) for g, n in sorted(quota.items())]
    rated = reduce(DataFrame.unionAll, picked, rated.limit(0))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                number, ends = features(batch.column("text"), bits)
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(number))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("grade"), lists.cast(pa.list_(pa.int32()))], ["id", "grade", "number"]
                )

    # at most ``sample`` rows of two numbers; then one row for each id, however often it repeats
    sampled = texts.join(F.broadcast(rated), "_id").groupBy("_id", "grade").agg(F.min("text").alias("text"))
    found = sampled.mapInArrow(run, "id bigint, grade int, number array<int>")
    stands_for = np.array([counts.get(g, 0) / max(quota.get(g, 0), 1) for g in range(grades)])
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    fitted = parts.groupBy("part").applyInArrow(_fit_part(grades, bits, stands_for), _FITTED).toArrow()
    weights = np.zeros(1 << bits, np.float32)
    if not fitted.num_rows:
        return OrdinalModel(weights, np.arange(grades - 1, dtype=np.float64), bits, np.zeros(grades - 1))
    kind, place, value = (fitted.column(c).to_numpy() for c in ("kind", "place", "value"))
    weights[place[kind == _WEIGHT]] = value[kind == _WEIGHT]
    thresholds = np.sort(value[kind == _THRESHOLD])
    return OrdinalModel(weights, thresholds, bits, _cuts(value[kind == _HELD], place[kind == _HELD], grades, CLEAN))


def grade_documents(
    docs: DataFrame,
    model: OrdinalModel,
    grade: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) of every document.

    ``tail_probability`` is that of reaching ``grade``; a document is kept when
    its score is at least the model's cut of that grade. A null, empty or blank
    text has no features and score 0, which is always kept. Null and repeated ids pass through, each row judged by itself.
    Whole texts are read; other columns are not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # scores are differences of running sums; what those round off is no reason to reject
    cut = float(model.cuts[grade - 1]) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                score = own.score(*features(batch.column("text"), own.bits))
                reach = own.at_least(score)
                tail = reach[:, grade - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(reach.sum(axis=1)), pa.array(tail), pa.array(score >= cut)],
                    ["id", "expected_grade", "tail_probability", "kept"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    graded = rows.mapInArrow(run, "id bigint, expected_grade double, tail_probability double, kept boolean")
    return graded.withColumnRenamed("id", id_col)
