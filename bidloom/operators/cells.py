"""Exact nearest neighbours through an index of cells and rings.

Every vector belongs to the cell of its nearest centre. A cell is cut into rings
of equal row counts by the distance to its centre, so one that holds a third of
all vectors is many rings. By the triangle inequality a vector of a ring whose
distances to the centre span ``[near, far]`` is at least ``max(d - far, near - d)``
away from a question at distance d from that centre.

A question visits rings in the order of that bound, a growing number each round,
and stops when no ring left can hold a nearer vector than its k-th best. Inside a
ring vectors are stored as one byte a dimension with the length of what rounding
lost, which bounds each distance from both sides; only vectors that the bounds
cannot rule out are fetched and compared in full. Results are those of comparing
everything.

Rings are dealt into lots of some ten thousand vectors. Questions meet a lot, not
each of its rings, so a question's vector moves once for a lot that it visits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import PARTITION_ID, measured, range_layout, stage_table

# tasks carry this module's functions themselves, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: centres come from at most about this many vectors; they steer speed, never results
SAMPLE_ROWS = 50_000
MOST_CELLS = 1024
RING_ROWS = 4096
#: vectors in a lot of rings, about
LOT_ROWS = 16_384
#: questions answered in one task
QUESTION_ROWS = 4096
#: rings a question may visit grow by this factor each round
GROWTH = 4
#: a row of question and vector id in memory, about, and what a row has beside its vector
PAIR_BYTES = 96
FIXED_BYTES = 32


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), width)


def _to_centers(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, from differences, so that small ones keep their digits."""
    out = np.empty((len(x), len(centers)))
    for j, center in enumerate(centers):
        out[:, j] = np.sqrt(((x - center) ** 2).sum(axis=1))
    return out


def fit_centers(vectors: DataFrame, vec: str, cells: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of the cells by k-means over a bounded sample, picked by the hash of row and vector."""
    n = vectors.count()
    every = max(1, -(-n // sample_rows))
    sample = vectors.where(F.pmod(F.xxhash64("id", vec), F.lit(every)) == 0) if every > 1 else vectors
    points = sample.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), maxIter=8, initMode="random", seed=5).fit(points)
    return np.array(model.clusterCenters())


def _assign(centers: np.ndarray, schema: pa.Schema):
    width = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = _matrix(batch.column(1), width)
                # the expanded form picks the cell; which one it is matters for speed only
                cell = ((centers**2).sum(axis=1)[None, :] - 2 * (x @ centers.T)).argmin(axis=1)
                rest = x - centers[cell]
                distance = np.sqrt((rest**2).sum(axis=1))
                scale = np.abs(rest).max(axis=1, initial=0) / 127
                code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                lost = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1))
                columns = [batch.column(0), cell.astype(np.int32), distance, scale, lost, [c.tobytes() for c in code]]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return run


@dataclass
class CellIndex:
    """Written tables of codes by ring, of rings, and of the vectors themselves; rings fall into so many lots."""

    centers: np.ndarray
    codes: DataFrame
    rings: DataFrame
    vectors: DataFrame
    id_type: T.DataType
    lots: int


def build_index(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    cells: int | None = None,
    ring_rows: int = RING_ROWS,
) -> CellIndex | None:
    """Index every vector; rows without one are left out. None for a table without vectors.

    The number of cells is the square root of the number of vectors, at most
    ``MOST_CELLS``, unless given.
    """
    stored = stage_table(
        vectors.select(F.col(vec_id).alias("id"), F.col(vec).alias("vector")).where(F.col(vec).isNotNull()), "vectors"
    )
    n = stored.count()
    if not n:
        return None
    centers = fit_centers(stored, "vector", cells or min(MOST_CELLS, int(np.ceil(np.sqrt(n)))))
    fields = [
        stored.schema["id"], T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType()),
        T.StructField("scale", T.DoubleType()), T.StructField("lost", T.DoubleType()), T.StructField("code", T.BinaryType()),
    ]
    out = T.StructType(fields)
    assigned = stored.mapInArrow(_assign(centers, to_arrow_schema(out)), out)
    laid = range_layout(assigned, ["cell", "distance", "id"], "cell-order")
    nth = F.row_number().over(Window.partitionBy(PARTITION_ID, "cell").orderBy("distance", "id"))
    numbered = laid.withColumn("_nth", F.floor((nth - 1) / ring_rows))
    ring = F.shiftleft(F.col(PARTITION_ID).cast("bigint"), 42) + F.shiftleft(F.col("cell").cast("bigint"), 26) + F.col("_nth")
    codes = stage_table(numbered.withColumn("ring", ring).drop("_nth", PARTITION_ID), "cell-codes")
    rings = codes.groupBy("ring", "cell").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.count("*").alias("n")
    )
    lots = max(1, -(-n // LOT_ROWS))
    return CellIndex(centers, codes, stage_table(rings, "cell-rings"), stored, stored.schema["id"].dataType, lots)


def _bounds_of_cells(centers: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _to_centers(_matrix(batch.column(1), centers.shape[1]), centers)
            n, cells = away.shape
            home = np.zeros((n, cells), bool)
            home[np.arange(n), away.argmin(axis=1)] = True
            rows = pa.array(np.repeat(np.arange(n), cells))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array(np.tile(np.arange(cells, dtype=np.int32), n)),
                    pa.array(away.ravel()),
                    pa.array(home.ravel()),
                ],
                schema=schema,
            )

    return run


def _candidates(q: np.ndarray, most: np.ndarray, near: np.ndarray, lost: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, column, lower, upper) of what may be among the k nearest, and the new limit of each row.

    ``near`` are the vectors as their codes say, ``lost`` the lengths that rounding took from them.
    """
    own, norms = (q**2).sum(axis=1), (near**2).sum(axis=1)
    square = q @ near.T
    square *= -2
    square += own[:, None]
    square += norms[None, :]
    # the expanded form loses digits; the slack covers them
    slack = lambda r, c: 1e-12 * (own[r] + norms[c])
    if len(near) >= k and np.isinf(most).any():
        every = np.sqrt(np.maximum(square, 0) + 1e-12 * (own[:, None] + norms[None, :])) + lost[None, :]
        most = np.minimum(most, np.partition(every, k - 1, axis=1)[:, k - 1])
    # squares first, by the largest loss and slack of all, as most pairs end here
    reach = (most + lost.max()) ** 2 * (1 + 1e-9) + 1e-12 * (own + norms.max())
    row, col = np.nonzero(square <= reach[:, None])
    square = square[row, col]
    lower = np.maximum(np.sqrt(np.maximum(square - slack(row, col), 0)) - lost[col], 0)
    upper = np.sqrt(np.maximum(square, 0) + slack(row, col)) + lost[col]
    # rows come in order: the k-th smallest bound of each that has so many
    count = np.bincount(row, minlength=len(q))
    enough = np.flatnonzero(count >= k)
    kth = upper[np.lexsort((upper, row))][(np.cumsum(count) - count)[enough] + k - 1]
    most = most.copy()
    most[enough] = np.minimum(most[enough], kth)
    kept = lower <= most[row]
    return row[kept], col[kept], lower[kept], upper[kept], most


def _visit(centers: np.ndarray, k: int, schema: pa.Schema):
    """Bounds of the distances between questions and the codes of the rings they visit in one lot; all that may be among the k nearest."""

    def run(codes: pa.Table, questions: pa.Table) -> pa.Table:
        if not codes.num_rows or not questions.num_rows:
            return schema.empty_table()
        codes, questions = codes.sort_by("ring").combine_chunks(), questions.combine_chunks()
        width = centers.shape[1]
        raw = codes.column("code").combine_chunks()
        code = np.frombuffer(b"".join(raw.to_pylist()), np.int8).reshape(-1, width)
        scale, lost, cell, at = (codes.column(c).to_numpy() for c in ("scale", "lost", "cell", "ring"))
        names = codes.column("id").combine_chunks()
        asked = questions.column("question").combine_chunks()
        q = _matrix(questions.column("vector").combine_chunks(), width)
        limit = questions.column("limit").to_numpy().copy()
        visits = questions.column("rings").combine_chunks()
        wanted = visits.flatten().to_numpy()
        who = np.repeat(np.arange(len(q)), visits.value_lengths().to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, who = wanted[order], who[order]
        parts = []
        for ring in np.unique(at):
            first, end = np.searchsorted(at, [ring, ring + 1])
            near = centers[cell[first:end]] + code[first:end] * scale[first:end, None]
            low, high = np.searchsorted(wanted, [ring, ring + 1])
            for start in range(low, high, 128):
                some = who[start : min(start + 128, high)]
                row, col, lower, upper, limit[some] = _candidates(q[some], limit[some], near, lost[first:end], k)
                parts.append((some[row], first + col, lower, upper))
        if not parts:
            return schema.empty_table()
        row, col, lower, upper = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.Table.from_arrays(
            [asked.take(pa.array(row)), names.take(pa.array(col)), pa.array(lower), pa.array(upper)], schema=schema
        )

    return run


def _compare(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = _matrix(batch.column("vector"), width), _matrix(batch.column("asked"), width)
            away = np.sqrt(((x - q) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("question"), batch.column("id"), pa.array(away)], schema=schema)

    return run


@dataclass
class Search:
    """Nearest vectors of each question, and what it took to find them."""

    hits: DataFrame
    work: DataFrame


def search(
    index: CellIndex,
    questions: DataFrame,
    k: int = 4,
    vec_id: str = "vec_id",
    question_id: str = "question_id",
    question_vec: str = "question_embedding",
) -> Search:
    """The exact k nearest vectors of each question by Euclidean distance, ties by id.

    ``hits`` has (question, vector id, distance, rank); ``work`` has for each
    question the rings it visited, the vectors whose bounds it saw there, the
    vectors compared in full, and all there are. Question ids are unique;
    questions without a vector are left out.

    What moves are questions and byte codes of the rings visited. The lists of
    visits and candidates are tables; one count a round reaches the driver.
    """
    centers, width = index.centers, index.centers.shape[1]
    asked = stage_table(
        questions.select(F.col(question_id).alias("question"), F.col(question_vec).alias("vector")).where(
            F.col(question_vec).isNotNull()
        ),
        "cell-questions",
    )
    asked = measured(asked, FIXED_BYTES + 4 * width)
    kind = asked.schema["question"]
    to_cells = T.StructType(
        [kind, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("home", T.BooleanType())]
    )
    cells = stage_table(asked.mapInArrow(_bounds_of_cells(centers, to_arrow_schema(to_cells)), to_cells), "cell-bounds")
    # the digits of a distance computed from differences are good to far less than this
    slack = F.lit(1e-9) * (1 + F.col("away") + F.col("far"))
    low = F.greatest(F.col("away") - F.col("far"), F.col("near") - F.col("away"), F.lit(0.0)) - slack
    blocks = max(1, -(-asked.count() // QUESTION_ROWS))
    found_type = T.StructType(
        [kind, T.StructField("id", index.id_type), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]
    )
    see = _visit(centers, k, to_arrow_schema(found_type))

    def visit(pairs: DataFrame) -> DataFrame:
        """Candidates of (question, ring, limit); lots of rings and blocks of questions meet."""
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("question"), F.lit(blocks)))
        dealt = dealt.withColumn("lot", F.pmod(F.xxhash64("ring"), F.lit(index.lots)))
        left = index.codes.join(dealt.select("ring", "lot", "block").distinct(), "ring")
        visits = dealt.groupBy("question", F.col("lot").alias("at_lot"), F.col("block").alias("at_block"))
        # a question has one limit a round
        right = visits.agg(F.collect_list("ring").alias("rings"), F.min("limit").alias("limit")).join(asked, "question")
        met = left.groupBy("lot", "block").cogroup(right.groupBy("at_lot", "at_block"))
        return stage_table(met.applyInArrow(see, found_type), "cell-candidates")

    def limits(found: DataFrame) -> DataFrame:
        """The k-th smallest upper bound of each question: no farther vector is among its k nearest."""
        order = Window.partitionBy("question").orderBy("upper", "id")
        kth = found.select("question", "id", "upper", F.row_number().over(order).alias("nth")).where(F.col("nth") == k)
        return stage_table(kth.select("question", F.col("upper").alias("limit")), "cell-limits")

    # first the ring of the nearest cell that the question lies in, or lies closest to
    own = cells.where("home").join(index.rings, "cell").select("question", "ring", "n", low.alias("low"))
    first = stage_table(own.groupBy("question").agg(F.min_by("ring", F.struct("low", "ring")).alias("ring")), "cell-home")
    found = visit(first.withColumn("limit", F.lit(float("inf"))))
    known = limits(found)
    far = F.coalesce("limit", F.lit(float("inf")))
    nearest = index.rings.groupBy("cell").agg(F.max("far").alias("cell_far"), F.min("near").alias("cell_near"))
    open_cells = (
        cells.join(nearest, "cell")
        .join(known, "question", "left")
        .where(F.greatest(F.col("away") - F.col("cell_far"), F.col("cell_near") - F.col("away")) <= far + 1e-9 * (1 + F.col("away")))
    )
    waiting = (
        open_cells.select("question", "cell", "away", "limit")
        .join(index.rings, "cell")
        .select("question", "ring", "n", low.alias("low"), "limit")
        .where(F.col("low") <= far)
        .join(first.select("question", "ring", F.lit(True).alias("_seen")), ["question", "ring"], "left")
        .where(F.col("_seen").isNull())
    )
    turn = F.row_number().over(Window.partitionBy("question").orderBy("low", "ring"))
    waiting = stage_table(waiting.select("question", "ring", "n", "low", turn.alias("turn")), "cell-visits")
    visited = first.join(index.rings.select("ring", "n"), "ring").select("question", "n")
    start, size = 1, GROWTH
    while True:
        due = waiting.where((F.col("turn") >= start) & (F.col("turn") < start + size)).join(known, "question", "left")
        due = stage_table(due.select("question", "ring", "n", "low", far.alias("limit")).where(F.col("low") <= F.col("limit")), "cell-due")
        # bounds grow with the turn: a question without a visit now needs none later
        if due.isEmpty():
            break
        found = found.unionByName(visit(due.select("question", "ring", "limit")))
        visited = visited.unionByName(due.select("question", "n"))
        known = limits(found)
        start, size = start + size, size * GROWTH
    last = found.join(known, "question", "left").where(F.col("lower") <= far).select("question", "id")
    last = measured(stage_table(last, "cell-compared"), PAIR_BYTES)
    exact_type = T.StructType([kind, T.StructField("id", index.id_type), T.StructField("distance", T.DoubleType())])
    compared = (
        last.join(index.vectors, "id")
        .join(asked.withColumnRenamed("vector", "asked"), "question")
        .mapInArrow(_compare(width, to_arrow_schema(exact_type)), exact_type)
    )
    rank = F.row_number().over(Window.partitionBy("question").orderBy("distance", "id"))
    hits = compared.withColumn("rank", rank).where(F.col("rank") <= k)
    total = index.rings.agg(F.sum("n").alias("total"))
    compared_rows = last.groupBy("question").agg(F.count("*").alias("compared"))
    work = visited.groupBy("question").agg(F.count("*").alias("rings"), F.sum("n").alias("bounded"))
    work = with_scalars(work.join(compared_rows, "question"), total)
    return Search(
        hits.select(F.col("question").alias(question_id), F.col("id").alias(vec_id), "distance", "rank"),
        work.withColumnRenamed("question", question_id),
    )


def nearest_by_cells(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = 4,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    question_id: str = "question_id",
    question_vec: str = "question_embedding",
    cells: int | None = None,
) -> DataFrame:
    """(question, vector id, distance, rank): index the vectors and search them once."""
    index = build_index(vectors, vec_id, vec, cells)
    if index is None:
        none = F.lit(None).cast(vectors.schema[vec_id].dataType).alias(vec_id)
        return questions.where("false").select(question_id, none, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    return search(index, questions, k, vec_id, question_id, question_vec).hits
