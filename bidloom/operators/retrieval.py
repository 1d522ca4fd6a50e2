"""Chunks, vectors, exact nearest neighbours and prompt tables."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bidloom.sources.staging import stage_table

# tasks carry this module's functions themselves, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Chunking parameters, default width and number of results.
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", ".", "!", "?"]
VECTOR_WIDTH = 384
TOP_K = 4
PREVIEW_CHARS = 200
SUMMARY_CHARS = 6000
# Characters of chunks that a task returns at a time.
BATCH_CHARS = 1 << 20
# Rows of either side in one block of the exact search.
BLOCK_ROWS = 4096


# ---- chunking -----------------------------------------------------------------

def _pieces(text: str, start: int, end: int, seps: list[str]) -> list[tuple[int, int]]:
    """Cut a span before each occurrence of the separator."""
    cuts, at = [start], text.find(seps[0], start, end)
    while at != -1:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(seps[0], at + len(seps[0]), end)
    return list(zip(cuts, cuts[1:] + [end], strict=True))


def chunk_spans(
    text: str, size: int, overlap: int, seps: list[str], cut_long: bool = False
) -> list[tuple[int, int]]:
    """Character spans of the chunks; a piece no separator can cut stays whole, or with ``cut_long`` is cut by length.

    Neighbouring pieces are contiguous, so a chunk is one span of the text.
    """
    out: list[tuple[int, int]] = []

    def keep(start: int, end: int) -> None:
        piece = text[start:end]
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            out.append((start + lead, start + len(piece.rstrip())))

    def pack(parts: list[tuple[int, int]]) -> None:
        window: deque[tuple[int, int]] = deque()
        for part in parts:
            if window and part[1] - window[0][0] > size:
                keep(window[0][0], window[-1][1])
                while window and (window[-1][1] - window[0][0] > overlap or part[1] - window[0][0] > size):
                    window.popleft()
            window.append(part)
        if window:
            keep(window[0][0], window[-1][1])

    def cut(start: int, end: int, left: list[str]) -> None:
        while left[1:] and text.find(left[0], start, end) == -1:
            left = left[1:]
        run: list[tuple[int, int]] = []
        for part in _pieces(text, start, end, left):
            if part[1] - part[0] < size:
                run.append(part)
                continue
            pack(run)
            run = []
            if left[1:]:
                cut(*part, left[1:])
            elif cut_long:
                for at in range(part[0], part[1], size):
                    keep(at, min(at + size, part[1]))
            else:
                out.append(part)
        pack(run)

    if text:
        cut(0, len(text), seps)
    return out


def _chunker(schema: pa.Schema, size: int, overlap: int, seps: list[str], cut_long: bool):
    """Chunks of (key, text) batches; one text and at most about ``BATCH_CHARS`` of chunks are Python objects at a time."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                doc, body = doc.as_py(), body.as_py() or ""
                for number, (start, end) in enumerate(chunk_spans(body, size, overlap, seps, cut_long), 1):
                    rows.append((doc, number, body[start:end]))
                    chars += end - start
                    if chars >= BATCH_CHARS:
                        yield packed(rows)
                        rows, chars = [], 0
            if rows:
                yield packed(rows)

    return run


def chunk_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: list[str] | None = None,
    cut_long: bool = False,
) -> DataFrame:
    """(key, chunk_no, chunk_text) in document order, whole texts, streamed by batch.

    With ``cut_long`` no chunk is longer than ``size``, so that k of them bound a context.
    """
    seps = separators or SEPARATORS
    out = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("chunk_no", T.LongType()),
            T.StructField("chunk_text", T.StringType()),
        ]
    )
    return df.select(key, text).mapInArrow(_chunker(to_arrow_schema(out), size, overlap, seps, cut_long), out)


# ---- vectors ------------------------------------------------------------------

def fit_embedding(chunks: DataFrame, text: str = "chunk_text", width: int = VECTOR_WIDTH) -> PipelineModel:
    """Hashed term weights, the offline stand-in for a sentence encoder."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    ).fit(chunks)


def embed(model: PipelineModel, chunks: DataFrame, out: str = "embedding") -> DataFrame:
    vectors = model.transform(chunks).withColumn(out, vector_to_array("_unit", "float32"))
    return vectors.drop("_words", "_tf", "_idf", "_unit")


# ---- nearest neighbours ---------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _k_nearest(k: int, schema: pa.Schema, ids: tuple[str, str], vecs: tuple[str, str]):
    """The k nearest vectors of one block for each question of another."""

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        if not vectors.num_rows or not questions.num_rows:
            return schema.empty_table()
        vectors, questions = vectors.combine_chunks(), questions.combine_chunks()
        block, q = (_matrix(t.column(c).combine_chunks()) for t, c in ((vectors, vecs[0]), (questions, vecs[1])))
        names, asked = vectors.column(ids[0]).to_pylist(), questions.column(ids[1]).to_pylist()
        norms, q_norm = (block**2).sum(axis=1), (q**2).sum(axis=1)
        rows = []
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            near = q_norm[start : start + 256, None] + norms[None, :] - 2 * (part @ block.T)
            # slack for the digits the expanded form loses; exact values decide
            slack = 1e-9 * (1 + q_norm[start : start + 256] + norms.max())
            bound = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(part), np.inf)
            for r in range(len(part)):
                chosen = np.flatnonzero(near[r] <= bound[r] + slack[r])
                exact = np.sqrt(((block[chosen] - part[r]) ** 2).sum(axis=1))
                found = sorted(zip(exact.tolist(), [names[j] for j in chosen], strict=True))[:k]
                rows += [(asked[start + r], name, d) for d, name in found]
        columns = zip(*rows, strict=True)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _ranked(found: DataFrame, question_id: str, vec_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(question_id).orderBy("distance", vec_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_chunks(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    question_id: str = "question_id",
    question_vec: str = "question_embedding",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest vectors per question by Euclidean distance, ties by id.

    Question ids are unique; rows without a vector are left out. Both sides are
    cut into blocks of about ``block`` rows; every pair of blocks is one group
    with its own top k, and the candidates are merged by question. The work grows
    with questions times vectors; ``nearest_chunks_lsh`` is the approximate form.
    """
    q_type, v_type = questions.schema[question_id].dataType, vectors.schema[vec_id].dataType
    out = T.StructType(
        [T.StructField(question_id, q_type), T.StructField(vec_id, v_type), T.StructField("distance", T.DoubleType())]
    )
    stored = vectors.select(vec_id, vec).where(F.col(vec).isNotNull())
    asked = questions.select(question_id, question_vec).where(F.col(question_vec).isNotNull())
    n_v, n_q = (max(1, -(-side.count() // block)) for side in (stored, asked))

    def dealt(side: DataFrame, own: str, own_n: int, other: str, other_n: int, name: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        return side.withColumn(own, F.pmod(F.xxhash64(name), F.lit(own_n)).cast("int")).withColumn(other, every)

    left = dealt(stored, "_vb", n_v, "_qb", n_q, vec_id)
    right = dealt(asked, "_qb", n_q, "_vb", n_v, question_id)
    run = _k_nearest(k, to_arrow_schema(out), (vec_id, question_id), (vec, question_vec))
    found = left.groupBy("_vb", "_qb").cogroup(right.groupBy("_vb", "_qb")).applyInArrow(run, out)
    # at most k candidates for each question and block of vectors
    return _ranked(found, question_id, vec_id, k)


def _bucket_numbers(width: int, tables: int, bits: int, id_col: str, vec_col: str, schema: pa.Schema):
    planes = np.random.default_rng(11).normal(size=(width, tables * bits))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = (_matrix(batch.column(vec_col)) @ planes > 0).reshape(batch.num_rows, tables, bits)
                numbers = (sides * powers).sum(axis=2)
                for table in range(tables):
                    columns = [batch.column(id_col), batch.column(vec_col), np.full(batch.num_rows, table, np.int32), numbers[:, table]]
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema
                    )

    return run


def nearest_chunks_lsh(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    question_id: str = "question_id",
    question_vec: str = "question_embedding",
    width: int = VECTOR_WIDTH,
    tables: int = 16,
    bits: int = 10,
) -> DataFrame:
    """Approximate k nearest vectors: those that share a random-hyperplane bucket with the question.

    The caller chooses this form; it is never chosen by size. More ``tables`` or
    fewer ``bits`` find more of the true neighbours and compare more candidates.
    A vector that shares several buckets counts once; distances are exact.
    """

    def bucketed(side: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        rows = side.select(id_col, F.col(vec_col).cast("array<float>").alias(vec_col)).where(F.col(vec_col).isNotNull())
        out = T.StructType([*rows.schema.fields, T.StructField("_table", T.IntegerType()), T.StructField("_bucket", T.LongType())])
        return rows.mapInArrow(_bucket_numbers(width, tables, bits, id_col, vec_col, to_arrow_schema(out)), out)

    left, right = bucketed(vectors, vec_id, vec), bucketed(questions, question_id, question_vec)
    met = right.join(left, ["_table", "_bucket"]).dropDuplicates([question_id, vec_id])
    gap = F.aggregate(
        F.zip_with(question_vec, vec, lambda a, b: (a - b).cast("double") * (a - b).cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    return _ranked(met.select(question_id, vec_id, F.sqrt(gap).alias("distance")), question_id, vec_id, k)


def with_chunks(hits: DataFrame, chunks: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """Hits next to their chunk. The hits are written first, so that the planner
    broadcasts them only when they are small and the chunk texts stay in place."""
    return chunks.join(stage_table(hits, "hits"), vec_id)


# ---- context, sources, prompts --------------------------------------------------

def pack_context(hits: DataFrame, question_id: str = "question_id", text: str = "chunk_text") -> DataFrame:
    """'[filename]' blocks in rank order; a question has at most k hits.

    Pieces of one hit follow one another by ``chunk_no``, where there is one.
    """
    block = F.concat(F.lit("["), F.col("filename"), F.lit("]\n"), F.col(text))
    place = F.col("chunk_no") if "chunk_no" in hits.columns else F.lit(None).cast("int")
    ranked = F.sort_array(F.collect_list(F.struct("rank", place.alias("at"), block.alias("block"))))
    return hits.groupBy(question_id).agg(F.array_join(ranked.getField("block"), "\n\n").alias("context"))


def source_list(hits: DataFrame, question_id: str = "question_id", text: str = "chunk_text") -> DataFrame:
    preview = F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))
    at = ["chunk_no"] if "chunk_no" in hits.columns else []
    return hits.select(
        question_id, "rank", *at, "filename", "folder", preview.alias("content"), F.col("distance").alias("score")
    )


def confidence_band(sources: DataFrame, question_id: str = "question_id", score: str = "score") -> DataFrame:
    mean = F.col("mean_score")
    return (
        sources.groupBy(question_id)
        .agg(F.avg(score).alias("mean_score"))
        .withColumn("confidence", F.when(mean > 0.7, "High").when(mean > 0.5, "Medium").otherwise("Low"))
    )


# Prompt texts.
ANSWER_PROMPT = (
    "You are a procurement and contracts expert. Use the following context to answer the question. "
    "If you cannot answer from the context, say 'I cannot find this information in the knowledge base.'\n"
    "Context:\n{context}\n\nQuestion: {question}\n\nAnswer (be concise and cite sources using [filename]):"
)
SUMMARY_PROMPT = (
    "You are summarizing content for a procurement and contracts dashboard.\n\nText to summarize:\n{text}\n\n"
    "Style: {style}\n\nInstructions:\n- Preserve key numbers, risk indicators, and decisions.\n"
    "- For 'bullet', return 3-7 bullets.\n- For 'short', return 2-3 concise sentences.\n"
    "- For 'detailed', return a structured explanation with headings.\n\nSummary:"
)


def _fill(template: str, values: dict[str, Column]) -> Column:
    pieces, rest = [], template
    for name, column in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), column]
    return F.concat(*pieces, F.lit(rest))


def answer_prompts(df: DataFrame, context: str = "context", question: str = "question") -> DataFrame:
    return df.withColumn("prompt", _fill(ANSWER_PROMPT, {"context": F.col(context), "question": F.col(question)}))


def summary_prompts(
    df: DataFrame, key: str = "doc_id", text: str = "text", style: str = "bullet", size: int = SUMMARY_CHARS
) -> DataFrame:
    """(key, part, n_parts, prompt): one prompt for each part of at most ``size`` characters.

    The parts follow one another and make up the whole text; a null or empty text
    is one empty part. ``joined_summary_prompts`` asks for one summary of the
    parts' summaries.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    n_parts = F.greatest(F.ceil(F.length(whole) / size), F.lit(1)).cast("int")
    parts = df.select(key, whole.alias("_whole"), n_parts.alias("n_parts")).select(
        key, "_whole", "n_parts", F.explode(F.sequence(F.lit(1), F.col("n_parts"))).alias("part")
    )
    piece = F.substring(F.col("_whole"), (F.col("part") - 1) * size + 1, F.lit(size))
    prompt = _fill(SUMMARY_PROMPT, {"text": piece, "style": F.lit(style)})
    return parts.select(key, "part", "n_parts", prompt.alias("prompt"))


def joined_summary_prompts(
    summaries: DataFrame, key: str = "doc_id", summary: str = "summary", style: str = "bullet"
) -> DataFrame:
    """(key, prompt): the summaries of a document's parts, in order, as one text to summarise."""
    ordered = F.array_sort(F.collect_list(F.struct("part", F.col(summary).alias("summary"))))
    joined = F.array_join(ordered.getField("summary"), "\n\n")
    return summaries.groupBy(key).agg(_fill(SUMMARY_PROMPT, {"text": joined, "style": F.lit(style)}).alias("prompt"))
