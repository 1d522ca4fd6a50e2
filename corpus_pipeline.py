"""Documents to token ids in five stages: quality, exact and near duplicates, mixture, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import bpe_trie, exact_dedup, mixture, near_dedup, ordinal_quality
from bidloom.llm.queries import rated, tokenizer_path
from bidloom.llm.rows import numbered
from bidloom.sources.staging import stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier expects to reach the highest grade; null ids are judged too."""
    rows, row = numbered(docs)
    model = ordinal_quality.fit(docs, rated(spark, sf_dir))
    kept = ordinal_quality.grade_documents(rows, model, id_col=row).where("kept")
    return _only(rows, kept, row, docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: the longest original, then the smallest id, null behind every other."""
    rows, row = numbered(docs)
    best = exact_dedup.classes(rows, also=[row]).where("kept")
    # rows that repeat the best id and text tie
    kept = best.groupBy("text_sha256").agg(F.min(row).alias(row))
    return _only(rows, kept, row, docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the row with the smallest id, null behind every other."""
    rows, row = numbered(docs)
    groups = near_dedup.near_components(rows, width=5, percent=80, id_col=row, unique=True).select(row, "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")
    kept = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first).select(F.col(f"first.{row}"))
    return _only(rows, kept, row, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixture.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of ids and decoded text, one row for each copy."""
    coded = bpe_trie.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


def _only(rows: DataFrame, kept: DataFrame, row: str, columns: list[str]) -> DataFrame:
    chosen = kept.select(F.col(row).alias(row + "_kept"))
    return rows.join(chosen, F.col(row) == F.col(row + "_kept"), "left_semi").select(*[F.col(f"`{c}`") for c in columns])


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("MinHash near-dedup", drop_near),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: the classifier, the near-duplicate search and the encoding have no SQL form
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
