"""An index of chunks and vectors that grows with what changed in its corpus.

``<base>/segments/segment=<n>`` holds the chunks of the documents that run n
added or changed; a published manifest (see ``sources.snapshots``) says for each
document which segment is its own. A run compares manifests by length and digest,
chunks and embeds what is new, and publishes the next manifest. Chunks of changed
and gone documents stay in old segments unread, until ``compact`` drops them.

The embedding model is fitted once, by the first run, and kept beside the index,
so that vectors of different runs can be compared.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators import retrieval
from bidloom.sources import snapshots
from bidloom.sources.staging import exists, stage_table


def manifest(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """(key, size, digest), one row for each document; keys are unique and not null."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key, F.length(body).alias("size"), F.sha2(body, 256).alias("digest"))


def difference(before: DataFrame, after: DataFrame, key: str = "source") -> DataFrame:
    """(key, size, digest, state): 'added', 'changed', 'gone' or 'same'; of gone ones the last size and digest."""
    old = before.select(key, F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    met = after.join(old, key, "full")
    same = (F.col("size") == F.col("_size")) & (F.col("digest") == F.col("_digest"))
    state = (
        F.when(F.col("_digest").isNull(), "added").when(F.col("digest").isNull(), "gone").when(same, "same").otherwise("changed")
    )
    return met.select(
        key, F.coalesce("size", "_size").alias("size"), F.coalesce("digest", "_digest").alias("digest"), state.alias("state")
    )


def _segment(base: str, number: int) -> str:
    return f"{base}/segments/segment={number}"


def _embedded(spark: SparkSession, base: str, chunks: DataFrame) -> DataFrame:
    if not exists(spark, f"{base}/model/_SUCCESS"):
        retrieval.fit_embedding(chunks).write().overwrite().save(f"{base}/model")
        # a model without this mark is half written
        snapshots.write_text(spark, f"{base}/model/_SUCCESS", "")
    return retrieval.embed(PipelineModel.load(f"{base}/model"), chunks)


def update_index(base: str, docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """Bring the index up to ``docs``; returns (key, size, digest, state) of this run.

    Only added and changed documents are chunked and embedded. The manifest is
    published last: a run that dies before leaves the index as it was, and the
    next one writes its segment anew.
    """
    spark = docs.sparkSession
    version = snapshots.current_version(spark, base)
    now = stage_table(manifest(docs, key, text), "manifest")
    if version is None:
        number = 0
        before = now.where("false").withColumn("segment", F.lit(0))
    else:
        number = int(version)
        before = snapshots.read_snapshot(spark, base)
    changes = stage_table(difference(before, now, key), "manifest-changes")
    if version is None:
        new = docs.where(F.col(key).isNotNull())
    else:
        # written by itself: the planner sees how few keys these are, and the texts stay in place
        fresh = stage_table(changes.where("state in ('added', 'changed')").select(key), "fresh-keys")
        new = docs.join(fresh, key, "left_semi")
    number += 1
    chunks = stage_table(retrieval.chunk_documents(new, key, text), "fresh-chunks")
    _embedded(spark, base, chunks).write.mode("overwrite").parquet(_segment(base, number))
    own = F.when(F.col("state") == "same", F.col("_segment")).otherwise(F.lit(number))
    live = (
        changes.where("state <> 'gone'")
        .join(before.select(key, F.col("segment").alias("_segment")), key, "left")
        .select(key, "size", "digest", own.cast("int").alias("segment"))
    )
    live.write.mode("overwrite").parquet(f"{base}/versions/{number}")
    snapshots.publish(spark, base, str(number))
    return changes


def read_index(spark: SparkSession, base: str, key: str = "source") -> DataFrame:
    """(key, chunk_no, chunk_text, embedding) of the documents in the published manifest.

    What is stored under keys that are no longer live is found by keys alone and
    written, so that chunks and vectors move only if much of the index is stale.
    """
    live = snapshots.read_snapshot(spark, base).select(key, "segment")
    # one number for each run since the index was compacted
    segments = [r[0] for r in live.select("segment").distinct().collect()]
    stored = spark.read.parquet(f"{base}/segments").where(F.col("segment").isin(segments))
    dead = stored.select(key, "segment").distinct().join(live, [key, "segment"], "left_anti")
    return stored.join(stage_table(dead, "stale-keys"), [key, "segment"], "left_anti").drop("segment")


def compact(spark: SparkSession, base: str, key: str = "source") -> None:
    """Write what is live as one segment and publish a manifest that names only it; old files stay for readers at work."""
    number = int(snapshots.current_version(spark, base)) + 1
    read_index(spark, base, key).write.mode("overwrite").parquet(_segment(base, number))
    live = snapshots.read_snapshot(spark, base).withColumn("segment", F.lit(number))
    live.write.mode("overwrite").parquet(f"{base}/versions/{number}")
    snapshots.publish(spark, base, str(number))
