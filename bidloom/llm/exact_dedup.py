"""Exact duplicates: combine locally, then by salted digest, then globally.

Every stage groups by the digest *and* the whole normalised text, so two texts
with one digest are never taken for one another. The first aggregate combines
copies inside each input split before anything is shuffled; a digest that holds
a third of all rows reaches the second stage as at most one row per split and
salt, and the third stage as at most ``salts`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.sources.staging import new_path

#: what separates words; deleted before texts are compared
BLANKS = " \t\n\x0b\x0c\r"

_RANK = "decimal(38,0)"


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_digest,
    also: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs`` with its class of equal texts.

    Returns ``doc_id`` (the id column under its own name), ``keep_id``,
    ``group_size`` (long), ``kept`` (boolean) and ``text_sha256``.

    Texts are equal when nothing but blanks (space, tab to carriage return)
    tells them apart. The row with the most code points stays, ties go to the
    smallest id. A null text counts as empty, so all of them form one class. A
    null id ranks behind every other id and gives a null ``keep_id`` if it wins.
    Rows that repeat an id and text are one document: each counts in
    ``group_size`` and all share the verdict. An empty table gives no rows.
    Columns other than the two named ones are not read, so their names cannot
    clash; those named in ``also`` are returned behind the others.
    """
    carried = [F.col(c).alias(f"_also_{k}") for k, c in enumerate(also)]
    own = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *carried
    )
    own = own.withColumn("_norm", F.translate("_text", BLANKS, ""))
    # longest text first, then smallest id: one number per row, so that the combine is a hash aggregate
    by_id = F.when(F.col("_id").isNull(), F.lit(0).cast(_RANK)).otherwise(
        F.lit(str(2**63)).cast(_RANK) - F.col("_id").cast(_RANK)
    )
    rank = (F.length("_text").cast(_RANK) * F.lit(str(10**20)).cast(_RANK) + by_id).cast(_RANK)
    rows = own.select(
        digest(F.col("_norm")).alias("_digest"),
        "_norm",
        F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"),
        rank.alias("_rank"),
        F.lit(1).cast("long").alias("_n"),
    )
    best = [F.max("_rank").alias("_rank"), F.sum("_n").alias("_n")]
    salted = rows.groupBy("_digest", "_norm", "_salt").agg(*best)
    # dealt by digest alone, so that the next line needs no further exchange
    merged = salted.repartition("_digest").groupBy("_digest", "_norm").agg(*best)
    several_texts = F.count("*").over(Window.partitionBy("_digest")) > 1
    # the text stays in the table only where its digest has more than one
    table = merged.withColumn("_clash", several_texts).select(
        "_digest",
        "_clash",
        F.when(F.col("_clash"), F.col("_norm")).alias("_norm"),
        "_rank",
        F.col("_n").alias("group_size"),
    )
    spark = docs.sparkSession
    path = new_path(spark, "exact-classes")
    table.write.partitionBy("_clash").parquet(path)
    schema = "_digest string, _norm string, _rank decimal(38,0), group_size long, _clash boolean"
    staged = spark.read.schema(schema).parquet(path)
    single = staged.where(~F.col("_clash")).select("_digest", "_rank", "group_size")
    several = staged.where("_clash").select("_digest", "_norm", "_rank", "group_size")
    members = own.select(
        "_id",
        digest(F.col("_norm")).alias("_digest"),
        F.sha2("_norm", 256).alias("text_sha256"),
        rank.alias("_own_rank"),
        # compared where a digest has several texts; this side of the join is a projection of the scan
        F.col("_norm").alias("_norm_text"),
        *[f"_also_{k}" for k in range(len(also))],
    )
    columns = ["_id", "text_sha256", "_own_rank", "_rank", "group_size", *[f"_also_{k}" for k in range(len(also))]]
    found = members.join(single, "_digest").select(*columns)
    if not several.isEmpty():
        clashing = members.withColumnRenamed("_norm_text", "_norm").join(several, ["_digest", "_norm"])
        found = found.unionByName(clashing.select(*columns))
    winner = F.col("_rank") % F.lit(str(10**20)).cast(_RANK)
    keep_id = F.when(winner != 0, (F.lit(str(2**63)).cast(_RANK) - winner).cast("long"))
    return found.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        "group_size",
        (F.col("_own_rank") == F.col("_rank")).alias("kept"),
        "text_sha256",
        *[F.col(f"_also_{k}").alias(c) for k, c in enumerate(also)],
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Ids should be unique; a null id stays when its text is alone or longest.
    """
    kept = classes(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
