"""Versioned snapshots of a table, published by swapping one small pointer file.

``<base>/versions/<version>`` holds a snapshot, ``<base>/CURRENT`` the name of the
published one. A snapshot is written in full before the pointer changes, and the
pointer changes by a rename, so a reader sees the old version or the new one; a
run that dies in between leaves the old one. Object stores without an atomic
rename need a table format instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.sources.staging import exists

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    target, files = _files(spark, path)
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, files = _files(spark, path)
    stream = files.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def current_version(spark: SparkSession, base: str) -> str | None:
    """The published version, or None before the first."""
    if not exists(spark, f"{base}/{POINTER}"):
        return None
    return read_text(spark, f"{base}/{POINTER}").strip()


def read_snapshot(spark: SparkSession, base: str, version: str | None = None) -> DataFrame:
    """The published snapshot, or an older one by its version."""
    version = version or current_version(spark, base)
    if version is None:
        raise ValueError(f"no snapshot in {base}")
    return spark.read.parquet(f"{base}/versions/{version}")


def version_of(changes: DataFrame, parent: str | None) -> str:
    """A name that depends on the parent version and the rows of ``changes``, in any order."""
    rows = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(changes.columns)])
    digest = changes.agg(F.count("*"), F.coalesce(F.sum(rows.cast("decimal(38,0)")), F.lit(0))).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{parent}|{digest[0]}|{digest[1]}").hex


def write_version(df: DataFrame, base: str, version: str) -> None:
    """Write a snapshot that nobody reads yet; one that is complete is not written again."""
    if not exists(df.sparkSession, f"{base}/versions/{version}/_SUCCESS"):
        df.write.mode("overwrite").parquet(f"{base}/versions/{version}")


def publish(spark: SparkSession, base: str, version: str) -> None:
    """Make a written version the current one."""
    path = f"{base}/.{POINTER}-{uuid.uuid4().hex}"
    write_text(spark, path, version)
    fresh, files = _files(spark, path)
    fs = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    overwrite[0] = getattr(fs, "Options$Rename").OVERWRITE
    pointer, _ = _files(spark, f"{base}/{POINTER}")
    context = fs.FileContext.getFileContext(files.makeQualified(pointer).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(pointer), overwrite)


def publish_update(base: str, changes: DataFrame, update) -> str:
    """Apply ``update(current, changes)`` to the published snapshot and publish the result; returns its version.

    The version follows from its parent and the changes. The parent is the
    published version, unless that one came from these very changes: then
    nothing is left to do, so a run repeated after a crash gives the same version.
    """
    spark = changes.sparkSession
    parent = current_version(spark, base)
    done = f"{base}/versions/{parent}.from"
    if parent and exists(spark, done):
        if version_of(changes, read_text(spark, done) or None) == parent:
            return parent
    version = version_of(changes, parent)
    write_version(update(read_snapshot(spark, base, parent), changes), base, version)
    write_text(spark, f"{base}/versions/{version}.from", parent or "")
    publish(spark, base, version)
    return version
