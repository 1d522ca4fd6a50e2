"""Readers and writers: CSV, text corpora, file drops, results, run records."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bidloom.functions import patterns as P
from bidloom.functions.formats import fixed_text
from bidloom.sources.staging import stage_table

# tasks carry this module's functions themselves, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRUPT = "_corrupt_record"


# What a line does to "inside quotes", by whether it begins outside or inside: a
# quote opens at the start of a field only, and closes unless doubled.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'(?s)^{_FIELDS}"{_QUOTED}$'
_STAYS = rf'(?s)^{_QUOTED}$'
_CLOSES_AND_OPENS = rf'(?s)^{_QUOTED}"[^,]*+,{_FIELDS}"{_QUOTED}$'


def _state(first: Column, fixed: Column, flips: Column) -> Column:
    """Inside quotes after lines: the value of the last line that fixes it, or the first state, turned by the flips since."""
    turned = F.when(fixed.isNull(), flips).otherwise(flips - fixed["flips"])
    return F.coalesce(fixed["value"], first) != (turned % 2 == 1)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records of CSV files, whose quoted fields may hold line breaks.

    The files are read in splits, line by line. Each line maps outside and inside
    of quotes to outside or inside; the maps are composed over the lines of a
    split, then over the splits of a file (one row each), so the state at every
    line is known without reading a file in one task. Lines that begin outside
    begin a record. Only records of several lines are put together by a shuffle.

    A record keeps its bytes, without the line end; ``first`` marks the first of
    each file. A quote that is never closed makes the rest of its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    has_quote = F.col("value").contains('"')
    from_out = has_quote & F.col("value").rlike(_OPENS)
    from_in = ~has_quote | F.col("value").rlike(_STAYS) | F.col("value").rlike(_CLOSES_AND_OPENS)
    lines = stage_table(lines.withColumns({"_out": from_out, "_in": from_in}), "csv-lines")

    # per line: a flip (outside and inside change places), a fixed end, or neither
    flips = (F.col("_out") & ~F.col("_in")).cast("int")
    own = Window.partitionBy("file", "block").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_flips", F.sum(flips).over(own))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("value"), F.col("_flips").alias("flips")))
    marked = marked.withColumn("_fixed", fixed)
    by_split = marked.groupBy("file", "block").agg(
        F.max("_flips").alias("_flips"), F.max_by("_fixed", F.when(F.col("_fixed").isNotNull(), F.col("seq"))).alias("_fixed")
    )
    # the state and the last begun record at each split: over the splits of a file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = by_split.withColumn("_all", F.sum("_flips").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    own_fixed = F.when(
        F.col("_fixed").isNotNull(),
        F.struct(F.col("_fixed.value").alias("value"), (F.col("_all") - F.col("_flips") + F.col("_fixed.flips")).alias("flips")),
    )
    totals = totals.withColumn("_own", own_fixed)
    starts = totals.select(
        "file", "block",
        F.coalesce(
            _state(F.lit(False), F.last("_own", True).over(earlier), F.coalesce(F.sum("_flips").over(earlier), F.lit(0))),
            F.lit(False),
        ).alias("_start"),
        F.row_number().over(Window.partitionBy("file").orderBy("block")).alias("_nth"),
    )
    placed = marked.join(starts, ["file", "block"])
    inside = _state(F.col("_start"), F.last("_fixed", True).over(before), F.coalesce(F.sum(flips).over(before), F.lit(0)))
    placed = placed.withColumn("_begins", ~inside)
    after = F.when(F.col("_begins"), F.col("_out")).otherwise(F.col("_in"))
    first = (F.col("_nth") == 1) & (F.row_number().over(own) == 1)
    placed = placed.select("file", "block", "seq", "value", "_begins", after.alias("_open"), first.alias("first"))
    alone = placed.where("_begins and not _open").select("file", "first", "value")
    rest = placed.where("not (_begins and not _open)")
    # lines of a longer record go to its first line; a split that begins none passes on the one before it
    latest = F.last(F.when(F.col("_begins"), F.struct("block", "seq")), True)
    within = rest.withColumn("_head", latest.over(own))
    heads = within.groupBy("file", "block").agg(F.max("_head").alias("_last"))
    carried = heads.select("file", "block", F.last("_last", True).over(earlier).alias("_carried"))
    joined = within.join(carried, ["file", "block"]).withColumn("_head", F.coalesce("_head", "_carried"))
    long = joined.groupBy("file", "_head").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).getField("value"), "\n").alias("value"),
        F.bool_or("first").alias("first"),
    )
    whole = alone.unionByName(long.select("file", "first", "value"))
    # byte by byte: what is not UTF-8 must not pass through a decoder here
    return whole.select("file", "first", F.expr(r"trim(TRAILING '\r' FROM value)").alias("text"))


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; quoted fields may hold line breaks, and a record that is not valid UTF-8 is read as Latin-1.

    Every file begins with the same header. Give a schema for large inputs;
    without one the types are inferred, which reads the files an extra time. A
    record that does not fit keeps its text in the corrupt-record column; blank
    records are skipped. Missing, empty or row-less input is an error.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = csv_records(spark, path)
    latin = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    text = F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(latin)
    body = stage_table(records.where((~F.col("first")) & (F.trim("text") != "")).select(text.alias("value")), "csv-records")
    if body.isEmpty():
        raise ValueError(f"no rows in {path}")
    if schema is None:
        reader = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"')
        kind = reader.csv(path).schema
    else:
        kind = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return body.select(F.from_csv("value", ddl, options).alias("row")).select("row.*")


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _write_files(root: str):
    """Each (folder, name, text) row, sorted by the first two, into a file; one that is cut off stays hidden."""

    def run(rows: Iterator) -> None:
        for (folder, name), same in groupby(rows, key=lambda r: (r[0], r[1])):
            inside = f"{root}/folder={quote(folder, safe=' ')}"
            os.makedirs(inside, exist_ok=True)
            waiting = f"{inside}/.{uuid.uuid4().hex}"
            with open(waiting, "w", encoding="utf-8", newline="") as out:
                out.writelines(f"{r[2]}\n" for r in same)
            os.replace(waiting, f"{inside}/name={quote(name, safe=' ')}.txt")

    return run


def write_corpus(df: DataFrame, path: str) -> None:
    """(folder, name, text) rows as text files below ``path``, one for each folder and name.

    Rows of one folder and name share its file, a line end after each. A folder
    that all executors mount (a ``file:`` path) is written by the tasks
    themselves: Hadoop's local file system starts two processes for each file and one
    for each folder, which takes longer than the data. Any other path goes
    through Spark's writer, where a file lies in a folder of its name.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    rows = df.select("folder", "name", F.coalesce("text", F.lit("")).alias("text")).repartition("folder", "name")
    if whole.getScheme() != "file":
        rows.write.partitionBy("folder", "name").option("lineSep", "\n").text(path)
        return
    named = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(_NO_VALUE)) for c in ("folder", "name")})
    named.sortWithinPartitions("folder", "name").foreachPartition(_write_files(whole.getPath()))


# Files and bytes that one task reads, about, and the bytes of text that it returns at a time.
TASK_FILES = 16_384
TASK_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_ENTRY = "path binary, source string, length bigint, is_folder boolean"
# Spark's reader unpacks these by their names.
_COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"


def _as_uri(path: str) -> str:
    """The path as Hadoop writes it: what a URI cannot hold is quoted, letters of any script stay."""
    other = lambda c: c > "\x9f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp")
    return "file:" + "".join(c if c.isascii() and c.isalnum() or c in "/_-!.~'()*,;:$&+=@" or other(c) else quote(c, safe="") for c in path)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _list_folders(schema: pa.Schema):
    """What lies in each folder; what Spark's reader skips by its name or for being empty is left out."""

    def entries(folder: bytes) -> Iterator[tuple]:
        with os.scandir(folder) as found:
            for entry in found:
                name = os.fsdecode(entry.name)
                inside = entry.is_dir()
                hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                if hidden and not (inside and name.startswith(("_metadata", "_common_metadata"))):
                    continue
                try:
                    length = entry.stat().st_size
                except FileNotFoundError:  # a link to nothing, or a file that has just gone
                    continue
                if inside or length:
                    yield entry.path, _as_uri(os.fsdecode(entry.path).encode(errors="replace").decode()), length, inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                listed = entries(folder)
                while rows := list(islice(listed, TASK_FILES)):
                    yield _packed(rows, schema)

    return run


def _read_files(schema: pa.Schema):
    """(source, bytes) of each listed file; at most about ``BATCH_BYTES``, or one file, are Python objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(path, "rb") as file:
                    rows.append((source, file.read()))
                size += len(rows[-1][1])
                if size >= BATCH_BYTES:
                    yield _packed(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _packed(rows, schema)

    return run


def _list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, length) of the files below a mounted folder: tasks list the folders of one depth after another."""
    kind = T.StructType.fromDDL(_ENTRY)
    folders = spark.createDataFrame([(bytearray(os.fsencode(root)),)], "path binary")
    found, n = None, 1
    while n:
        # one task for each folder, up to a bound
        dealt = folders.repartition(min(n, 1024))
        level = stage_table(dealt.mapInArrow(_list_folders(to_arrow_schema(kind)), kind), "corpus-listing")
        found = level if found is None else found.unionByName(level)
        folders = level.where("is_folder").select("path")
        n = folders.count()
    return found.where("not is_folder").drop("is_folder")


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) per file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    if whole.getScheme() == "file" and os.path.isdir(whole.getPath()):
        listed = _list_files(spark, whole.getPath())
        facts = listed.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.count_if(F.col("source").rlike(_COMPRESSED)).alias("packed")).first()
        if not facts["packed"]:
            least = min(facts["n"], spark.sparkContext.defaultParallelism)
            tasks = max(1, least, -(-facts["n"] // TASK_FILES), -(-(facts["bytes"] or 0) // TASK_BYTES))
            # a given number, as the sizes of the names say nothing about those of the files; sorted, so that rows lie alike in every run
            dealt = listed.select("path", "source").repartition(tasks, "source").sortWithinPartitions("source")
            out = T.StructType.fromDDL("source string, text binary")
            read = dealt.mapInArrow(_read_files(to_arrow_schema(out)), out)
            return read.select("source", F.col("text").cast("string").alias("text"))
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(filename, folder, source, size, text) per file; hidden, '_' and empty files are skipped.

    Tasks list and read a folder that all executors mount (a ``file:`` path):
    Spark's reader keeps the status of every file in the driver, about two
    kilobytes each, and starts a task for some thirty of them. Any other path,
    a pattern, and a folder with packed files go through that reader.
    """
    parts = F.split(F.col("source"), "/")
    return _whole_texts(spark, path).select(
        F.element_at(parts, -1).alias("filename"),
        F.element_at(parts, -2).alias("folder"),
        "source",
        F.length("text").alias("size"),
        "text",
    )


def corpus_manifest(docs: DataFrame, chunks: DataFrame | None = None, key: str = "source") -> DataFrame:
    """Documents, characters and chunks per folder.

    The list of files is the document table itself (``manifest_files``): it grows
    with the corpus and so is not packed into one row.
    """
    base = docs.groupBy("folder").agg(F.count("*").alias("n_documents"), F.sum("size").alias("n_chars"))
    if chunks is None:
        return base
    # chunks are counted per document first, so the join sees one row per document
    per_doc = chunks.groupBy(key).agg(F.count("*").alias("_chunks"))
    counted = docs.select(key, "folder").join(per_doc, key, "left")
    by_folder = counted.groupBy("folder").agg(F.coalesce(F.sum("_chunks"), F.lit(0)).alias("n_chunks"))
    return base.join(by_folder, "folder", "left")


def manifest_files(docs: DataFrame) -> DataFrame:
    return docs.select("folder", "filename", "size", "source")


def file_admission(spark: SparkSession, path: str) -> DataFrame:
    """Which dropped files are accepted, with the reason for each refusal.

    Only names and lengths are read, never the contents.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path"), F.col("length"))
    )
    return admission(listing)


def admission(listing: DataFrame) -> DataFrame:
    """(path, length, accepted, reason) from a table of paths and lengths."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    megabytes = fixed_text(F.col("length") / F.lit(1024.0 * 1024.0), 2)
    limit = P.MAX_FILE_BYTES // (1024 * 1024)
    # Refusal texts.
    reason = (
        F.when(
            ~extension.isin(P.DROP_EXTENSIONS), F.lit(f"Invalid file type. Allowed: {', '.join(P.DROP_EXTENSIONS)}")
        )
        .when(
            F.col("length") > P.MAX_FILE_BYTES,
            F.concat(F.lit("File too large ("), megabytes, F.lit(f"MB). Maximum: {limit}MB")),
        )
        .otherwise("")
    )
    return listing.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def write_result(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Result sink; CSV takes nested columns as JSON text, JSON takes NaN as null."""
    if form == "parquet":
        df.write.parquet(path)
        return
    if form == "json":
        floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
        clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
        clean.write.option("ignoreNullFields", False).json(path)
        return
    if form == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        # quotes are doubled, as csv_records and most other readers expect
        options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        flat.write.options(**options).csv(path)
        return
    raise ValueError(f"unknown result format: {form}")


_RUN = (
    "run_id string, stage_number int, stage_name string, status string, started timestamp, "
    "duration_seconds double, input_rows bigint, error string"
)


def run_stage(df: DataFrame, stage_number: int, stage_name: str, transform, sink: str, runs: str) -> DataFrame:
    """Run a stage into ``sink`` and append one record to the ``runs`` table.

    The input is written once, so that counting it does not run what made it twice.
    A failed stage is recorded too, and its error raised again.
    """
    spark = df.sparkSession
    started, clock = dt.datetime.now(), time.monotonic()
    status, error, rows = "completed", None, None
    try:
        df = stage_table(df, "stage-input")
        rows = df.count()
        write_result(transform(df), sink)
    except Exception as problem:
        status, error = "failed", str(problem)
        raise
    finally:
        record = [
            (uuid.uuid4().hex, stage_number, stage_name, status, started, time.monotonic() - clock, rows, error)
        ]
        spark.createDataFrame(record, _RUN).coalesce(1).write.mode("append").parquet(runs)
    return spark.read.parquet(sink)
