import gzip
import json

import pytest
from conftest import rows

from bidloom.operators import retrieval
from bidloom.sources import files, staging


def test_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("vendor_id,name\n1,Zoë\n2,b\n", encoding="utf-8")
    (tmp_path / "l.csv").write_bytes("vendor_id,name\n1,Zoë\n".encode("latin-1"))
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("vendor_id,name\n")
    assert rows(files.load_csv(spark, str(tmp_path / "u.csv")), "vendor_id", "name") == [(1, "Zoë"), (2, "b")]
    assert rows(files.load_csv(spark, str(tmp_path / "l.csv"), "vendor_id int, name string"), "vendor_id", "name") == [(1, "Zoë")]
    for name in ("e.csv", "h.csv"):
        with pytest.raises(ValueError):
            files.load_csv(spark, str(tmp_path / name))
    with pytest.raises(Exception, match="(?i)path"):
        files.load_csv(spark, str(tmp_path / "missing.csv"))


def test_csv_folder_of_two_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_text("vendor_id,name\n1,Zoë\n2,b\n", encoding="utf-8")
    (tmp_path / "l.csv").write_bytes("vendor_id,name\n3,Zoë\n4,é\n".encode("latin-1"))
    out = files.load_csv(spark, str(tmp_path), "vendor_id int, name string")
    assert sorted(rows(out, "vendor_id", "name")) == [(1, "Zoë"), (2, "b"), (3, "Zoë"), (4, "é")]


def test_run_folder_can_be_dropped(spark):
    df = spark.range(10)
    with staging.run_folder(spark) as path:
        inside = staging.stage_tables({"a": df, "b": df})
    outside = staging.stage_table(df)
    assert all(path.rsplit("/", 1)[1] in t.inputFiles()[0] for t in inside.values())
    assert inside["a"].count() == 10
    staging.drop_folder(spark, path)
    assert outside.count() == 10
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path).count()


def test_bad_csv_rows_are_kept(spark, tmp_path):
    (tmp_path / "b.csv").write_text("vendor_id,amount\n1,5.5\nx,abc\n")
    out = files.load_csv(spark, str(tmp_path / "b.csv"), "vendor_id int, amount double")
    assert out.count() == 2 and len([r for r in out.collect() if r[files.CORRUPT]]) == 1


def test_corpus_and_manifest(spark, tmp_path):
    for folder, name, text in [("gcc", "a.txt", "one. " * 500), ("gcc", "b.txt", "two"), ("scc", "c.txt", "three"), ("scc", ".hidden", "x"), ("scc", "_skip", "x")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    docs = files.load_corpus(spark, str(tmp_path))
    assert sorted(rows(docs, "folder", "filename", "size")) == [("gcc", "a.txt", 2500), ("gcc", "b.txt", 3), ("scc", "c.txt", 5)]
    chunks = retrieval.chunk_documents(docs, "source")
    assert sorted(rows(files.corpus_manifest(docs, chunks), "folder", "n_documents", "n_chars", "n_chunks")) == [("gcc", 2, 2503, 3), ("scc", 1, 5, 1)]
    assert files.manifest_files(docs).count() == 3


def test_admission(spark, tmp_path):
    for name in ("a.csv", "b.EXE", "c.PDF", "plain"):
        (tmp_path / name).write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r["accepted"] for r in files.file_admission(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": True, "b.EXE": False, "c.PDF": True, "plain": False}
    listing = spark.createDataFrame([("big.csv", 60 * 1024 * 1024)], "path string, length long")
    assert files.admission(listing).first()["reason"] == "File too large (60.00MB). Maximum: 50MB"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["a", "b"]), (2, 1.5, [])], "id int, v double, items array<string>")
    files.write_result(df, str(tmp_path / "p"))
    files.write_result(df, str(tmp_path / "j"), "json")
    files.write_result(df, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["id"])[0] == {"id": 1, "v": None, "items": ["a", "b"]}
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        files.write_result(df, str(tmp_path / "x"), "pdf")


def test_run_records(spark, tmp_path):
    df, runs = spark.range(10), str(tmp_path / "runs")
    out = files.run_stage(df, 3, "bids", lambda d: d.where("id > 3"), str(tmp_path / "out"), runs)
    assert out.count() == 6
    with pytest.raises(Exception, match="nothing"):
        files.run_stage(df, 4, "broken", lambda d: d.select("nothing"), str(tmp_path / "out2"), runs)
    got = sorted(rows(spark.read.parquet(runs), "stage_number", "status", "input_rows"))
    assert got == [(3, "completed", 10), (4, "failed", 10)]


def test_staged_tables_live_in_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert staging.shared_folder(spark) == folder
    table = staging.stage_table(spark.range(5), "t")
    assert table.inputFiles()[0].find("/bidloom/t-") > 0 and table.count() == 5
    both = staging.stage_tables({"a": spark.range(2), "b": spark.range(3)})
    assert (both["a"].count(), both["b"].count()) == (2, 3)


def test_corpus_is_written_as_flat_files(spark, tmp_path):
    text = "a \u20b9\r\nb"
    rows = [("s1", "doc1", text), ("s1", "doc2", None), ("s 2", "doc1", "other"), ("s1", "doc1", "again"), (None, "doc3", "x")]
    docs = spark.createDataFrame(rows, "folder string, name string, text string")
    files.write_corpus(docs, str(tmp_path / "corpus"))
    # a folder for each document costs the local file system more than its text
    assert sorted(p.name for p in (tmp_path / "corpus").rglob("*") if p.is_dir()) == [
        "folder=__HIVE_DEFAULT_PARTITION__", "folder=s 2", "folder=s1"]
    found = {r["filename"] + "|" + r["folder"]: r["text"] for r in files.load_corpus(spark, str(tmp_path / "corpus")).collect()}
    both = found.pop("name=doc1.txt|folder=s1")
    assert sorted([text + "\n" + "again\n", "again\n" + text + "\n"]).count(both) == 1
    assert {k.replace("%20", " "): v for k, v in found.items()} == {
        "name=doc2.txt|folder=s1": "\n", "name=doc1.txt|folder=s 2": "other\n",
        "name=doc3.txt|folder=__HIVE_DEFAULT_PARTITION__": "x\n"}


def test_refused_sizes_round_ties_to_even(spark):
    sizes = [64 * 2**20 + 2**17, 64 * 2**20 + 3 * 2**17, 60 * 2**20 + 1]
    listing = spark.createDataFrame([(f"d/{n}.csv", n) for n in sizes], "path string, length bigint")
    got = [r["reason"] for r in files.admission(listing).orderBy("length").collect()]
    assert got == [f"File too large ({n / 2**20:.2f}MB). Maximum: 50MB" for n in sorted(sizes)]


def test_corpus_is_listed_and_read_as_by_sparks_reader(spark, tmp_path, monkeypatch):
    names = ["a.txt", "sp ace.txt", "100%.txt", "%20.txt", "é ü.txt", "न.txt", "q?#.txt", "br[1]{2}.txt", "p+l,u;s@.txt", 'qu"o\'te|^`<>.txt',
             "b\\s.txt", "no break.txt", "c\x85.txt", "_x=1.txt", "_skip.txt", ".hid", "w._COPYING_", "_metadata", "_metadata.txt", "empty.txt"]
    for folder in ("s1", "s 2/deep/er", "_no", ".no", "_yes=1", "_metadata", "x._COPYING_"):
        (tmp_path / "c" / folder).mkdir(parents=True)
        for n, name in enumerate(names):
            (tmp_path / "c" / folder / name).write_bytes(b"" if name == "empty.txt" else b"%d \xff\r\nx\n\xe2\x82\xac " % n + name.encode())
    (tmp_path / "c" / "top.txt").write_text("﻿top")
    (tmp_path / "c" / "s1" / "link").symlink_to(tmp_path / "c" / "top.txt")
    (tmp_path / "c" / "s1" / "broken").symlink_to(tmp_path / "nothing")
    path = str(tmp_path / "c")
    as_bytes = lambda pairs: pairs.select("source", pairs.text.cast("binary"))
    monkeypatch.setattr(files, "BATCH_BYTES", 50)
    for given in (path, f"file:{path}", f"file://{path}/"):
        expected = spark.read.option("recursiveFileLookup", True).text(given, wholetext=True)
        expected = as_bytes(expected.selectExpr("_metadata.file_path AS source", "value AS text")).collect()
        loaded = files.load_corpus(spark, given)
        found = as_bytes(loaded).collect()
        assert set(found) ^ set(expected) == set() and len(found) == len(expected) == 58
    # the driver knows the files of the listing only
    assert all("/corpus-listing-" in f for f in loaded.inputFiles())
    assert rows(loaded.where("filename = 'top.txt'"), "size", "folder") == [(4, "c")]


def test_corpus_of_packed_files_patterns_and_no_files(spark, tmp_path):
    (tmp_path / "c" / "s").mkdir(parents=True)
    assert files.load_corpus(spark, str(tmp_path / "c")).count() == 0
    (tmp_path / "c" / "s" / "a.txt").write_text("plain")
    assert rows(files.load_corpus(spark, f"{tmp_path}/c/*/a.t?t"), "text") == [("plain",)]
    assert rows(files.load_corpus(spark, f"{tmp_path}/c/s/a.txt"), "text") == [("plain",)]
    (tmp_path / "c" / "s" / "b.txt.gz").write_bytes(gzip.compress(b"packed"))
    assert sorted(rows(files.load_corpus(spark, str(tmp_path / "c")), "text")) == [("packed",), ("plain",)]
    with pytest.raises(Exception, match="(?i)path"):
        files.load_corpus(spark, str(tmp_path / "missing"))
