"""Published snapshots, repeated changes, records over several lines, names in texts."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from bidloom.operators import clauses, corpus_index, names, retrieval
from bidloom.plans import profiles
from bidloom.sources import files, snapshots

FIELDS = "vendor_id string, status string, empanelment_tier string, registration_date string"
CHANGES = FIELDS + ", changed_at int, change_id int"


@pytest.fixture
def base(spark, tmp_path):
    master = spark.createDataFrame([("a", "NEW", None, "d0"), ("b", "NEW", "T1", None)], FIELDS)
    snapshots.write_version(master, str(tmp_path), "v0")
    snapshots.publish(spark, str(tmp_path), "v0")
    return str(tmp_path)


def changes(spark, *given):
    return spark.createDataFrame(list(given), CHANGES)


def test_repeated_changes_apply_in_order_and_double_nothing(spark, base):
    given = changes(
        spark, ("a", "OLD", "T9", None, 1, 1), ("a", "OK", None, None, 2, 1), ("a", "X", None, None, 2, 0), ("zz", "X", None, None, 1, 1)
    )
    out = profiles.update_master(snapshots.read_snapshot(spark, base), given)
    assert sorted(rows(out, *FIELDS.replace(" string", "").split(", "))) == [("a", "OK", "T9", "d0"), ("b", "NEW", "T1", None)]


def test_crash_before_the_swap_leaves_the_old_version(spark, base, monkeypatch):
    given = changes(spark, ("b", "OK", None, None, 1, 1))

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(snapshots, "publish", dies)
    with pytest.raises(OSError, match="gone"):
        snapshots.publish_update(base, given, profiles.update_master)
    assert snapshots.current_version(spark, base) == "v0"
    assert rows(snapshots.read_snapshot(spark, base).where("vendor_id = 'b'"), "status") == [("NEW",)]
    monkeypatch.undo()
    version = snapshots.publish_update(base, given, profiles.update_master)
    assert snapshots.publish_update(base, given.repartition(3), profiles.update_master) == version == snapshots.current_version(spark, base)
    assert rows(snapshots.read_snapshot(spark, base).where("vendor_id = 'b'"), "status") == [("OK",)]
    # older versions stay readable
    assert rows(snapshots.read_snapshot(spark, base, "v0").where("vendor_id = 'b'"), "status") == [("NEW",)]
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_snapshot(spark, base + "/elsewhere")


KIND = "n int, text string, m int"


def csv_text(values, end):
    return end.join(["n,text,m", *(f'{i},"{v.replace(chr(34), chr(34) * 2)}",{i}' for i, v in enumerate(values))]) + end


@pytest.mark.parametrize("split", [1 << 20, 97])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_several_lines_in_many_splits(spark, tmp_path, split, end):
    random.seed(2)
    values = ["".join(random.choices(['"', "\n", ",", "x", "é", "\n\n"], k=random.randint(1, 9))) for _ in range(120)]
    (tmp_path / "a.csv").write_bytes(csv_text(values, end).encode())
    (tmp_path / "b.csv").write_bytes(csv_text(values[::-1], end).encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = files.load_csv(spark, str(tmp_path), KIND)
        got = Counter((r.n, r.text, r.m) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == Counter((i, v, i) for own in (values, values[::-1]) for i, v in enumerate(own))


def test_quotes_inside_plain_fields_and_rows_like_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,text,m\n1,a 5" pipe,1\nn,text,m\n\n2,x"y"z,2\n3,"",3\n4,"a\n\nb",4\n')
    out = files.load_csv(spark, str(tmp_path), KIND).where(F.col("n").isNotNull())
    assert sorted(rows(out, "n", "text", "m")) == [(1, 'a 5" pipe', 1), (2, 'x"y"z', 2), (3, None, 3), (4, "a\n\nb", 4)]
    # a row that repeats the header is data that does not fit the schema
    assert files.load_csv(spark, str(tmp_path), KIND).where(f"{files.CORRUPT} = 'n,text,m'").count() == 1
    assert files.load_csv(spark, str(tmp_path)).where("n = 'n'").count() == 1


def test_names_longest_first_and_whole_tokens(spark):
    known = spark.createDataFrame([(n,) for n in ["Acme", "acme Ltd", "Acme Ltd. Trading", "Trading House", "x", None, "--", "ACME"]], "name string")
    texts = [
        (1, "With ACME, ltd trading house and Acme."), (2, "acmes only"), (3, None), (4, ""), (5, "x x x Trading-House/acme LTD"), (6, "Acme ltd"),
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id: r.organizations for r in names.with_organizations(df, known, ["doc_id"]).collect()}
    assert got == {1: ["Acme Ltd. Trading", "ACME"], 2: [], 3: [], 4: [], 5: ["x", "Trading House", "acme Ltd"], 6: ["acme Ltd"]}
    features = {r.doc_id: r.vendor_name for r in clauses.document_features(df, names=known).collect()}
    assert features == {1: "Acme Ltd. Trading", 2: None, 3: None, 4: None, 5: "x", 6: "acme Ltd"}
    assert names.with_organizations(df, known.where("false"), ["doc_id"]).where("size(organizations) > 0").count() == 0
    assert names.with_organizations(df.where("false"), known, ["doc_id"]).count() == 0


def test_index_grows_with_what_changed(spark, tmp_path):
    base = str(tmp_path)
    docs = [(f"d{k}", f"text number {k}. " * (1 + k % 5 * 60)) for k in range(200)]
    kind = "source string, text string"
    corpus_index.update_index(base, spark.createDataFrame(docs, kind))
    first = spark.read.parquet(f"{base}/segments/segment=1").count()
    after = [(k, t + "changed") if k in ("d7", "d9") else (k, t) for k, t in docs if k != "d3"] + [("new", "a new one")]
    states = dict(rows(corpus_index.update_index(base, spark.createDataFrame(after, kind)).where("state <> 'same'"), "source", "state"))
    assert states == {"d7": "changed", "d9": "changed", "d3": "gone", "new": "added"}
    # about what changed was written, and the whole equals a full build with the same model
    fresh = spark.read.parquet(f"{base}/segments/segment=2")
    assert {r.source for r in fresh.select("source").collect()} == {"d7", "d9", "new"} and fresh.count() < 0.05 * first
    columns = ["source", "chunk_no", "chunk_text", "embedding"]
    chunks = retrieval.chunk_documents(spark.createDataFrame(after, kind), "source")
    full = retrieval.embed(PipelineModel.load(f"{base}/model"), chunks)
    assert sorted(rows(corpus_index.read_index(spark, base), *columns)) == sorted(rows(full, *columns))
    corpus_index.compact(spark, base)
    assert sorted(rows(corpus_index.read_index(spark, base), *columns)) == sorted(rows(full, *columns))
    again = corpus_index.update_index(base, spark.createDataFrame(after, kind))
    assert again.where("state <> 'same'").count() == 0 and corpus_index.read_index(spark, base).count() == full.count()


def test_an_index_is_read_and_grown_without_moving_texts(spark, tmp_path):
    base, kind = str(tmp_path), "source string, text string"
    docs = [(f"{k:032d}", f"text number {k}. " * 20) for k in range(20000)]
    corpus_index.update_index(base, spark.createDataFrame(docs, kind))
    after = [(k, t + "changed") if n < 20 else (k, t) for n, (k, t) in enumerate(docs) if n != 30]
    whole = spark.createDataFrame(after, kind)
    # smaller than the manifest, larger than what changed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        corpus_index.update_index(base, whole)
        index = corpus_index.read_index(spark, base)
        plan = index._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        got = sorted(rows(index, "source", "chunk_no", "chunk_text"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(rows(retrieval.chunk_documents(whole, "source"), "source", "chunk_no", "chunk_text"))
