import pytest
from conftest import rows
from pyspark.sql import functions as F

from bidloom.functions import expr, patterns
from bidloom.operators import quality


def test_gstin_report(spark):
    df = spark.createDataFrame(
        [(2, "22AAAAA0000A1Z5"), (3, "INVALID"), (4, "27BBBBB1111B1Z6"), (5, None)], "row int, gstin string"
    )
    got = quality.format_report(df, "row", {"gstin": patterns.FORMATS["gstin"]}).first()
    assert (got["n_bad"], got["first_rows"], got["n_more"]) == (1, [3], 0)
    many = spark.createDataFrame([(i, "x") for i in range(9)], "row int, gstin string")
    got = quality.format_report(many, "row", {"gstin": patterns.FORMATS["gstin"]}).first()
    assert (got["n_bad"], got["first_rows"], got["n_more"]) == (9, [0, 1, 2, 3, 4], 4)


def test_minimum_rows(spark):
    df = spark.range(3)
    assert quality.has_rows(df, 3) and not quality.has_rows(df, 4) and not quality.has_rows(df.where("false"))


def test_duplicate_keys_count_nulls_as_one_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), (None,)], "vendor_id string")
    assert rows(quality.duplicate_key_counts(df), "column", "n_duplicates") == [("vendor_id", 3)]


def test_numeric_reasons(spark):
    df = spark.createDataFrame([(5.0,), (-1.0,), (0.0,), (float("nan"),), (None,), (101.0,)], "v double")
    reason = quality.numeric_reason(F.col("v"), 1, 100, allow_negative=False, allow_zero=False)
    assert [r[0] for r in rows(df.select(reason.alias("r")), "r")] == [
        None, "negative", "zero", "missing", "missing", "above maximum",
    ]


def test_phones(spark):
    df = spark.createDataFrame(
        [("+91 98765 43210", "IN"), ("(212) 555-0199", "US"), ("12345", "IN"), ("4915112345678", "DE"), (None, "IN")],
        "p string, c string",
    )
    got = [r[0] for r in rows(df.select(quality.phone_reason(F.col("p"), F.col("c")).alias("r")), "r")]
    assert got == [None, None, "phone", None, "phone"]


def test_summary_counts_violations(spark):
    df = spark.createDataFrame([(1, 50.0, "a@b.co"), (2, 150.0, "bad")], "id int, share double, email string")
    checks = [
        quality.Check("percentage", "share", quality.percentage_reason(F.col("share"))),
        quality.Check("email", "email", quality.email_reason(F.col("email"))),
    ]
    assert rows(quality.check_summary(df, checks), "check", "n_rows", "n_bad") == [("percentage", 2, 1), ("email", 2, 1)]
    assert sorted(rows(quality.violations(df, "id", checks), "check", "row_key", "reason")) == [
        ("email", "2", "email"), ("percentage", "2", "above maximum"),
    ]


def test_required_columns_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),)], "a double")
    with pytest.raises(ValueError, match="b"):
        expr.require(df, "a", "b")
    assert expr.nan_to_null(df).first()[0] is None
    assert expr.with_defaults(df, {"a": 1, "c": 2}).columns == ["a", "c"]
