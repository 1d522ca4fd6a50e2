import datetime as dt
import random
import re

from conftest import rows
from pyspark.sql import functions as F

from bidloom.functions import formats, text
from bidloom.operators import clauses, clean, names


def _texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, text string")


def test_clean_text(spark):
    df = _texts(spark, ["  A  b\t\tc®©™\r\nd\n \n\n e é ", None, ""])
    got = [r[0] for r in rows(df.select(text.clean_text(F.col("text")).alias("t")), "t")]
    assert got == ["A b c\nd\n\n e", "", ""]


def test_currency_values(spark):
    df = _texts(spark, ["₹2,50,000", "Rs. 1,00,000", "500000", "1000", "abc", None, "12d", "1e3", "-5.5"])
    got = [r[0] for r in rows(df.select(text.currency_to_double(F.col("text")).alias("t")), "t")]
    assert got == [250000.0, 100000.0, 500000.0, 1000.0, 0.0, 0.0, 0.0, 1000.0, -5.5]


def test_dates(spark):
    day = dt.date(2026, 1, 15)
    values = ["15-01-2026", "15/01/2026", "2026-01-15", "2026/1/15", "15-Jan-2026", "15 January 2026", "January 15, 2026"]
    df = _texts(spark, [*values, "30-02-2026", "soon", None])
    got = [r[0] for r in rows(df.select(text.parse_date(F.col("text")).alias("t")), "t")]
    assert got == [day] * 7 + [None] * 3


def test_normalize_data(spark):
    df = spark.createDataFrame(
        [("V1", "₹2,50,000", "120.0", "15-01-2026"), ("V2", "500000", "-3", "bad")],
        "vendor_id string, contract_value string, quality_score string, contract_date string",
    )
    assert rows(clean.normalize_data(df), "contract_value", "quality_score", "contract_date") == [
        (250000.0, 100.0, dt.date(2026, 1, 15)),
        (500000.0, 0.0, None),
    ]


def test_segments_split_decimals(spark):
    df = _texts(spark, ["Pay in 30 days. Penalty of 0.5% applies. . \n Done.\n", "", None])
    assert rows(clauses.segment(df), "doc_id", "clause_id", "clause_text") == [
        (0, 1, "Pay in 30 days"),
        (0, 2, "Penalty of 0"),
        (0, 3, "5% applies"),
        (0, 4, "Done"),
    ]


def test_clause_types_and_tags(spark):
    df = spark.createDataFrame(
        [
            (1, "Payment shall be made within 30 days"),
            (2, "Penalty of 0.5% will apply for delays"),
            (3, "Warranty period is 12 months"),
            (4, "The contractor must deliver by deadline"),
            (5, "Nothing here"),
        ],
        "i int, clause_text string",
    )
    out = clauses.with_tags(clauses.with_type(df)).orderBy("i")
    assert rows(out, "clause_type", "mandatory", "risk_level") == [
        ("payment", True, "low"),
        ("penalty", False, "high"),
        ("warranty", False, "medium"),
        ("delivery", True, "low"),
        ("other", False, "low"),
    ]


def test_extraction_and_features(spark):
    body = (
        "Contract dated 15-01-2026 and 30/06/2026.\nContract Value: ₹2,50,00,000 and INR 5,000.50, Rs. 70\n"
        "Payment shall be made within 30 days.\nA penalty of 0.5% per week\nThe warranty is 12 months\n"
    )
    df = _texts(spark, [body])
    one = df.select(clauses.entities(F.col("text")).alias("e")).select("e.*").first()
    assert one["dates"] == ["15-01-2026", "30/06/2026"]
    assert one["money"] == ["2,50,00,000", "70", "5,000.50"]
    assert one["percentages"] == ["0.5%"]
    got = clauses.document_features(df).first()
    assert (got["contract_value"], got["payment_terms"], got["penalty_clause"], got["warranty_period"]) == (
        "2,50,00,000", "30 days", "0.5%", "12 month",
    )
    roll = clauses.document_rollup(clauses.clause_table(df)).first()
    assert roll["clause_count"] > 0 and roll["mandatory_clauses"] == 1


def test_number_texts(spark):
    values = [150000.0, 28500000.0, -1234567.891, 999.995, 0.0, 12.0, 98627.765, 0.996]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in rows(df.select("i", formats.currency(F.col("v")).alias("t")).orderBy("i"), "t")]
    plain = [f"{abs(v):.2f}" for v in values]
    assert [t.replace("₹", "").replace(",", "").replace("-", "") for t in got] == plain
    assert got[0] == "₹1,50,000.00" and got[1] == "₹2,85,00,000.00" and got[2] == "₹-12,34,567.89"
    big = spark.createDataFrame([(1500000.0,), (2500.0,), (12.0,)], "v double")
    assert [r[0] for r in rows(big.select(formats.large_number(F.col("v")).alias("t")), "t")] == ["1.5M", "2.5K", "12"]
    assert [r[0] for r in rows(big.select(formats.currency_compact(F.col("v")).alias("t")), "t")] == [
        "₹15.00L", "₹2.50K", "₹12.00",
    ]


def test_number_texts_round_as_the_exact_value(spark):
    # 0.045 and 31.785 lie off a tie that their product with 100 meets; 0.125 and 0.375 are ties
    values = [0.045, 1.005, 0.285, 31.785, 0.125, 0.375, 4.035, 14.145, 0.145, 1234567.125, 0.995, 8.325, 0.015, 0.075]
    values += [i / 1000 for i in range(5, 20000, 10)] + [i / 8 for i in range(64)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", formats.fixed_text(F.col("v"), 2).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in got] == [(r["v"], f"{r['v']:.2f}") for r in got]


def _by_hand(text, known):
    """Names in a text: each token goes to the longest name over it, then the first; a name with all of its tokens stays."""
    words = re.findall(r"[^\W_]+", text.lower())
    met = [(len(n), -i, " ".join(n)) for i in range(len(words)) for n in known if tuple(words[i : i + len(n)]) == n]
    best = {t: max(m for m in met if -m[1] <= t < m[0] - m[1]) for m in met for t in range(-m[1], m[0] - m[1])}
    return sorted((-at + 1, size, name) for size, at, name in set(met) if all(best[t] == (size, at, name) for t in range(-at, size - at)))


def test_names_in_random_texts_move_once(spark):
    random.seed(4)
    words = [f"w{k}" for k in range(9)]
    known = {tuple(random.choices(words[:5], k=random.randint(1, 4))) for _ in range(12)}
    texts = [(k, random.choice([" ", "--", ". "]).join(random.choices(words, k=random.randint(0, 40)))) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    found = names.find_names(df, spark.createDataFrame([(" ".join(n),) for n in known], "name string"), ["doc_id"])
    got = {k: [] for k, _ in texts}
    for r in found.collect():
        got[r.doc_id].append((r.at, r.size, r.name))
    assert {k: sorted(v) for k, v in got.items()} == {k: _by_hand(text, known) for k, text in texts}
    # what is found moves once, to its row, and texts are taken apart once
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    exchanges = re.findall(r"Exchange hashpartitioning\(.*", found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])
    assert len(exchanges) == 1


def test_texts_stay_where_names_are_joined(spark):
    known = spark.createDataFrame([("Acme",), ("Acme Ltd",)], "name string")
    df = spark.createDataFrame([(1, "by ACME ltd. INR 5 on 1-2-2024, 3 %"), (2, None)], "doc_id int, text string")
    for table, first in (
        (clauses.with_entities(df, known, ["doc_id"]).drop("text"), (1, ["1-2-2024"], ["5"], ["3 %"], ["Acme Ltd"])),
        (clauses.document_features(df, names=known).select("doc_id", "contract_value", "vendor_name"), (1, "5", "Acme Ltd")),
    ):
        assert tuple(table.orderBy("doc_id").first()) == first
        join = table._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].split("Relation")[0]
        # what comes to the join are the facts, not the text
        columns = re.search(r"Project \[(.*)\]", join).group(1)
        assert " AS " in columns and not re.search(r"(^|, )text#\d+(,|$)", columns)


def test_clauses_are_segmented_once(spark):
    pieces = clauses.segment(_texts(spark, ["A. b.  c", None, "", " . "]))
    assert sorted(rows(pieces, "doc_id", "clause_id", "clause_text")) == [(0, 1, "A"), (0, 2, "b"), (0, 3, "c")]
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
