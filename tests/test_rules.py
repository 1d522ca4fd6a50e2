from conftest import rows
from pyspark.sql import functions as F

import pytest

from bidloom.operators import recommend, rules


def test_vendor_scores(spark):
    df = spark.createDataFrame(
        [(90, 95, 92, 98, 0), (40, 35, 45, 50, 5), (70, 68, 72, 75, 1)],
        "cost_competitiveness int, on_time_delivery int, quality_score int, compliance_score int, past_disputes int",
    )
    assert [r[0] for r in rows(df.withColumn("s", rules.vendor_score(df)), "s")] == [93.85, 37.25, 71.65]


def test_missing_inputs_follow_the_capped_defaults(spark):
    df = spark.createDataFrame([(None, None)], "cost_competitiveness int, past_disputes int")
    assert rows(df.withColumn("s", rules.vendor_score(df)), "s") == [(30.0,)]


def test_risk_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in (85, 75, 65, 50, 45, 20, 100, -1)], "s double")
    got = [r[0] for r in rows(df.withColumn("b", rules.score_risk(F.col("s"))), "b")]
    assert got == ["low", "low", "medium", "medium", "high", "high", "low", "low"]


def test_vendor_rules(spark):
    df = spark.createDataFrame(
        [("V1", 88, 92, 90, 95, 0, 0), ("V2", 65, 58, 62, 68, 2, 3), ("V3", 42, 38, 45, 50, 4, 5)],
        "vendor_id string, cost_competitiveness int, on_time_delivery int, quality_score int, compliance_score int, "
        "past_disputes int, dispute_count int",
    )
    out = rules.vendor_rules(df)
    assert rows(out, "vendor_score", "risk_level", "high_dispute_flag", "low_compliance_flag", "preferred_vendor") == [
        (91.65, "low", False, False, True),
        (62.6, "medium", True, True, False),
        (40.6, "high", True, True, False),
    ]
    recs = rules.rule_recommendations(out, "vendor")
    assert rows(recs, "type", "count") == [("preferred_vendors", 1), ("high_risk_vendors", 1)]


BIDS = [("V001", 250000, 30), ("V002", 350000, 28), ("V003", 180000, 50), ("V004", 245000, 31), ("V005", 260000, 29)]


def test_bid_rules(spark):
    df = spark.createDataFrame(BIDS, "vendor_id string, quoted_price int, delivery_days int")
    out = rules.bid_rules(df).orderBy("vendor_id")
    assert [r[0] for r in rows(out, "anomaly_severity")] == ["none", "medium", "medium", "none", "none"]
    assert rows(out.where("vendor_id = 'V002'"), "price_high_flag", "delivery_deviation_flag") == [(True, True)]
    grouped = rules.bid_rules(df.withColumn("rfq", F.lit(1)), ["rfq"]).orderBy("vendor_id")
    assert rows(grouped, "anomaly_severity") == rows(out, "anomaly_severity")


def test_contract_rules(spark):
    text = "yes"
    df = spark.createDataFrame(
        [
            ("C001", 5e6, text, text, text, text, text, True, "low"),
            ("C002", 15e6, None, text, text, None, text, False, "high"),
            ("C003", 75e6, text, text, text, text, text, True, "medium"),
        ],
        "contract_id string, contract_value double, payment_clause string, penalty_clause string, "
        "termination_clause string, warranty_clause string, liability_clause string, gcc_compliant boolean, "
        "vendor_risk_level string",
    )
    out = rules.contract_rules(df)
    assert rows(out, "contract_risk_score", "rag_status", "requires_board_approval") == [
        (0, "Green", False),
        (70, "Red", False),
        (20, "Green", True),
    ]
    assert rows(rules.rule_recommendations(out, "contract"), "type", "count") == [("red_contracts", 1)]


def test_weights_must_sum_to_hundred():
    with pytest.raises(ValueError):
        rules.RuleSettings(weights={"quality_score": 50})


def test_amounts_add_up_exactly(spark):
    amounts = [1e15] + [0.01, 1e9 + 0.07] * 2000 + [-1e15, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(amounts)], "id int, v double")
    got = recommend.recommend(df.coalesce(1), [recommend.Rule("all", "High", "true", amount="v", id_col="id")]).first()
    assert round(got["amount"], 2) == 2000000000160.0 and got["count"] == len(amounts)
    # beyond what a decimal holds it is a plain sum
    huge = spark.createDataFrame([(1, 1e300), (2, 1.0)], "id int, v double")
    assert recommend.recommend(huge, [recommend.Rule("all", "High", "true", amount="v")]).first()["amount"] == 1e300
