"""Stage plans on small literal tables, and fraud under heavy skew."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from bidloom.operators import recommend
from bidloom.plans import (
    approval,
    change_orders,
    contract_review,
    documents,
    fraud,
    negotiation,
    predictive,
    profiles,
    records,
    rfq,
    risk,
    shortlist,
)


def test_approval_rules_last_one_wins(spark):
    df = spark.createDataFrame(
        [("V1", "a", 90.0, 90.0, 90.0, 90.0), ("V2", "b", 90.0, 55.0, 95.0, 95.0), ("V3", "c", 45.0, 99.0, 99.0, 99.0),
         ("V4", "d", 70.0, 70.0, 70.0, 70.0), ("V5", "e", 55.0, 61.0, 55.0, 55.0), ("V6", "f", None, 90.0, 90.0, 90.0)],
        "vendor_id string, vendor_name string, financial_score double, compliance_score double, performance_score double, delivery_score double",
    )
    out = approval.assess(df)
    assert [r[0] for r in rows(out.orderBy("vendor_id"), "status")] == [
        "approved", "rejected", "rejected", "pending", "rejected", "pending",
    ]
    assert rows(approval.top_vendors(out, 2), "vendor_id") == [("V1",), ("V2",)]
    assert approval.statistics(out).first()["approval_rate"] == pytest.approx(100 / 6)
    with pytest.raises(ValueError):
        approval.assess(df.drop("vendor_id"))
    assert approval.statistics(out.where("false")).first()["total_vendors"] == 0


def test_purchase_orders(spark):
    amounts = [250000.0, 5500000.0, 1200000.0, 450000.0, 8000000.0, 0.0]
    df = spark.createDataFrame([(i, f"V{i}", f"n{i}", a) for i, a in enumerate(amounts, 1)], "n int, vendor_id string, vendor_name string, amount double")
    numbered = documents.numbered(df, [F.col("n")])
    out = documents.purchase_orders(numbered, "2026-01-07").orderBy("po_number")
    assert rows(out, "po_number", "payment_terms", "requires_approval")[:5] == [
        ("PO-20260107-0001", "30 days", False), ("PO-20260107-0002", "45 days", True), ("PO-20260107-0003", "45 days", False),
        ("PO-20260107-0004", "30 days", False), ("PO-20260107-0005", "45 days", True),
    ]
    assert rows(out.limit(1), "date", "delivery_date") == [(dt.date(2026, 1, 7), dt.date(2026, 2, 6))]
    checked = documents.validate(documents.both(numbered, "2026-01-07"))
    assert documents.statistics(checked.where("doc_type = 'po'")).first()["total_value"] == 15400000.0
    assert tuple(documents.batch_result(checked).first()) == (12, 10, 2)
    missing = documents.validate(documents.purchase_orders(numbered.withColumn("vendor_id", F.lit(None).cast("string")), "2026-01-07"))
    assert "Missing vendor_id" in missing.first()["validation_errors"]


def test_rfq_severities(spark):
    prices = [100.0] * 12 + [1000.0, 60.0, 100.0]
    df = spark.createDataFrame(
        [(i, f"V{i}", p, 30 if i != 12 else 90, "30", "45" if i in (12, 3) else "30") for i, p in enumerate(prices)],
        "i int, vendor_id string, quoted_price double, delivery_days int, payment_terms string, required_payment_terms string",
    )
    out = rfq.analyze(df).orderBy("i")
    got = {r["i"]: (r["severity"], r["anomaly_count"]) for r in out.collect()}
    assert got[12] == ("high", 3) and got[3][0] == "medium" and got[0][0] == "low"
    by_set = rfq.analyze(df.withColumn("rfq", F.lit("r")), ["rfq"]).orderBy("i")
    assert rows(by_set, "severity", "anomaly_count") == rows(out, "severity", "anomaly_count")
    only_price = rfq.analyze(df.select("vendor_id", "quoted_price"))
    assert only_price.where("delivery_anomaly or spec_mismatch").count() == 0


def test_shortlist_keeps_disputes_and_rank_is_a_permutation(spark):
    rng = random.Random(4)
    df = spark.createDataFrame(
        [(f"V{i:03d}", f"n{i}", *[float(rng.randint(55, 100)) for _ in range(4)], rng.randint(0, 5)) for i in range(300)],
        "vendor_id string, vendor_name string, delivery_score double, quality_score double, cost_competitiveness double, payment_compliance double, dispute_count int",
    )
    checked = shortlist.eligibility(shortlist.score(df))
    ranked = shortlist.rank(checked)
    n = checked.where("eligible").count()
    assert sorted(r[0] for r in rows(ranked, "rank")) == list(range(1, n + 1))
    top = shortlist.shortlist(checked, 7)
    assert sorted(rows(top, "rank", "vendor_id")) == sorted(rows(ranked.where("rank <= 7"), "rank", "vendor_id"))
    assert "dispute_count" in top.columns
    recs = recommend.recommend(top, shortlist.RULES).collect()
    assert recs[0]["ids"] == [v for _, v in sorted(rows(top, "rank", "vendor_id"))[:3]]
    assert shortlist.result(checked).first()["shortlisted_count"] == 10


def test_negotiation_low_odds_get_the_whole_sentence(spark):
    df = spark.createDataFrame(
        [("V1", 100.0, 130.0, 100.0, 45.0), ("V2", 130.0, 100.0, 140.0, 95.0), ("V3", 90.0, 100.0, 120.0, 50.0)],
        "vendor_id string, current_price double, market_avg_price double, historical_avg_price double, vendor_relationship_score double",
    )
    out = {r["vendor_id"]: r for r in negotiation.analyze(df).collect()}
    assert out["V2"]["recommended_approach"] == "Aggressive Negotiation" and out["V2"]["strategy"].startswith("Start with aggressive offer at ₹95.00")
    assert out["V3"]["risk_level"] == "High" and out["V3"]["recommended_approach"] == "No Negotiation"
    assert all(0.1 <= r["success_probability"] <= 0.95 for r in out.values())


def test_contract_review_counts_row_by_row(spark):
    clauses = contract_review.CLAUSES
    df = spark.createDataFrame(
        [("C1", 5e6, *[True] * 7, True, True), ("C2", 2e7, *[False] * 4, None, True, True, False, False)],
        "contract_id string, contract_value double, " + ", ".join(f"{c} boolean" for c in clauses) + ", gcc_compliant boolean, scc_included boolean",
    )
    a, b = contract_review.analyze(df).orderBy("contract_id").collect()
    assert (a["risk_score"], a["rag_status"], a["is_compliant"]) == (0, "Green", True)
    assert (b["missing_clauses"], b["risk_score"], b["rag_status"], b["requires_legal_review"]) == (5, 100, "Red", True)
    assert "Multiple missing clauses (5)" in b["risk_flags"] and not b["risk_flags"].endswith("; ")
    assert contract_review.compliance_summary(contract_review.analyze(df)).first()["most_common_missing"] == "payment"
    assert contract_review.compliance_summary(contract_review.analyze(df).where("contract_id = 'C1'")).first()["most_common_missing"] == "None"


def test_change_routing(spark):
    df = spark.createDataFrame(
        [("a", "C", 4e5, 1e8, 1.5e8, 1, 100), ("b", "C", 1e6, 1e8, 1.5e8, 1, 100), ("c", "C", 5e6, 1e8, 1.5e8, 1, 100),
         ("d", "C", 2e7, 1e8, 1.5e8, 1, 100), ("e", "C", 0.0, 1e8, 1.5e8, 1, 100), ("f", None, 4e5, 1e8, 1e8, 30, 100),
         ("g", "C", 4e5, 0.0, 0.0, 1, 0)],
        "change_order_id string, contract_id string, change_cost double, original_contract_value double, project_budget double, timeline_extension_days int, original_timeline_days int",
    ).withColumn("change_reason", F.when(F.col("change_order_id") < "e", "B").otherwise("A"))
    out = change_orders.analyze(df)
    assert rows(out.orderBy("change_order_id"), "approval_status", "approval_level", "impact_level") == [
        ("Auto-Approved", "System", "Low"), ("Review Required", "Manager", "Low"), ("Review Required", "Director", "Low"),
        ("Review Required", "Board", "High"), ("Rejected", "Manager", "Low"), ("Rejected", "Board", "High"),
        ("Auto-Approved", "System", "Low"),
    ]
    assert change_orders.summary(out).first()["most_common_reason"] == "B"
    assert change_orders.summary(out.where("false")).first()["most_common_reason"] == "N/A"


def test_risk_unknown_certificate_stays_unknown(spark):
    df = spark.createDataFrame(
        [("E1", "v", 300.0, 4.0, 0.0, 20.0, 40.0, 10.0, 5, 10.0, "Expired", 20.0, 12.0, 20.0),
         ("E2", "v", 850.0, 0.0, 3.0, 100.0, 0.0, 1.0, 3, 100.0, "Odd", 100.0, 0.0, 100.0)],
        "entity_id string, entity_type string, credit_score double, debt_to_equity double, liquidity_ratio double, on_time_delivery_pct double, "
        "average_delay_days double, project_complexity_score double, compliance_violations int, audit_score double, certification_status string, "
        "quality_score double, defect_rate_pct double, customer_satisfaction double",
    )
    a, b = risk.analyze(df).orderBy("entity_id").collect()
    assert a["risk_level"] == "High" and a["requires_immediate_action"]
    assert (b["overall_risk_score"], b["risk_level"], b["requires_immediate_action"]) == (None, "Low", True)


def test_outlook_and_records(spark):
    item = spark.createDataFrame(
        [("I1", 120.0, 100.0, 80.0, 110.0, 100.0, 20.0, 10.0, 80)],
        "item_id string, current_price double, price_3m_ago double, price_6m_ago double, current_monthly_demand double, demand_3m_ago double, "
        "past_delivery_performance double, supplier_reliability_score double, lead_time_days int",
    )
    got = predictive.analyze(item).first()
    assert got["predicted_price_change_pct"] == pytest.approx(32.0) and got["price_trend"] == "Increasing"
    assert got["high_volatility"] and got["delay_risk"] == "High" and got["allocated_budget"] == 120 * 110 * 3
    docs = spark.createDataFrame(
        [("R1", "RFQ Response", dt.date(2020, 1, 1), "Active", True), ("R2", "Memo", dt.date(2022, 6, 1), "Active", False), ("R3", "Invoice", None, "Pending", True)],
        "record_id string, document_type string, creation_date date, document_status string, is_latest_version boolean",
    ).withColumns({"last_access_date": F.lit(dt.date(2023, 12, 1)), "access_count": F.lit(21)})
    out = records.analyze(docs, "2024-01-01").orderBy("record_id")
    assert rows(out, "within_retention", "deletion_candidate", "archival_candidate", "is_compliant") == [
        (False, True, False, False), (True, False, True, False), (False, False, False, False),
    ]
    assert rows(out, "compliance_issues")[1] == ("Outdated version",)


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_fraud_with_a_third_of_all_rows_on_one_vendor(spark, broadcast, coalesce):
    rng = random.Random(9)
    data = []
    for i in range(1500):
        vendor = "V001" if i % 3 == 0 else None if i % 50 == 1 else f"V{rng.randint(2, 60):03d}"
        amount = 500400.0 if i % 3 == 1 else float(rng.randint(1, 200) * 1000 + rng.randint(-400, 400))
        invoice = f"INV-{rng.choice([i, i - 1, i]) if i else 0:06d}"
        data.append((i, amount, vendor, invoice, rng.choice(["a", "b", None]), float(rng.randint(1, 99)), dt.date(2024, 1, 1 + i % 5)))
    df = spark.createDataFrame(data, "transaction_id int, amount double, vendor_id string, invoice_number string, item_category string, unit_price double, invoice_date date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = {r["transaction_id"]: r for r in fraud.analyze(df.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data)
    seen, near = set(), set()
    day = Counter((v, d) for _, _, v, _, _, _, d in data)
    price = Counter((int(a / 10000), c) for _, a, _, _, c, _, _ in data)
    vendors = Counter(v for _, _, v, *_ in data if v)
    blocks = defaultdict(int)
    for v, n in vendors.items():
        blocks[int(v[1:]) // 10] += n
    before = None
    for i, amount, vendor, invoice, category, _, date in data:
        row, number = got[i], int(invoice[4:])
        rounded = round(amount / 1000) * 1000
        assert row["is_duplicate"] == ((invoice, vendor) in seen), i
        assert row["is_near_duplicate"] == ((rounded, vendor) in near), i
        assert row["same_day_same_vendor"] == (day[vendor, date] if vendor else None)
        assert row["same_price_count"] == (price[int(amount / 10000), category] if category else None)
        assert row["vendor_frequency"] == (vendors[vendor] if vendor else None)
        assert row["similar_vendor_exists"] == bool(vendor and blocks[int(vendor[1:]) // 10] > 3)
        assert row["sequential_invoices"] == (before is not None and abs(number - before) == 1)
        assert row["expected_frequency"] == pytest.approx(len(data) / len(vendors))
        assert not row["unusually_fast_payment"] and not row["after_hours_payment"]
        seen.add((invoice, vendor))
        near.add((rounded, vendor))
        before = number


def test_profiles_do_not_fan_out(spark):
    vendors = spark.createDataFrame([("V1", "OLD", "A"), ("V2", "OLD", "B")], "vendor_id string, status string, tier string")
    bids = spark.createDataFrame([("V1", "AWARDED")] * 50 + [("V2", "OPEN")], "vendor_id string, status string").withColumnRenamed("status", "status")
    deals = spark.createDataFrame([("V1", i, dt.date(2024, 1, 1 + i % 3), float(i), 1.0) for i in range(40)], "vendor_id string, negotiation_id int, negotiation_date date, negotiated_price double, savings_percentage double")
    out = profiles.awarded_bids(bids, vendors.select("vendor_id", "tier"), deals)
    assert set(rows(out, "n_negotiations", "negotiation_id")) == {(40, 38)} and out.count() == 50
    changed = profiles.update_master(vendors, spark.createDataFrame([("V1", "NEW")], "vendor_id string, status string"), ["status"])
    assert sorted(rows(changed, "vendor_id", "status", "tier")) == [("V1", "NEW", "A"), ("V2", "OLD", "B")]


def test_recommendation_members(spark):
    df = spark.createDataFrame([("a", 5.0, True), ("b", 7.0, False), ("c", None, None)], "id string, amount double, bad boolean")
    rule = recommend.Rule("bad", "High", "bad", "{count} rows worth {amount}", id_col="id", amount="amount")
    good = recommend.Rule("good", "Info", "NOT bad", "{count}", id_col="id", top=1, top_by=("-amount",))
    none = recommend.Rule("none", None, "amount > 100", "{count}")
    out = recommend.recommend(df, [rule, good, none])
    assert rows(out, "type", "count", "amount", "ids", "message") == [
        ("bad", 1, 5.0, None, "1 rows worth ₹5.00"), ("good", 1, None, ["b"], "1"),
    ]
    assert sorted(rows(recommend.members(df, [rule, good, none]), "type", "id")) == [("bad", "a"), ("good", "b")]
