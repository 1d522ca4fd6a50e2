"""Roll-ups read their input once."""

import pytest

from bidloom.plans import change_orders, contract_review, fraud
from workloads.catalog import CATALOG
from workloads.views import view

SF_DIR = "/root/testdata/sf0.001"


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


@pytest.mark.parametrize(
    ("name", "analyze", "roll_up"),
    [
        ("v_contracts", contract_review.analyze, contract_review.compliance_summary),
        ("v_change_orders", change_orders.analyze, change_orders.summary),
    ],
)
def test_summary_scans_its_detail_once(spark, name, analyze, roll_up):
    detail = analyze(view(spark, SF_DIR, name))
    assert scans(roll_up(detail)) == scans(detail)


def test_fraud_summary_scans_its_detail_once(spark):
    detail = fraud.analyze(view(spark, SF_DIR, "v_transactions"))
    assert scans(fraud.summary(detail)) <= scans(detail)


@pytest.mark.parametrize("name", [n for n in CATALOG if n.endswith("_recommendations") and not n.startswith("fraud")])
def test_recommendations_do_not_rerun_their_detail(spark, name):
    # every top list reads the written detail: no plan has more scans than lists and one aggregate
    assert scans(CATALOG[name](spark, SF_DIR)) <= 6
