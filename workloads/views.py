"""Domain tables as SQL that Spark and DuckDB both read.

Only the input tables are shared between the two sides; every operator has its
own implementation in Spark and its own SQL in ``oracle``. Scores and flags are
spread by key arithmetic so that every band and branch has rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings"]

VIEWS = {
    "v_vendors": """
        SELECT 'V' || lpad(cast(s.s_suppkey AS string), 5, '0') AS vendor_id,
               s.s_name AS vendor_name,
               cast(45 + (s.s_suppkey * 29) % 56 AS double) AS financial_score,
               cast(52 + (s.s_suppkey * 31) % 49 AS double) AS compliance_score,
               CASE WHEN s.s_suppkey % 29 = 7 THEN NULL
                    ELSE cast(50 + (s.s_suppkey * 23) % 51 AS double) END AS performance_score,
               cast(52 + (s.s_suppkey * 37) % 46 AS double) + 4e0 * a.late / a.n AS delivery_score,
               CASE WHEN s.s_suppkey % 17 = 3 THEN NULL
                    ELSE cast(50 + (s.s_suppkey * 41) % 51 AS double) END AS quality_score,
               cast(55 + (s.s_suppkey * 17) % 50 AS double) AS cost_competitiveness,
               cast(60 + (s.s_suppkey * 13) % 45 AS double) AS on_time_delivery,
               cast(60 + (s.s_suppkey * 19) % 41 AS double) AS payment_compliance,
               s.s_suppkey % 6 AS past_disputes,
               s.s_suppkey % 6 AS dispute_count,
               CASE WHEN s.s_suppkey % 4 = 0 THEN 'A' WHEN s.s_suppkey % 4 = 1 THEN 'B' ELSE 'C' END AS empanelment_tier,
               CASE WHEN s.s_suppkey % 5 = 0 THEN 'PENDING' ELSE 'ACTIVE' END AS status,
               date '2001-01-01' + cast(s.s_suppkey % 700 AS int) AS registration_date
        FROM {supplier} s
        LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS late
                   FROM {lineitem} GROUP BY l_suppkey) a ON a.l_suppkey = s.s_suppkey""",
    "v_bids": """
        SELECT l_partkey AS rfq_id, l_orderkey, l_linenumber,
               'V' || lpad(cast(l_suppkey AS string), 5, '0') AS vendor_id,
               l_extendedprice * (CASE WHEN l_orderkey % 97 = 0 THEN 4e0 ELSE 1e0 END) AS quoted_price,
               CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE 20 + l_orderkey % 25 END AS delivery_days,
               CASE WHEN l_linestatus = 'F' THEN '30 days' WHEN l_orderkey % 59 = 0 THEN NULL ELSE '45 days' END
                   AS payment_terms,
               CASE WHEN l_returnflag = 'R' THEN '45 days' WHEN l_linestatus = 'F' THEN '30 days' ELSE '45 days' END
                   AS required_payment_terms,
               CASE WHEN l_returnflag = 'R' THEN '45 days' WHEN l_linestatus = 'F' THEN '30 days' ELSE '45 days' END
                   AS rfq_payment_terms,
               l_quantity AS quoted_quantity,
               CASE WHEN l_orderkey % 10 = 0 THEN l_quantity + 1 ELSE l_quantity END AS required_quantity,
               CASE WHEN l_orderkey % 3 = 0 THEN 'AWARDED' ELSE 'OPEN' END AS status
        FROM {lineitem}""",
    "v_contracts": """
        SELECT o_orderkey AS contract_id,
               'V' || lpad(cast(o_custkey % 150 AS string), 5, '0') AS vendor_id,
               o_totalprice * 120 AS contract_value,
               o_orderkey % 5 <> 0 AS payment_clause, o_orderkey % 7 <> 0 AS penalty_clause,
               o_orderkey % 11 <> 0 AS termination_clause,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 3 <> 0 END AS warranty_clause,
               o_orderkey % 13 <> 0 AS liability_clause, o_orderkey % 17 <> 0 AS force_majeure_clause,
               o_orderkey % 19 <> 0 AS dispute_resolution_clause,
               o_orderkey % 4 <> 0 AS gcc_compliant, o_orderkey % 6 <> 1 AS scc_included,
               cast(o_orderdate AS date) AS start_date,
               cast(o_orderdate AS date) + cast(365 AS int) AS end_date,
               o_orderpriority AS contract_type
        FROM {orders}""",
    "v_contract_texts": """
        SELECT o_orderkey AS contract_id, o_totalprice * 120 AS contract_value,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE 'Net 30' END
                   AS payment_clause,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '0.5% per week' END AS penalty_clause,
               CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '30 days notice' END AS termination_clause,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '12 months' END AS warranty_clause,
               CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Limited' END AS liability_clause,
               o_orderkey % 4 <> 0 AS gcc_compliant,
               CASE WHEN o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 3 = 1 THEN 'medium' ELSE 'low' END
                   AS vendor_risk_level
        FROM {orders}""",
    "v_change_orders": """
        SELECT o_orderkey AS change_order_id,
               CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderkey END AS contract_id,
               o_totalprice * (o_orderkey % 30) AS change_cost,
               o_totalprice * 100 AS original_contract_value,
               o_totalprice * 100 * (1.05e0 + (o_orderkey % 5) * 0.1e0) AS project_budget,
               o_orderkey % 60 AS timeline_extension_days,
               CASE WHEN o_orderkey % 47 = 0 THEN 0 ELSE 90 + o_orderkey % 200 END AS original_timeline_days,
               o_orderpriority AS change_reason
        FROM {orders}""",
    "v_transactions": """
        SELECT o_orderkey AS transaction_id,
               CASE WHEN o_orderkey % 20 = 0 THEN 250000e0 WHEN o_orderkey % 33 = 0 THEN 970000e0
                    ELSE o_totalprice * 10 END AS amount,
               CASE WHEN o_orderkey % 211 = 0 THEN NULL
                    WHEN o_orderkey % 10 < 2 THEN 'V' || lpad(cast((o_orderkey - o_orderkey % 10) % 150 AS string), 3, '0')
                    ELSE 'V' || lpad(cast(o_custkey % 150 AS string), 3, '0') END AS vendor_id,
               'INV-' || lpad(cast(o_orderkey - (CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END) AS string), 8, '0')
                   AS invoice_number,
               CASE WHEN o_orderkey % 307 = 0 THEN NULL ELSE o_orderpriority END AS item_category,
               o_totalprice * 10 / (1 + o_orderkey % 97) AS unit_price,
               cast(o_orderdate AS date) AS invoice_date,
               cast(o_orderdate AS date) + cast(o_orderkey % 45 AS int) AS payment_date,
               CASE WHEN o_orderkey % 9 = 0 THEN 'Cash' WHEN o_orderkey % 9 < 7 THEN 'Bank Transfer' ELSE 'Wire' END
                   AS payment_method,
               cast((o_orderkey * 7) % 24 AS int) AS payment_hour
        FROM {orders}""",
    "v_offers": """
        SELECT 'V' || lpad(cast(l_suppkey AS string), 5, '0') AS vendor_id, l_orderkey, l_linenumber,
               l_extendedprice AS current_price,
               l_extendedprice * (0.82e0 + (l_orderkey % 37) * 0.01e0) AS market_avg_price,
               CASE WHEN l_orderkey % 71 = 0 THEN 0e0
                    ELSE l_extendedprice * (0.9e0 + (l_orderkey % 29) * 0.01e0) END AS historical_avg_price,
               cast(45 + (l_orderkey * 7) % 56 AS double) AS vendor_relationship_score
        FROM {lineitem}""",
    "v_items": """
        SELECT p_partkey AS item_id, p_name AS item_name, p_retailprice AS current_price,
               p_retailprice * (0.85e0 + (p_partkey % 31) * 0.01e0) AS price_3m_ago,
               p_retailprice * (0.8e0 + (p_partkey % 41) * 0.01e0) AS price_6m_ago,
               a.demand AS current_monthly_demand,
               a.demand * (0.8e0 + (p_partkey % 45) * 0.01e0) AS demand_3m_ago,
               cast(30 + p_partkey % 70 AS double) AS past_delivery_performance,
               cast(30 + (p_partkey * 3) % 70 AS double) AS supplier_reliability_score,
               15 + p_partkey % 76 AS lead_time_days,
               p_retailprice * a.demand * 3 * (0.8e0 + (p_partkey % 5) * 0.1e0) AS allocated_budget
        FROM {part} JOIN (SELECT l_partkey, sum(l_quantity) / 10 AS demand FROM {lineitem} GROUP BY l_partkey) a
             ON a.l_partkey = p_partkey""",
    "v_entities": """
        SELECT entity_id, entity_type,
               CASE WHEN k % 61 = 0 THEN NULL ELSE cast(300 + (k * 37) % 551 AS double) END AS credit_score,
               cast((k * 13) % 46 AS double) / 10e0 AS debt_to_equity,
               cast(3 + (k * 7) % 32 AS double) / 10e0 AS liquidity_ratio,
               cast(30 + (k * 3) % 70 AS double) AS on_time_delivery_pct,
               cast(k % 40 AS double) AS average_delay_days,
               cast(1 + k % 10 AS double) AS project_complexity_score,
               k % 6 AS compliance_violations,
               cast(30 + (k * 11) % 71 AS double) AS audit_score,
               CASE WHEN k % 23 = 0 THEN 'Unknown' WHEN k % 8 < 4 THEN 'Valid' WHEN k % 8 < 6 THEN 'Pending'
                    ELSE 'Expired' END AS certification_status,
               cast(35 + (k * 5) % 64 AS double) AS quality_score,
               cast((k * 3) % 13 AS double) AS defect_rate_pct,
               cast(30 + (k * 17) % 71 AS double) AS customer_satisfaction
        FROM (SELECT 'S' || cast(s_suppkey AS string) AS entity_id, 'supplier' AS entity_type, s_suppkey AS k
              FROM {supplier}
              UNION ALL
              SELECT 'C' || cast(c_custkey AS string) AS entity_id, 'customer' AS entity_type, c_custkey + 5 AS k
              FROM {customer}) e""",
    "v_records": """
        SELECT o_orderkey AS record_id,
               CASE o_orderkey % 7 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Invoice' WHEN 2 THEN 'Purchase Order'
                    WHEN 3 THEN 'RFQ Response' WHEN 4 THEN 'Vendor Agreement' WHEN 5 THEN 'Change Order'
                    ELSE 'Memo' END AS document_type,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS creation_date,
               CASE WHEN o_orderkey % 10 < 6 THEN 'Active' WHEN o_orderkey % 10 < 9 THEN 'Archived' ELSE 'Pending' END
                   AS document_status,
               cast(o_orderdate AS date) + cast(o_orderkey % 500 AS int) AS last_access_date,
               1 + o_orderkey % 50 AS access_count,
               o_orderkey % 9 <> 0 AS is_latest_version
        FROM {orders}""",
    "v_series": """
        SELECT o_orderpriority || '/' || o_orderstatus AS series_id,
               cast(date_trunc('month', o_orderdate) AS date) AS ts, sum(o_totalprice) AS value
        FROM {orders} GROUP BY 1, 2""",
    "v_customer_series": """
        SELECT o_custkey AS series_id, cast(date_trunc('month', o_orderdate) AS date) AS ts, sum(o_totalprice) AS value
        FROM {orders} GROUP BY 1, 2""",
    "v_contract_docs": """
        SELECT o_orderkey AS doc_id,
               'Contract ' || cast(o_orderkey AS string) || ' dated ' || lpad(cast(day(o_orderdate) AS string), 2, '0')
               || '-' || lpad(cast(month(o_orderdate) AS string), 2, '0') || '-' || cast(year(o_orderdate) AS string)
               || ' covers supply and installation work'
               || CASE o_orderkey % 5 WHEN 1 THEN ' by Supplier#' || lpad(cast(o_custkey % 12 AS string), 9, '0')
                    WHEN 2 THEN ' by SUPPLIER ' || lpad(cast(o_custkey % 12 AS string), 9, '0') || ' Trading Company for Supplier#'
                         || lpad(cast(o_custkey % 7 AS string), 9, '0')
                    WHEN 3 THEN ' by Supplier#999999999' ELSE '' END
               || '.' || chr(10)
               || CASE o_orderkey % 4 WHEN 0 THEN 'Contract value is INR ' WHEN 1 THEN 'Total value: ₹'
                    WHEN 2 THEN 'The price is Rs. ' ELSE 'No price is fixed for lot ' END
               || cast(cast(floor(o_totalprice) AS bigint) AS string) || ',00,000.00 in full. '
               || 'Payment shall be made within ' || cast(15 + o_orderkey % 60 AS string) || ' days of invoice. '
               || CASE WHEN o_orderkey % 3 = 0 THEN 'A penalty of ' || cast(o_orderkey % 5 AS string)
                    || '.5% per week applies for delay; damages are limited to 10 % of value. ' ELSE '' END
               || CASE WHEN o_orderkey % 5 <> 0 THEN 'Warranty is ' || cast(6 + o_orderkey % 30 AS string)
                    || CASE WHEN o_orderkey % 2 = 0 THEN ' months' ELSE ' years' END || ' from handover. ' ELSE '' END
               || CASE WHEN o_orderkey % 7 = 0 THEN 'Either party may terminate on breach.  ' ELSE '' END
               || 'The contractor must deliver by ' || cast(1 + o_orderkey % 28 AS string) || '/'
               || cast(1 + o_orderkey % 12 AS string) || '/' || cast(2000 + o_orderkey % 20 AS string) || '. '
               || CASE WHEN o_orderkey % 6 = 0 THEN 'Parties keep records..' ELSE 'Any dispute goes to arbitration' END
               AS text
        FROM {orders}""",
    "v_names": """
        SELECT s_name AS name FROM {supplier}
        UNION ALL SELECT s_name || ' Trading Company' FROM {supplier} WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'Trading Company' FROM {supplier} WHERE s_suppkey = 1""",
    "v_messy": """
        SELECT o_orderkey AS row_id,
               CASE o_orderkey % 9
                    WHEN 0 THEN '₹' || cast(cast(floor(o_totalprice) AS bigint) AS string) || ',50'
                    WHEN 1 THEN 'Rs. 1,00,' || cast(100 + o_orderkey % 900 AS string)
                    WHEN 2 THEN cast(cast(floor(o_totalprice) AS bigint) AS string) || '.25'
                    WHEN 3 THEN ' -12.5 ' WHEN 4 THEN '1e3' WHEN 5 THEN 'n/a' WHEN 6 THEN NULL
                    WHEN 7 THEN '12d' ELSE '' END AS contract_value,
               CASE o_orderkey % 9
                    WHEN 0 THEN cast(1 + o_orderkey % 28 AS string) || '-' || cast(1 + o_orderkey % 12 AS string) || '-2024'
                    WHEN 1 THEN '15/01/' || cast(1990 + o_orderkey % 40 AS string)
                    WHEN 2 THEN '2026-01-' || lpad(cast(1 + o_orderkey % 28 AS string), 2, '0')
                    WHEN 3 THEN '2026/2/' || cast(27 + o_orderkey % 4 AS string)
                    WHEN 4 THEN '07-Jan-2026' WHEN 5 THEN '7 March 2025' WHEN 6 THEN 'April 9, 2024'
                    WHEN 7 THEN '30-02-2025' ELSE 'soon' END AS contract_date,
               CASE WHEN o_orderkey % 11 = 0 THEN 'high' ELSE cast(o_orderkey % 160 - 20 AS string) END AS quality_score,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 700 END AS vendor_id,
               CASE o_orderkey % 4 WHEN 0 THEN '22AAAAA0000A1Z5' WHEN 1 THEN 'INVALID' WHEN 2 THEN NULL
                    ELSE '27BBBBB1111B1Z6' END AS gstin,
               CASE o_orderkey % 3 WHEN 0 THEN 'ABCDE1234F' WHEN 1 THEN 'abcde1234f' ELSE 'ABCDE1234FX' END AS pan,
               CASE o_orderkey % 4 WHEN 0 THEN 'a.b@example.com' WHEN 1 THEN 'a@b' WHEN 2 THEN 'x@y.z trailing'
                    ELSE NULL END AS email,
               CASE o_orderkey % 6 WHEN 0 THEN '+91 98765 43210' WHEN 1 THEN '9876543210' WHEN 2 THEN '(212) 555-0199'
                    WHEN 3 THEN '12345' WHEN 4 THEN NULL ELSE '004915112345678' END AS phone,
               CASE o_orderkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' ELSE 'IN' END AS country,
               CASE o_orderkey % 3 WHEN 0 THEN 'HDFC0AB12CD' ELSE 'HDFC1AB12CD' END AS ifsc,
               CASE o_orderkey % 2 WHEN 0 THEN '560001' ELSE '5600011' END AS pincode,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice - 20000 END AS amount,
               cast(o_orderkey % 130 - 10 AS double) AS share_pct,
               CASE o_orderkey % 5 WHEN 0 THEN 'INR' WHEN 1 THEN 'AED' WHEN 2 THEN 'JPY' ELSE 'USD' END AS currency,
               cast(o_orderdate AS date) AS start_date,
               cast(o_orderdate AS date) + cast(o_orderkey % 40 - 10 AS int) AS end_date
        FROM {orders}""",
    "v_text": "SELECT doc_id, source AS folder, text FROM {documents}",
    "v_drops": """
        SELECT 'drop/file' || cast(o_orderkey AS string)
               || CASE o_orderkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls' WHEN 3 THEN '.pdf'
                    WHEN 4 THEN '.exe' ELSE '' END AS path,
               cast(floor(o_totalprice * 200) AS bigint) AS length
        FROM {orders}""",
    "v_negotiations": """
        SELECT o_orderkey AS negotiation_id, 'V' || lpad(cast(o_custkey % 90 AS string), 5, '0') AS vendor_id,
               o_totalprice * 0.9e0 AS negotiated_price, cast(o_orderkey % 20 AS double) AS savings_percentage,
               cast(o_orderdate AS date) AS negotiation_date
        FROM {orders}""",
    "v_projects": """
        SELECT o_orderkey AS project_id,
               CASE WHEN o_orderstatus = 'F' THEN 'V' ELSE 'P' END
               || lpad(cast(o_custkey % 130 AS string), 5, '0') AS vendor_id,
               o_totalprice * 50 AS project_value, cast(1 + o_orderkey % 5 AS double) AS performance_rating
        FROM {orders}""",
    "v_scores": """
        SELECT CASE WHEN s_nationkey = 3 THEN 'U' ELSE 'V' END || lpad(cast(s_suppkey AS string), 5, '0') AS vendor_id,
               cast((s_suppkey * 7) % 100 AS double) AS risk_score,
               cast(40 + (s_suppkey * 11) % 60 AS double) AS predicted_performance
        FROM {supplier}""",
    "v_master_history": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'V00003' ELSE 'V' || lpad(cast(o_custkey % 130 AS string), 5, '0') END
                   AS vendor_id,
               o_orderkey AS change_id, cast(o_orderdate AS date) AS changed_at,
               CASE WHEN o_orderkey % 4 = 1 THEN 'APPROVED' WHEN o_orderkey % 4 = 2 THEN 'BLOCKED' ELSE NULL END AS status,
               CASE WHEN o_orderkey % 5 < 3 THEN 'T' || cast(o_orderkey % 7 AS string) ELSE NULL END AS empanelment_tier,
               CASE WHEN o_orderkey % 6 = 0 THEN cast(o_orderdate AS date) ELSE NULL END AS registration_date
        FROM {orders}""",
    "v_odd_csv": """
        SELECT o_orderkey AS change_order_id, o_custkey AS contract_id, o_totalprice AS change_cost,
               CASE o_orderkey % 7
                    WHEN 0 THEN 'two' || chr(10) || 'lines, "quoted"' WHEN 1 THEN 'a 5" pipe' WHEN 2 THEN 'change_reason'
                    WHEN 3 THEN chr(10) || ',' || chr(10) || chr(10) || 'x' WHEN 4 THEN '"' WHEN 5 THEN '5" of, pipe'
                    ELSE o_orderpriority END AS change_reason
        FROM {orders}""",
    "v_master_changes": """
        SELECT CASE WHEN s_acctbal > 0 THEN 'V' ELSE 'N' END || lpad(cast(s_suppkey AS string), 5, '0') AS vendor_id,
               CASE WHEN s_suppkey % 3 = 0 THEN 'APPROVED' ELSE NULL END AS status,
               CASE WHEN s_suppkey % 4 = 3 THEN 'A' ELSE NULL END AS empanelment_tier,
               CASE WHEN s_suppkey % 5 = 0 THEN date '2003-05-05' ELSE NULL END AS registration_date
        FROM {supplier}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
