"""SQL twins of the operators, written for DuckDB and without sight of the Spark code."""

from __future__ import annotations


def r2(expr: str, digits: int = 2) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def clip(expr: str, low: str = "0e0", high: str = "100e0") -> str:
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE least({high}, greatest({low}, ({expr}))) END)"


def _pairs(text: str, width: int) -> str:
    dots = "." * width
    return f"ltrim(reverse(regexp_replace(reverse({text}), '({dots})', '\\1,', 'g')), ',')"


def _number(expr: str, decimals: int, indian: bool) -> str:
    text = f"printf('%.{decimals}f', abs({expr}))"
    whole = f"split_part({text}, '.', 1)"
    if indian:
        grouped = (
            f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE "
            f"{_pairs(f'left({whole}, length({whole}) - 3)', 2)} || ',' || right({whole}, 3) END"
        )
    else:
        grouped = _pairs(whole, 3)
    fraction = f" || '.' || split_part({text}, '.', 2)" if decimals else ""
    return f"(CASE WHEN {expr} < 0 THEN '-' ELSE '' END || ({grouped}){fraction})"


def inr(expr: str) -> str:
    return f"('₹' || {_number(f'({expr})', 2, True)})"


def western(expr: str, decimals: int = 0) -> str:
    return _number(f"({expr})", decimals, False)


def recommendation(source: str, rules: list[dict]) -> str:
    parts = []
    for n, r in enumerate(rules):
        when = f"coalesce({r['when']}, false)"
        rows = f"(SELECT * FROM {source} WHERE {when} {r.get('limit', '')})"
        amount = f"CAST(sum({r['amount']}) AS DOUBLE)" if "amount" in r else "CAST(NULL AS DOUBLE)"
        mean = f"avg({r['mean']})" if "mean" in r else "CAST(NULL AS DOUBLE)"
        ids = f"({r['ids']})" if "ids" in r else "CAST(NULL AS VARCHAR[])"
        priority = f"'{r['priority']}'" if r.get("priority") else "CAST(NULL AS VARCHAR)"
        message = r.get("message", "CAST(NULL AS VARCHAR)")
        action = f"'{r['action']}'" if "action" in r else "CAST(NULL AS VARCHAR)"
        keep = "" if r.get("always") else "WHERE n > 0"
        parts.append(
            f"SELECT '{r['type']}' AS type, {priority} AS priority, n AS count, amount, mean, ids, "
            f"{message} AS message, {action} AS action "
            f"FROM (SELECT count(*) AS n, {amount} AS amount, {mean} AS mean, {ids} AS ids FROM {rows} AS r{n}) {keep}"
        )
    return "\nUNION ALL\n".join(parts)


def counted(before: str, after: str) -> str:
    return f"'{before}' || n || '{after}'"


CTES: dict[str, str] = {}

# ---- rules -------------------------------------------------------------------
CTES["o_vendor_rules"] = f"""
  SELECT *, coalesce(dispute_count > 2, false) AS high_dispute_flag,
         coalesce(compliance_score < 70, false) AS low_compliance_flag,
         coalesce(vendor_score >= 85 AND risk_level = 'low' AND dispute_count = 0, false) AS preferred_vendor
  FROM (SELECT *, CASE WHEN vendor_score >= 75 AND vendor_score < 100 THEN 'low'
                       WHEN vendor_score >= 50 AND vendor_score < 75 THEN 'medium'
                       WHEN vendor_score >= 0 AND vendor_score < 50 THEN 'high' ELSE 'low' END AS risk_level
        FROM (SELECT *, {r2('''least(100, cost_competitiveness) * 0.3e0 + least(100, on_time_delivery) * 0.25e0
              + least(100, quality_score) * 0.2e0 + least(100, compliance_score) * 0.15e0
              + greatest(0, 100 - past_disputes * 20) * 0.1e0''')} AS vendor_score FROM v_vendors) a) b"""
_BID_RULES = """
  SELECT *, CASE WHEN n_flags >= 3 THEN 'high' WHEN n_flags = 2 THEN 'medium' WHEN n_flags = 1 THEN 'low'
                 ELSE 'none' END AS anomaly_severity, n_flags > 0 AS anomaly_detected
  FROM (SELECT *, price_high_flag::INT + price_low_flag::INT + delivery_deviation_flag::INT
                  + payment_terms_flag::INT AS n_flags
        FROM (SELECT *, (quoted_price - mean_price) / mean_price * 100 > 30 AS price_high_flag,
                     (mean_price - quoted_price) / mean_price * 100 > 20 AS price_low_flag,
                     coalesce(abs(delivery_days - mean_delivery) / mean_delivery * 100 > 15, false)
                         AS delivery_deviation_flag,
                     payment_terms IS NULL OR rfq_payment_terms IS NULL OR payment_terms <> rfq_payment_terms
                         AS payment_terms_flag
              FROM (SELECT *, avg(quoted_price) OVER ({w}) AS mean_price, avg(delivery_days) OVER ({w}) AS mean_delivery
                    FROM v_bids) a) b) c"""
CTES["o_bid_rules"] = _BID_RULES.format(w="")
CTES["o_bid_rules_by_rfq"] = _BID_RULES.format(w="PARTITION BY rfq_id")
CTES["o_contract_rules"] = """
  SELECT *, CASE WHEN contract_risk_score >= 70 THEN 'Red' WHEN contract_risk_score >= 40 THEN 'Amber'
                 ELSE 'Green' END AS rag_status
  FROM (SELECT *, least(100, 20 * (payment_clause_missing::INT + penalty_clause_missing::INT
                 + termination_clause_missing::INT) + 15 * gcc_deviation::INT + 10 * high_value_contract::INT
                 + CASE vendor_risk_level WHEN 'high' THEN 25 WHEN 'medium' THEN 10 ELSE 0 END) AS contract_risk_score
        FROM (SELECT *, coalesce(payment_clause, '') = '' AS payment_clause_missing,
                     coalesce(penalty_clause, '') = '' AS penalty_clause_missing,
                     coalesce(termination_clause, '') = '' AS termination_clause_missing,
                     coalesce(warranty_clause, '') = '' AS warranty_clause_missing,
                     coalesce(liability_clause, '') = '' AS liability_clause_missing,
                     NOT gcc_compliant AS gcc_deviation, contract_value > 10000000 AS high_value_contract,
                     contract_value > 50000000 AS requires_board_approval
              FROM v_contract_texts) a) b"""

# ---- outliers ------------------------------------------------------------------
_SUMMARY = """
  SELECT {key} count(x) AS count, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
         CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END AS std,
         CASE WHEN count(x) = 1 THEN 0 ELSE var_samp(x) END AS variance, stddev_pop(x) AS std_pop,
         min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, max(x) - min(x) AS range
  FROM (SELECT *, {value} AS x FROM {table}) t {group}"""
CTES["o_price_summary"] = _SUMMARY.format(key="", value="quoted_price", table="v_bids", group="")
CTES["o_price_summary_by_rfq"] = _SUMMARY.format(
    key="rfq_id,", value="quoted_price", table="v_bids", group="GROUP BY rfq_id"
)
CTES["o_quality_summary"] = _SUMMARY.format(key="", value="quality_score", table="v_vendors", group="")
_OUTLIERS = """
  SELECT *, coalesce(abs(zscore) > 3, false) AS is_outlier_zscore,
         CASE WHEN zscore > 3 THEN 'high' WHEN zscore < -3 THEN 'low' ELSE 'none' END AS z_type,
         CASE WHEN abs(zscore) > 4.5 THEN 2 WHEN abs(zscore) > 3 THEN 1 ELSE 0 END AS z_level,
         coalesce(x < lower_bound OR x > upper_bound, false) AS is_outlier_iqr,
         CASE WHEN x < lower_bound THEN 'low' WHEN x > upper_bound THEN 'high' ELSE 'none' END AS iqr_type,
         CASE WHEN distance_from_bound > iqr THEN 2 WHEN distance_from_bound > 0 THEN 1 ELSE 0 END AS iqr_level
  FROM (SELECT *, CASE WHEN x < lower_bound THEN lower_bound - x WHEN x > upper_bound THEN x - upper_bound
                       ELSE 0e0 END AS distance_from_bound
        FROM (SELECT b.*, {value} AS x, s.mean, s.median, s.std, s.iqr,
                     CASE WHEN s.std = 0 THEN 0 ELSE ({value} - s.mean) / s.std END AS zscore,
                     s.q1 - 1.5e0 * s.iqr AS lower_bound, s.q3 + 1.5e0 * s.iqr AS upper_bound
              FROM {table} b JOIN {stats} s ON {on}) a) b"""
CTES["o_price_outliers"] = _OUTLIERS.format(
    value="b.quoted_price", table="v_bids", stats="o_price_summary_by_rfq", on="b.rfq_id = s.rfq_id"
)
CTES["o_quality_outliers"] = _OUTLIERS.format(
    value="b.quality_score", table="v_vendors", stats="o_quality_summary", on="true"
)
_LEVEL = "CASE greatest({}, {}) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END"
CTES["o_price_combined"] = f"""
  SELECT *, is_outlier_zscore OR is_outlier_iqr AS is_outlier, z_type AS outlier_type,
         {_LEVEL.format('z_level', 'iqr_level')} AS severity, {_LEVEL.format('z_level', 'z_level')} AS z_severity,
         {_LEVEL.format('iqr_level', 'iqr_level')} AS iqr_severity,
         CASE WHEN is_outlier_zscore AND is_outlier_iqr THEN 'both' WHEN is_outlier_zscore THEN 'zscore_only'
              WHEN is_outlier_iqr THEN 'iqr_only' ELSE 'none' END AS detection_method,
         CASE WHEN mean > 0 THEN (quoted_price - mean) / mean * 100 ELSE 0 END AS deviation_pct
  FROM o_price_outliers"""
CTES["o_quality_combined"] = f"""
  SELECT *, is_outlier_zscore OR is_outlier_iqr AS is_performance_outlier, z_type AS outlier_type,
         {_LEVEL.format('z_level', 'iqr_level')} AS severity
  FROM o_quality_outliers"""

# ---- forecasts -------------------------------------------------------------------
_PLACED = """
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, value) AS rn,
         count(*) OVER (PARTITION BY series_id) AS n FROM {v}"""
CTES["o_series"] = _PLACED.format(v="v_series")
CTES["o_customer_series"] = _PLACED.format(v="v_customer_series")
CTES["o_moving_average"] = """
  SELECT series_id, step, CAST(date_trunc('month', last_ts) + to_months(CAST(step AS INT)) AS DATE) AS ts,
         level AS forecast, 'moving_average' AS method, last_value
  FROM (SELECT series_id, max(ts) AS last_ts, avg(value) FILTER (rn > n - 3) AS level,
               max(value) FILTER (rn = n) AS last_value FROM o_customer_series WHERE n >= 3 GROUP BY series_id) s,
       (SELECT unnest(range(1, 7)) AS step) h"""
CTES["o_linear_trend"] = """
  SELECT series_id, step, CAST(date_trunc('month', last_ts) + to_months(CAST(step AS INT)) AS DATE) AS ts,
         a + b * (n - 1 + step) AS forecast, 'linear_trend' AS method, last_value
  FROM (SELECT series_id, max(ts) AS last_ts, max(n) AS n, regr_slope(value, rn - 1) AS b,
               regr_intercept(value, rn - 1) AS a, max(value) FILTER (rn = n) AS last_value
        FROM o_series WHERE n >= 3 GROUP BY series_id) s,
       (SELECT unnest(range(1, 13)) AS step) h"""
CTES["o_smoothing"] = """
  SELECT series_id, step, last_day(CAST(last_ts + to_months(CAST(step - 1 AS INT)) AS DATE)) AS ts,
         level + (level - before) * step AS forecast, 'exponential_smoothing' AS method, points[n] AS last_value
  FROM (SELECT *, list_reduce(points, lambda s, x: 0.7e0 * s + 0.3e0 * x) AS level,
               list_reduce(points[1:n - 1], lambda s, x: 0.7e0 * s + 0.3e0 * x) AS before
        FROM (SELECT series_id, max(ts) AS last_ts, count(*) AS n, list(value ORDER BY rn) AS points
              FROM o_series WHERE n >= 3 GROUP BY series_id) p) s,
       (SELECT unnest(range(1, 13)) AS step) h"""

# ---- clauses ---------------------------------------------------------------------
CTES["o_pieces"] = r"""
  SELECT doc_id, list_filter(list_transform(string_split(text, '.'),
           lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS pieces FROM v_contract_docs"""
_WORDS = {
    "payment": "payment invoice due remittance billing paid",
    "penalty": "penalty liquidated_damages delay late_fee damages",
    "termination": "terminate termination notice_period cancellation cancel",
    "liability": "liability indemnity damages liable responsible",
    "warranty": "warranty guarantee defect repair replacement",
    "delivery": "delivery deliver timeline completion handover",
    "scope": "scope work services supply installation",
}


def _score(words: str) -> str:
    return " + ".join(f"(strpos(low, '{w.replace('_', ' ')}') > 0)::INT" for w in words.split())


def _any(words: str) -> str:
    return "(" + " OR ".join(f"strpos(low, '{w}') > 0" for w in words.split()) + ")"


MONEY = r"""list_concat(list_concat(regexp_extract_all({t}, '₹\s*([\d,]+(?:\.\d{2})?)', 1),
    regexp_extract_all({t}, 'Rs\.?\s*([\d,]+(?:\.\d{2})?)', 1)), regexp_extract_all({t}, 'INR\s*([\d,]+(?:\.\d{2})?)', 1))"""
DATES = r"regexp_extract_all({t}, '\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b')"
PERCENTS = r"regexp_extract_all({t}, '\b\d+(?:\.\d+)?\s*%')"


def _on(pattern: str, text: str) -> str:
    return pattern.replace("{t}", text)


CTES["o_clauses"] = (
    "SELECT *, CASE WHEN best = 0 THEN 'other' "
    + " ".join(f"WHEN s_{name} = best THEN '{name}'" for name in _WORDS)
    + " END AS clause_type FROM (SELECT *, greatest("
    + ", ".join(f"s_{name}" for name in _WORDS)
    + ") AS best FROM (SELECT *, "
    + ", ".join(f"{_score(words)} AS s_{name}" for name, words in _WORDS.items())
    + f", {_any('shall must required mandatory')} AS mandatory, "
    + f"CASE WHEN {_any('penalty damages liability terminate breach')} THEN 'high' "
    + f"WHEN {_any('delay warranty guarantee dispute')} THEN 'medium' ELSE 'low' END AS risk_level, "
    + f"{_on(MONEY, 'clause_text')} AS money, {_on(DATES, 'clause_text')} AS dates, "
    + f"{_on(PERCENTS, 'clause_text')} AS percentages, CAST([] AS VARCHAR[]) AS organizations "
    + "FROM (SELECT *, lower(clause_text) AS low FROM (SELECT doc_id, unnest(pieces) AS clause_text, "
    + "unnest(range(1, len(pieces) + 1)) AS clause_id FROM o_pieces) a) b) c) d"
)
_TOKENS = r"list_filter(string_split_regex(lower({t}), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _found_names(keys: str, text: str, relation: str) -> str:
    """Arrays of dictionary names: the longest of overlapping ones, by first place."""
    return f"""
  SELECT {keys}, list(name ORDER BY place) AS organizations FROM (
    SELECT {keys}, name, min(at_token) AS place FROM (
      SELECT {keys}, at_token, size, name, count(*) AS tokens FROM (
        SELECT {keys}, token, arg_max(at_token, best) AS at_token, arg_max(size, best) AS size, arg_max(name, best) AS name FROM (
          SELECT {keys}, at_token, size, name, size * 1000000 - at_token AS best, unnest(range(at_token, at_token + size)) AS token FROM (
            SELECT {keys}, at_token, g.size, d.name FROM (
              SELECT {keys}, at_token, size, array_to_string(tokens[at_token:at_token + size - 1], ' ') AS phrase FROM (
                SELECT *, unnest(range(1, len(tokens) - size + 2)) AS at_token FROM (
                  SELECT {keys}, {_on(_TOKENS, text)} AS tokens, unnest([1, 2, 3, 4, 5]) AS size FROM {relation}) a) b) g
            JOIN (SELECT phrase, min(name) AS name FROM (
                    SELECT name, array_to_string({_on(_TOKENS, 'name')}, ' ') AS phrase FROM v_names) p GROUP BY phrase) d
              ON d.phrase = g.phrase) m) c GROUP BY {keys}, token) w
      GROUP BY {keys}, at_token, size, name HAVING count(*) = size) k GROUP BY {keys}, name) f GROUP BY {keys}"""


CTES["o_clause_names"] = _found_names("doc_id, clause_id", "clause_text", "o_clauses")
CTES["o_doc_names"] = _found_names("doc_id", "text", "v_contract_docs")
CTES["o_named_clauses"] = (
    "SELECT c.* EXCLUDE (organizations), coalesce(n.organizations, []) AS organizations "
    "FROM o_clauses c LEFT JOIN o_clause_names n ON n.doc_id = c.doc_id AND n.clause_id = c.clause_id"
)
CTES["o_entities"] = (
    f"SELECT doc_id, {_on(MONEY, 'text')} AS money, {_on(DATES, 'text')} AS dates, "
    f"{_on(PERCENTS, 'text')} AS percentages, coalesce(organizations, []) AS organizations "
    "FROM v_contract_docs LEFT JOIN o_doc_names USING (doc_id)"
)
CTES["o_features"] = (
    f"SELECT doc_id, {_on(MONEY, 'text')}[1] AS contract_value, organizations[1] AS vendor_name, "
    f"{_on(DATES, 'text')}[1] AS contract_date, {_on(DATES, 'text')}[2] AS delivery_date, "
    r"nullif(regexp_extract(lower(text), 'payment.*?(\d+)\s*days', 1), '') || ' days' AS payment_terms, "
    r"nullif(regexp_extract(lower(text), 'penalty.*?([\d.]+)\s*%', 1), '') || '%' AS penalty_clause, "
    r"nullif(regexp_extract(lower(text), 'warranty.*?(\d+)\s*(month|year)', 1), '') || ' ' || "
    r"regexp_extract(lower(text), 'warranty.*?(\d+)\s*(month|year)', 2) AS warranty_period FROM v_contract_docs LEFT JOIN o_doc_names USING (doc_id)"
)

# ---- approval ----------------------------------------------------------------------
CTES["o_approval"] = """
  SELECT *, final_score / 100 AS confidence,
         CASE WHEN final_score < 60 OR financial_score < 50 OR compliance_score < 60 THEN 'rejected'
              WHEN final_score >= 80 THEN 'approved' ELSE 'pending' END AS status
  FROM (SELECT *, financial_score * 0.3e0 + compliance_score * 0.25e0 + performance_score * 0.25e0
               + delivery_score * 0.2e0 AS final_score FROM (SELECT * EXCLUDE (status) FROM v_vendors) v) a"""

# ---- documents ---------------------------------------------------------------------
CTES["o_orders_in"] = """
  SELECT *, row_number() OVER (ORDER BY amount, contract_id) AS seq
  FROM (SELECT contract_id, vendor_id, 'Vendor ' || vendor_id AS vendor_name,
               CASE WHEN contract_id % 43 = 0 THEN 0e0 ELSE contract_value / 8 END AS amount FROM v_contracts) a"""
_SEQ = "CASE WHEN seq < 10000 THEN lpad(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END"
_DAYS = "CASE WHEN amount < 50000 THEN '15' WHEN amount < 500000 THEN '30' ELSE '45' END"
CTES["o_pos"] = f"""
  SELECT 'po' AS doc_type, 'PO-20260115-' || {_SEQ} AS po_number, vendor_id, vendor_name, amount,
         DATE '2026-01-15' AS date, DATE '2026-02-14' AS delivery_date, {_DAYS} || ' days' AS payment_terms,
         'Supply of materials as per RFQ' AS items, amount > 5000000 AS requires_approval FROM o_orders_in"""
CTES["o_conts"] = f"""
  SELECT 'contract' AS doc_type, 'CONT-20260115-' || {_SEQ} AS contract_number, vendor_id, vendor_name,
         amount AS contract_value, DATE '2026-01-15' AS start_date, DATE '2027-01-15' AS end_date,
         'Payment within ' || {_DAYS} || ' days' AS payment_clause, 'Penalty @ 0.5% per week delay' AS penalty_clause,
         'Termination with 30 days notice' AS termination_clause, '12 months warranty' AS warranty_clause,
         'Limited to contract value' AS liability_clause, true AS gcc_compliant, true AS scc_included,
         CASE WHEN amount > 5000000 THEN 'Board' ELSE 'Manager' END AS approval_level FROM o_orders_in"""
CTES["o_docs"] = """
  SELECT *, CASE WHEN value <= 0 THEN ['Invalid amount'] ELSE CAST([] AS VARCHAR[]) END AS validation_errors,
         value > 0 AS is_valid
  FROM (SELECT doc_type, po_number AS number, vendor_id, vendor_name, amount AS value FROM o_pos
        UNION ALL SELECT doc_type, contract_number, vendor_id, vendor_name, contract_value FROM o_conts) u"""

# ---- bids ----------------------------------------------------------------------------
_RFQ = """
  SELECT *, CASE WHEN anomaly_count >= 3 THEN 'high' WHEN anomaly_count = 2 OR extreme_outlier THEN 'medium'
                 WHEN anomaly_count = 1 THEN 'low' ELSE 'none' END AS severity,
         anomaly_count >= 2 OR extreme_outlier AS requires_review, anomaly_count >= 3 AS reject_bid
  FROM (SELECT *, price_too_high::INT + price_too_low::INT + delivery_anomaly::INT + spec_mismatch::INT AS anomaly_count,
               price_too_high OR price_too_low OR is_outlier OR delivery_anomaly OR spec_mismatch AS has_anomaly
        FROM (SELECT *, price_deviation_pct > 30 AS price_too_high, price_deviation_pct < -20 AS price_too_low,
                     coalesce(quoted_price < lower_bound OR quoted_price > upper_bound, false) AS is_outlier,
                     coalesce(abs(z_score) > 3, false) AS extreme_outlier,
                     coalesce(abs(delivery_deviation_pct) > 15, false) AS delivery_anomaly,
                     (payment_terms IS DISTINCT FROM required_payment_terms OR payment_terms IS NULL
                      OR quoted_quantity <> required_quantity) AS spec_mismatch,
                     quoted_quantity <> required_quantity AS quantity_mismatch
              FROM (SELECT *, (quoted_price - mean) / mean * 100 AS price_deviation_pct,
                           (quoted_price - mean) / nullif(std_pop, 0) AS z_score,
                           (delivery_days - mean_days) / mean_days * 100 AS delivery_deviation_pct
                    FROM (SELECT b.*, s.mean, s.std_pop, s.q1 - 1.5e0 * s.iqr AS lower_bound,
                                 s.q3 + 1.5e0 * s.iqr AS upper_bound, avg(delivery_days) OVER ({w}) AS mean_days
                          FROM v_bids b JOIN {stats} s ON {on}) a) b) c) d"""
CTES["o_rfq"] = _RFQ.format(w="PARTITION BY b.rfq_id", stats="o_price_summary_by_rfq", on="b.rfq_id = s.rfq_id")
CTES["o_rfq_all"] = _RFQ.format(w="", stats="o_price_summary", on="true")

# ---- shortlist -------------------------------------------------------------------------
CTES["o_scored"] = f"""
  SELECT *, CASE WHEN rejection_reasons = '' THEN true ELSE false END AS eligible
  FROM (SELECT *, concat_ws('; ', CASE WHEN delivery_score < 60 THEN 'Low delivery score (<60)' END,
                 CASE WHEN quality_score < 60 THEN 'Low quality score (<60)' END,
                 CASE WHEN dispute_count > 3 THEN 'Too many disputes (>3)' END,
                 CASE WHEN final_score < 50 THEN 'Low overall score (<50)' END) AS rejection_reasons
        FROM (SELECT *, {r2('''delivery_score * 0.3e0 + quality_score * 0.25e0 + cost_competitiveness * 0.25e0
                 + payment_compliance * 0.1e0 + dispute_history * 0.1e0''')} AS final_score
              FROM (SELECT *, CASE WHEN dispute_count IS NULL THEN NULL
                     ELSE least(100e0, greatest(0e0, 100 - dispute_count * 20)) END AS dispute_history
                    FROM v_vendors) a) b) c"""
CTES["o_ranked"] = """
  SELECT *, row_number() OVER (ORDER BY final_score DESC NULLS LAST, vendor_id) AS rank,
         CASE WHEN final_score >= 85 THEN 'Excellent' WHEN final_score >= 70 THEN 'Good'
              WHEN final_score >= 50 THEN 'Average' ELSE 'Poor' END AS category FROM o_scored WHERE eligible"""
CTES["o_shortlist"] = """
  SELECT *, CASE WHEN risk_count >= 2 THEN 'High' WHEN risk_count = 1 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM (SELECT *, coalesce((delivery_score < 75)::INT, 0) + coalesce((quality_score < 75)::INT, 0)
                 + coalesce((dispute_count > 1)::INT, 0) AS risk_count,
               concat_ws('; ', CASE WHEN delivery_score < 75 THEN 'Low delivery' END,
                 CASE WHEN quality_score < 75 THEN 'Quality concerns' END,
                 CASE WHEN dispute_count > 1 THEN 'Past disputes' END) AS risk_flags
        FROM o_ranked WHERE rank <= 10) a"""

# ---- negotiation -------------------------------------------------------------------------
CTES["o_nego"] = f"""
  SELECT *, CASE WHEN NOT is_negotiable
                 THEN 'Not recommended for negotiation. Accept current price or seek alternatives.'
                 WHEN success_probability >= 0.7e0
                 THEN 'Start with aggressive offer at ' || {inr('aggressive_offer')} || '. High success probability.'
                 WHEN success_probability >= 0.4e0
                 THEN 'Start with conservative offer at ' || {inr('conservative_offer')}
                      || '. Negotiate gradually over 3 rounds.'
                 ELSE 'Limited negotiation potential. Focus on non-price terms (payment, delivery). Maximum discount: 5%'
                 END AS strategy,
         CASE WHEN NOT is_negotiable THEN 'No Negotiation' WHEN success_probability >= 0.7e0 THEN 'Aggressive Negotiation'
              WHEN success_probability >= 0.5e0 THEN 'Standard Negotiation' ELSE 'Conservative Negotiation' END
              AS recommended_approach
  FROM (SELECT *, coalesce(potential_savings > 0 AND success_probability >= 0.3e0 AND risk_level <> 'High', false)
                  AS is_negotiable
        FROM (SELECT *, CASE WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' ELSE 'Low' END
                        AS risk_level
              FROM (SELECT *, CASE WHEN price_vs_market_pct < -5 THEN 30 ELSE 0 END
                           + CASE WHEN recommended_discount_pct > 15 THEN 25 ELSE 0 END
                           + CASE WHEN vendor_relationship_score < 70 THEN 20 ELSE 0 END
                           + CASE WHEN price_trend_pct < -10 THEN 15 ELSE 0 END AS risk_score,
                           concat_ws('; ', CASE WHEN price_vs_market_pct < -5 THEN 'Already below market' END,
                             CASE WHEN recommended_discount_pct > 15 THEN 'Aggressive discount' END,
                             CASE WHEN vendor_relationship_score < 70 THEN 'Weak relationship' END,
                             CASE WHEN price_trend_pct < -10 THEN 'Price declining trend' END) AS risk_flags,
                           least(0.95e0, greatest(0.1e0, 0.5e0 + CASE WHEN price_vs_market_pct > 10 THEN 0.2e0 ELSE 0e0 END
                             + CASE WHEN price_vs_market_pct > 20 THEN 0.1e0 ELSE 0e0 END
                             + CASE WHEN price_trend_pct < 0 THEN 0.15e0 ELSE 0e0 END
                             + CASE WHEN recommended_discount_pct < 10 THEN 0.1e0 ELSE 0e0 END
                             + CASE WHEN recommended_discount_pct > 20 THEN -0.2e0 ELSE 0e0 END
                             + (vendor_relationship_score - 70) / 100)) AS success_probability
                    FROM (SELECT *, (current_price - target_price) / nullif(current_price, 0) * 100
                                 AS recommended_discount_pct, current_price - target_price AS potential_savings
                          FROM (SELECT *, CASE WHEN above_market THEN current_price * (1e0 - 10e0 / 100)
                                          ELSE current_price * (1e0 - 5e0 / 100) END AS target_price,
                                       current_price * (1e0 - 5e0 / 100) AS conservative_offer,
                                       market_avg_price * 0.95e0 AS aggressive_offer
                                FROM (SELECT *, (current_price - market_avg_price) / nullif(market_avg_price, 0) * 100
                                           AS price_vs_market_pct,
                                           (current_price - historical_avg_price) / nullif(historical_avg_price, 0) * 100
                                           AS price_trend_pct, current_price > market_avg_price AS above_market
                                      FROM v_offers) a) b) c) d) e) f"""

# ---- contract review -----------------------------------------------------------------------
_CLAUSES = "payment penalty termination warranty liability force_majeure dispute_resolution".split()
CTES["o_review"] = f"""
  SELECT *, CASE rag_status WHEN 'Red' THEN 'Reject / Legal Review' WHEN 'Amber' THEN 'Review Required'
                 ELSE 'Approve' END AS approval_recommendation,
         rag_status = 'Red' OR (rag_status = 'Amber' AND is_high_value) AS requires_legal_review
  FROM (SELECT *, CASE WHEN risk_score >= 70 THEN 'Red' WHEN risk_score >= 40 THEN 'Amber' ELSE 'Green' END AS rag_status
        FROM (SELECT *, least(100, base + CASE WHEN is_high_value AND base > 20 THEN 10 ELSE 0 END) AS risk_score
              FROM (SELECT *, least(60, 20 * missing_clauses) + CASE WHEN gcc_compliant THEN 0 ELSE 25 END
                           + CASE WHEN scc_included THEN 0 ELSE 15 END AS base,
                           gcc_compliant AND scc_included AND missing_clauses = 0 AS is_compliant,
                           concat_ws('; ', CASE WHEN NOT payment_clause THEN 'Missing payment clause' END,
                             CASE WHEN NOT penalty_clause THEN 'Missing penalty clause' END,
                             CASE WHEN NOT liability_clause THEN 'Missing liability clause' END,
                             CASE WHEN NOT gcc_compliant THEN 'GCC non-compliant' END,
                             CASE WHEN is_high_value AND NOT scc_included THEN 'High value without SCC' END,
                             CASE WHEN missing_clauses >= 3
                                  THEN 'Multiple missing clauses (' || missing_clauses || ')' END) AS risk_flags
                    FROM (SELECT *, len(missing_clause_names) AS missing_clauses, contract_value > 10000000 AS is_high_value
                          FROM (SELECT *, list_filter([{', '.join(
                              f"CASE WHEN coalesce({c}_clause, false) THEN NULL ELSE '{c}' END" for c in _CLAUSES)}],
                              lambda x: x IS NOT NULL) AS missing_clause_names FROM v_contracts) a) b) c) d) e"""

# ---- change orders ---------------------------------------------------------------------------
CTES["o_changes"] = """
  SELECT *, CASE WHEN cost_variance_pct > 15 OR timeline_variance_pct > 20 OR budget_overrun THEN 'High'
                 WHEN cost_variance_pct > 5 OR timeline_variance_pct > 10 THEN 'Medium' ELSE 'Low' END AS impact_level,
         CASE WHEN NOT is_valid THEN 'Rejected'
              WHEN change_cost > 500000 OR budget_overrun OR significant_cost_impact THEN 'Review Required'
              ELSE 'Auto-Approved' END AS approval_status,
         CASE WHEN change_cost > 10000000 OR budget_overrun THEN 'Board'
              WHEN change_cost > 2000000 OR significant_cost_impact THEN 'Director'
              WHEN change_cost > 500000 THEN 'Manager' WHEN is_valid THEN 'System' ELSE 'Manager' END AS approval_level
  FROM (SELECT *, change_cost > 0 AND contract_id IS NOT NULL AS is_valid,
               concat_ws('; ', CASE WHEN change_cost <= 0 THEN 'Invalid cost' END,
                 CASE WHEN contract_id IS NULL THEN 'Missing contract ID' END) AS validation_errors,
               cost_variance_pct AS cumulative_variance_pct, cost_variance_pct > 10 AS significant_cost_impact,
               coalesce(timeline_variance_pct > 15, false) AS significant_timeline_impact,
               new_contract_value / project_budget * 100 AS budget_utilization_pct,
               new_contract_value / project_budget * 100 > 100 AS budget_overrun,
               project_budget - new_contract_value AS remaining_budget
        FROM (SELECT *, change_cost / original_contract_value * 100 AS cost_variance_pct,
                     original_contract_value + change_cost AS new_contract_value,
                     timeline_extension_days / nullif(original_timeline_days, 0) * 100 AS timeline_variance_pct,
                     original_timeline_days + timeline_extension_days AS new_timeline_days
              FROM v_change_orders) a) b"""

# ---- entity risk -------------------------------------------------------------------------------
_FIN = f"""((850 - credit_score) / 850 * 100) * 0.4e0 + {clip('debt_to_equity / 4e0 * 100')} * 0.35e0
        + {clip('(3e0 - liquidity_ratio) / 3e0 * 100')} * 0.25e0"""
_DEL = f"""(100 - on_time_delivery_pct) * 0.5e0 + {clip('average_delay_days / 30 * 100')} * 0.3e0
        + (project_complexity_score / 10 * 100) * 0.2e0"""
_COM = f"""{clip('compliance_violations / 5 * 100')} * 0.4e0 + (100 - audit_score) * 0.4e0
        + CASE certification_status WHEN 'Valid' THEN 0 WHEN 'Pending' THEN 30 WHEN 'Expired' THEN 60 END * 0.2e0"""
_PER = f"""(100 - quality_score) * 0.4e0 + {clip('defect_rate_pct / 10 * 100')} * 0.35e0
        + (100 - customer_satisfaction) * 0.25e0"""
CTES["o_risk"] = f"""
  SELECT *, risk_level = 'High' OR coalesce(financial_risk_score >= 80, false) OR compliance_violations >= 3
              AS requires_immediate_action,
         CASE greatest(financial_risk_score, delivery_risk_score, compliance_risk_score, performance_risk_score)
              WHEN financial_risk_score THEN 'Financial' WHEN delivery_risk_score THEN 'Delivery'
              WHEN compliance_risk_score THEN 'Compliance' ELSE 'Performance' END AS primary_risk_area
  FROM (SELECT *, CASE WHEN overall_risk_score >= 70 THEN 'High' WHEN overall_risk_score >= 40 THEN 'Medium'
                       ELSE 'Low' END AS risk_level
        FROM (SELECT *, {r2('''financial_risk_score * 0.3e0 + delivery_risk_score * 0.25e0
                 + compliance_risk_score * 0.25e0 + performance_risk_score * 0.2e0''')} AS overall_risk_score
              FROM (SELECT *, {clip(_FIN)} AS financial_risk_score, {clip(_DEL)} AS delivery_risk_score,
                           {clip(_COM)} AS compliance_risk_score, {clip(_PER)} AS performance_risk_score
                    FROM v_entities) a) b) c"""

# ---- outlook -----------------------------------------------------------------------------------
CTES["o_outlook"] = """
  SELECT *, budget_variance / nullif(allocated_budget, 0) * 100 AS budget_variance_pct,
         CASE WHEN p > 0.7e0 THEN 'High' WHEN p > 0.4e0 THEN 'Medium' ELSE 'Low' END AS budget_risk,
         p AS budget_overrun_probability
  FROM (SELECT *, predicted_spend - allocated_budget AS budget_variance,
               least(1e0, greatest(0e0, CASE WHEN price_trend = 'Increasing' THEN 0.3e0 ELSE 0e0 END
                 + CASE WHEN demand_trend = 'Growing' THEN 0.2e0 ELSE 0e0 END + delay_probability * 0.3e0
                 + CASE WHEN high_volatility THEN 0.2e0 ELSE 0e0 END)) AS p
        FROM (SELECT *, predicted_price * forecasted_demand * 3 AS predicted_spend,
                     CAST(trunc(delay_probability * lead_time_days * 0.3e0) AS BIGINT) AS expected_delay_days,
                     CASE WHEN delay_probability > 0.6e0 THEN 'High' WHEN delay_probability > 0.3e0 THEN 'Medium'
                          ELSE 'Low' END AS delay_risk
              FROM (SELECT *, current_price * (1 + predicted_price_change_pct / 100) AS predicted_price,
                           CASE WHEN predicted_price_change_pct > 5 THEN 'Increasing'
                                WHEN predicted_price_change_pct < -5 THEN 'Decreasing' ELSE 'Stable' END AS price_trend,
                           CAST(trunc(current_monthly_demand * (1 + demand_growth_rate / 100)) AS BIGINT)
                               AS forecasted_demand,
                           CASE WHEN demand_growth_rate > 10 THEN 'Growing' WHEN demand_growth_rate < -10 THEN 'Declining'
                                ELSE 'Stable' END AS demand_trend,
                           least(1e0, greatest(0e0, (100 - past_delivery_performance) / 100 * 0.4e0
                             + (100 - supplier_reliability_score) / 100 * 0.3e0 + (lead_time_days / 90) * 0.2e0
                             + high_volatility::INT * 0.1e0)) AS delay_probability
                    FROM (SELECT *, price_change_3m_pct * 0.6e0 + price_change_6m_pct * 0.4e0 AS predicted_price_change_pct,
                                 abs(price_change_3m_pct - price_change_6m_pct) AS price_volatility,
                                 abs(price_change_3m_pct - price_change_6m_pct) > 15 AS high_volatility
                          FROM (SELECT *, (current_price - price_3m_ago) / price_3m_ago * 100 AS price_change_3m_pct,
                                       (current_price - price_6m_ago) / price_6m_ago * 100 AS price_change_6m_pct,
                                       (current_monthly_demand - demand_3m_ago) / demand_3m_ago * 100 AS demand_growth_rate
                                FROM v_items) a) b) c) d) e"""

# ---- records -----------------------------------------------------------------------------------
CTES["o_records"] = f"""
  SELECT *, within_retention AND is_latest_version AND document_status <> 'Pending' AS is_compliant,
         concat_ws('; ', CASE WHEN NOT within_retention THEN 'Retention expired' END,
           CASE WHEN NOT is_latest_version THEN 'Outdated version' END,
           CASE WHEN document_status = 'Pending' THEN 'Pending status' END) AS compliance_issues,
         CASE WHEN NOT archival_candidate THEN 'None' WHEN age_days > 730 THEN 'High' ELSE 'Medium' END
           AS archival_priority, retention_expired AS deletion_candidate
  FROM (SELECT *, coalesce(age_days > 365 AND within_retention AND document_status = 'Active', false)
                  AS archival_candidate
        FROM (SELECT *, coalesce(age_years <= retention_period_years, false) AS within_retention,
                     coalesce(age_years > retention_period_years, false) AS retention_expired,
                     CASE WHEN age_days IS NOT NULL THEN greatest(0, retention_period_years * 365 - age_days) END
                       AS days_until_expiry,
                     date_diff('day', last_access_date, DATE '2003-01-01') AS days_since_access,
                     access_count > 20 AS high_importance,
                     concat_ws(',', document_type, document_status,
                       'age_' || CAST(CAST(floor(age_years) AS BIGINT) AS VARCHAR) || 'y') AS search_tags
              FROM (SELECT *, {r2('age_days / 365e0', 1)} AS age_years,
                           CASE document_type WHEN 'RFQ Response' THEN 3 WHEN 'Purchase Order' THEN 5
                                WHEN 'Change Order' THEN 5 ELSE 7 END AS retention_period_years
                    FROM (SELECT *, date_diff('day', creation_date, DATE '2003-01-01') AS age_days FROM v_records) a) b) c) d"""

# ---- fraud -------------------------------------------------------------------------------------
CTES["o_fraud"] = f"""
  SELECT *, len(fraud_indicators) AS indicator_count,
         CASE WHEN fraud_score >= 70 THEN 'High' WHEN fraud_score >= 40 THEN 'Medium' ELSE 'Low' END AS fraud_risk,
         fraud_score >= 70 OR len(fraud_indicators) >= 3 OR is_duplicate AS requires_investigation,
         fraud_score >= 85 OR (is_duplicate AND amount > 500000) AS immediate_action
  FROM (SELECT *, {r2('''least(100e0, greatest(0e0, duplicate_score * 0.3e0 + price_manipulation_score * 0.3e0
                 + collusion_score * 0.25e0 + payment_pattern_score * 0.15e0))''')} AS fraud_score,
         list_filter([CASE WHEN is_duplicate THEN 'Duplicate Invoice' END,
           CASE WHEN is_near_duplicate THEN 'Near-Duplicate' END,
           CASE WHEN price_manipulation_detected THEN 'Price Manipulation' END,
           CASE WHEN just_below_threshold THEN 'Just-Below-Threshold' END,
           CASE WHEN split_invoice_suspected THEN 'Split Invoice' END, CASE WHEN collusion_risk THEN 'Vendor Collusion' END,
           CASE WHEN unusually_fast_payment THEN 'Fast Payment' END,
           CASE WHEN cash_payment_high_value THEN 'High-Value Cash' END,
           CASE WHEN repeated_payment_pattern THEN 'Repeated Pattern' END], lambda x: x IS NOT NULL) AS fraud_indicators
  FROM (SELECT *, CASE WHEN is_duplicate THEN 100 WHEN is_near_duplicate THEN 60 ELSE 0 END AS duplicate_score,
               40 * price_manipulation_detected::INT + 30 * just_below_threshold::INT + 30 * split_invoice_suspected::INT
                 AS price_manipulation_score,
               30 * similar_vendor_exists::INT + 40 * collusion_risk::INT + 30 * sequential_invoices::INT AS collusion_score,
               20 * unusually_fast_payment::INT + 50 * cash_payment_high_value::INT + 15 * after_hours_payment::INT
                 + 25 * repeated_payment_pattern::INT AS payment_pattern_score,
               abs(vendor_frequency - expected_frequency) AS frequency_variance
  FROM (SELECT *, row_number() OVER (PARTITION BY invoice_number, vendor_id ORDER BY transaction_id) > 1 AS is_duplicate,
               row_number() OVER (PARTITION BY amount_rounded, vendor_id ORDER BY transaction_id) > 1 AS is_near_duplicate,
               (unit_price - category_avg_price) / category_avg_price * 100 AS price_deviation_pct,
               coalesce(abs((unit_price - category_avg_price) / category_avg_price * 100) > 25, false)
                 AS price_manipulation_detected,
               amount >= 950000 AND amount < 1000000 AS just_below_threshold,
               coalesce(same_day_same_vendor > 2, false) AS split_invoice_suspected,
               (SELECT count(*) / count(DISTINCT vendor_id) FROM v_transactions) AS expected_frequency,
               coalesce(vendor_block_rows > 3, false) AS similar_vendor_exists,
               coalesce(same_price_count > 5, false) AS collusion_risk,
               coalesce(abs(number - before) = 1, false) AS sequential_invoices,
               coalesce(payment_delay_days < 3, false) AS unusually_fast_payment,
               payment_method = 'Cash' AND amount > 100000 AS cash_payment_high_value,
               payment_hour < 6 OR payment_hour > 20 AS after_hours_payment,
               repeated_amount_count > 10 AS repeated_payment_pattern
  FROM (SELECT *, round_even(amount / 1000, 0) * 1000 AS amount_rounded,
               round_even(amount / 1000, 0) * 1000 AS rounded_amount,
               CASE WHEN item_category IS NOT NULL THEN avg(unit_price) OVER (PARTITION BY item_category) END
                 AS category_avg_price,
               CASE WHEN item_category IS NOT NULL THEN stddev_samp(unit_price) OVER (PARTITION BY item_category) END
                 AS category_std_price,
               CASE WHEN vendor_id IS NOT NULL THEN count(*) OVER (PARTITION BY vendor_id, invoice_date) END
                 AS same_day_same_vendor,
               CASE WHEN vendor_id IS NOT NULL THEN count(*) OVER (PARTITION BY vendor_id) END AS vendor_frequency,
               CASE WHEN vendor_id IS NOT NULL THEN count(vendor_id) OVER (
                 PARTITION BY floor(CAST(regexp_extract(vendor_id, '(\\d+)', 1) AS BIGINT) / 10)) END AS vendor_block_rows,
               CASE WHEN item_category IS NOT NULL THEN count(*) OVER (
                 PARTITION BY CAST(trunc(amount / 10000) AS BIGINT), item_category) END AS same_price_count,
               count(*) OVER (PARTITION BY round_even(amount / 1000, 0) * 1000) AS repeated_amount_count,
               CAST(regexp_extract(invoice_number, '(\\d+)', 1) AS BIGINT) AS number,
               lag(CAST(regexp_extract(invoice_number, '(\\d+)', 1) AS BIGINT)) OVER (ORDER BY transaction_id) AS before,
               date_diff('day', invoice_date, payment_date) AS payment_delay_days
        FROM v_transactions) a) b) c) d"""
