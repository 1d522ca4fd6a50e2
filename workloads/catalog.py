"""Every registered query with its output layout and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import formats, patterns, text
from bidloom.operators import (
    cells,
    clauses,
    clean,
    corpus_index,
    forecast,
    isolation,
    models,
    outliers,
    quality,
    recommend,
    report,
    retrieval,
    rules,
    series_state,
)
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
from bidloom.operators.scalars import with_scalars
from bidloom.sources import files, snapshots, staging
from workloads.oracle import inr, recommendation, western
from workloads.shape import shape, twin
from workloads.views import table, view

AS_OF_DOCUMENTS = "2026-01-15"
AS_OF_RECORDS = "2003-01-01"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    layout: str | None = None
    source: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        return shape(df, self.layout) if self.layout else df

    def sql(self) -> str | None:
        return twin(self.source, self.layout) if self.source else None


CATALOG: dict[str, Query] = {}
REC = "type priority count:i amount:2 mean:4 ids:l message action"


def add(name: str, layout: str | None, source: str | None, run) -> None:
    CATALOG[name] = Query(run, layout, source)


def on(view_name: str, step: Callable[[DataFrame], DataFrame]):
    """A query that applies one step to one domain table."""
    return lambda spark, sf_dir: step(view(spark, sf_dir, view_name))


def add_stage(prefix: str, view_name: str, analyze, relation: str, layouts: dict[str, str]) -> None:
    for name, layout in layouts.items():
        add(f"{prefix}_{name}", layout, relation, on(view_name, analyze))


# ---- sources -------------------------------------------------------------------

def _corpus(spark, sf_dir):
    docs = view(spark, sf_dir, "v_text")
    return docs.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "folder",
        F.col("doc_id").alias("source"),
        F.length("text").alias("size"),
        "text",
    )


add(
    "corpus_manifest", "folder n_documents:i n_chars:i",
    "(SELECT source AS folder, count(*) AS n_documents, sum(length(text)) AS n_chars FROM documents GROUP BY source) m",
    lambda s, d: files.corpus_manifest(_corpus(s, d)),
)
add(
    "corpus_manifest_files", "folder filename size:i source:i",
    "(SELECT source AS folder, 'doc' || doc_id || '.txt' AS filename, length(text) AS size, doc_id AS source "
    "FROM documents) m",
    lambda s, d: files.manifest_files(_corpus(s, d)),
)
add(
    "corpus_manifest_chunks", "folder n_documents:i n_chars:i n_chunks:i", None,
    lambda s, d: files.corpus_manifest(_corpus(s, d), retrieval.chunk_documents(_corpus(s, d), "source")),
)
add(
    "file_drop_admission", "path length:i accepted reason",
    """(SELECT *, reason = '' AS accepted FROM (SELECT *, CASE
        WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) NOT IN ('.csv', '.xlsx', '.xls', '.pdf')
        THEN 'Invalid file type. Allowed: .csv, .xlsx, .xls, .pdf'
        WHEN length > 52428800 THEN 'File too large (' || printf('%.2f', length / 1048576e0) || 'MB). Maximum: 50MB'
        ELSE '' END AS reason FROM v_drops) a) b""",
    on("v_drops", files.admission),
)


def _fresh(spark, label: str) -> str:
    """A new folder in the shared one; nothing is overwritten."""
    return staging.new_path(spark, label)


def _written_corpus(s, d):
    """The documents as one text file each, in a folder for each source."""
    path = _fresh(s, "corpus")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    files.write_corpus(view(s, d, "v_text").select("folder", name.alias("name"), "text"), path)
    return _with_names(files.load_corpus(s, path)), path


def _with_names(df):
    """Folder and file name from a source: .../folder=src1/name=doc7.txt, or .../name=doc7/part-0.txt."""
    part = lambda key: F.regexp_extract("source", f"{key}=([^/]+?)(\\.txt)?(/|$)", 1)
    return df.withColumns({"folder": part("folder"), "filename": F.concat(part("name"), F.lit(".txt"))})


def _corpus_files(s, d):
    loaded, _ = _written_corpus(s, d)
    # the writer ends each row with a line end
    return loaded.withColumn("size", F.col("size") - 1)


add(
    "corpus_files", "folder filename size:i",
    "(SELECT source AS folder, 'doc' || doc_id || '.txt' AS filename, coalesce(length(text), 0) AS size FROM documents) m",
    _corpus_files,
)
add(
    "corpus_file_admission", "folder n_files:i accepted:i",
    "(SELECT source AS folder, count(*) AS n_files, 0 AS accepted FROM documents GROUP BY source) m",
    lambda s, d: files.file_admission(s, _written_corpus(s, d)[1])
    .groupBy(F.regexp_extract("path", "folder=([^/]+)", 1).alias("folder"))
    .agg(F.count("*").alias("n_files"), F.count_if("accepted").alias("accepted")),
)


def _answer_from_files(s, d):
    """Load, chunk, embed, index, search and prompt; the questions are the first sentences of every twentieth document."""
    corpus, _ = _written_corpus(s, d)
    # the source names folder and file, so the files are read once and nothing is joined
    named = _with_names(retrieval.chunk_documents(corpus, "source", cut_long=True))
    chunks = staging.stage_table(
        named.withColumn("vec_id", F.concat_ws("#", "folder", "filename", "chunk_no")), "chunks"
    )
    model = retrieval.fit_embedding(chunks)
    asked = view(s, d, "v_text").where("doc_id % 20 = 0").select(
        F.col("doc_id").alias("question_id"),
        F.coalesce(F.element_at(F.split("text", "[.]"), 1), F.lit("")).alias("chunk_text"))
    questions = retrieval.embed(model, asked, "question_embedding").withColumnRenamed("chunk_text", "question")
    questions = staging.stage_table(questions, "questions")
    vectors = retrieval.embed(model, chunks).select("vec_id", "embedding")
    found = cells.search(cells.build_index(vectors), questions)
    context = retrieval.pack_context(retrieval.with_chunks(found.hits, chunks))
    prompts = retrieval.answer_prompts(context.join(questions.select("question_id", "question"), "question_id"))
    return prompts.select("question_id", "context", "prompt"), found.work


add("answer_from_files", None, None, lambda s, d: _answer_from_files(s, d)[0])
add("answer_from_files_work", None, None, lambda s, d: _answer_from_files(s, d)[1])
add(
    "answer_from_files_check", "question_id:i blocks:i bounded:i",
    "(SELECT doc_id AS question_id, 4 AS blocks, 1 AS bounded FROM documents WHERE doc_id % 20 = 0) m",
    lambda s, d: _answer_from_files(s, d)[0].select(
        "question_id",
        F.size(F.regexp_extract_all("context", F.lit(r"\[doc[0-9]+\.txt\]\n"), F.lit(0))).alias("blocks"),
        # four blocks of at most a chunk each, with names and blank lines
        (F.length("context") <= 4 * (retrieval.CHUNK_SIZE + 40)).cast("int").alias("bounded"),
    ),
)


_CHANGE = "change_order_id:i contract_id:i change_cost:2 change_reason"
_CHANGE_DDL = "change_order_id bigint, contract_id bigint, change_cost double, change_reason string"


def _csv_round_trip(name: str):
    def run(s, d):
        path = _fresh(s, "csv")
        columns = ["change_order_id", "contract_id", "change_cost", "change_reason"]
        files.write_result(view(s, d, name).select(*columns), path, "csv")
        return files.load_csv(s, path, _CHANGE_DDL)

    return run


def _sink_round_trip(form: str):
    def run(s, d):
        path = _fresh(s, form)
        files.write_result(contract_review.analyze(view(s, d, "v_contracts")), path, form)
        ddl = "contract_id bigint, risk_score double, rag_status string, missing_clause_names array<string>"
        return s.read.schema(ddl).format(form).load(path)

    return run


def _run_record(s, d):
    sink, runs = _fresh(s, "sink"), _fresh(s, "runs")
    files.run_stage(view(s, d, "v_change_orders"), 7, "Change orders", change_orders.analyze, sink, runs)
    return s.read.parquet(runs)


add("csv_round_trip", _CHANGE, "v_change_orders", _csv_round_trip("v_change_orders"))
add("csv_records_over_lines", _CHANGE, "v_odd_csv", _csv_round_trip("v_odd_csv"))
for _form in ("parquet", "json"):
    add(f"result_sink_{_form}", "contract_id:i risk_score:2 rag_status missing_clause_names:l", "o_review",
        _sink_round_trip(_form))
add(
    "stage_run_record", "stage_number:i stage_name status input_rows:i error",
    "(SELECT 7 AS stage_number, 'Change orders' AS stage_name, 'completed' AS status, count(*) AS input_rows, "
    "CAST(NULL AS VARCHAR) AS error FROM v_change_orders) a",
    _run_record,
)

# ---- quality -------------------------------------------------------------------
add(
    "quality_min_rows", "has_rows", "(SELECT count(*) >= 1 AS has_rows FROM v_messy) a",
    lambda s, d: s.createDataFrame([(quality.has_rows(view(s, d, "v_messy")),)], "has_rows boolean"),
)
add(
    "quality_non_numeric", "column n_bad:i",
    """(SELECT 'quality_score' AS "column", count(*) FILTER (quality_score IS NOT NULL
         AND try_cast(quality_score AS DOUBLE) IS NULL) AS n_bad FROM v_messy
        UNION ALL SELECT 'gstin', count(*) FILTER (gstin IS NOT NULL AND try_cast(gstin AS DOUBLE) IS NULL) FROM v_messy
        UNION ALL SELECT 'pincode', count(*) FILTER (try_cast(pincode AS DOUBLE) IS NULL) FROM v_messy) a""",
    on("v_messy", lambda df: quality.non_numeric_counts(df, ["quality_score", "gstin", "pincode"])),
)
_NULLABLE = ["row_id", "contract_value", "vendor_id", "gstin", "email", "phone", "amount"]
add(
    "quality_null_counts", "column n_null:i level",
    "(SELECT *, CASE WHEN n_null = 0 THEN 'ok' WHEN \"column\" IN ('vendor_id', 'amount') THEN 'error' ELSE 'warning' END "
    "AS level FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null FROM v_messy" for c in _NULLABLE
    ) + ") a) b",
    on("v_messy", lambda df: quality.null_counts(df.select(*_NULLABLE), ["vendor_id", "amount"])),
)
_FORMATTED = ["gstin", "pan", "email", "ifsc", "pincode"]


def _format_twin() -> str:
    parts = []
    for c in _FORMATTED:
        bad = f"{c} IS NOT NULL AND NOT regexp_matches({c}, '^(?:{patterns.FORMATS[c]})')"
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({bad}) AS n_bad, (SELECT list(row_id ORDER BY row_id) FROM "
            f"(SELECT row_id FROM v_messy WHERE {bad} ORDER BY row_id LIMIT 5) t) AS first_rows, "
            f"greatest(0, count(*) FILTER ({bad}) - 5) AS n_more FROM v_messy"
        )
    return "(" + " UNION ALL ".join(parts) + ") a"


add(
    "quality_formats", "column n_bad:i first_rows:l n_more:i", _format_twin(),
    on("v_messy", lambda df: quality.format_report(df, "row_id", {c: patterns.FORMATS[c] for c in _FORMATTED})),
)
add(
    "quality_pattern_library", "row_id:i gstin_ok pan_ok email_ok phone_ok ifsc_ok pincode_ok",
    "(SELECT row_id, " + ", ".join(
        f"coalesce(regexp_matches({c}, '^(?:{p})'), true) AS {c}_ok" for c, p in patterns.FORMATS.items()
    ) + " FROM v_messy) a",
    on(
        "v_messy",
        lambda df: df.select(
            "row_id",
            *[quality.format_reason(F.col(c), p).isNull().alias(f"{c}_ok") for c, p in patterns.FORMATS.items()],
        ),
    ),
)
add(
    "quality_duplicate_keys", "column n_duplicates:i",
    """(SELECT 'vendor_id' AS "column", count(*) - count(DISTINCT vendor_id)
           - (CASE WHEN count(*) > count(vendor_id) THEN 1 ELSE 0 END) AS n_duplicates FROM v_messy) a""",
    on("v_messy", quality.duplicate_key_counts),
)


def _checks() -> list[quality.Check]:
    return [
        quality.Check("amount", "amount", quality.amount_reason(F.col("amount"), 0, 400000)),
        quality.Check("no_zero", "share_pct", quality.numeric_reason(F.col("share_pct"), allow_zero=False)),
        quality.Check("percentage", "share_pct", quality.percentage_reason(F.col("share_pct"))),
        quality.Check("date", "contract_date", quality.date_reason(F.col("contract_date"), "yyyy-MM-dd", "2026-01-05", "2026-01-25")),
        quality.Check("date_order", "end_date", quality.date_order_reason(F.col("start_date"), F.col("end_date"), False)),
        quality.Check("email", "email", quality.email_reason(F.col("email"))),
        quality.Check("phone", "phone", quality.phone_reason(F.col("phone"), F.col("country"))),
        quality.Check("currency", "currency", quality.currency_warning(F.col("currency"))),
    ]


_CHECK_SQL = {
    ("amount", "amount"): """CASE WHEN amount IS NULL THEN 'missing' WHEN amount < 0 THEN 'negative'
        WHEN amount > 400000 THEN 'above maximum' END""",
    ("no_zero", "share_pct"): "CASE WHEN share_pct IS NULL THEN 'missing' WHEN share_pct = 0 THEN 'zero' END",
    ("percentage", "share_pct"): """CASE WHEN share_pct IS NULL THEN 'missing' WHEN share_pct < 0 THEN 'negative'
        WHEN share_pct > 100 THEN 'above maximum' END""",
    ("date", "contract_date"): """CASE WHEN try_strptime(contract_date, '%Y-%m-%d') IS NULL THEN 'unreadable'
        WHEN try_strptime(contract_date, '%Y-%m-%d') < DATE '2026-01-05' THEN 'too early'
        WHEN try_strptime(contract_date, '%Y-%m-%d') > DATE '2026-01-25' THEN 'too late' END""",
    ("date_order", "end_date"): "CASE WHEN end_date <= start_date THEN 'end before start' END",
    ("email", "email"): """CASE WHEN email IS NULL OR NOT regexp_matches(email,
        '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN 'email' END""",
    ("phone", "phone"): """CASE WHEN phone IS NULL OR NOT regexp_matches(regexp_replace(phone, '[\\s\\-()+]', '', 'g'),
        CASE country WHEN 'IN' THEN '^(91)?[6-9]\\d{9}$' WHEN 'US' THEN '^(1)?[2-9]\\d{9}$' ELSE '^\\d{10,15}$' END)
        THEN 'phone' END""",
    ("currency", "currency"): """CASE WHEN currency NOT IN ('INR', 'USD', 'EUR', 'GBP', 'AED')
        THEN 'unlisted currency' END""",
}


def _check_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", '{col}' AS \"column\", CAST(row_id AS VARCHAR) AS row_key, {sql} AS reason "
        "FROM v_messy" for (name, col), sql in _CHECK_SQL.items()
    )


add(
    "quality_violations", "check column row_key reason", f"(SELECT * FROM ({_check_rows()}) a WHERE reason IS NOT NULL) b",
    on("v_messy", lambda df: quality.violations(df, "row_id", _checks())),
)
add(
    "quality_check_summary", "check column n_rows:i n_bad:i",
    f'(SELECT "check", "column", count(*) AS n_rows, count(reason) AS n_bad FROM ({_check_rows()}) a GROUP BY 1, 2) b',
    on("v_messy", lambda df: quality.check_summary(df, _checks())),
)
for _i, ((_name, _), _sql) in enumerate(_CHECK_SQL.items()):
    add(
        f"quality_{_name}", "row_id:i reason", f"(SELECT row_id, {_sql} AS reason FROM v_messy) a",
        on("v_messy", lambda df, i=_i: df.select("row_id", _checks()[i].reason.alias("reason"))),
    )

# ---- cleaning ------------------------------------------------------------------
_ASCII = "regexp_replace({t}, '[^\\x00-\\x7F]+', '', 'g')"
_CLEAN = "regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
_STRIP = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
add(
    "clean_text", "doc_id:i cleaned",
    "(SELECT doc_id, " + _STRIP.replace("{t}", "regexp_replace(" + _ASCII.replace("{t}", _CLEAN)
                                        + ", '\\r\\n?', chr(10), 'g')") + " AS cleaned FROM v_text) a",
    on("v_text", lambda df: df.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))),
)
add(
    "clean_ocr_text", "doc_id:i cleaned",
    "(SELECT doc_id, " + _STRIP.replace("{t}", _ASCII.replace("{t}", _CLEAN)) + " AS cleaned FROM v_text) a",
    on("v_text", lambda df: df.select("doc_id", text.clean_ocr_text(F.col("text")).alias("cleaned"))),
)
_MONEY_SQL = """CASE WHEN regexp_full_match(trim(replace(replace(replace(contract_value, '₹', ''), 'Rs.', ''), ',', '')),
    '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
    THEN CAST(trim(replace(replace(replace(contract_value, '₹', ''), 'Rs.', ''), ',', '')) AS DOUBLE) ELSE 0e0 END"""
_DATE_SQL = "CAST(coalesce(" + ", ".join(
    f"try_strptime(contract_date, '{f}')"
    for f in ["%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%Y/%m/%d", "%d-%b-%Y", "%d %B %Y", "%B %d, %Y"]
) + ") AS DATE)"
add(
    "normalize_currency", "row_id:i amount_value:4", f"(SELECT row_id, {_MONEY_SQL} AS amount_value FROM v_messy) a",
    on("v_messy", lambda df: df.select("row_id", text.currency_to_double(F.col("contract_value")).alias("amount_value"))),
)
add(
    "normalize_date", "row_id:i parsed:d", f"(SELECT row_id, {_DATE_SQL} AS parsed FROM v_messy) a",
    on("v_messy", lambda df: df.select("row_id", text.parse_date(F.col("contract_date")).alias("parsed"))),
)
add(
    "normalize_data", "row_id:i contract_value:4 contract_date:d quality_score:4",
    f"""(SELECT row_id, {_MONEY_SQL} AS contract_value, {_DATE_SQL} AS contract_date,
        CASE WHEN try_cast(quality_score AS DOUBLE) IS NOT NULL
        THEN least(100e0, greatest(0e0, try_cast(quality_score AS DOUBLE))) END AS quality_score FROM v_messy) a""",
    on("v_messy", clean.normalize_data),
)

# ---- clauses -------------------------------------------------------------------
add(
    "clause_segments", "doc_id:i clause_id:i clause_text", "o_clauses",
    on("v_contract_docs", clauses.segment),
)
add("clause_types", "doc_id:i clause_id:i clause_type", "o_clauses",
    on("v_contract_docs", lambda df: clauses.with_type(clauses.segment(df))))
add("clause_tags", "doc_id:i clause_id:i mandatory risk_level", "o_clauses",
    on("v_contract_docs", lambda df: clauses.with_tags(clauses.segment(df))))
for _name, _layout in {
    "money": "doc_id:i clause_id:i money:l",
    "dates": "doc_id:i clause_id:i dates:l",
    "percentages": "doc_id:i clause_id:i percentages:l",
    "table": "doc_id:i clause_id:i clause_text clause_type mandatory risk_level dates:l money:l percentages:l organizations:l",
}.items():
    add(f"clause_{_name}", _layout, "o_clauses", on("v_contract_docs", clauses.clause_table))
add(
    "clause_organizations", "doc_id:i clause_id:i clause_type organizations:l", "o_named_clauses",
    lambda s, d: clauses.clause_table(view(s, d, "v_contract_docs"), names=view(s, d, "v_names")),
)
add(
    "document_entities", "doc_id:i money:l dates:l percentages:l organizations:l", "o_entities",
    lambda s, d: clauses.with_entities(view(s, d, "v_contract_docs"), view(s, d, "v_names"), ["doc_id"]),
)
add(
    "document_features",
    "doc_id:i contract_value vendor_name contract_date delivery_date payment_terms penalty_clause warranty_period",
    "o_features",
    lambda s, d: clauses.document_features(view(s, d, "v_contract_docs"), names=view(s, d, "v_names")),
)
add(
    "document_clause_rollup", "doc_id:i clause_count:i high_risk_clauses:i mandatory_clauses:i",
    """(SELECT doc_id, count(*) AS clause_count, count(*) FILTER (risk_level = 'high') AS high_risk_clauses,
        count(*) FILTER (mandatory) AS mandatory_clauses FROM o_clauses GROUP BY doc_id) a""",
    on("v_contract_docs", lambda df: clauses.document_rollup(clauses.clause_table(df))),
)

# ---- rules ---------------------------------------------------------------------
add("vendor_score", "vendor_id vendor_score:2", "o_vendor_rules", on("v_vendors", rules.vendor_rules))
add("vendor_risk_band", "vendor_id risk_level", "o_vendor_rules", on("v_vendors", rules.vendor_rules))
add(
    "vendor_rules", "vendor_id vendor_score:2 risk_level high_dispute_flag low_compliance_flag preferred_vendor",
    "o_vendor_rules", on("v_vendors", rules.vendor_rules),
)
_BID = "rfq_id:i l_orderkey:i l_linenumber:i vendor_id quoted_price:2"
_BID_FLAGS = f"{_BID} price_high_flag price_low_flag delivery_deviation_flag payment_terms_flag anomaly_detected"
add("bid_rules", _BID_FLAGS, "o_bid_rules", on("v_bids", rules.bid_rules))
add("bid_rules_by_rfq", _BID_FLAGS, "o_bid_rules_by_rfq", on("v_bids", lambda df: rules.bid_rules(df, ["rfq_id"])))
add("bid_rule_severity", f"{_BID} anomaly_severity", "o_bid_rules", on("v_bids", rules.bid_rules))
_MISSING = " ".join(f"{c}_clause_missing" for c in "payment penalty termination warranty liability".split())
add(
    "contract_rules", f"contract_id:i {_MISSING} gcc_deviation high_value_contract requires_board_approval",
    "o_contract_rules", on("v_contract_texts", rules.contract_rules),
)
add("contract_risk_score", "contract_id:i contract_risk_score:i", "o_contract_rules",
    on("v_contract_texts", rules.contract_rules))
add("contract_traffic_light", "contract_id:i rag_status", "o_contract_rules",
    on("v_contract_texts", rules.contract_rules))
add(
    "vendor_rule_recommendations", REC,
    "(" + recommendation("o_vendor_rules", [
        {"type": "preferred_vendors", "when": "preferred_vendor",
         "message": "'Found ' || n || ' preferred vendors with score >= 85 and low risk'"},
        {"type": "high_risk_vendors", "when": "risk_level = 'high'",
         "message": "'⚠️  ' || n || ' vendors flagged as HIGH RISK - avoid or escalate'"},
    ]) + ") a",
    on("v_vendors", lambda df: rules.rule_recommendations(rules.vendor_rules(df), "vendor")),
)
add(
    "bid_rule_recommendations", REC,
    "(" + recommendation("o_bid_rules", [
        {"type": "critical_anomalies", "when": "anomaly_severity = 'high'",
         "message": "'🚨 ' || n || ' bids with HIGH severity anomalies - requires immediate review'"},
    ]) + ") a",
    on("v_bids", lambda df: rules.rule_recommendations(rules.bid_rules(df), "bid")),
)
add(
    "contract_rule_recommendations", REC,
    "(" + recommendation("o_contract_rules", [
        {"type": "red_contracts", "when": "rag_status = 'Red'",
         "message": "'🔴 ' || n || ' contracts flagged RED - do not approve without legal review'"},
    ]) + ") a",
    on("v_contract_texts", lambda df: rules.rule_recommendations(rules.contract_rules(df), "contract")),
)

# ---- outliers ------------------------------------------------------------------
_SUM = "count:i mean:4 median:6 std:4 variance:2 min:4 max:4 q1:6 q3:6 iqr:6 range:6"
add("price_summary", _SUM, "o_price_summary", on("v_bids", lambda df: outliers.summary(df, "quoted_price")))
add("price_summary_by_rfq", f"rfq_id:i {_SUM}", "o_price_summary_by_rfq",
    on("v_bids", lambda df: outliers.summary(df, "quoted_price", ["rfq_id"])))
add("quality_score_summary", _SUM, "o_quality_summary",
    on("v_vendors", lambda df: outliers.summary(df, "quality_score")))
add("price_zscore_outliers", f"{_BID} zscore:6 is_outlier_zscore outlier_type severity",
    "(SELECT * EXCLUDE (severity), z_severity AS severity FROM o_price_combined) a",
    on("v_bids", lambda df: outliers.zscore_outliers(df, "quoted_price", ["rfq_id"])))
add("price_iqr_outliers",
    f"{_BID} iqr:6 lower_bound:6 upper_bound:6 is_outlier_iqr outlier_type distance_from_bound:6 severity",
    "(SELECT * EXCLUDE (severity, outlier_type), iqr_severity AS severity, iqr_type AS outlier_type "
    "FROM o_price_combined) a",
    on("v_bids", lambda df: outliers.iqr_outliers(df, "quoted_price", ["rfq_id"])))
add("price_combined_outliers",
    f"{_BID} zscore:6 is_outlier_zscore is_outlier_iqr is_outlier outlier_type severity detection_method",
    "o_price_combined", on("v_bids", lambda df: outliers.combined_outliers(df, "quoted_price", ["rfq_id"])))
add("bid_price_analysis",
    f"{_BID} is_price_outlier outlier_type outlier_severity detection_method zscore:6 price_mean:4 price_median:6 "
    "price_std:4 deviation_pct:6",
    "(SELECT *, is_outlier AS is_price_outlier, severity AS outlier_severity, mean AS price_mean, "
    "median AS price_median, std AS price_std FROM o_price_combined) a",
    on("v_bids", lambda df: outliers.bid_price_analysis(df, by=["rfq_id"])))
add("vendor_metric_analysis",
    "vendor_id quality_score:4 is_performance_outlier outlier_type severity zscore:6 metric_mean:4 metric_median:6",
    "(SELECT *, mean AS metric_mean, median AS metric_median FROM o_quality_combined) a",
    on("v_vendors", lambda df: outliers.vendor_metric_analysis(df, "quality_score")))

# ---- models --------------------------------------------------------------------
_TRAIN = "(CAST('0x' || substr(md5(item_id || '|42'), 1, 8) AS BIGINT) % 10000 >= 2000)"


def _ols_items(s, d):
    return view(s, d, "v_items").select("item_id", "current_price", F.col("allocated_budget").alias("label"))


def _vendor_features(s, d):
    """Late suppliers as a two-class problem over line items."""
    line = table(s, d, "lineitem")
    return line.select(
        F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("key"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        ((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.06)).cast("double").alias("label"),
    )


_FIT = f"""(SELECT regr_slope(label, current_price) AS slope, regr_intercept(label, current_price) AS intercept
    FROM (SELECT *, allocated_budget AS label FROM v_items) i WHERE {_TRAIN})"""
add("train_test_split", "item_id:i is_train", f"(SELECT item_id, {_TRAIN} AS is_train FROM v_items) a",
    lambda s, d: _ols_items(s, d).select("item_id", models.train_share("item_id").alias("is_train")))


def _linear(s, d):
    return models.train_model(_ols_items(s, d), "label", "item_id", "linear_regression", "regression")


add(
    "linear_regression_predictions", "item_id:i prediction:3",
    f"(SELECT item_id, f.intercept + f.slope * current_price AS prediction FROM v_items, {_FIT} f) a",
    lambda s, d: _linear(s, d).predict(_ols_items(s, d), ("item_id",)),
)


def _reloaded(s, d):
    path = _fresh(s, "model")
    _linear(s, d).save(path)
    return models.TrainedModel.load(path).predict(_ols_items(s, d), ("item_id",))


add("model_reload_predictions", "item_id:i prediction:3",
    f"(SELECT item_id, f.intercept + f.slope * current_price AS prediction FROM v_items, {_FIT} f) a", _reloaded)
add(
    "linear_regression_metrics", "metric value:6",
    f"""(SELECT unnest(['train_r2', 'test_r2', 'train_rmse', 'test_rmse', 'n_features', 'n_train_samples',
            'n_test_samples']) AS metric,
          unnest([1 - e1 / t1, 1 - e0 / t0, sqrt(e1 / n1), sqrt(e0 / n0), 1, n1, n0]) AS value
        FROM (SELECT count(*) FILTER (tr) AS n1, count(*) FILTER (NOT tr) AS n0,
                sum(e) FILTER (tr) AS e1, sum(e) FILTER (NOT tr) AS e0,
                var_pop(y) FILTER (tr) * count(*) FILTER (tr) AS t1,
                var_pop(y) FILTER (NOT tr) * count(*) FILTER (NOT tr) AS t0
              FROM (SELECT {_TRAIN} AS tr, allocated_budget AS y,
                      pow(allocated_budget - f.intercept - f.slope * current_price, 2) AS e
                    FROM v_items, {_FIT} f) a) b) c""",
    lambda s, d: _linear(s, d).metrics_table(),
)
add(
    "forest_classifier_metrics", None, None,
    lambda s, d: models.train_model(_vendor_features(s, d), "label", "key").metrics_table(),
)
add(
    "forest_classifier_importance", None, None,
    lambda s, d: models.train_model(_vendor_features(s, d), "label", "key").feature_importance(),
)
add(
    "forest_classifier_predictions", None, None,
    lambda s, d: models.train_model(_vendor_features(s, d), "label", "key")
    .predict(_vendor_features(s, d), ("key",)).select("key", "prediction"),
)
add(
    "logistic_regression_probabilities", None, None,
    lambda s, d: models.train_model(_vendor_features(s, d), "label", "key", "logistic_regression")
    .predict_proba(_vendor_features(s, d), ("key",)).select("key", "probability", "prediction"),
)
add(
    "forest_regressor_metrics", None, None,
    lambda s, d: models.train_model(
        _ols_items(s, d), "label", "item_id", "random_forest", "regression"
    ).metrics_table(),
)
add(
    "isolation_forest", None, None,
    lambda s, d: isolation.detect_anomalies(
        view(s, d, "v_transactions").select("transaction_id", "amount", "unit_price", "payment_hour"),
        "transaction_id", ["amount", "unit_price", "payment_hour"],
    ),
)

# properties of the models above that SQL can state
_LATE = "(l_quantity > 30 AND l_discount < 0.06)"
add(
    "forest_prediction_check", "n_rows:i n_keys:i n_classes:i learned:i beats_majority:i",
    # the classes follow from two columns, so a forest that learned them errs on few rows of either class
    f"""(SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS n_keys,
        0 AS n_classes, 1 AS learned, CASE WHEN count(*) FILTER ({_LATE}) BETWEEN 1 AND count(*) - 1 THEN 1 ELSE 0 END
        AS beats_majority FROM lineitem) a""",
    lambda s, d: models.train_model(_vendor_features(s, d), "label", "key")
    .predict(_vendor_features(s, d), ("key", "label"))
    .agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"),
         F.count_if(~F.col("prediction").isin(0.0, 1.0)).alias("n_classes"),
         (F.avg((F.col("prediction") == F.col("label")).cast("double")) >= 0.97).cast("int").alias("learned"),
         # recall of both classes: one that always answers the majority has none of the other
         (F.least(*[F.count_if((F.col("label") == c) & (F.col("prediction") == c)) / F.count_if(F.col("label") == c)
                    for c in (0.0, 1.0)]) >= 0.9).cast("int").alias("beats_majority")),
)
add(
    "forest_importance_check", "feature decides:i",
    # the two columns that the classes follow from have nearly all importance
    "(SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature, unnest([1, 0, 1, 0]) AS decides) a",
    lambda s, d: models.train_model(_vendor_features(s, d), "label", "key").feature_importance()
    .select("feature", (F.col("importance") >= 0.2).cast("int").alias("decides")),
)
add(
    "logistic_regression_check", "slopes_at_rest:i out_of_range:i",
    "(SELECT 1 AS slopes_at_rest, 0 AS out_of_range) a",
    lambda s, d: _logistic_at_rest(s, d),
)

def _net_quantities(s, d):
    """Line items whose target follows from two of three columns."""
    net = F.col("l_quantity") * (1 - F.col("l_discount"))
    return _vendor_features(s, d).select("key", "l_quantity", "l_discount", "l_tax", net.alias("label"))


add(
    "forest_regressor_check", "metric in_range:i",
    # the target follows from the columns: far above the mean alone (an R2 of 0), on rows it has not seen
    "(SELECT unnest(['train_r2', 'test_r2', 'train_rmse', 'test_rmse']) AS metric, 1 AS in_range) a",
    lambda s, d: models.train_model(_net_quantities(s, d), "label", "key", "random_forest", "regression").metrics_table()
    .where(F.col("metric").rlike("_(r2|rmse)$"))
    .select("metric", F.when(F.col("metric").endswith("_r2"), F.col("value").between(0.8, 1))
            .otherwise(F.col("value") > 0).cast("int").alias("in_range")),
)
add(
    "classification_metrics", "metric value:6",
    """(SELECT unnest(['train_accuracy', 'test_accuracy', 'precision', 'recall', 'f1_score']) AS metric,
        unnest([tr_hit / tr_n, te_hit / te_n, (pos * prec1 + neg * prec0) / te_n, (pos * rec1 + neg * rec0) / te_n,
            (pos * 2 * prec1 * rec1 / (prec1 + rec1) + neg * 2 * prec0 * rec0 / (prec0 + rec0)) / te_n]) AS value
      FROM (SELECT *, tp / pp AS prec1, tp / pos AS rec1, tn / pn AS prec0, tn / neg AS rec0 FROM (
        SELECT count(*) FILTER (tr) AS tr_n, count(*) FILTER (NOT tr) AS te_n,
               count(*) FILTER (tr AND y = p) AS tr_hit, count(*) FILTER (NOT tr AND y = p) AS te_hit,
               count(*) FILTER (NOT tr AND y = 1 AND p = 1) AS tp, count(*) FILTER (NOT tr AND y = 0 AND p = 0) AS tn,
               count(*) FILTER (NOT tr AND p = 1) AS pp, count(*) FILTER (NOT tr AND p = 0) AS pn,
               count(*) FILTER (NOT tr AND y = 1) AS pos, count(*) FILTER (NOT tr AND y = 0) AS neg
        FROM (SELECT quality AS y, CASE WHEN toxic = 0 AND doc_id % 7 > 0 THEN 1 ELSE 0 END AS p, doc_id % 3 > 0 AS tr
              FROM labels WHERE quality IS NOT NULL) l) c) r) a""",
    lambda s, d: _rule_metrics(s, d),
)
_SCORED = ["transaction_id", "amount", "unit_price", "payment_hour"]


def _with_extremes(s, d):
    """Transactions, and copies of every 997th far outside of them, under negative ids."""
    rows = view(s, d, "v_transactions").select(*_SCORED)
    far = rows.where("transaction_id % 997 = 0").select(
        (-F.col("transaction_id") - 1).alias("transaction_id"), (F.col("amount") * 50).alias("amount"),
        (F.col("unit_price") * 1000 + 1e9).alias("unit_price"), "payment_hour")
    return rows.unionByName(far)


add(
    "isolation_forest_check", "n_rows:i n_planted:i out_of_range:i flag_share_ok:i high_share_ok:i planted_found:i",
    "(SELECT count(*) + count(*) FILTER (transaction_id % 997 = 0) AS n_rows, "
    "count(*) FILTER (transaction_id % 997 = 0) AS n_planted, 0 AS out_of_range, 1 AS flag_share_ok, 1 AS high_share_ok, "
    "1 AS planted_found FROM v_transactions) a",
    lambda s, d: isolation.detect_anomalies(_with_extremes(s, d), "transaction_id", _SCORED[1:]).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("transaction_id") < 0).alias("n_planted"),
        F.count_if(~F.col("anomaly_score").between(-1, 0)).alias("out_of_range"),
        # scores tie, so the shares are about the contamination and its half at most
        F.avg(F.col("is_anomaly").cast("double")).between(0.02, 0.101).cast("int").alias("flag_share_ok"),
        F.avg((F.col("anomaly_severity") == "high").cast("double")).between(0.01, 0.051).cast("int").alias("high_share_ok"),
        # every planted row is flagged, and all score below the mean of the others by a margin
        (F.bool_and((F.col("transaction_id") >= 0) | F.col("is_anomaly"))
         & (F.max(F.when(F.col("transaction_id") < 0, F.col("anomaly_score")))
            < F.avg(F.when(F.col("transaction_id") >= 0, F.col("anomaly_score"))) - 0.05)).cast("int").alias("planted_found"),
    ),
)


def _logistic_at_rest(s, d):
    """Slope of the penalised loss at the fitted coefficients, which is zero at the optimum."""
    rows = _vendor_features(s, d)
    model = models.train_model(rows, "label", "key", "logistic_regression")
    fitted = model.pipeline.stages[-1]
    train = rows.where(models.train_share("key"))
    z = reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(model.features, fitted.coefficients, strict=True)])
    residual = F.lit(1.0) / (1 + F.exp(-(z + float(fitted.intercept)))) - F.col("label")
    scale = [F.stddev_pop(c) for c in model.features]
    slopes = [F.sum(residual * F.col(c)) + float(w) for c, w in zip(model.features, fitted.coefficients, strict=True)]
    at_rest = [F.abs(g) / F.count("*") <= 1e-3 * F.greatest(F.lit(1.0), sd + F.abs(F.avg(c)))
               for g, sd, c in zip(slopes, scale, model.features, strict=True)]
    checked = train.agg(reduce(lambda a, b: a & b, at_rest).cast("int").alias("slopes_at_rest"))
    odds = model.predict_proba(rows, ("key",)).agg(
        F.count_if(~F.col("probability")[1].between(0, 1)).alias("out_of_range"))
    return with_scalars(checked, odds)


def _rule_metrics(s, d):
    guess = F.when((F.col("toxic") == 0) & (F.col("doc_id") % 7 > 0), 1.0).otherwise(0.0)
    scored = table(s, d, "labels").where("quality is not null").select(
        F.col("quality").alias("label"), guess.alias("prediction"), (F.col("doc_id") % 3 > 0).alias("_train"))
    found = models.classification_metrics(scored, "label")
    return s.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


# ---- forecasts -----------------------------------------------------------------
_FC = "series_id{} step:i ts:d forecast:2 method last_value:2"
add("forecast_moving_average", _FC.format(":i"), "o_moving_average",
    on("v_customer_series", lambda df: forecast.forecast(df, 6, "moving_average", "month_start")))
add("forecast_linear_trend", _FC.format(""), "o_linear_trend",
    on("v_series", lambda df: forecast.forecast(df, 12, "linear_trend", "month_start")))
add("forecast_exponential_smoothing", _FC.format(""), "o_smoothing",
    on("v_series", lambda df: forecast.forecast(df, 12, "exponential_smoothing", "month_end")))


def _grown(name: str, periods: int, method: str, freq: str):
    """States of the months before 1996, extended by what came in two later stretches."""
    def run(s, d):
        points = staging.stage_table(view(s, d, name), "series")
        state = series_state.summarize(points.where("ts < date '1996-01-01'"))
        for later in ("ts < date '1997-01-01'", "ts >= date '1997-01-01'"):
            new = points.where(f"ts >= date '1996-01-01' and {later}")
            state = series_state.extend(staging.stage_table(state, "series-state"), new)
        return series_state.forecast_from(state, periods, method, freq)
    return run


add("forecast_growing_moving_average", _FC.format(":i"), "o_moving_average",
    _grown("v_customer_series", 6, "moving_average", "month_start"))
add("forecast_growing_linear_trend", _FC.format(""), "o_linear_trend",
    _grown("v_series", 12, "linear_trend", "month_start"))
add("forecast_growing_smoothing", _FC.format(""), "o_smoothing",
    _grown("v_series", 12, "exponential_smoothing", "month_end"))
add("forecast_result", "series_id method periods:i last_historical_value:2 first_forecast_value:2 last_forecast_value:2",
    """(SELECT series_id, max(method) AS method, max(step) AS periods, max(last_value) AS last_historical_value,
        arg_min(forecast, step) AS first_forecast_value, arg_max(forecast, step) AS last_forecast_value
        FROM o_smoothing GROUP BY series_id) a""",
    on("v_series", lambda df: forecast.forecast_result(forecast.forecast(df, 12, "exponential_smoothing"))))
_AHEAD = {"week": None, "quarter_start": 3, "quarter_end": 3, "year_start": 12, "year_end": 12}


def _frequencies(df):
    ahead = [
        forecast.forecast(df, 3, "moving_average", f).select("series_id", F.lit(f).alias("freq"), "step", "ts") for f in _AHEAD
    ]
    return reduce(DataFrame.unionByName, ahead)


def _next_in_sql(freq: str, months: int | None) -> str:
    unit, _, side = freq.partition("_")
    if months is None:
        return "last + CAST(7 * step AS INT)"
    start = f"date_trunc('{unit}', last)"
    if side == "start":
        return f"CAST({start} + to_months(CAST(step * {months} AS INT)) AS DATE)"
    end = f"CAST({start} + INTERVAL {months} MONTH AS DATE) - 1"
    ahead = f"(step + CASE WHEN last = {end} THEN 1 ELSE 0 END)"
    return f"CAST({start} + to_months(CAST({ahead} * {months} AS INT)) AS DATE) - 1"


add("forecast_frequencies", "series_id freq step:i ts:d",
    "(" + " UNION ALL ".join(
        f"SELECT series_id, '{f}' AS freq, step, {_next_in_sql(f, m)} AS ts FROM (SELECT series_id, max(CAST(ts AS DATE)) AS last, "
        f"unnest([1, 2, 3]) AS step FROM v_series GROUP BY series_id HAVING count(*) >= 3) a" for f, m in _AHEAD.items()
    ) + ") u",
    on("v_series", _frequencies))
add("forecast_inferred_frequency", "series_id frequency",
    """(SELECT series_id, CASE WHEN gap BETWEEN 0 AND 2 THEN 'day' WHEN gap BETWEEN 5 AND 9 THEN 'week'
          WHEN gap BETWEEN 26 AND 33 THEN 'month' || side WHEN gap BETWEEN 80 AND 100 THEN 'quarter' || side
          WHEN gap BETWEEN 340 AND 390 THEN 'year' || side END AS frequency
        FROM (SELECT series_id, CASE WHEN starts THEN '_start' ELSE '_end' END AS side,
                CASE WHEN g.gap IS NOT NULL THEN g.gap END AS gap
              FROM (SELECT series_id, bool_and(day(ts) = 1) AS starts FROM v_series GROUP BY series_id) a
              LEFT JOIN (SELECT series_id, gap, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, gap) AS nth
                FROM (SELECT series_id, gap, count(*) AS n FROM (SELECT series_id,
                        ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap
                        FROM (SELECT DISTINCT series_id, CAST(ts AS DATE) AS ts FROM v_series) t) l
                      WHERE gap IS NOT NULL GROUP BY ALL) c) g USING (series_id) WHERE coalesce(nth, 1) = 1) f) u""",
    on("v_series", forecast.infer_frequency))
add("forecast_short_series", "series_id:i n_points:i",
    "(SELECT series_id, count(*) AS n_points FROM v_customer_series GROUP BY series_id HAVING count(*) < 3) a",
    on("v_customer_series", forecast.short_series))

# ---- retrieval -----------------------------------------------------------------

def _questions(s, d):
    """Every twentieth vector is a question."""
    asked = table(s, d, "embeddings").where("vec_id % 20 = 0")
    return asked.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_embedding"))


def _hits(s, d):
    return retrieval.nearest_chunks(table(s, d, "embeddings"), _questions(s, d))


def _indexed(s, d):
    return cells.search(cells.build_index(table(s, d, "embeddings")), _questions(s, d))


def _pieces(s, d):
    """Each document in pieces of a chunk's size, under its vector's id; the pieces make up the whole text."""
    size = retrieval.CHUNK_SIZE
    last = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    parts = table(s, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("source").alias("folder"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text",
        F.explode(F.sequence(F.lit(1), last)).alias("chunk_no"))
    text = F.substring(F.col("text"), (F.col("chunk_no") - 1) * size + 1, F.lit(size))
    return parts.withColumn("chunk_text", text).drop("text")


def _hit_texts(s, d):
    return retrieval.with_chunks(_indexed(s, d).hits, _pieces(s, d))


_HITS = """(SELECT question_id, vec_id, distance, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM (
      SELECT q.vec_id AS question_id, e.vec_id, sqrt(sum((e.x - q.x) * (e.x - q.x))) AS distance
      FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS pos
            FROM embeddings WHERE vec_id % 20 = 0) q
      JOIN (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS pos
            FROM embeddings) e ON e.pos = q.pos GROUP BY q.vec_id, e.vec_id) b) c WHERE rank <= 4)"""
_SOURCES = f"""(SELECT question_id, rank, filename, folder, chunk_no, left(chunk_text, 200) || '...' AS content,
    distance AS score, chunk_text AS text FROM {_HITS} h JOIN (
      SELECT doc_id AS vec_id, source AS folder, 'doc' || doc_id || '.txt' AS filename, chunk_no,
             substr(text, (chunk_no - 1) * 1500 + 1, 1500) AS chunk_text
      FROM (SELECT *, unnest(range(1, greatest(1, ceil(length(text) / 1500))::BIGINT + 1)) AS chunk_no FROM documents) p) t
    USING (vec_id))"""
add("chunk_documents", None, None,
    on("v_text", retrieval.chunk_documents))


def _embedded(s, d):
    chunks = staging.stage_table(retrieval.chunk_documents(view(s, d, "v_text")), "chunks")
    return retrieval.embed(retrieval.fit_embedding(chunks), chunks)


add("embed_chunks", None, None, lambda s, d: _embedded(s, d).drop("chunk_text"))
add(
    "embedding_check", "doc_id:i n_vectors:i width:i off_length:i",
    "(SELECT doc_id, 1 AS n_vectors, 384 AS width, 0 AS off_length FROM documents WHERE trim(text) <> '') a",
    lambda s, d: _embedded(s, d)
    .withColumn("norm", F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    .groupBy("doc_id")
    .agg(
        F.countDistinct("chunk_no").alias("_chunks"), F.max(F.size("embedding")).alias("width"),
        F.count_if((F.abs(F.col("norm") - 1) > 1e-4) & (F.col("norm") != 0)).alias("off_length"),
        F.count("*").alias("_rows"),
    )
    .withColumn("n_vectors", F.col("_rows") / F.col("_chunks")),
)
add(
    "chunk_cover", "doc_id:i first:i gaps:i short:i",
    # every letter of a text lies in a chunk, in order: checked as counts of what is missing
    "(SELECT doc_id, 1 AS first, 0 AS gaps, 0 AS short FROM documents WHERE trim(text) <> '') a",
    lambda s, d: _chunk_cover(s, d),
)


def _chunk_cover(s, d):
    docs = view(s, d, "v_text")
    letters = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    chunks = retrieval.chunk_documents(docs)
    per_doc = chunks.groupBy("doc_id").agg(
        F.min("chunk_no").alias("first"), (F.max("chunk_no") - F.count("*")).alias("gaps"),
        F.sum(letters("chunk_text")).alias("_in_chunks"),
    )
    whole = docs.select("doc_id", letters("text").alias("_in_text"))
    return per_doc.join(whole, "doc_id").withColumn(
        "short", (F.col("_in_chunks") < F.col("_in_text")).cast("int")
    )


add("nearest_chunks", "question_id:i vec_id:i distance:6 rank:i", f"{_HITS} h", _hits)
def _changed_corpus(s, d):
    """Index the documents, then again with some of them changed, some gone and some new."""
    base = _fresh(s, "index")
    docs = _corpus(s, d).select("source", "text")
    corpus_index.update_index(base, docs.where("source % 100 <> 2"))
    text = F.when(F.col("source") % 100 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    after = docs.where("source % 100 <> 1").withColumn("text", text)
    return corpus_index.update_index(base, after), base


def _index_cover(s, d):
    """Live documents with their segment and whether their chunks hold every letter."""
    _, base = _changed_corpus(s, d)
    letters = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    held = corpus_index.read_index(s, base).groupBy("source").agg(
        F.sum(letters("chunk_text")).alias("_letters"), F.max(F.size("embedding")).alias("width"))
    text = F.when(F.col("source") % 100 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    whole = _corpus(s, d).select("source", letters(text).alias("_whole"))
    live = snapshots.read_snapshot(s, base).join(held, "source").join(whole, "source")
    return live.select(F.col("source").alias("doc_id"), "size", "segment", "width",
                       (F.col("_letters") >= F.col("_whole")).alias("held"))


add(
    "corpus_index_changes", "doc_id:i size:i state",
    """(SELECT doc_id, length(text) + CASE WHEN doc_id % 100 = 0 THEN 5 ELSE 0 END AS size,
        CASE doc_id % 100 WHEN 0 THEN 'changed' WHEN 1 THEN 'gone' WHEN 2 THEN 'added' ELSE 'same' END AS state
        FROM documents) a""",
    lambda s, d: _changed_corpus(s, d)[0].withColumnRenamed("source", "doc_id"),
)
add(
    "corpus_index_cover", "doc_id:i size:i segment:i width:i held",
    """(SELECT doc_id, length(text) + CASE WHEN doc_id % 100 = 0 THEN 5 ELSE 0 END AS size,
        CASE WHEN doc_id % 100 IN (0, 2) THEN 2 ELSE 1 END AS segment, 384 AS width, true AS held
        FROM documents WHERE doc_id % 100 <> 1 AND trim(text) <> '') a""",
    _index_cover,
)
add("nearest_by_cells", "question_id:i vec_id:i distance:6 rank:i", f"{_HITS} h", lambda s, d: _indexed(s, d).hits)
add(
    "nearest_by_cells_work", "question_id:i total:i in_order compared_some compared_few",
    # what is compared in full is a part of what bounds were seen of, and under 30 % of all vectors
    "(SELECT vec_id AS question_id, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS total, "
    "true AS in_order, true AS compared_some, true AS compared_few FROM embeddings WHERE vec_id % 20 = 0) w",
    lambda s, d: _indexed(s, d).work.select(
        "question_id", "total", F.expr("compared <= bounded and bounded <= total").alias("in_order"),
        F.expr("compared >= 4").alias("compared_some"), F.expr("compared < 0.3 * total").alias("compared_few")),
)
add("source_list", "question_id:i rank:i chunk_no:i filename folder content score:6", f"{_SOURCES} s",
    lambda s, d: retrieval.source_list(_hit_texts(s, d)))
_CONTEXT = f"""(SELECT question_id, string_agg('[' || filename || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank, chunk_no)
    AS context FROM {_SOURCES} s GROUP BY question_id)"""
add("pack_context", "question_id:i context", f"{_CONTEXT} c", lambda s, d: retrieval.pack_context(_hit_texts(s, d)))
add(
    "answer_prompts", "question_id:i prompt",
    f"""(SELECT question_id, {' || '.join([
        "'You are a procurement and contracts expert. Use the following context to answer the question. '",
        "'If you cannot answer from the context, say ''I cannot find this information in the knowledge base.'''",
        "chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: What is label ' || question_id",
        "'?' || chr(10) || chr(10) || 'Answer (be concise and cite sources using [filename]):'"])} AS prompt
        FROM {_CONTEXT} c) p""",
    lambda s, d: retrieval.answer_prompts(
        retrieval.pack_context(_hit_texts(s, d)).withColumn(
            "question", F.concat(F.lit("What is label "), F.col("question_id").cast("string"), F.lit("?"))
        )
    ),
)
_PART = "left(substr(text, (part - 1) * 6000 + 1), 6000)"
add(
    "summary_prompts", "doc_id:i part:i n_parts:i prompt",
    f"""(SELECT doc_id, part, n_parts,
        'You are summarizing content for a procurement and contracts dashboard.' || chr(10) || chr(10)
        || 'Text to summarize:' || chr(10) || {_PART} || chr(10) || chr(10) || 'Style: bullet' || chr(10)
        || chr(10) || 'Instructions:' || chr(10) || '- Preserve key numbers, risk indicators, and decisions.' || chr(10)
        || '- For ''bullet'', return 3-7 bullets.' || chr(10) || '- For ''short'', return 2-3 concise sentences.'
        || chr(10) || '- For ''detailed'', return a structured explanation with headings.' || chr(10) || chr(10)
        || 'Summary:' AS prompt FROM (SELECT *, unnest(range(1, n_parts + 1)) AS part FROM (
            SELECT doc_id, text, greatest(1, ceil(length(text) / 6000))::BIGINT AS n_parts FROM v_text) p) q) a""",
    on("v_text", retrieval.summary_prompts),
)
add(
    "summary_prompt_characters", "doc_id:i n_chars:i",
    "(SELECT doc_id, length(text) AS n_chars FROM documents) a",
    on("v_text", lambda df: retrieval.summary_prompts(df).groupBy("doc_id").agg(
        F.sum(F.length("prompt") - len(retrieval.SUMMARY_PROMPT) + len("{text}{style}") - len("bullet")).alias("n_chars"))),
)
add(
    "retrieval_confidence", "question_id:i mean_score:6 confidence",
    f"""(SELECT *, CASE WHEN mean_score > 0.7 THEN 'High' WHEN mean_score > 0.5 THEN 'Medium' ELSE 'Low' END AS confidence
        FROM (SELECT question_id, avg(distance) AS mean_score FROM {_HITS} s GROUP BY question_id) a) b""",
    lambda s, d: retrieval.confidence_band(_indexed(s, d).hits, score="distance"),
)

# ---- vendor approval -------------------------------------------------------------
add_stage("approval", "v_vendors", approval.assess, "o_approval", {
    "scores": "vendor_id final_score:6",
    "status": "vendor_id status confidence:6",
})
add(
    "approval_statistics",
    "total_vendors:i approved_count:i rejected_count:i pending_count:i approval_rate:6 average_score:6 median_score:6 "
    "std_score:6",
    """(SELECT count(*) AS total_vendors, count(*) FILTER (status = 'approved') AS approved_count,
        count(*) FILTER (status = 'rejected') AS rejected_count, count(*) FILTER (status = 'pending') AS pending_count,
        count(*) FILTER (status = 'approved') / count(*) * 100 AS approval_rate, avg(final_score) AS average_score,
        median(final_score) AS median_score, stddev_samp(final_score) AS std_score FROM o_approval) a""",
    on("v_vendors", lambda df: approval.statistics(approval.assess(df))),
)
add(
    "approval_top_vendors", "vendor_id vendor_name final_score:6 status",
    "(SELECT * FROM o_approval ORDER BY final_score DESC NULLS LAST, vendor_id LIMIT 5) a",
    on("v_vendors", lambda df: approval.top_vendors(approval.assess(df))),
)

# ---- documents -------------------------------------------------------------------

def _order_rows(s, d):
    rows = view(s, d, "v_contracts")
    rows = rows.select(
        "contract_id", "vendor_id", F.concat(F.lit("Vendor "), "vendor_id").alias("vendor_name"),
        F.when(F.col("contract_id") % 43 == 0, F.lit(0.0)).otherwise(F.col("contract_value") / 8).alias("amount"),
    )
    return documents.numbered(rows, [F.col("amount"), F.col("contract_id")])


def _all_docs(s, d):
    return documents.validate(documents.both(_order_rows(s, d), AS_OF_DOCUMENTS))


add(
    "purchase_orders",
    "doc_type po_number vendor_id vendor_name amount:4 date:d delivery_date:d payment_terms items requires_approval",
    "o_pos", lambda s, d: documents.purchase_orders(_order_rows(s, d), AS_OF_DOCUMENTS),
)
add(
    "contract_documents",
    "doc_type contract_number vendor_id vendor_name contract_value:4 start_date:d end_date:d payment_clause "
    "penalty_clause termination_clause warranty_clause liability_clause gcc_compliant scc_included approval_level",
    "o_conts", lambda s, d: documents.contracts(_order_rows(s, d), AS_OF_DOCUMENTS),
)
_NUMBERED = "doc_type number vendor_id vendor_name value:4"
_numbered = lambda df: df.withColumns(
    {"number": F.coalesce("po_number", "contract_number"), "value": F.coalesce("amount", "contract_value")}
)
add("both_documents", _NUMBERED, "o_docs",
    lambda s, d: _numbered(documents.both(_order_rows(s, d), AS_OF_DOCUMENTS)))
add("document_validation", f"{_NUMBERED} is_valid validation_errors:l", "o_docs", lambda s, d: _numbered(_all_docs(s, d)))
add(
    "document_statistics", "total_value:2 average_value:2 max_value:2 min_value:2 high_value_count:i",
    """(SELECT sum(value) AS total_value, avg(value) AS average_value, max(value) AS max_value, min(value) AS min_value,
        count(*) FILTER (value > 5000000) AS high_value_count FROM o_docs) a""",
    lambda s, d: documents.statistics(_all_docs(s, d)),
)
add(
    "document_batch_result", "total_documents:i valid_documents:i invalid_documents:i",
    """(SELECT count(*) AS total_documents, count(*) FILTER (is_valid) AS valid_documents,
        count(*) FILTER (NOT is_valid) AS invalid_documents FROM o_docs) a""",
    lambda s, d: documents.batch_result(_all_docs(s, d)),
)

# ---- bids ------------------------------------------------------------------------
_by_rfq = lambda df: rfq.analyze(df, ["rfq_id"])
_STATS = "mean:4 median:6 std:4 min:4 max:4 q1:6 q3:6 iqr:6 lower_bound:6 upper_bound:6"
_FENCED = "(SELECT * EXCLUDE (std), std_pop AS std, q1 - 1.5e0 * iqr AS lower_bound, q3 + 1.5e0 * iqr AS upper_bound FROM {}) a"
add("rfq_price_statistics", f"rfq_id:i {_STATS}", _FENCED.format("o_price_summary_by_rfq"),
    on("v_bids", lambda df: rfq.price_statistics(df, ["rfq_id"])))
add("rfq_price_statistics_overall", _STATS, _FENCED.format("o_price_summary"), on("v_bids", rfq.price_statistics))
add_stage("rfq", "v_bids", _by_rfq, "o_rfq", {
    "price_flags": f"{_BID} price_deviation_pct:6 price_too_high price_too_low is_outlier z_score:6 extreme_outlier",
    "delivery_flags": f"{_BID} delivery_deviation_pct:6 delivery_anomaly",
    "spec_mismatch": f"{_BID} quantity_mismatch spec_mismatch",
    "anomalies": f"{_BID} has_anomaly anomaly_count:i",
    "severity": f"{_BID} severity requires_review reject_bid",
})
add("rfq_overall_severity", f"{_BID} z_score:6 anomaly_count:i severity", "o_rfq_all", on("v_bids", rfq.analyze))
_RESULT = "total_bids:i anomalies_detected:i high_severity:i medium_severity:i low_severity:i"
_RESULT_SQL = """(SELECT {} count(*) AS total_bids, count(*) FILTER (has_anomaly) AS anomalies_detected,
    count(*) FILTER (severity = 'high') AS high_severity, count(*) FILTER (severity = 'medium') AS medium_severity,
    count(*) FILTER (severity = 'low') AS low_severity FROM o_rfq {}) a"""
add("rfq_bid_set_result", f"rfq_id:i {_RESULT}", _RESULT_SQL.format("rfq_id,", "GROUP BY rfq_id"),
    on("v_bids", lambda df: rfq.bid_set_result(_by_rfq(df), ["rfq_id"])))
add("rfq_result", _RESULT, _RESULT_SQL.format("", ""), on("v_bids", lambda df: rfq.bid_set_result(_by_rfq(df))))
add(
    "rfq_recommendations", REC,
    "(" + recommendation("o_rfq", [
        {"type": "reject", "when": "severity = 'high'", "message": "'🚨 REJECT ' || n || ' bids with HIGH severity anomalies'"},
        {"type": "review", "when": "severity = 'medium'",
         "message": "'⚠️  REVIEW ' || n || ' bids with MEDIUM severity - seek clarification'"},
        {"type": "investigate", "when": "price_too_low",
         "message": "'🔍 INVESTIGATE ' || n || ' bids with suspiciously low prices'"},
        {"type": "approve", "when": "NOT has_anomaly", "message": "'✅ ' || n || ' clean bids ready for evaluation'"},
    ]) + ") a",
    on("v_bids", lambda df: recommend.recommend(_by_rfq(df), rfq.RULES)),
)
add(
    "rfq_recommendation_members", "type id",
    """(SELECT 'reject' AS type, vendor_id AS id FROM o_rfq WHERE severity = 'high'
        UNION ALL SELECT 'review', vendor_id FROM o_rfq WHERE severity = 'medium'
        UNION ALL SELECT 'investigate', vendor_id FROM o_rfq WHERE price_too_low
        UNION ALL SELECT 'approve', vendor_id FROM o_rfq WHERE NOT has_anomaly) a""",
    on("v_bids", lambda df: recommend.members(_by_rfq(df), rfq.RULES)),
)

# ---- shortlist -------------------------------------------------------------------
_checked = lambda df: shortlist.eligibility(shortlist.score(df))
add_stage("shortlist", "v_vendors", _checked, "o_scored", {
    "scores": "vendor_id dispute_history:2 final_score:2",
    "eligibility": "vendor_id eligible rejection_reasons",
})
add("shortlist_ranking", "rank:i vendor_id vendor_name final_score:2 category", "o_ranked",
    on("v_vendors", lambda df: shortlist.rank(_checked(df))))
_SHORT = "rank:i vendor_id vendor_name final_score:2 category delivery_score:4 quality_score:4 dispute_count:i"
add("shortlist_top", _SHORT, "o_shortlist", on("v_vendors", lambda df: shortlist.shortlist(_checked(df))))
add("shortlist_risk_flags", "vendor_id risk_flags risk_count:i risk_level", "o_shortlist",
    on("v_vendors", lambda df: shortlist.shortlist(_checked(df))))
add(
    "shortlist_result", "total_vendors:i eligible_vendors:i shortlisted_count:i rejected_count:i average_score:6",
    """(SELECT count(*) AS total_vendors, count(*) FILTER (eligible) AS eligible_vendors,
        least(10, count(*) FILTER (eligible)) AS shortlisted_count, count(*) FILTER (NOT eligible) AS rejected_count,
        avg(final_score) FILTER (eligible) AS average_score FROM o_scored) a""",
    on("v_vendors", lambda df: shortlist.result(_checked(df))),
)
add(
    "shortlist_recommendations", REC,
    "(" + recommendation("o_shortlist", [
        {"type": "top_vendors", "when": "rank <= 3", "always": True, "ids": "list(vendor_id ORDER BY rank)",
         "message": "'✅ TOP 3 VENDORS: ' || (SELECT string_agg(vendor_name, ', ' ORDER BY rank) FROM o_shortlist "
                    "WHERE rank <= 3) || ' - Recommend for immediate invitation'"},
        {"type": "excellent", "when": "category = 'Excellent'",
         "message": "'⭐ ' || n || ' EXCELLENT vendors in shortlist - Priority consideration'"},
        {"type": "risk_warning", "when": "risk_level = 'High'",
         "message": "'⚠️  ' || n || ' vendors have HIGH risk flags - Require additional due diligence'"},
        {"type": "statistics", "when": "true", "always": True, "mean": "final_score",
         "message": "'📊 Shortlist average score: ' || printf('%.2f', mean) || ' - Quality threshold maintained'"},
    ]) + ") a",
    on("v_vendors", lambda df: recommend.recommend(shortlist.shortlist(_checked(df)), shortlist.RULES)),
)

# ---- negotiation -----------------------------------------------------------------
_OFFER = "vendor_id l_orderkey:i l_linenumber:i current_price:2"
add_stage("negotiation", "v_offers", negotiation.analyze, "o_nego", {
    "price_position": f"{_OFFER} price_vs_market_pct:6 price_trend_pct:6 above_market",
    "counter_offers": f"{_OFFER} target_price:4 recommended_discount_pct:6 potential_savings:4 conservative_offer:4 "
                      "aggressive_offer:4",
    "success_odds": f"{_OFFER} success_probability:6",
    "risk": f"{_OFFER} risk_score:i risk_level risk_flags",
    "strategy": f"{_OFFER} is_negotiable recommended_approach strategy",
})
add(
    "negotiation_market_benchmark",
    "market_average:4 market_median:6 market_std:4 lowest_price:4 highest_price:4 price_range_pct:4",
    """(SELECT avg(current_price) AS market_average, median(current_price) AS market_median,
        stddev_pop(current_price) AS market_std, min(current_price) AS lowest_price, max(current_price) AS highest_price,
        (max(current_price) - min(current_price)) / avg(current_price) * 100 AS price_range_pct FROM v_offers) a""",
    on("v_offers", negotiation.market_benchmark),
)
add(
    "negotiation_result",
    "total_vendors:i negotiable_vendors:i total_potential_savings:2 average_discount_achievable:6 high_success_probability:i",
    """(SELECT count(*) AS total_vendors, count(*) FILTER (is_negotiable) AS negotiable_vendors,
        sum(potential_savings) AS total_potential_savings, avg(recommended_discount_pct) AS average_discount_achievable,
        count(*) FILTER (success_probability >= 0.7e0) AS high_success_probability FROM o_nego) a""",
    on("v_offers", lambda df: negotiation.result(negotiation.analyze(df))),
)
_BEST = ("is_negotiable AND potential_savings > (SELECT quantile_cont(potential_savings, 0.75) FROM o_nego)",
         "ORDER BY potential_savings DESC, vendor_id LIMIT 3")
add(
    "negotiation_recommendations", REC,
    "(" + recommendation("o_nego", [
        {"type": "high_value", "priority": "High", "when": _BEST[0], "limit": _BEST[1], "amount": "potential_savings",
         "ids": "list(vendor_id ORDER BY potential_savings DESC, vendor_id)",
         "message": "'💰 TOP PRIORITY: Negotiate with ' || n || ' vendors for potential savings of ' || " + inr("amount")},
        {"type": "quick_wins", "priority": "Medium", "when": "success_probability >= 0.7e0 AND is_negotiable",
         "message": "'✅ QUICK WINS: ' || n || ' vendors with high success probability (≥70%)'"},
        {"type": "risk_warning", "priority": "Warning", "when": "risk_level = 'High'",
         "message": "'⚠️  CAUTION: ' || n || ' vendors flagged as HIGH RISK - Consider alternative strategies'"},
        {"type": "market_insight", "priority": "Info", "when": "above_market", "mean": "price_vs_market_pct",
         "message": "'📊 MARKET INSIGHT: ' || n || ' vendors priced ' || printf('%.1f', mean) || "
                    "'% above market - Strong negotiation leverage'"},
    ]) + ") a",
    on("v_offers", lambda df: negotiation.recommendations(negotiation.analyze(df))),
)

# ---- contract review -------------------------------------------------------------
add_stage("contract", "v_contracts", contract_review.analyze, "o_review", {
    "missing_clauses": "contract_id:i missing_clauses:i missing_clause_names:l",
    "compliance": "contract_id:i is_compliant",
    "risk_flags": "contract_id:i is_high_value risk_flags",
    "review_score": "contract_id:i risk_score:i",
    "grade": "contract_id:i rag_status approval_recommendation requires_legal_review",
})
add(
    "contract_compliance_summary",
    "total_contracts:i compliant_pct:6 gcc_compliance_pct:6 scc_inclusion_pct:6 avg_missing_clauses:6 most_common_missing",
    """(SELECT count(*) AS total_contracts, count(*) FILTER (is_compliant) / count(*) * 100 AS compliant_pct,
        count(*) FILTER (gcc_compliant) / count(*) * 100 AS gcc_compliance_pct,
        count(*) FILTER (scc_included) / count(*) * 100 AS scc_inclusion_pct, avg(missing_clauses) AS avg_missing_clauses,
        (SELECT c FROM (SELECT unnest(missing_clause_names) AS c FROM o_review) u GROUP BY c ORDER BY count(*) DESC, c
         LIMIT 1) AS most_common_missing FROM o_review) a""",
    on("v_contracts", lambda df: contract_review.compliance_summary(contract_review.analyze(df))),
)
add(
    "contract_review_result",
    "total_contracts:i compliant_contracts:i amber_contracts:i red_contracts:i average_risk_score:6 high_value_contracts:i",
    """(SELECT count(*) AS total_contracts, count(*) FILTER (rag_status = 'Green') AS compliant_contracts,
        count(*) FILTER (rag_status = 'Amber') AS amber_contracts, count(*) FILTER (rag_status = 'Red') AS red_contracts,
        avg(risk_score) AS average_risk_score, count(*) FILTER (is_high_value) AS high_value_contracts FROM o_review) a""",
    on("v_contracts", lambda df: contract_review.result(contract_review.analyze(df))),
)
add(
    "contract_recommendations", REC,
    "(" + recommendation("o_review", [
        {"type": "critical", "priority": "High", "when": "rag_status = 'Red'",
         "message": "'🔴 CRITICAL: ' || n || ' contracts flagged RED - Do NOT approve without legal review'"},
        {"type": "warning", "priority": "Medium", "when": "rag_status = 'Amber'",
         "message": "'⚠️  CAUTION: ' || n || ' contracts flagged AMBER - Requires review before approval'"},
        {"type": "approved", "priority": "Info", "when": "rag_status = 'Green'",
         "message": "'✅ APPROVED: ' || n || ' contracts passed all compliance checks'"},
        {"type": "high_value", "priority": "High", "when": "requires_legal_review AND is_high_value",
         "amount": "contract_value",
         "message": "'💰 HIGH VALUE: ' || n || ' contracts worth ' || " + inr("amount") + " || ' require legal review'"},
    ]) + ") a",
    on("v_contracts", lambda df: recommend.recommend(contract_review.analyze(df), contract_review.RULES)),
)

# ---- change orders ---------------------------------------------------------------
add_stage("change", "v_change_orders", change_orders.analyze, "o_changes", {
    "validation": "change_order_id:i is_valid validation_errors",
    "cost_impact": "change_order_id:i cost_variance_pct:6 new_contract_value:2 cumulative_variance_pct:6 "
                   "significant_cost_impact",
    "timeline_impact": "change_order_id:i timeline_variance_pct:6 new_timeline_days:i significant_timeline_impact",
    "budget_impact": "change_order_id:i budget_utilization_pct:6 budget_overrun remaining_budget:2",
    "routing": "change_order_id:i impact_level approval_status approval_level",
})
add(
    "change_summary",
    "total_cost_impact:0 average_cost_variance:6 average_timeline_extension:6 budget_overrun_count:i auto_approval_rate:6 "
    "most_common_reason",
    """(SELECT sum(change_cost) AS total_cost_impact, avg(cost_variance_pct) AS average_cost_variance,
        avg(timeline_extension_days) AS average_timeline_extension, count(*) FILTER (budget_overrun) AS budget_overrun_count,
        count(*) FILTER (approval_status = 'Auto-Approved') / count(*) * 100 AS auto_approval_rate,
        (SELECT change_reason FROM o_changes GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_reason
        FROM o_changes) a""",
    on("v_change_orders", lambda df: change_orders.summary(change_orders.analyze(df))),
)
add(
    "change_result",
    "total_change_orders:i approved_count:i review_required:i rejected_count:i total_cost_impact:0 "
    "average_cost_variance:6 high_impact_changes:i",
    """(SELECT count(*) AS total_change_orders, count(*) FILTER (approval_status = 'Auto-Approved') AS approved_count,
        count(*) FILTER (approval_status = 'Review Required') AS review_required,
        count(*) FILTER (approval_status = 'Rejected') AS rejected_count, sum(change_cost) AS total_cost_impact,
        avg(cost_variance_pct) AS average_cost_variance, count(*) FILTER (impact_level = 'High') AS high_impact_changes
        FROM o_changes) a""",
    on("v_change_orders", lambda df: change_orders.result(change_orders.analyze(df))),
)
add(
    "change_recommendations", REC.replace("amount:2", "amount:0").replace(" message", ""),
    "(" + recommendation("o_changes", [
        {"type": "high_impact", "priority": "Critical", "when": "impact_level = 'High'", "amount": "change_cost"},
        {"type": "budget_overrun", "priority": "High", "when": "budget_overrun"},
        {"type": "auto_approved", "priority": "Info", "when": "approval_status = 'Auto-Approved'", "amount": "change_cost"},
        {"type": "timeline_impact", "priority": "Medium", "when": "significant_timeline_impact",
         "mean": "timeline_extension_days"},
    ]) + ") a",
    on("v_change_orders", lambda df: recommend.recommend(change_orders.analyze(df), change_orders.RULES)),
)

# ---- entity risk -----------------------------------------------------------------
add_stage("risk", "v_entities", risk.analyze, "o_risk", {
    "financial": "entity_id financial_risk_score:6",
    "delivery": "entity_id delivery_risk_score:6",
    "compliance": "entity_id compliance_risk_score:6",
    "performance": "entity_id performance_risk_score:6",
    "overall": "entity_id overall_risk_score:2",
    "levels": "entity_id risk_level requires_immediate_action primary_risk_area",
})
add(
    "risk_distribution",
    "level_high:i level_medium:i level_low:i area_financial:i area_delivery:i area_compliance:i area_performance:i "
    "mean_financial:6 mean_delivery:6 mean_compliance:6 mean_performance:6",
    "(SELECT " + ", ".join(
        [f"count(*) FILTER (risk_level = '{v}') AS level_{v.lower()}" for v in ("High", "Medium", "Low")]
        + [f"count(*) FILTER (primary_risk_area = '{v}') AS area_{v.lower()}, avg({v.lower()}_risk_score) AS mean_{v.lower()}"
           for v in ("Financial", "Delivery", "Compliance", "Performance")]
    ) + " FROM o_risk) a",
    on("v_entities", lambda df: risk.distribution(risk.analyze(df))),
)
add(
    "risk_result",
    "total_entities:i high_risk_count:i medium_risk_count:i low_risk_count:i average_risk_score:6 critical_risks:i",
    """(SELECT count(*) AS total_entities, count(*) FILTER (risk_level = 'High') AS high_risk_count,
        count(*) FILTER (risk_level = 'Medium') AS medium_risk_count, count(*) FILTER (risk_level = 'Low') AS low_risk_count,
        avg(overall_risk_score) AS average_risk_score, count(*) FILTER (requires_immediate_action) AS critical_risks
        FROM o_risk) a""",
    on("v_entities", lambda df: risk.result(risk.analyze(df))),
)
add(
    "risk_recommendations", REC,
    "(" + recommendation("o_risk", [
        {"type": name, "priority": priority, "when": when, "action": "; ".join(risk.ACTIONS[name])}
        for name, priority, when in [
            ("High", "Critical", "risk_level = 'High'"), ("Financial", "High", "primary_risk_area = 'Financial'"),
            ("Compliance", "High", "primary_risk_area = 'Compliance'"),
            ("Delivery", "Medium", "primary_risk_area = 'Delivery'"),
        ]
    ]) + ") a",
    on("v_entities", lambda df: recommend.recommend(risk.analyze(df), risk.RULES)),
)

# ---- outlook ---------------------------------------------------------------------
add_stage("outlook", "v_items", predictive.analyze, "o_outlook", {
    "price": "item_id:i price_change_3m_pct:6 price_change_6m_pct:6 predicted_price_change_pct:6 predicted_price:4 "
             "price_trend price_volatility:6 high_volatility",
    "delay": "item_id:i delay_probability:6 expected_delay_days:i delay_risk",
    "demand": "item_id:i demand_growth_rate:6 forecasted_demand:i demand_trend",
    "budget": "item_id:i predicted_spend:2 budget_variance:2 budget_variance_pct:6 budget_overrun_probability:6 budget_risk",
})
add(
    "outlook_summary",
    "forecast_horizon_days:i total_items_analyzed:i average_price_change:6 average_delay_probability:6 "
    "total_predicted_spend:0 total_budget_allocated:0 overall_budget_variance:0 at_risk_price_increase:i "
    "at_risk_high_delay:i at_risk_budget_overrun:i",
    """(SELECT 90 AS forecast_horizon_days, count(*) AS total_items_analyzed,
        avg(predicted_price_change_pct) AS average_price_change, avg(delay_probability) AS average_delay_probability,
        sum(predicted_spend) AS total_predicted_spend, sum(allocated_budget) AS total_budget_allocated,
        sum(budget_variance) AS overall_budget_variance,
        count(*) FILTER (price_trend = 'Increasing') AS at_risk_price_increase,
        count(*) FILTER (delay_risk = 'High') AS at_risk_high_delay,
        count(*) FILTER (budget_risk = 'High') AS at_risk_budget_overrun FROM o_outlook) a""",
    on("v_items", lambda df: predictive.summary(predictive.analyze(df))),
)
add(
    "outlook_result",
    "total_items:i items_with_price_increase:i high_delay_risk_items:i budget_overrun_risk:i average_price_change_pct:6",
    """(SELECT count(*) AS total_items, count(*) FILTER (price_trend = 'Increasing') AS items_with_price_increase,
        count(*) FILTER (delay_risk = 'High') AS high_delay_risk_items,
        count(*) FILTER (budget_overrun_probability > 0.7e0) AS budget_overrun_risk,
        avg(predicted_price_change_pct) AS average_price_change_pct FROM o_outlook) a""",
    on("v_items", lambda df: predictive.result(predictive.analyze(df))),
)
add(
    "outlook_recommendations", REC.replace("amount:2", "amount:0").replace(" message", ""),
    "(" + recommendation("o_outlook", [
        {"type": "price_increase", "priority": "High", "when": "price_trend = 'Increasing'",
         "ids": "list(CAST(item_id AS VARCHAR) ORDER BY predicted_price_change_pct DESC, item_id)[1:3]",
         "action": "Accelerate procurement for high-increase items"},
        {"type": "delay_risk", "priority": "High", "when": "delay_risk = 'High'",
         "action": "Identify alternative suppliers or increase safety stock"},
        {"type": "budget_overrun", "priority": "Critical", "when": "budget_risk = 'High'", "amount": "budget_variance",
         "action": "Review and increase budget allocation or reduce demand"},
        {"type": "opportunity", "priority": "Info", "when": "price_trend = 'Decreasing'",
         "action": "Wait for price decrease or negotiate better rates"},
    ]) + ") a",
    on("v_items", lambda df: recommend.recommend(predictive.analyze(df), predictive.RULES)),
)

# ---- records ---------------------------------------------------------------------
_records = lambda df: records.analyze(df, AS_OF_RECORDS)
add_stage("records", "v_records", _records, "o_records", {
    "index": "record_id:i age_days:i age_years:1 search_tags",
    "retention": "record_id:i retention_period_years:i within_retention retention_expired days_until_expiry:i",
    "archival": "record_id:i archival_candidate archival_priority deletion_candidate",
    "audit": "record_id:i days_since_access:i high_importance",
    "versions": "record_id:i is_compliant compliance_issues",
})
add(
    "records_summary",
    "total_records:i status_active:i status_archived:i status_pending:i compliance_rate:6 average_age_years:6 "
    "archival_candidates:i deletion_candidates:i storage_optimization_potential",
    """(SELECT count(*) AS total_records, count(*) FILTER (document_status = 'Active') AS status_active,
        count(*) FILTER (document_status = 'Archived') AS status_archived,
        count(*) FILTER (document_status = 'Pending') AS status_pending,
        count(*) FILTER (is_compliant) / count(*) * 100 AS compliance_rate, avg(age_years) AS average_age_years,
        count(*) FILTER (archival_candidate) AS archival_candidates,
        count(*) FILTER (deletion_candidate) AS deletion_candidates,
        CAST(trunc(count(*) FILTER (archival_candidate) / count(*) * 100) AS BIGINT) || '%' AS storage_optimization_potential
        FROM o_records) a""",
    on("v_records", lambda df: records.summary(_records(df))),
)
add("records_by_type", "document_type n_records:i",
    "(SELECT document_type, count(*) AS n_records FROM o_records GROUP BY 1) a",
    on("v_records", lambda df: records.by_type(_records(df))))
add(
    "records_result",
    "total_records:i compliant_records:i non_compliant:i archival_candidates:i records_to_delete:i compliance_rate:6",
    """(SELECT count(*) AS total_records, count(*) FILTER (is_compliant) AS compliant_records,
        count(*) FILTER (NOT is_compliant) AS non_compliant, count(*) FILTER (archival_candidate) AS archival_candidates,
        count(*) FILTER (deletion_candidate) AS records_to_delete,
        count(*) FILTER (is_compliant) / count(*) * 100 AS compliance_rate FROM o_records) a""",
    on("v_records", lambda df: records.result(_records(df))),
)
_TEN = "list(CAST(record_id AS VARCHAR) ORDER BY record_id)[1:10]"
add(
    "records_recommendations", REC,
    "(" + recommendation("o_records", [
        {"type": "archival", "priority": "Medium", "when": "archival_candidate", "ids": _TEN,
         "message": "'📦 ARCHIVAL: ' || n || ' records ready for archival - Free up active storage'",
         "action": "Move to archival storage system"},
        {"type": "deletion", "priority": "High", "when": "deletion_candidate", "ids": _TEN,
         "message": "'🗑️  DELETION: ' || n || ' records past retention period - Delete per policy'",
         "action": "Schedule for secure deletion after legal review"},
        {"type": "compliance", "priority": "High", "when": "NOT is_compliant", "ids": _TEN,
         "message": "'⚠️  COMPLIANCE: ' || n || ' records have compliance issues - Immediate action required'",
         "action": "Review and update to latest version or proper status"},
        {"type": "version_update", "priority": "Medium", "when": "NOT is_latest_version", "ids": _TEN,
         "message": "'🔄 VERSION: ' || n || ' records need version update'",
         "action": "Update to latest version and archive old versions"},
    ]) + ") a",
    on("v_records", lambda df: recommend.recommend(_records(df), records.RULES)),
)

# ---- fraud -----------------------------------------------------------------------
_T = "transaction_id:i"
for _name, _step, _layout in [
    ("exact_duplicates", fraud.duplicates, f"{_T} is_duplicate"),
    ("near_duplicates", fraud.duplicates, f"{_T} amount_rounded:2 is_near_duplicate duplicate_score:i"),
    ("price_baseline", fraud.price_manipulation,
     f"{_T} category_avg_price:4 category_std_price:4 price_deviation_pct:6 price_manipulation_detected"),
    ("below_threshold", fraud.price_manipulation, f"{_T} just_below_threshold"),
    ("split_invoices", fraud.price_manipulation, f"{_T} same_day_same_vendor:i split_invoice_suspected"),
    ("price_score", fraud.price_manipulation, f"{_T} price_manipulation_score:i"),
    ("vendor_frequency", fraud.vendor_frequency,
     f"{_T} vendor_frequency:i expected_frequency:6 frequency_variance:6"),
    ("similar_vendors", fraud.collusion, f"{_T} similar_vendor_exists"),
    ("similar_pricing", fraud.collusion, f"{_T} same_price_count:i collusion_risk"),
    ("sequential_invoices", fraud.sequential_invoices, f"{_T} sequential_invoices"),
    ("collusion_score", fraud.collusion, f"{_T} collusion_score:i"),
    ("payment_patterns", fraud.payment_patterns,
     f"{_T} payment_delay_days:i unusually_fast_payment cash_payment_high_value after_hours_payment "
     "repeated_amount_count:i repeated_payment_pattern payment_pattern_score:i"),
    ("scores", fraud.analyze, f"{_T} fraud_score:2 fraud_indicators:l indicator_count:i"),
    ("levels", fraud.analyze, f"{_T} fraud_risk requires_investigation immediate_action"),
]:
    add(f"fraud_{_name}", _layout, "o_fraud", on("v_transactions", _step))
add(
    "fraud_sequential_by_vendor", f"{_T} sequential_invoices",
    """(SELECT transaction_id, coalesce(abs(number - lag(number) OVER (PARTITION BY vendor_id ORDER BY transaction_id)) = 1,
        false) AS sequential_invoices
        FROM (SELECT *, CAST(regexp_extract(invoice_number, '([0-9]+)', 1) AS BIGINT) AS number FROM v_transactions) t) a""",
    on("v_transactions", lambda df: fraud.sequential_invoices(df, within=["vendor_id"])),
)
add(
    "fraud_summary",
    "total_transactions:i fraud_detection_rate:6 level_high:i level_medium:i level_low:i type_duplicate_invoices:i "
    "type_price_manipulation:i type_vendor_collusion:i type_payment_anomalies:i total_fraud_exposure:2 "
    "average_fraud_score:6 transactions_requiring_investigation:i most_common_indicator",
    """(SELECT count(*) AS total_transactions, count(*) FILTER (fraud_score > 0) / count(*) * 100 AS fraud_detection_rate,
        count(*) FILTER (fraud_risk = 'High') AS level_high, count(*) FILTER (fraud_risk = 'Medium') AS level_medium,
        count(*) FILTER (fraud_risk = 'Low') AS level_low, count(*) FILTER (is_duplicate) AS type_duplicate_invoices,
        count(*) FILTER (price_manipulation_detected) AS type_price_manipulation,
        count(*) FILTER (collusion_risk) AS type_vendor_collusion,
        count(*) FILTER (payment_pattern_score > 50) AS type_payment_anomalies,
        coalesce(sum(amount) FILTER (fraud_risk = 'High'), 0) AS total_fraud_exposure,
        avg(fraud_score) AS average_fraud_score,
        count(*) FILTER (requires_investigation) AS transactions_requiring_investigation,
        (SELECT i FROM (SELECT unnest(fraud_indicators) AS i FROM o_fraud) u GROUP BY i ORDER BY count(*) DESC LIMIT 1)
          AS most_common_indicator FROM o_fraud) a""",
    on("v_transactions", lambda df: fraud.summary(fraud.analyze(df))),
)
add(
    "fraud_result",
    "total_transactions:i high_risk_fraud:i medium_risk_fraud:i suspicious_transactions:i duplicate_invoices:i "
    "price_manipulations:i potential_collusion:i total_fraud_exposure:2",
    """(SELECT count(*) AS total_transactions, count(*) FILTER (fraud_risk = 'High') AS high_risk_fraud,
        count(*) FILTER (fraud_risk = 'Medium') AS medium_risk_fraud,
        count(*) FILTER (fraud_score > 50) AS suspicious_transactions,
        count(*) FILTER (is_duplicate) AS duplicate_invoices,
        count(*) FILTER (price_manipulation_detected) AS price_manipulations,
        count(*) FILTER (collusion_risk) AS potential_collusion,
        coalesce(sum(amount) FILTER (fraud_risk = 'High'), 0) AS total_fraud_exposure FROM o_fraud) a""",
    on("v_transactions", lambda df: fraud.result(fraud.analyze(df))),
)
add(
    "fraud_recommendations", REC,
    "(" + recommendation("o_fraud", [
        {"type": "immediate_action", "priority": "Critical", "when": "immediate_action", "amount": "amount",
         "message": "'🚨 CRITICAL: ' || n || ' transactions require IMMEDIATE investigation - Exposure: ' || " + inr("amount")},
        {"type": "duplicate_invoice", "priority": "High", "when": "is_duplicate", "amount": "amount",
         "message": "'⚠️  DUPLICATE: ' || n || ' duplicate invoices detected - Potential double payment'"},
        {"type": "price_manipulation", "priority": "High", "when": "price_manipulation_detected",
         "message": "'💰 PRICE FRAUD: ' || n || ' transactions with abnormal pricing detected'"},
        {"type": "vendor_collusion", "priority": "High", "when": "collusion_risk",
         "message": "'🤝 COLLUSION: ' || n || ' transactions show vendor collusion patterns'"},
        {"type": "high_risk", "priority": "High", "when": "fraud_risk = 'High'", "amount": "amount",
         "message": "'🔴 HIGH RISK: ' || n || ' transactions flagged - Total exposure: ' || " + inr("amount")},
    ]) + ") a",
    on("v_transactions", lambda df: recommend.recommend(fraud.analyze(df), fraud.RULES)),
)


def add_members(name: str, view_name: str, analyze, stage_rules, parts: list[tuple[str, str, str]], source: str) -> None:
    """Full membership of a stage's recommendations: (type, id) rows."""
    sql = " UNION ALL ".join(
        f"SELECT '{kind}' AS type, CAST({key} AS VARCHAR) AS id FROM {source} WHERE {when}" for kind, key, when in parts
    )
    add(f"{name}_recommendation_members", "type id", f"({sql}) a",
        on(view_name, lambda df: recommend.members(analyze(df), stage_rules)))


add_members("fraud", "v_transactions", fraud.analyze, fraud.RULES, [
    ("immediate_action", "transaction_id", "immediate_action"), ("duplicate_invoice", "transaction_id", "is_duplicate"),
    ("price_manipulation", "transaction_id", "price_manipulation_detected"),
    ("vendor_collusion", "vendor_id", "collusion_risk"), ("high_risk", "transaction_id", "fraud_risk = 'High'"),
], "o_fraud")
add_members("records", "v_records", _records, records.RULES, [
    ("archival", "record_id", "archival_candidate"), ("deletion", "record_id", "deletion_candidate"),
    ("compliance", "record_id", "NOT is_compliant"), ("version_update", "record_id", "NOT is_latest_version"),
], "o_records")
add_members("outlook", "v_items", predictive.analyze, predictive.RULES, [
    ("price_increase", "item_id", "price_trend = 'Increasing'"), ("delay_risk", "item_id", "delay_risk = 'High'"),
    ("budget_overrun", "item_id", "budget_risk = 'High'"), ("opportunity", "item_id", "price_trend = 'Decreasing'"),
], "o_outlook")
add_members("risk", "v_entities", risk.analyze, risk.RULES, [
    ("High", "entity_id", "risk_level = 'High'"),
    *[(a, "entity_id", f"primary_risk_area = '{a}'") for a in ("Financial", "Compliance", "Delivery")],
], "o_risk")
add_members("change", "v_change_orders", change_orders.analyze, change_orders.RULES, [
    ("high_impact", "change_order_id", "impact_level = 'High'"), ("budget_overrun", "change_order_id", "budget_overrun"),
    ("auto_approved", "change_order_id", "approval_status = 'Auto-Approved'"),
    ("timeline_impact", "change_order_id", "significant_timeline_impact"),
], "o_changes")
add_members("contract", "v_contracts", contract_review.analyze, contract_review.RULES, [
    ("critical", "contract_id", "rag_status = 'Red'"), ("warning", "contract_id", "rag_status = 'Amber'"),
    ("approved", "contract_id", "rag_status = 'Green'"),
], "o_review")
add_members("negotiation", "v_offers", negotiation.analyze, negotiation.RULES, [
    ("quick_wins", "vendor_id", "success_probability >= 0.7e0 AND is_negotiable"),
    ("risk_warning", "vendor_id", "risk_level = 'High'"),
], "o_nego")
add("fraud_collusion_vendors", "vendor_id", "(SELECT DISTINCT vendor_id FROM o_fraud WHERE collusion_risk) a",
    on("v_transactions", lambda df: fraud.collusion_vendors(fraud.analyze(df))))

# ---- profiles --------------------------------------------------------------------
add(
    "vendor_profile",
    "vendor_id n_contracts:i contract_total:2 last_contract_end:d n_projects:i project_total:2 mean_rating:6 risk_score:2 "
    "predicted_performance:2",
    """(SELECT v.vendor_id, coalesce(c.n, 0) AS n_contracts, c.t AS contract_total, c.e AS last_contract_end,
        coalesce(p.n, 0) AS n_projects, p.t AS project_total, p.r AS mean_rating, s.risk_score, s.predicted_performance
        FROM v_vendors v
        LEFT JOIN (SELECT vendor_id, count(*) AS n, sum(contract_value) AS t, max(end_date) AS e FROM v_contracts
                   GROUP BY 1) c ON c.vendor_id = v.vendor_id
        LEFT JOIN (SELECT vendor_id, count(*) AS n, sum(project_value) AS t, avg(performance_rating) AS r FROM v_projects
                   GROUP BY 1) p ON p.vendor_id = v.vendor_id
        LEFT JOIN v_scores s ON s.vendor_id = v.vendor_id) a""",
    lambda s, d: profiles.vendor_profile(*[view(s, d, v) for v in ("v_vendors", "v_contracts", "v_projects", "v_scores")]),
)
add(
    "awarded_bids",
    f"{_BID} vendor_name empanelment_tier n_negotiations:i negotiation_id:i negotiated_price:4 savings_percentage:2",
    """(SELECT b.*, v.vendor_name, v.empanelment_tier, n.n AS n_negotiations, n.negotiation_id, n.negotiated_price,
        n.savings_percentage FROM v_bids b JOIN v_vendors v ON v.vendor_id = b.vendor_id
        LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY vendor_id) AS n,
                     row_number() OVER (PARTITION BY vendor_id ORDER BY negotiation_date DESC, negotiation_id DESC) AS rn
                   FROM v_negotiations) n ON n.vendor_id = b.vendor_id AND n.rn = 1
        WHERE b.status = 'AWARDED') a""",
    lambda s, d: profiles.awarded_bids(
        view(s, d, "v_bids"), view(s, d, "v_vendors").select("vendor_id", "vendor_name", "empanelment_tier"),
        view(s, d, "v_negotiations"),
    ),
)
add(
    "change_with_contract", "change_order_id:i contract_id:i change_cost:2 contract_value:2 vendor_id contract_type",
    "(SELECT o.change_order_id, o.change_cost, c.* FROM v_change_orders o JOIN v_contracts c USING (contract_id)) a",
    lambda s, d: profiles.change_with_contract(view(s, d, "v_change_orders"), view(s, d, "v_contracts")),
)
add(
    "vendor_scorecard",
    "vendor_id overall_rating:6 quality_score:4 delivery_score:4 compliance_score:4 risk_score:4 rating",
    """(SELECT *, CASE WHEN overall_rating >= 85 THEN 'EXCELLENT' WHEN overall_rating >= 70 THEN 'GOOD'
        WHEN overall_rating >= 50 THEN 'AVERAGE' ELSE 'POOR' END AS rating
        FROM (SELECT v.*, s.risk_score, (quality_score + delivery_score + compliance_score) / 3 AS overall_rating
              FROM v_vendors v LEFT JOIN v_scores s ON s.vendor_id = v.vendor_id) a) b""",
    lambda s, d: profiles.vendor_scorecard(view(s, d, "v_vendors"), view(s, d, "v_scores")),
)
add(
    "vendor_master_update", "vendor_id vendor_name status empanelment_tier registration_date:d",
    """(SELECT v.vendor_id, v.vendor_name, coalesce(c.status, v.status) AS status,
        coalesce(c.empanelment_tier, v.empanelment_tier) AS empanelment_tier,
        coalesce(c.registration_date, v.registration_date) AS registration_date
        FROM v_vendors v LEFT JOIN v_master_changes c ON c.vendor_id = v.vendor_id) a""",
    lambda s, d: profiles.update_master(view(s, d, "v_vendors"), view(s, d, "v_master_changes")),
)


def _published_master(s, d):
    """Publish the master, then two halves of its history, and read what is current."""
    base = _fresh(s, "master")
    snapshots.write_version(view(s, d, "v_vendors"), base, "first")
    snapshots.publish(s, base, "first")
    history = view(s, d, "v_master_history")
    middle = "changed_at < date '1995-06-01'"
    for part in (history.where(middle), history.where(f"not ({middle})")):
        snapshots.publish_update(base, part, profiles.update_master)
    return snapshots.read_snapshot(s, base)


add(
    "master_snapshot", "vendor_id status empanelment_tier registration_date:d",
    """(SELECT v.vendor_id, coalesce(c.status, v.status) AS status,
        coalesce(c.empanelment_tier, v.empanelment_tier) AS empanelment_tier,
        coalesce(c.registration_date, v.registration_date) AS registration_date
        FROM v_vendors v LEFT JOIN (SELECT vendor_id,
          arg_max(status, (changed_at, change_id)) FILTER (status IS NOT NULL) AS status,
          arg_max(empanelment_tier, (changed_at, change_id)) FILTER (empanelment_tier IS NOT NULL) AS empanelment_tier,
          arg_max(registration_date, (changed_at, change_id)) FILTER (registration_date IS NOT NULL) AS registration_date
          FROM v_master_history GROUP BY vendor_id) c ON c.vendor_id = v.vendor_id) a""",
    _published_master,
)

# ---- report text -----------------------------------------------------------------
_MONEY_TEXT = "record amount_inr amount_usd amount_code"


def _render_money(s, d):
    amount = F.col("value")
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("record"), (F.col("o_totalprice") * (F.col("o_orderkey") % 400) - 9999).alias("value"),
        F.when(F.col("o_orderkey") % 3 == 0, "INR").when(F.col("o_orderkey") % 3 == 1, "AED").otherwise("CHF").alias("code"),
    ).select(
        "record", formats.currency(amount).alias("amount_inr"), formats.currency(amount, "USD", 0).alias("amount_usd"),
        formats.currency(amount, F.col("code")).alias("amount_code"),
    )


_VALUE_SQL = "(SELECT o_orderkey AS record, o_totalprice * (o_orderkey % 400) - 9999 AS value FROM orders) v"
add(
    "render_currency", _MONEY_TEXT.replace("record", "record:i"),
    f"""(SELECT record, {inr('value')} AS amount_inr, '$' || {western('value', 0)} AS amount_usd,
        CASE record % 3 WHEN 0 THEN {inr('value')} WHEN 1 THEN 'AED ' || {western('value', 2)}
             ELSE 'CHF ' || {western('value', 2)} END AS amount_code FROM {_VALUE_SQL}) a""",
    _render_money,
)


def _values(s, d):
    o = table(s, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("record"), (F.col("o_totalprice") * (F.col("o_orderkey") % 400)).alias("value"),
        (F.col("o_orderkey") % 1001 / 1000).alias("score"), F.col("o_orderdate").alias("day"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("later"),
        F.transform(F.sequence(F.lit(1), F.col("o_orderkey") % 13 + 1), lambda i: F.concat(F.lit("V"), i)).alias("items"),
    )


def _on_values(step):
    return lambda s, d: step(_values(s, d))


_STEPS = "CASE WHEN value >= {a}e0 THEN printf('%.{n}f', value / {a}e0) || '{x}' WHEN value >= {b}e0 THEN " \
         "printf('%.{n}f', value / {b}e0) || '{y}' WHEN value >= 1000 THEN printf('%.{n}f', value / 1000e0) || 'K' " \
         "ELSE printf('%.{p}f', value) END"
_POS_SQL = "(SELECT o_orderkey AS record, o_totalprice * (o_orderkey % 400) AS value FROM orders) v"
add(
    "render_compact_currency", "record:i inr usd",
    f"(SELECT record, '₹' || {_STEPS.format(a='10000000', b='100000', x='Cr', y='L', n=2, p=2)} AS inr, "
    "'$' || CASE WHEN value >= 1000000000e0 THEN printf('%.2f', value / 1000000000e0) || 'B' ELSE "
    f"{_STEPS.format(a='1000000', b='1000', x='M', y='K', n=2, p=2)} END AS usd FROM {_POS_SQL}) a",
    _on_values(lambda df: df.select("record", formats.currency_compact(F.col("value")).alias("inr"),
                                    formats.currency_compact(F.col("value"), "USD").alias("usd"))),
)
_SCORE_SQL = "(SELECT o_orderkey AS record, (o_orderkey % 1001) / 1000 AS score FROM orders) v"
add(
    "render_percentage", "record:i pct plain",
    """(SELECT record, printf('%.2f', share) || '%' AS pct, printf('%.1f', share) AS plain
        FROM (SELECT o_orderkey AS record, (o_orderkey % 801) / 8 AS share FROM orders) v) a""",
    _on_values(lambda df: df.withColumn("share", F.col("record") % 801 / 8).select(
        "record", formats.percentage(F.col("share")).alias("pct"),
        formats.percentage(F.col("share"), 1, False).alias("plain"))),
)
add(
    "render_confidence", "record:i label",
    f"""(SELECT record, CASE WHEN score >= 0.8e0 THEN 'High' WHEN score >= 0.6e0 THEN 'Medium' ELSE 'Low' END
        || ' (' || CAST(CAST(round_even(score * 100, 0) AS BIGINT) AS VARCHAR) || '%)' AS label FROM {_SCORE_SQL}) a""",
    _on_values(lambda df: df.select("record", formats.confidence(F.col("score")).alias("label"))),
)
add(
    "render_dates", "record:i standard short long iso datetime span",
    """(SELECT o_orderkey AS record, strftime(o_orderdate, '%d-%b-%Y') AS standard,
        strftime(o_orderdate, '%d/%m/%Y') AS short, strftime(o_orderdate, '%-d %B %Y') AS long,
        strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d-%b-%Y %H:%M') AS datetime,
        strftime(o_orderdate, '%d-%b-%Y') || ' to ' || strftime(o_orderdate + INTERVAL 30 DAY, '%d-%b-%Y') AS span
        FROM orders) a""",
    _on_values(lambda df: df.select(
        "record", *[formats.date_text(F.col("day"), n).alias(n) for n in ("standard", "short", "long", "iso", "datetime")],
        formats.date_range(F.col("day"), F.col("later")).alias("span"))),
)
add(
    "render_numbers", "record:i grouped plain large",
    f"""(SELECT record, {western('value', 2)} AS grouped, printf('%.2f', value) AS plain,
        CASE WHEN value >= 1000000000e0 THEN printf('%.1f', value / 1000000000e0) || 'B' ELSE
        {_STEPS.format(a='1000000', b='1000', x='M', y='K', n=1, p=0)} END AS large FROM {_POS_SQL}) a""",
    _on_values(lambda df: df.select("record", formats.western_number(F.col("value"), 2).alias("grouped"),
                                    formats.western_number(F.col("value"), 2, False).alias("plain"),
                                    formats.large_number(F.col("value")).alias("large"))),
)
add(
    "render_lists", "record:i listed",
    """(SELECT record, CASE WHEN len(items) <= 10 THEN array_to_string(items, ', ')
        ELSE array_to_string(items[1:10], ', ') || '... (' || len(items) || ' total)' END AS listed
        FROM (SELECT o_orderkey AS record, list_transform(range(1, o_orderkey % 13 + 2), lambda i: 'V' || i) AS items
              FROM orders) a) b""",
    _on_values(lambda df: df.select("record", formats.list_text(F.col("items")).alias("listed"))),
)
add(
    "render_report", "change_order_id:i change_cost cost_variance_pct approval_status",
    f"""(SELECT change_order_id, {inr('change_cost')} AS change_cost, printf('%.2f', cost_variance_pct) || '%'
        AS cost_variance_pct, approval_status FROM o_changes) a""",
    on("v_change_orders", lambda df: report.render(
        change_orders.analyze(df), {"change_cost": "currency", "cost_variance_pct": "percentage"})),
)
