"""Contract texts to clause tables: segmentation, typing, tagging, extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.text import strip
from bidloom.operators.names import organizations, with_organizations
from bidloom.sources.staging import attach

# Clause keywords, tag words and extraction patterns.
CLAUSE_KEYWORDS = {
    "payment": ["payment", "invoice", "due", "remittance", "billing", "paid"],
    "penalty": ["penalty", "liquidated damages", "delay", "late fee", "damages"],
    "termination": ["terminate", "termination", "notice period", "cancellation", "cancel"],
    "liability": ["liability", "indemnity", "damages", "liable", "responsible"],
    "warranty": ["warranty", "guarantee", "defect", "repair", "replacement"],
    "delivery": ["delivery", "deliver", "timeline", "completion", "handover"],
    "scope": ["scope", "work", "services", "supply", "installation"],
}
MANDATORY_WORDS = ["shall", "must", "required", "mandatory"]
HIGH_RISK_WORDS = ["penalty", "damages", "liability", "terminate", "breach"]
MEDIUM_RISK_WORDS = ["delay", "warranty", "guarantee", "dispute"]
MONEY_PATTERNS = [
    r"(?U)₹\s*([\d,]+(?:\.\d{2})?)",
    r"(?U)Rs\.?\s*([\d,]+(?:\.\d{2})?)",
    r"(?U)INR\s*([\d,]+(?:\.\d{2})?)",
]
MONEY_MARKS = ["₹", "Rs", "INR"]
DATE_PATTERN = r"(?U)\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
PERCENT_PATTERN = r"(?U)\b\d+(?:\.\d+)?\s*%"
PAYMENT_TERMS = r"payment.*?(\d+)\s*days"
PENALTY_RATE = r"penalty.*?([\d.]+)\s*%"
WARRANTY_PERIOD = r"warranty.*?(\d+)\s*(month|year)"


def clause_texts(text: Column) -> Column:
    """Pieces between full stops, trimmed, blanks dropped."""
    # whitespace next to a stop goes first, so that no piece needs its own trim
    tight = F.regexp_replace(strip(text), r"(?<!\s)\s+\.|\.\s+", ".")
    return F.array_remove(F.split(F.regexp_replace(tight, r"\.\s+", "."), r"\."), "")


def segment(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per clause with its 1-based position in the document."""
    others = [c for c in df.columns if c != text]
    # the outer form, as the inner one would be given a filter that segments the texts a second time
    pieces = df.select(*others, F.posexplode_outer(clause_texts(F.col(text))).alias("_pos", "clause_text"))
    return pieces.where(F.col("_pos").isNotNull()).select(
        *others, (F.col("_pos") + 1).alias("clause_id"), "clause_text"
    )


def _mentions(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def _keyword_hits(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [lowered.contains(w).cast("int") for w in words])


def with_type(df: DataFrame, clause: str = "clause_text") -> DataFrame:
    """The type with most keywords present; earlier types win ties.

    Lower-casing and scores are columns of their own, so each is computed once.
    """
    hits = {f"_hits_{name}": _keyword_hits(F.col("_low"), words) for name, words in CLAUSE_KEYWORDS.items()}
    scored = df.withColumn("_low", F.lower(clause)).withColumns(hits)
    scored = scored.withColumn("_best", F.greatest(*hits))
    chain = F.when(F.col("_best") == 0, F.lit("other"))
    for name in CLAUSE_KEYWORDS:
        chain = chain.when(F.col(f"_hits_{name}") == F.col("_best"), F.lit(name))
    return scored.withColumn("clause_type", chain).drop("_low", "_best", *hits)


def with_tags(df: DataFrame, clause: str = "clause_text") -> DataFrame:
    """Mandatory wording and risk level."""
    low = F.col("_low")
    return (
        df.withColumn("_low", F.lower(clause))
        .withColumns(
            {
                "mandatory": _mentions(low, MANDATORY_WORDS),
                "risk_level": F.when(_mentions(low, HIGH_RISK_WORDS), "high")
                .when(_mentions(low, MEDIUM_RISK_WORDS), "medium")
                .otherwise("low"),
            }
        )
        .drop("_low")
    )


def _found(text: Column, mark: Column, pattern: str, group: int) -> Column:
    """All matches; the cheap ``mark`` test spares texts that cannot match."""
    none = F.array().cast("array<string>")
    return F.when(mark, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def money(text: Column) -> Column:
    return F.concat(
        *[
            _found(text, text.contains(mark), pattern, 1)
            for mark, pattern in zip(MONEY_MARKS, MONEY_PATTERNS, strict=True)
        ]
    )


def dates(text: Column) -> Column:
    return _found(text, text.contains("-") | text.contains("/"), DATE_PATTERN, 0)


def percentages(text: Column) -> Column:
    return _found(text, text.contains("%"), PERCENT_PATTERN, 0)


def entities(text: Column) -> Column:
    """Entity record. Organisations need a dictionary (``with_entities``); persons and places a language model."""
    none = F.array().cast("array<string>")
    return F.struct(
        dates(text).alias("dates"),
        money(text).alias("money"),
        percentages(text).alias("percentages"),
        none.alias("organizations"),
        none.alias("persons"),
        none.alias("locations"),
    )


def with_entities(df: DataFrame, names: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows with dates, money, percentages and the organisations of a dictionary of names.

    All that is read from the text is taken before the names are joined, so a
    text that is not asked for does not move.
    """
    body = F.col(text)
    found = {"dates": dates(body), "money": money(body), "percentages": percentages(body)}
    return with_organizations(df.withColumns(found), names, keys, text)


def clause_table(
    df: DataFrame, text: str = "text", names: DataFrame | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Segment, type, tag and extract; narrow, without a shuffle.

    With a table of ``names`` the organisations of each clause are filled, in one
    join; ``keys`` tell the documents apart (``doc_id`` unless given).
    """
    clause = F.col("clause_text")
    table = with_tags(with_type(segment(df, text))).withColumns(
        {
            "dates": dates(clause),
            "money": money(clause),
            "percentages": percentages(clause),
            "organizations": F.array().cast("array<string>"),
        }
    )
    if names is None:
        return table
    return with_organizations(table, names, [*(keys or ["doc_id"]), "clause_id"], "clause_text")


def document_features(
    df: DataFrame, text: str = "text", names: DataFrame | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Headline facts of each document from its full text; its vendor is the first of ``names`` in it.

    The facts are taken before the vendors are joined, so texts do not move.
    """
    keys = keys or ["doc_id"]

    def found(word: str, pattern: str, group: int) -> Column:
        low = F.col("_low")
        return F.when(low.contains(word), F.nullif(F.regexp_extract(low, pattern, group), F.lit("")))

    period = F.concat_ws(" ", found("warranty", WARRANTY_PERIOD, 1), found("warranty", WARRANTY_PERIOD, 2))
    body = F.col(text)
    facts = (
        df.withColumns({"_low": F.lower(text), "_money": money(body), "_dates": dates(body)})
        .withColumns(
            {
                "contract_value": F.get("_money", F.lit(0)),
                "vendor_name": F.lit(None).cast("string"),
                "contract_date": F.get("_dates", F.lit(0)),
                "delivery_date": F.get("_dates", F.lit(1)),
                "payment_terms": F.concat(found("payment", PAYMENT_TERMS, 1), F.lit(" days")),
                "penalty_clause": F.concat(found("penalty", PENALTY_RATE, 1), F.lit("%")),
                "warranty_period": F.nullif(period, F.lit("")),
            }
        )
        .drop(text, "_low", "_money", "_dates")
    )
    if names is None:
        return facts
    first = F.get("organizations", F.lit(0)).alias("_vendor")
    vendors = organizations(df, names, keys, text).select(*keys, first)
    named = attach(facts.drop("organizations"), vendors, keys, "vendors")
    return named.withColumn("vendor_name", F.col("_vendor")).drop("_vendor")


def document_rollup(clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    return clauses.groupBy(key).agg(
        F.count("*").alias("clause_count"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_clauses"),
        F.count_if("mandatory").alias("mandatory_clauses"),
    )
