"""Contract review: mandatory clauses, compliance, risk grade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import clip, count_true, flag, label_list, label_text, points, require, share_pct, with_defaults
from bidloom.operators.recommend import Rule
from bidloom.operators.rules import traffic_light

REQUIRED = ("contract_id", "contract_value")

# Mandatory clauses, and those whose absence is flagged by name.
CLAUSES = (
    "payment_clause",
    "penalty_clause",
    "termination_clause",
    "warranty_clause",
    "liability_clause",
    "force_majeure_clause",
    "dispute_resolution_clause",
)
CRITICAL = ("payment_clause", "penalty_clause", "liability_clause")


@dataclass(frozen=True)
class ReviewSettings:
    clauses: tuple = CLAUSES
    high_value: float = 10_000_000
    many_missing: int = 3


DEFAULTS = ReviewSettings()


def _present(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def missing_clauses(df: DataFrame, s: ReviewSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    out = with_defaults(df, defaults)
    absent = [(~_present(c), c.removesuffix("_clause")) for c in s.clauses if c in out.columns]
    return out.withColumns(
        {"missing_clauses": count_true(*[a for a, _ in absent]), "missing_clause_names": label_list(*absent)}
    )


def compliance(df: DataFrame) -> DataFrame:
    met = _present("gcc_compliant") & _present("scc_included") & (F.col("missing_clauses") == 0)
    return df.withColumn("is_compliant", met)


def risk_signs(df: DataFrame, s: ReviewSettings = DEFAULTS) -> DataFrame:
    out = df.withColumn("is_high_value", flag(F.col("contract_value") > s.high_value))
    n = F.col("missing_clauses")
    signs: list[tuple[Column, str | Column]] = [
        (~_present(c), f"Missing {c.replace('_', ' ')}") for c in CRITICAL if c in df.columns
    ]
    signs += [
        (~_present("gcc_compliant"), "GCC non-compliant"),
        (F.col("is_high_value") & ~_present("scc_included"), "High value without SCC"),
        (
            n >= s.many_missing,
            F.concat(F.lit("Multiple missing clauses ("), n.cast("string"), F.lit(")")),
        ),
    ]
    return out.withColumn("risk_flags", label_text(*signs))


def risk_score(df: DataFrame) -> DataFrame:
    base = F.least(F.col("missing_clauses") * 20, F.lit(60)) + points(
        (~_present("gcc_compliant"), 25), (~_present("scc_included"), 15)
    )
    raised = base + F.when(F.col("is_high_value") & (base > 20), 10).otherwise(0)
    return df.withColumn("risk_score", clip(raised, 0, 100))


def grade(df: DataFrame) -> DataFrame:
    out = df.withColumn("rag_status", traffic_light(F.col("risk_score")))
    status = F.col("rag_status")
    return out.withColumns(
        {
            "approval_recommendation": F.when(status == "Red", "Reject / Legal Review")
            .when(status == "Amber", "Review Required")
            .otherwise("Approve"),
            "requires_legal_review": (status == "Red") | ((status == "Amber") & F.col("is_high_value")),
        }
    )


def analyze(df: DataFrame, s: ReviewSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    return grade(risk_score(risk_signs(compliance(missing_clauses(df, s, defaults)), s)))


def _missing_counts(detail: DataFrame, s: ReviewSettings) -> dict[str, Column]:
    names = [c.removesuffix("_clause") for c in s.clauses if c in detail.columns]
    return {n: F.count_if(~_present(f"{n}_clause")).alias(f"_{n}") for n in names}


def _most_common(names: list[str]) -> Column:
    best = F.greatest(*[F.col(f"_{n}") for n in names])
    chain = F.when(best == 0, "None")
    for n in names:
        chain = chain.when(F.col(f"_{n}") == best, n)
    return F.coalesce(chain, F.lit("None")).alias("most_common_missing")


def most_common_missing(detail: DataFrame, s: ReviewSettings = DEFAULTS) -> DataFrame:
    """The clause missing most often, ties by clause order; 'None' when none is missing."""
    counts = _missing_counts(detail, s)
    return detail.agg(*counts.values()).select(_most_common(list(counts)))


def compliance_summary(detail: DataFrame, s: ReviewSettings = DEFAULTS) -> DataFrame:
    n = F.count("*")
    counts = _missing_counts(detail, s)

    def share(condition: Column) -> Column:
        return F.coalesce(share_pct(F.count_if(condition), n), F.lit(0.0))

    base = detail.agg(
        n.alias("total_contracts"),
        share(F.col("is_compliant")).alias("compliant_pct"),
        share(_present("gcc_compliant")).alias("gcc_compliance_pct"),
        share(_present("scc_included")).alias("scc_inclusion_pct"),
        F.avg("missing_clauses").alias("avg_missing_clauses"),
        *counts.values(),
    )
    return base.select("*", _most_common(list(counts))).drop(*[f"_{n}" for n in counts])


def result(detail: DataFrame) -> DataFrame:
    status = F.col("rag_status")
    return detail.agg(
        F.count("*").alias("total_contracts"),
        F.count_if(status == "Green").alias("compliant_contracts"),
        F.count_if(status == "Amber").alias("amber_contracts"),
        F.count_if(status == "Red").alias("red_contracts"),
        F.avg("risk_score").alias("average_risk_score"),
        F.count_if("is_high_value").alias("high_value_contracts"),
    )


# Recommendation texts.
RULES = [
    Rule(
        "critical", "High", "rag_status = 'Red'", id_col="contract_id",
        message="🔴 CRITICAL: {count} contracts flagged RED - Do NOT approve without legal review",
    ),
    Rule(
        "warning", "Medium", "rag_status = 'Amber'", id_col="contract_id",
        message="⚠️  CAUTION: {count} contracts flagged AMBER - Requires review before approval",
    ),
    Rule(
        "approved", "Info", "rag_status = 'Green'", id_col="contract_id",
        message="✅ APPROVED: {count} contracts passed all compliance checks",
    ),
    Rule(
        "high_value", "High", "requires_legal_review AND is_high_value", amount="contract_value",
        message="💰 HIGH VALUE: {count} contracts worth {amount} require legal review",
    ),
]
