"""Recommendation roll-ups: counts and amounts per rule in one aggregate pass.

A roll-up row carries ids only for a rule with a bounded top list. The full
membership of every rule is a table of its own (``members``), because an id
list that grows with the data does not fit in one row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.formats import currency, fixed_text
from bidloom.sources.staging import stage_table

SCHEMA = [
    ("type", "string"),
    ("priority", "string"),
    ("count", "bigint"),
    ("amount", "double"),
    ("mean", "double"),
    ("ids", "array<string>"),
    ("message", "string"),
    ("action", "string"),
]


@dataclass(frozen=True)
class Rule:
    """One recommendation.

    ``when`` is a SQL condition. ``message`` may use {count}, {amount}, {mean:N} (N decimals) and {ids}.
    ``top`` keeps the first ids in ``top_by`` order ('-name' is descending); with ``top_only`` the count
    and amount also describe just those rows.
    """

    type: str
    priority: str | None
    when: str
    message: str | None = None
    id_col: str | None = None
    amount: str | None = None
    mean: str | None = None
    top: int | None = None
    top_by: Sequence[str] = ()
    top_name: str | None = None
    top_only: bool = False
    always: bool = False
    action: str | None = None


def exact_sum(value: Column) -> Column:
    """Sum of doubles as decimals, the same in every order; NaN counts as missing.

    A sum of doubles loses a little at each step, in hundredths past 10^12, and
    differs between runs. With values that the decimal cannot hold it is one.
    """
    number = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    # the digits a double prints, up to ten decimals; past 10^18 a sum could overflow
    exact = F.when(F.abs(number) < 1e18, number).cast("decimal(28,10)")
    return F.when(F.count(number) == F.count(exact), F.sum(exact).cast("double")).otherwise(F.sum(number))


def _text(rule: Rule, count: Column, amount: Column, mean: Column, names: Column) -> Column:
    if rule.message is None:
        return F.lit(None).cast("string")
    pieces = []
    for piece in re.split(r"(\{[^}]*\})", rule.message):
        if piece == "{count}":
            pieces.append(count.cast("string"))
        elif piece == "{amount}":
            pieces.append(currency(F.coalesce(amount, F.lit(0.0))))
        elif piece.startswith("{mean:"):
            pieces.append(fixed_text(mean, int(piece[6:-1])))
        elif piece == "{ids}":
            pieces.append(F.array_join(names, ", "))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def _top_list(df: DataFrame, rule: Rule) -> DataFrame:
    """The first ``top`` rows of a rule as one struct: bounded by ``top``."""
    amount = F.col(rule.amount) if rule.amount else F.lit(None)
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in (*rule.top_by, rule.id_col)]
    # numbered after the limit: a window over ``top`` rows
    rows = (
        df.where(rule.when)
        .orderBy(*order)
        .limit(rule.top)
        .select(
            F.row_number().over(Window.orderBy(*order)).alias("_n"),
            F.col(rule.id_col).cast("string").alias("id"),
            F.col(rule.top_name or rule.id_col).cast("string").alias("name"),
            amount.cast("double").alias("amount"),
        )
    )
    packed = rows.agg(
        F.count("*").alias("count"),
        exact_sum(F.col("amount")).alias("amount"),
        F.sort_array(F.collect_list(F.struct("_n", "id", "name"))).alias("rows"),
    )
    return packed.select(F.struct("count", "amount", F.col("rows.id").alias("id"), F.col("rows.name").alias("name")).alias("top"))


def recommend(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule that matches anything (or is marked ``always``).

    All counts and amounts come from one aggregate. With top lists the detail is
    written once, so that no list runs again what made it.
    """
    if any(rule.top for rule in rules):
        df = stage_table(df, "recommend")
    measures = [F.count("*").alias("_rows")]
    for i, rule in enumerate(rules):
        kept = F.coalesce(F.expr(rule.when), F.lit(False))
        measures.append(F.count_if(kept).alias(f"n{i}"))
        if rule.amount:
            measures.append(exact_sum(F.when(kept, F.col(rule.amount))).alias(f"a{i}"))
        if rule.mean:
            measures.append(F.avg(F.when(kept, F.col(rule.mean))).alias(f"m{i}"))
    wide = df.agg(*measures)
    for i, rule in enumerate(rules):
        if rule.top:
            wide = wide.withColumn(f"top{i}", _top_list(df, rule).scalar())

    entries = []
    for i, rule in enumerate(rules):
        top = F.col(f"top{i}") if rule.top else None
        count = top["count"] if rule.top_only else F.col(f"n{i}")
        amount = top["amount"] if rule.top_only else F.col(f"a{i}") if rule.amount else F.lit(None)
        mean = F.col(f"m{i}") if rule.mean else F.lit(None)
        ids = top["id"] if rule.top else F.lit(None)
        names = top["name"] if rule.top else F.lit(None)
        values = {
            "type": F.lit(rule.type),
            "priority": F.lit(rule.priority),
            "count": count,
            "amount": amount,
            "mean": mean,
            "ids": ids,
            "message": _text(rule, count, amount, mean, names),
            "action": F.lit(rule.action),
        }
        shown = F.lit(True) if rule.always else count > 0
        entry = F.struct(*[values[name].cast(kind).alias(name) for name, kind in SCHEMA])
        entries.append(F.when(shown, entry))
    return wide.select(F.inline(F.array_compact(F.array(*entries))))


def members(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule and matching row: (type, id)."""
    with_ids = [r for r in rules if r.id_col and not r.top_only]
    tried = [
        F.struct(
            F.lit(r.type).alias("type"), F.col(r.id_col).cast("string").alias("id"), F.expr(r.when).alias("_matches")
        )
        for r in with_ids
    ]
    return df.select(F.inline(F.array(*tried))).where("_matches").drop("_matches")
