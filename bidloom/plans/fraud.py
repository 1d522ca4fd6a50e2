"""Payment fraud: duplicates, price manipulation, collusion, payment patterns.

All group figures are partial sums of one aggregate over grouping sets, written
and then joined to a narrow copy of the rows, which meets the wide rows once. No
window runs over a business key, so a vendor or an amount that holds a third of
all rows costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.functions.expr import clip, count_true, flag, has, label_list, nan_to_null, pct_over, points, require, round_scaled, share_pct
from bidloom.operators.ordering import previous_value
from bidloom.operators.recommend import Rule
from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import exists, new_path, stage_table

REQUIRED = ("transaction_id", "amount")
KEY = "transaction_id"


@dataclass(frozen=True)
class FraudSettings:
    high_risk: float = 70
    medium_risk: float = 40
    price_variance_pct: float = 25
    approval_threshold: float = 1_000_000
    below_threshold_share: float = 0.95
    same_day_limit: int = 2
    similar_vendor_limit: int = 3
    similar_price_limit: int = 5
    repeated_amount_limit: int = 10
    fast_payment_days: int = 3
    cash_limit: float = 100_000
    opening_hour: int = 6
    closing_hour: int = 20
    duplicate_amount: float = 500_000


DEFAULTS = FraudSettings()


# ---- group figures ---------------------------------------------------------------
# All of them come from one aggregate over grouping sets: one scan, one shuffle of
# partial sums, written with a folder for each set. A set's figures are then a
# table of their own with its own measured size.


def _round_thousand(name: str = "amount") -> Column:
    return F.rint(F.col(name) / 1000) * 1000


def _price_group() -> Column:
    return (F.col("amount") / 10000).cast("bigint")


def _digits(name: str) -> Column:
    return F.regexp_extract(F.col(name).cast("string"), r"(\d+)", 1).try_cast("bigint")


EXACT = ["invoice_number", "vendor_id"]
NEAR = ["amount_rounded", "vendor_id"]
DAY = ["vendor_id", "invoice_date"]
PRICE = ["similar_pricing_group", "item_category"]
AMOUNT = ["rounded_amount"]

#: keys of each set; "rounded_amount" is computed like "amount_rounded" and grouped under that name
SETS = {
    "exact": EXACT,
    "near": NEAR,
    "category": ["item_category"],
    "day": DAY,
    "vendor": ["vendor_id"],
    "price": PRICE,
    "amount": ["amount_rounded"],
}
_DERIVED = {"amount_rounded": _round_thousand, "similar_pricing_group": _price_group}
_SET = "_set"


def _grouped(df: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """Figures of all named sets with more than one row; a lone row is 1 by rule. Vendors and categories are all kept."""
    keys = list(dict.fromkeys(c for name in names for c in SETS[name]))
    derived = df.withColumns({c: make() for c, make in _DERIVED.items() if c in keys})
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    price = F.col("unit_price") if "category" in names else F.lit(None).cast("double")
    narrow = derived.select(*keys, place.alias("_place"), price.alias("_price"))
    figures_of = [
        F.count("*").alias("_n"),
        F.min("_place").alias("_first"),
        F.avg("_price").alias("category_avg_price"),
        F.stddev_samp("_price").alias("category_std_price"),
    ]
    sets = [[F.col(c) for c in SETS[name]] for name in names]
    grouped = narrow.groupingSets(sets, *map(F.col, keys)).agg(F.grouping_id().alias("_gid"), *figures_of)
    # a bit of the grouping id is set where a key is not in the set
    bits = {name: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in SETS[name]) for name in names}
    which = F.lit(None).cast("string")
    for name, gid in bits.items():
        which = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(which)
    whole = F.col(_SET).isin("vendor", "category")
    return grouped.withColumn(_SET, which).drop("_gid").where(whole | (F.col("_n") > 1))


def _block_sizes(vendors: DataFrame) -> DataFrame:
    """Rows per vendor and per block of ten vendor numbers; the null vendor is kept for the totals."""
    counts = vendors.select("vendor_id", F.col("_n").alias("vendor_frequency"))
    counts = counts.withColumn("_block", F.floor(_digits("vendor_id") / 10))
    blocks = counts.groupBy("_block").agg(F.sum("vendor_frequency").alias("vendor_block_rows"))
    return counts.join(blocks, "_block", "left").drop("_block")


def _sequence_marks(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Keys of the rows whose invoice number is one away from that of the row before, overall or in its group."""
    base = df.select(*dict.fromkeys([KEY, *order, *(within or [])]), _digits("invoice_number").alias("_number"))
    before = previous_value(base, "_number", [F.col(c) for c in order], "_before", within)
    close = F.abs(F.col("_number") - F.col("_before")) == 1
    return before.where(close).select(KEY, F.lit(True).alias("sequential_invoices"))


def figures(
    df: DataFrame, names: list[str], order: list[str] | None = None, within: list[str] | None = None
) -> dict[str, DataFrame]:
    """The named group figures of ``df`` as written tables; "sequence" is the marks of sequential invoices."""
    order = order or [KEY]
    sets = [name for name in names if name in SETS]
    found: dict[str, DataFrame] = {}
    if sets:
        path = new_path(df.sparkSession, "fraud-figures")
        grouped = _grouped(df, sets, order)
        grouped.write.partitionBy(_SET).parquet(path)
        kinds = {f.name: f for f in grouped.schema}
        for name in sets:
            columns = [*SETS[name], "_n", "_first", "category_avg_price", "category_std_price"]
            kind, folder = T.StructType([kinds[c] for c in columns]), f"{path}/{_SET}={name}"
            # a set without rows has no folder
            there = exists(df.sparkSession, folder)
            found[name] = df.sparkSession.read.schema(kind).parquet(folder) if there else df.sparkSession.createDataFrame([], kind)
    out: dict[str, DataFrame] = {}
    for name, own in found.items():
        if name in ("exact", "near"):
            out[name] = own.select(*SETS[name], "_first")
        elif name == "category":
            out[name] = own.dropna(subset=SETS[name]).select("item_category", "category_avg_price", "category_std_price")
        elif name == "vendor":
            out[name] = stage_table(_block_sizes(own), "vendor-blocks")
        else:
            size = {"day": "same_day_same_vendor", "price": "same_price_count", "amount": "repeated_amount_count"}[name]
            own = own.dropna(subset=SETS[name]).select(*SETS[name], F.col("_n").alias(size))
            out[name] = own.withColumnRenamed("amount_rounded", "rounded_amount")
    if "sequence" in names:
        out["sequence"] = stage_table(_sequence_marks(df, order, within), "sequence")
    return out


def _with_size(df: DataFrame, sizes: DataFrame, keys: list[str], out: str) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.join(sizes, keys, "left").withColumn(out, F.coalesce(F.col(out), F.when(known, F.lit(1))))


def _with_repeat(df: DataFrame, groups: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    matches = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    joined = df.alias("t").join(groups.alias("g"), matches, "left")
    own = [F.col(f"t.{c}") for c in order]
    later = flag((own[0] if len(own) == 1 else F.struct(*own)) > F.col("g._first"))
    return joined.select("t.*", later.alias(out))


# ---- operators -------------------------------------------------------------------
# Each has a part that joins figures and a part that only compares columns; the
# whole chain runs the first parts on the narrow rows.

def _join_duplicates(df: DataFrame, known: dict, order: list[str]) -> DataFrame:
    out = df.withColumn("amount_rounded", _round_thousand())
    out = _with_repeat(out, known["exact"], EXACT, order, "is_duplicate")
    return _with_repeat(out, known["near"], NEAR, order, "is_near_duplicate")


def _score_duplicates(out: DataFrame) -> DataFrame:
    score = F.when(F.col("is_duplicate"), 100).when(F.col("is_near_duplicate"), 60).otherwise(0)
    return out.withColumn("duplicate_score", score)


def duplicates(df: DataFrame, order: list[str] | None = None, known: dict | None = None) -> DataFrame:
    """Exact repeats of (invoice, vendor) and near repeats of (rounded amount, vendor).

    ``order`` is the row order; the first row of a group is the clean one. End it
    with a unique column.
    """
    df = nan_to_null(df)
    require(df, *REQUIRED, *EXACT)
    order = order or [KEY]
    return _score_duplicates(_join_duplicates(df, known or figures(df, ["exact", "near"], order), order))


def _join_prices(df: DataFrame, known: dict) -> DataFrame:
    out = df.join(known["category"], "item_category", "left")
    return _with_size(out, known["day"], DAY, "same_day_same_vendor") if "day" in known else out


def _score_prices(out: DataFrame, s: FraudSettings, dated: bool) -> DataFrame:
    deviation = pct_over(F.col("unit_price"), F.col("category_avg_price"))
    threshold = F.col("approval_threshold") if has(out, "approval_threshold") else F.lit(s.approval_threshold)
    amount = F.col("amount")
    out = out.withColumns(
        {
            "price_deviation_pct": deviation,
            "price_manipulation_detected": flag(F.abs(deviation) > s.price_variance_pct),
            "just_below_threshold": flag((amount >= threshold * s.below_threshold_share) & (amount < threshold)),
            "split_invoice_suspected": flag(F.col("same_day_same_vendor") > s.same_day_limit) if dated else F.lit(False),
        }
    )
    score = points(
        (F.col("price_manipulation_detected"), 40),
        (F.col("just_below_threshold"), 30),
        (F.col("split_invoice_suspected"), 30),
    )
    return out.withColumn("price_manipulation_score", score)


def price_manipulation(df: DataFrame, s: FraudSettings = DEFAULTS, known: dict | None = None) -> DataFrame:
    df = nan_to_null(df)
    dated = has(df, "invoice_date")
    known = known or figures(df, ["category", *(["day"] if dated else [])])
    return _score_prices(_join_prices(df, known), s, dated)


def vendor_frequency(df: DataFrame, known: dict | None = None) -> DataFrame:
    """Rows per vendor against the even share, and rows per block of ten vendor numbers."""
    table = (known or figures(df, ["vendor"]))["vendor"]
    share = F.try_divide(F.sum("vendor_frequency"), F.count("vendor_id")).alias("expected_frequency")
    out = with_scalars(df.join(table, "vendor_id", "left"), table.agg(share))
    gap = F.abs(F.col("vendor_frequency") - F.col("expected_frequency"))
    return out.withColumn("frequency_variance", gap)


def sequential_invoices(
    df: DataFrame, order: list[str] | None = None, known: dict | None = None, within: list[str] | None = None
) -> DataFrame:
    """True where the invoice number is one away from that of the row before in ``order``.

    The row before is that of the whole table, or with ``within`` (for example
    ``["vendor_id"]``) the one before in the same group.
    """
    marks = (known or figures(df, ["sequence"], order, within))["sequence"]
    return df.join(marks, KEY, "left").withColumn("sequential_invoices", flag(F.col("sequential_invoices")))


def _join_collusion(df: DataFrame, known: dict, order: list[str] | None) -> DataFrame:
    out = vendor_frequency(df, known).withColumn("similar_pricing_group", _price_group())
    out = _with_size(out, known["price"], PRICE, "same_price_count")
    return sequential_invoices(out, order, known)


def _score_collusion(out: DataFrame, s: FraudSettings) -> DataFrame:
    out = out.withColumns(
        {
            "similar_vendor_exists": flag(F.col("vendor_block_rows") > s.similar_vendor_limit),
            "collusion_risk": flag(F.col("same_price_count") > s.similar_price_limit),
        }
    )
    score = points(
        (F.col("similar_vendor_exists"), 30),
        (F.col("collusion_risk"), 40),
        (F.col("sequential_invoices"), 30),
    )
    return out.withColumn("collusion_score", score)


def collusion(
    df: DataFrame, s: FraudSettings = DEFAULTS, order: list[str] | None = None, known: dict | None = None
) -> DataFrame:
    known = known or figures(df, ["vendor", "price", "sequence"], order)
    return _score_collusion(_join_collusion(df, known, order), s)


def _join_amounts(df: DataFrame, known: dict) -> DataFrame:
    return _with_size(df.withColumn("rounded_amount", _round_thousand()), known["amount"], AMOUNT, "repeated_amount_count")


def _score_payments(out: DataFrame, s: FraudSettings) -> DataFrame:
    never = F.lit(False)
    delay = (
        F.datediff(F.to_date("payment_date"), F.to_date("invoice_date"))
        if has(out, "payment_date", "invoice_date")
        else F.lit(None).cast("int")
    )
    hour = F.col("payment_hour") if has(out, "payment_hour") else None
    cash = (F.col("payment_method") == "Cash") & (F.col("amount") > s.cash_limit) if has(out, "payment_method") else never
    out = out.withColumns(
        {
            "payment_delay_days": delay,
            "unusually_fast_payment": flag(delay < s.fast_payment_days),
            "cash_payment_high_value": flag(cash),
            "after_hours_payment": never if hour is None else flag((hour < s.opening_hour) | (hour > s.closing_hour)),
            "repeated_payment_pattern": flag(F.col("repeated_amount_count") > s.repeated_amount_limit),
        }
    )
    score = points(
        (F.col("unusually_fast_payment"), 20),
        (F.col("cash_payment_high_value"), 50),
        (F.col("after_hours_payment"), 15),
        (F.col("repeated_payment_pattern"), 25),
    )
    return out.withColumn("payment_pattern_score", score)


def payment_patterns(df: DataFrame, s: FraudSettings = DEFAULTS, known: dict | None = None) -> DataFrame:
    return _score_payments(_join_amounts(df, known or figures(df, ["amount"])), s)


# Indicator names in order.
INDICATORS = {
    "is_duplicate": "Duplicate Invoice",
    "is_near_duplicate": "Near-Duplicate",
    "price_manipulation_detected": "Price Manipulation",
    "just_below_threshold": "Just-Below-Threshold",
    "split_invoice_suspected": "Split Invoice",
    "collusion_risk": "Vendor Collusion",
    "unusually_fast_payment": "Fast Payment",
    "cash_payment_high_value": "High-Value Cash",
    "repeated_payment_pattern": "Repeated Pattern",
}


def score(df: DataFrame) -> DataFrame:
    mix = (
        F.col("duplicate_score") * 0.30
        + F.col("price_manipulation_score") * 0.30
        + F.col("collusion_score") * 0.25
        + F.col("payment_pattern_score") * 0.15
    )
    return df.withColumns(
        {
            "fraud_score": round_scaled(clip(mix, 0, 100), 2),
            "fraud_indicators": label_list(*[(F.col(name), text) for name, text in INDICATORS.items()]),
            "indicator_count": count_true(*[F.col(name) for name in INDICATORS]),
        }
    )


def classify(df: DataFrame, s: FraudSettings = DEFAULTS) -> DataFrame:
    value = F.col("fraud_score")
    out = df.withColumn(
        "fraud_risk", F.when(value >= s.high_risk, "High").when(value >= s.medium_risk, "Medium").otherwise("Low")
    )
    return out.withColumns(
        {
            "requires_investigation": (F.col("fraud_risk") == "High")
            | (F.col("indicator_count") >= 3)
            | F.col("is_duplicate"),
            "immediate_action": flag(
                (value >= 85) | (F.col("is_duplicate") & (F.col("amount") > s.duplicate_amount))
            ),
        }
    )


def analyze(df: DataFrame, s: FraudSettings = DEFAULTS, order: list[str] | None = None) -> DataFrame:
    """The whole chain. Transaction ids are unique.

    The figures come from one aggregate of the input. They are joined to the
    narrow rows (ids and group keys), written, and joined to the wide rows once.
    """
    df = nan_to_null(df)
    require(df, *REQUIRED, *EXACT)
    order = order or [KEY]
    dated = has(df, "invoice_date")
    known = figures(df, [name for name in [*SETS, "sequence"] if name != "day" or dated], order)
    keys = ["invoice_number", "vendor_id", "amount", "item_category", *(["invoice_date"] if dated else [])]
    narrow = df.select(*dict.fromkeys([KEY, *order, *keys]))
    joined = _join_amounts(_join_collusion(_join_prices(_join_duplicates(narrow, known, order), known), known, order), known)
    added = stage_table(joined.select(KEY, *[c for c in joined.columns if c not in narrow.columns]), "fraud-marks")
    out = _score_prices(_score_duplicates(df.join(added, KEY, "left")), s, dated)
    return classify(score(_score_payments(_score_collusion(out, s), s)), s)


def _most_common(counts: dict[str, str]) -> Column:
    """Label of the largest of the named count columns, ties by order; 'None' without any."""
    best = F.greatest(*[F.col(c) for c in counts])
    chain = F.when(best == 0, "None")
    for name, text in counts.items():
        chain = chain.when(F.col(name) == best, text)
    return F.coalesce(chain, F.lit("None"))


def most_common_indicator(detail: DataFrame) -> DataFrame:
    """Most frequent indicator, ties by indicator order; 'None' without any."""
    counts = detail.agg(*[F.count_if(F.col(c)).alias(c) for c in INDICATORS])
    return counts.select(_most_common(INDICATORS).alias("most_common_indicator"))


def summary(detail: DataFrame) -> DataFrame:
    n, risk = F.count("*"), F.col("fraud_risk")
    base = detail.agg(
        n.alias("total_transactions"),
        F.coalesce(share_pct(F.count_if(F.col("fraud_score") > 0), n), F.lit(0.0)).alias("fraud_detection_rate"),
        F.count_if(risk == "High").alias("level_high"),
        F.count_if(risk == "Medium").alias("level_medium"),
        F.count_if(risk == "Low").alias("level_low"),
        F.count_if("is_duplicate").alias("type_duplicate_invoices"),
        F.count_if("price_manipulation_detected").alias("type_price_manipulation"),
        F.count_if("collusion_risk").alias("type_vendor_collusion"),
        F.count_if(F.col("payment_pattern_score") > 50).alias("type_payment_anomalies"),
        F.coalesce(F.sum(F.when(risk == "High", F.col("amount"))), F.lit(0.0)).alias("total_fraud_exposure"),
        F.avg("fraud_score").alias("average_fraud_score"),
        F.count_if("requires_investigation").alias("transactions_requiring_investigation"),
        *[F.count_if(F.col(c)).alias(f"_{c}") for c in INDICATORS],
    )
    label = _most_common({f"_{c}": text for c, text in INDICATORS.items()})
    return base.withColumn("most_common_indicator", label).drop(*[f"_{c}" for c in INDICATORS])


def result(detail: DataFrame) -> DataFrame:
    risk = F.col("fraud_risk")
    return detail.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(risk == "High").alias("high_risk_fraud"),
        F.count_if(risk == "Medium").alias("medium_risk_fraud"),
        F.count_if(F.col("fraud_score") > 50).alias("suspicious_transactions"),
        F.count_if("is_duplicate").alias("duplicate_invoices"),
        F.count_if("price_manipulation_detected").alias("price_manipulations"),
        F.count_if("collusion_risk").alias("potential_collusion"),
        F.coalesce(F.sum(F.when(risk == "High", F.col("amount"))), F.lit(0.0)).alias("total_fraud_exposure"),
    )


def collusion_vendors(detail: DataFrame) -> DataFrame:
    """Distinct vendors of the collusion alert, as a table."""
    return detail.where("collusion_risk").select("vendor_id").distinct()


# Alert texts.
RULES = [
    Rule(
        "immediate_action", "Critical", "immediate_action", id_col="transaction_id", amount="amount",
        message="🚨 CRITICAL: {count} transactions require IMMEDIATE investigation - Exposure: {amount}",
    ),
    Rule(
        "duplicate_invoice", "High", "is_duplicate", id_col="transaction_id", amount="amount",
        message="⚠️  DUPLICATE: {count} duplicate invoices detected - Potential double payment",
    ),
    Rule(
        "price_manipulation", "High", "price_manipulation_detected", id_col="transaction_id",
        message="💰 PRICE FRAUD: {count} transactions with abnormal pricing detected",
    ),
    Rule(
        "vendor_collusion", "High", "collusion_risk", id_col="vendor_id",
        message="🤝 COLLUSION: {count} transactions show vendor collusion patterns",
    ),
    Rule(
        "high_risk", "High", "fraud_risk = 'High'", id_col="transaction_id", amount="amount",
        message="🔴 HIGH RISK: {count} transactions flagged - Total exposure: {amount}",
    ),
]
