"""Quality rules: a table of thresholds compiled into one projection.

Only built-in column functions run: every measure is an expression over the
text, and every rule of the table compares one measure with its bounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: frequent words of the four languages of the corpus
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "it", "on", "be", "by", "this", "are", "or",
    "der", "die", "und", "das", "den", "von", "zu", "für", "ein", "als", "auch", "dem",
    "le", "la", "les", "de", "et", "des", "un", "une", "que", "qui", "du", "est", "dans", "pour", "au", "par",
    "el", "los", "las", "del", "y", "se", "una", "por", "con", "como", "su", "no",
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie within ``low`` and ``high``; a missing bound holds always."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols per word", "symbols_per_word", None, 0.1),
    Rule("stop words", "stop_words", 2, None),
    Rule("duplicate lines", "dup_line_share", None, 0.5),
    Rule("words in repeated windows", "repeat_word_share", None, 0.3),
    Rule("words per line", "mean_line_words", 1.5, None),
    Rule("capitals", "capital_share", None, 0.5),
)


def words_of(text: Column) -> Column:
    """The maximal runs without blanks, as an array."""
    return F.array_remove(F.split(text, _BLANK + "+"), "")


def _covered(starts: str) -> Column:
    """Length of the union of windows that start at the sorted ``starts``."""
    gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every text.

    Words are runs without blanks (space, tab to carriage return). A null or
    blank text has no words, zero counts, and ratios of 0. Ids are passed
    through, null or repeated ones too; other columns are not read.
    """
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    parts = text.select(
        "_id",
        words_of(F.col("_text")).alias("_words"),
        F.length(F.translate("_text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, _BLANKS, "")) > 0).alias("_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]", ""))).alias("_capitals"),
    )
    hashed = parts.select(
        "*",
        F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW))),
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("_hashes"),
    )
    # columns of their own: what a lambda names is then evaluated once a row, not once an element
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = hashed.select(
        "*",
        F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("_placed"),
    )
    beside = lambda w, k: F.coalesce(F.get("_placed", k)["h"] == w["h"], F.lit(False))
    twice = F.filter("_placed", lambda w, k: ((k > 0) & beside(w, k - 1)) | beside(w, k + 1))
    repeated = placed.select("*", F.array_sort(F.transform(twice, lambda w: w["i"])).alias("_starts"))
    n_words = F.size("_words").cast("long")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    counted = repeated.select(
        F.col("_id"),
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered("_starts").alias("n_repeat_words"),
        F.size(F.array_intersect(F.transform("_words", F.lower), stop)).cast("long").alias("stop_words"),
        "_capitals",
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counted.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        "stop_words",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("n_words", "n_lines").alias("mean_line_words"),
        share("_capitals", "word_chars").alias("capital_share"),
    )


def within(rule: Rule) -> Column:
    bounds = []
    if rule.low is not None:
        bounds.append(F.col(rule.measure) >= F.lit(rule.low))
    if rule.high is not None:
        bounds.append(F.col(rule.measure) <= F.lit(rule.high))
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Measures, ``base_failed``, the names of the rules that failed, and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words inside
    eight-word windows that occur twice or more. Such a document is not kept;
    any other is kept when no rule of the table fails.
    """
    measured = measure(docs, id_col, text_col)
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    failed = F.array_compact(F.array(*[F.when(~within(r), F.lit(r.name)) for r in rules]))
    return measured.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
