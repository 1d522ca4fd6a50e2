"""Names of a dictionary found in texts: organisations, and the vendor of a document.

A name is its sequence of tokens (letters and digits, lower-cased). The places
of a text whose token starts some name are found by one join on the token; only
there the n-grams of the lengths such names have are built, and a second join on
their hash finds the names, which the tokens themselves confirm. Where names
overlap, the longest wins, then the one that starts first. Nothing is compared
with every name, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.sources.staging import attach, stage_table

_TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _TOKEN_BREAK), lambda t: t != "")


def dictionary(names: DataFrame, name: str = "name") -> DataFrame:
    """(hash, size, phrase, name), one row for each token sequence: the smallest of its spellings."""
    own = names.select(F.col(name).alias("name"), tokens(F.col(name)).alias("_tokens")).where(F.size("_tokens") > 0)
    phrase = F.array_join("_tokens", " ")
    return (
        own.groupBy(phrase.alias("phrase"), F.size("_tokens").alias("size"))
        .agg(F.min("name").alias("name"))
        .select(F.xxhash64("phrase").alias("hash"), "size", "phrase", "name")
    )


def find_names(df: DataFrame, names: DataFrame, keys: list[str], text: str = "text", name: str = "name") -> DataFrame:
    """(keys, at, size, name): the names in each text, by the place of their first token.

    ``keys`` tell the rows apart and are not null. A null text or name matches
    nothing. A name that a third of all texts hold is a skewed join, which
    adaptive execution splits: neither side is grouped by the name. What is found
    moves once, to its row.
    """
    known = stage_table(dictionary(names, name), "name-dictionary")
    # the length of the longest name: one number
    longest = known.agg(F.max("size")).first()[0]
    if longest is None:
        return df.select(*keys, F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("name")).where("false")
    # the first tokens of names, each with the lengths of its names
    first = F.xxhash64(F.substring_index("phrase", " ", 1))
    starts = stage_table(known.groupBy(first.alias("start")).agg(F.collect_set("size").alias("sizes")), "name-starts")
    # the outer form, as the inner one would be given a filter that takes the texts apart a second time
    places = df.select(*keys, tokens(F.col(text)).alias("_tokens")).select(
        *keys, "_tokens", F.posexplode_outer("_tokens").alias("_i", "_token")
    )
    places = places.where(F.col("_token").isNotNull())
    # a place takes no more tokens with it than the longest name has
    places = places.select(
        *keys, (F.col("_i") + 1).alias("at"), F.xxhash64("_token").alias("start"),
        F.slice("_tokens", F.col("_i") + 1, F.lit(longest)).alias("_rest"),
    )
    begun = places.join(starts, "start").select(*keys, "at", "_rest", F.explode("sizes").alias("size"))
    grams = begun.where(F.size("_rest") >= F.col("size")).select(
        *keys, "at", F.array_join(F.slice("_rest", F.lit(1), F.col("size")), " ").alias("_phrase")
    )
    grams = grams.withColumn("hash", F.xxhash64("_phrase"))
    met = grams.join(known, "hash").where(F.col("_phrase") == F.col("phrase")).select(*keys, "at", "size", "name")
    # every later step is by row, so that this is the only move
    met = met.repartition(*keys)
    # each token goes to the longest name over it; a name stays if it has all of its tokens
    claims = met.select(
        *keys, F.struct("size", (-F.col("at")).alias("first"), "name").alias("claim"),
        F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("token"),
    )
    won = claims.groupBy(*keys, "token").agg(F.max("claim").alias("claim"))
    kept = won.groupBy(*keys, "claim").agg(F.count("*").alias("tokens")).where(F.col("tokens") == F.col("claim.size"))
    return kept.select(*keys, (-F.col("claim.first")).alias("at"), "claim.size", "claim.name")


def organizations(df: DataFrame, names: DataFrame, keys: list[str], text: str = "text", name: str = "name") -> DataFrame:
    """(keys, organizations): the distinct names in each text, in order of their first place; texts without any are left out."""
    found = find_names(df, names, keys, text, name).groupBy(*keys, "name").agg(F.min("at").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return found.groupBy(*keys).agg(ordered.getField("name").alias("organizations"))


def with_organizations(
    df: DataFrame, names: DataFrame, keys: list[str], text: str = "text", name: str = "name"
) -> DataFrame:
    """Rows with their array of names, empty where there is none."""
    rest = df.drop("organizations")
    joined = attach(rest, organizations(df, names, keys, text, name), keys, "organizations")
    return joined.withColumn("organizations", F.coalesce("organizations", F.array().cast("array<string>")))
