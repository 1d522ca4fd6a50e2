"""License scans: TF-IDF cosine of sentences to templates, and inheritance down the directories."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.sources.staging import stage_table

#: statements that name a licence, by its usual short name
TEMPLATES: dict[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
    ),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "The MIT License"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU GPL version 3",
    ),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", "Licensed under the BSD License"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0",),
    "Proprietary": ("All rights reserved",),
}
LICENCE_FILES = ("LICENSE", "LICENCE", "COPYING")
LEAST = 0.8

_WORD = "[a-z0-9]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _idf(df: Column, total: Column) -> Column:
    return F.log((total + 1) / (df + 1)) + 1


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(word, df): in how many documents each word occurs, over all whole texts."""
    return texts.select(F.explode(F.array_distinct(_words(F.col("_text")))).alias("word")).groupBy("word").agg(
        F.count("*").alias("df")
    )


def _weights(
    templates: Mapping[str, Sequence[str]], df: DataFrame, total: int, least: float
) -> tuple[list[tuple[str, str, float]], list[str]]:
    """Unit vectors of the templates, and the words of which every match must have one.

    The list of templates bounds what is looked up here.
    """
    lines = [(name, line, re.findall(_WORD, line.lower())) for name, ls in templates.items() for line in ls]
    words = sorted({w for _, _, ws in lines for w in ws})
    known = {r["word"]: r["df"] for r in df.where(F.col("word").isin(words)).collect()}
    idf = {w: math.log((total + 1) / (known.get(w, 0) + 1)) + 1 for w in words}
    vectors, signals = [], set()
    for number, (name, _, ws) in enumerate(lines):
        raw = {w: ws.count(w) * idf[w] for w in set(ws)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        unit = {w: v / norm for w, v in raw.items()}
        vectors += [(f"{name}#{number}", w, v) for w, v in unit.items()]
        # without the heaviest words, what is left cannot reach the cosine: its length bounds it
        rest = 1.0
        for w in sorted(unit, key=lambda w: (-unit[w], w)):
            if rest < (least - 1e-9) ** 2:
                break
            signals.add(w)
            rest -= unit[w] ** 2
    return vectors, sorted(signals)


def matches(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least: float = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, sentence, licence, score): every sentence close to a template.

    Sentences end at a line end or behind ``.``, ``!`` or ``?`` before a blank.
    The score is the cosine of TF-IDF vectors (words of a-z and 0-9, inverse
    frequencies over all documents), rounded to six digits; a sentence goes to
    its best template, ties to the first by name. Sentences are looked at only if
    they hold one of the words without which the score cannot be reached, which
    loses none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    total = texts.count()
    df = stage_table(document_frequencies(texts), "licence-words")
    vectors, signals = _weights(templates, df, total, least)
    signal = rf"(?<![a-z0-9])(?:{'|'.join(signals)})(?![a-z0-9])"
    sentences = F.filter(F.split("_text", r"\n|(?<=[.!?])[ \t]+"), lambda s: F.lower(s).rlike(signal))
    units = texts.select("_id", F.explode(sentences).alias("_sentence")).select(
        "_id", "_sentence", F.sha2("_sentence", 256).alias("_unit")
    )
    # one vector for each distinct sentence: a line that a third of all documents carry is scored once
    terms = (
        units.groupBy("_unit")
        .agg(F.any_value("_sentence").alias("_sentence"))
        .select("_unit", F.explode(_words(F.col("_sentence"))).alias("word"))
        .groupBy("_unit", "word")
        .agg(F.count("*").alias("tf"))
    )
    weighed = terms.join(df, "word").select(
        "_unit", "word", (F.col("tf") * _idf(F.col("df"), F.lit(total))).alias("w")
    )
    weighed = stage_table(weighed, "licence-terms")
    norms = weighed.groupBy("_unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    table = spark.createDataFrame(vectors, "template string, word string, t double")
    best = (
        weighed.join(F.broadcast(table), "word")  # a row for each word of the templates
        .groupBy("_unit", "template")
        .agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
        .join(norms, "_unit")
        .select(
            "_unit",
            F.regexp_replace("template", "#[0-9]+$", "").alias("licence"),
            F.round(F.col("dot") / F.col("norm"), 6).alias("score"),
        )
        .where(F.col("score") >= least)
        .groupBy("_unit")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
        .select("_unit", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))
    )
    return units.join(stage_table(best, "licence-sentences"), "_unit").select(
        F.col("_id").alias(id_col), F.col("_sentence").alias("sentence"), "licence", "score"
    )


def scan(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least: float = LEAST,
    licence_files: Sequence[str] = LICENCE_FILES,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "path",
) -> DataFrame:
    """The licence of every document: its own, or that of the nearest directory above it.

    Returns the id, ``path``, ``own_licence`` and ``own_score`` (its best
    sentence), ``licence``, ``from_directory`` (null unless inherited) and
    ``is_licence_file``. A directory has the licence of the licence files that
    lie in it, the best score first, then the smallest id. A document without a
    licence of its own takes the one of the deepest directory at or above its
    own that has one.

    A null or empty text has no licence of its own; a null path lies in no
    directory and inherits nothing. Ids should be unique: rows that repeat an id
    share their sentences. A null id has no own licence. An empty table gives no
    rows. Other columns are not read.
    """
    found = matches(docs, templates, least, id_col, text_col)
    own = (
        found.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
        .select("_id", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"))
    )
    places = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(path_col).cast("string").alias("path")).select(
        "_id",
        "path",
        F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
        .when(F.col("path").isNotNull(), F.lit(""))
        .alias("_dir"),
        F.coalesce(F.regexp_extract("path", "[^/]*$", 0).isin(*licence_files), F.lit(False)).alias("is_licence_file"),
    )
    rows = stage_table(places.join(own, "_id", "left"), "licence-rows")
    directories = (
        rows.where(F.col("is_licence_file") & F.col("own_licence").isNotNull() & F.col("_dir").isNotNull())
        .groupBy("_dir")
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("_id").alias("i"), F.col("own_licence").alias("l"))).alias("b"))
        .select(F.col("_dir").alias("_above"), F.col("b.l").alias("_licence"))
    )
    # each directory once, with all directories above it
    names = F.split("_dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(names)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, F.lit(1), k), "/").alias("name")),
    )
    nearest = (
        rows.select("_dir").where("_dir is not null").distinct()
        .select("_dir", F.explode(above).alias("a"))
        .select("_dir", F.col("a.depth").alias("depth"), F.col("a.name").alias("_above"))
        .distinct()
        .join(directories, "_above")
        .groupBy("_dir")
        .agg(F.max(F.struct("depth", "_above", "_licence")).alias("b"))
        .select("_dir", F.col("b._above").alias("_from"), F.col("b._licence").alias("_licence"))
    )
    inherits = F.col("own_licence").isNull() & F.col("_licence").isNotNull()
    return rows.join(stage_table(nearest, "licence-directories"), "_dir", "left").select(
        F.col("_id").alias(id_col),
        "path",
        "own_licence",
        "own_score",
        F.coalesce("own_licence", "_licence").alias("licence"),
        F.when(inherits, F.col("_from")).alias("from_directory"),
        "is_licence_file",
    )
