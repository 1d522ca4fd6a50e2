"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import (
    bpe_trie,
    collocations,
    exact_dedup,
    license_scan,
    line_windows,
    mixture,
    near_dedup,
    ordinal_quality,
    periodic_runs,
    rule_filter,
    shards,
    suffix_levels,
    super_kmers,
)

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from the labels table."""
    grade = ordinal_quality.rating(F.col("quality"), F.col("toxic"))
    return _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ordinal_quality.grade_documents(docs, ordinal_quality.fit(docs, rated(spark, sf_dir)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_filter.apply_rules(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_windows.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_bytes")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path(), texts=False)


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), width=3, percent=85)


def file_path() -> F.Column:
    """A file tree over the documents: source, language and folder, some files being licence files."""
    folder = F.concat(F.lit("part"), F.pmod(F.floor(F.col("doc_id") / 1000), F.lit(16)).cast("string"))
    name = F.when(F.col("doc_id") % 8 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    deep = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", "lang", folder, name))
    return F.coalesce(deep, F.concat_ws("/", "source", "lang", folder, F.lit("text"), name))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("path", file_path())
    return license_scan.scan(docs)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a digest of the id, with their last words made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, a, p = F.size("_words"), F.col("_a"), F.col("_p")
    chosen = (h % 10 == 0) & (F.size(words) > 0)
    marked = docs.withColumn("_words", F.when(chosen, words)).withColumn("_a", (g % n).cast("int"))
    marked = marked.withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    turned = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.get("_words", a + (i - a) % p)))
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.array_join(turned, " "))
    return marked.withColumn("text", text).drop("_words", "_a", "_p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.collapse_runs(with_planted_runs(docs), texts=False).drop("n_words")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.remove_earlier_passages(_table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_quality_classifier,
        op3_quality_rules,
        op4_line_dedup,
        op5_suffix_dedup,
        op6_sharding,
        op7_bpe,
        op8_mixture,
        op9_near_dedup,
        op10_license_scan,
        op11_periodic_runs,
        op12_collocations,
        op13_substring_dedup,
    )
}

_WORDS = r"string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW best AS (PARTITION BY norm ORDER BY cp DESC, doc_id)""",
    "op3_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(WORDS, lambda w: w <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 7]) AS n FROM i),
        p AS (
            SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
            FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM r WHERE n > 1) GROUP BY doc_id),
        m AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                   length(array_to_string(words, ''))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   len(lines) AS n_lines,
                   len(list_intersect(list_transform(words, lambda w: lower(w)), STOPS)) AS stop_words,
                   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
                   coalesce(p.n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN p USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.1
               AND stop_words >= 2 AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.3
               AND n_words / n_lines >= 1.5 AND capitals / word_chars <= 0.5 AS kept
        FROM b""".replace("WORDS", _WORDS).replace("STOPS", str(list(rule_filter.STOP_WORDS))),
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS ln
            FROM documents WHERE text IS NOT NULL),
        w AS (
            SELECT doc_id, ln, line,
                   lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3
            FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY ln)),
        r AS (
            SELECT doc_id, ln,
                   row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, ln) > 1 AND l3 IS NOT NULL AS later
            FROM w),
        c AS (
            SELECT l.doc_id, l.ln, l.line,
                   coalesce(max(r.later::INT) OVER (PARTITION BY l.doc_id ORDER BY l.ln ROWS 2 PRECEDING), 0) AS gone
            FROM l JOIN r USING (doc_id, ln)),
        e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY ln), 0) = 0 AS opens FROM c)
        SELECT d.doc_id, coalesce(count(e.ln), 0) AS n_lines,
               coalesce(sum(gone), 0)::BIGINT AS n_removed, coalesce(sum(opens::INT), 0)::BIGINT AS n_spans,
               CASE WHEN d.text IS NOT NULL THEN
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (gone = 0), '')) END AS kept_sha256
        FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id, d.text""",
    "op8_mixture": r"""
        WITH d AS (
            SELECT doc_id, source,
                   len(list_filter(WORDS, lambda w: w <> ''))::BIGINT AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM d GROUP BY source),
        o AS (
            SELECT *, 2.0 * source_size AS cap,
                   sum(weight) OVER w AS open_weight,
                   coalesce(sum(2.0 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_caps,
                   1.5 * sum(source_size) OVER () AS total
            FROM (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS nth FROM s)
            WINDOW w AS (ORDER BY nth)),
        h AS (
            SELECT *, (total - full_caps) / (sum(weight) OVER () - open_weight + weight) AS level FROM o),
        v AS (SELECT arg_min(level, nth) FILTER (weight * level <= cap) AS level FROM h),
        t AS (
            SELECT source, source_size, least(weight * (SELECT level FROM v), cap)::DOUBLE AS target FROM s
            JOIN (SELECT source AS source_, cap FROM o) ON source IS NOT DISTINCT FROM source_),
        c AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   ('0x' || substr(md5('mixture-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
                       / 4503599627370496.0 AS coin
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               ((floor(rate) + (coin < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM c""".replace(
        "WORDS", _WORDS
    ),
    "op12_collocations": r"""
        WITH p AS (
            SELECT row_number() OVER () AS piece, lang, words FROM (
                SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words FROM (
                    SELECT coalesce(lang, 'und') AS lang,
                           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                    FROM documents))),
        n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
        g AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
        o AS (SELECT lang, k, words[i:i + k - 1] AS words FROM g, range(1, 6) AS t(k) WHERE i + k - 1 <= len(words)),
        f AS (SELECT lang, k, words, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, words, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (
            SELECT c.lang, c.words, c.k, c.a, c.cut, x.f AS l, y.f AS r, n.n,
                   (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
            FROM c JOIN f x ON x.lang = c.lang AND x.words = c.words[1:c.cut]
            JOIN f y ON y.lang = c.lang AND y.words = c.words[c.cut + 1:] JOIN n ON n.lang = c.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
        i AS (
            SELECT lang, words[j:j + m - 1] AS words, max(f) AS around
            FROM (SELECT lang, words, f, k, unnest(range(2, k)) AS m FROM f WHERE k > 2), range(1, 5) AS t(j)
            WHERE j + m - 1 <= k GROUP BY ALL),
        r AS (
            SELECT b.*, array_to_string(b.words, ' ') AS phrase
            FROM b LEFT JOIN i ON i.lang = b.lang AND i.words = b.words
            WHERE i.around IS NULL OR i.around < b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score::BIGINT AS score
        FROM r QUALIFY rank <= 2000""",
    "op13_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(WORDS, lambda w: w <> '') AS words FROM documents),
        s AS (
            SELECT r, doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM d WHERE len(words) >= 50),
        w AS (
            SELECT r, i,
                   coalesce(doc_id > min(doc_id) OVER same, FALSE)
                       OR doc_id IS NULL AND min(doc_id) OVER same IS NOT NULL AS later
            FROM s WINDOW same AS (PARTITION BY array_to_string(words[i:i + 49], ' '))),
        p AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
        c AS (
            SELECT p.r, p.i, word,
                   coalesce(max(w.later::INT) OVER (PARTITION BY p.r ORDER BY p.i ROWS 49 PRECEDING), 0) AS gone
            FROM p LEFT JOIN w ON w.r = p.r AND w.i = p.i)
        SELECT d.doc_id, count(c.i) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY c.i) FILTER (gone = 0), '')) AS kept_sha256
        FROM d LEFT JOIN c ON c.r = d.r GROUP BY d.r, d.doc_id""".replace("WORDS", _WORDS),
}
