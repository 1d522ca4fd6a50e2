"""Collocations by set-oriented relational mining over sorted occurrence relations.

Texts are cut into pieces at punctuation; equal pieces of a language become one
row with its number of copies. ``R_k`` is the relation of all occurrences (piece,
position) of frequent phrases of k words, written in that order, the positions
of a piece as one sorted list beside it. ``R_k+1`` is the merge join of ``R_k``
with itself by piece and adjacent position: a piece lies in one row, so the join
moves nothing. Its phrases are counted in groups, and only occurrences of
frequent groups are stored for the next length.

Which groups are frequent reaches the tasks as a bit set of hashes of fixed size.
It lets none of their occurrences go; what it lets through besides, more of it the
fuller it is, costs work and falls to its own exact count at the next length. Pairs, nearly all
of them rare, are counted by hash before they are counted as phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.spans import U64, Hasher, flat, mix, slices, word_spans
from bidloom.sources.staging import stage_table, stage_tables

LEAST = 100
LONGEST = 5
TOP = 2000
#: the bit set of frequent pairs has 2 ** BITS places: 8 MB
BITS = 26
#: rows of one language are ranked in this many parts first
PARTS = 64

#: bytes that end a piece; space and tab part words
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(_CAPITALS + BREAKS, _CAPITALS.lower() + b"\n" * len(BREAKS))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each piece that has a word, its words joined by one space."""
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at = flat(batch.column("text"))
            plain = data.tobytes().translate(_PLAIN)
            found, row = [], []
            for k in range(batch.num_rows):
                # line ends are gone by then, so split() parts words at spaces and tabs alone
                own = [b" ".join(w) for w in map(bytes.split, plain[at[k] : at[k + 1]].split(b"\n")) if w]
                found += own
                row += [k] * len(own)
            lang = batch.column("lang").take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([lang, pa.array(found, pa.binary()).cast(pa.string())], ["lang", "text"])


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(piece, lang, text, copies): the distinct pieces of each language that have a word."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    rows = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    cut = rows.mapInArrow(_cut, "lang string, text string")
    same = cut.groupBy("lang", "text").agg(F.count("*").alias("copies"))
    return same.select(F.monotonically_increasing_id().alias("piece"), "lang", "text", "copies")


class _Words:
    """The words of a batch of pieces: rows, places in their piece, bytes, and hashes of phrases from any of them."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.data, at = flat(batch.column("text"))
        self.start, self.end, self.per_row = word_spans(self.data, at)
        self.first = np.cumsum(self.per_row) - self.per_row
        self.row = np.repeat(np.arange(batch.num_rows), self.per_row)
        self._hash = Hasher(self.data)(self.start, self.end)
        self._lang = batch.column("lang_hash").to_numpy().view(U64)

    def candidates(self, batch: pa.RecordBatch, k: int) -> np.ndarray:
        """Words that begin two occurrences of ``k - 1`` words at adjacent positions of a piece."""
        n = len(self.row)
        if k == 2:
            return np.flatnonzero(self.row[1:] == self.row[:-1])
        known = batch.column("pos")
        sizes = np.diff(known.offsets.to_numpy())
        mark = np.zeros(n + 1, bool)
        mark[np.repeat(self.first, sizes) + known.flatten().to_numpy()] = True
        both = np.flatnonzero(mark[:-1] & mark[1:])
        return both[self.row[both] == self.row[both + 1]]

    def phrases(self, first: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words that begin at ``first``, apart for each language."""
        value = mix(self._hash[first] + self._lang[self.row[first]])
        for j in range(1, k):
            value = mix(value * U64(0xD6E8FEB86659FD93) + self._hash[first + j])
        return value


def _taken(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    place = hashes >> U64(64 - (len(bits).bit_length() + 5))
    return ((bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1)).astype(bool)


def _bit_set(frequent: DataFrame, bits: int) -> Broadcast:
    """A set of 2 ** ``bits`` places with those of ``hash`` taken; 64 places a row, so its size does not follow their number."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")
    found = frequent.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(mask).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(U64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of pairs with their numbers of copies, equal ones of a slice added up."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words = _Words(batch)
            pairs = words.candidates(batch, 2)
            value, inverse = np.unique(words.phrases(pairs, 2), return_inverse=True)
            copies = np.zeros(len(value), np.int64)
            np.add.at(copies, inverse, batch.column("copies").to_numpy()[words.row[pairs]])
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(copies)], ["hash", "copies"])


def _phrase_hashes(k: int):
    """The hash of each row's text, a phrase of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = _Words(batch)
                yield pa.RecordBatch.from_arrays([pa.array(words.phrases(words.first, k).view(np.int64))], ["hash"])

    return run


def _grouped(k: int, shared: Broadcast | None):
    """(lang, phrase, copies) of the candidates of ``k`` words, equal ones of a slice added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = _Words(batch)
                found = words.candidates(batch, k)
                if shared is not None:
                    found = found[_taken(shared.value, words.phrases(found, k))]
                langs = batch.column("lang").to_pylist()
                copies, data = batch.column("copies").to_numpy(), words.data.tobytes()
                rows, counts = words.row[found].tolist(), defaultdict(int)
                spans = zip(rows, words.start[found].tolist(), words.end[found + k - 1].tolist(), strict=True)
                for row, a, b in spans:
                    counts[langs[row], data[a:b]] += int(copies[row])
                lang, phrase = zip(*counts, strict=True) if counts else ((), ())
                columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string())]
                columns.append(pa.array(list(counts.values()), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "copies"])

    return run


_RELATION = "piece bigint, lang string, lang_hash bigint, copies bigint, text string, pos array<int>"


def _kept(k: int, shared: Broadcast):
    """``R_k``: pieces with the positions of their frequent phrases of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = _Words(batch)
                found = words.candidates(batch, k)
                found = found[_taken(shared.value, words.phrases(found, k))]
                row, sizes = np.unique(words.row[found], return_counts=True)
                pos = (found - words.first[words.row[found]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(pos))
                names = ["piece", "lang", "lang_hash", "copies", "text"]
                columns = [batch.column(c).take(pa.array(row)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, lists], [*names, "pos"])

    return run


def frequent_phrases(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    lang_col: str = "lang",
    text_col: str = "text",
    bits: int = BITS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases of up to ``longest`` words that occur ``least`` times, and (lang, n)."""
    parts = stage_table(pieces(docs, lang_col, text_col), "phrase-pieces")
    totals = parts.groupBy("lang").agg(F.sum(F.size(F.split("text", " ")) * F.col("copies")).alias("n"))
    words = parts.select("lang", "copies", F.explode(F.split("text", " ")).alias("phrase"))

    def counted(groups: DataFrame) -> DataFrame:
        return groups.groupBy("lang", "phrase").agg(F.sum("copies").alias("f")).where(F.col("f") >= least)

    def hashes(counts: DataFrame, k: int) -> DataFrame:
        rows = counts.select(F.xxhash64("lang").alias("lang_hash"), F.col("phrase").alias("text"))
        return rows.mapInArrow(_phrase_hashes(k), "hash bigint")

    found = stage_tables({"phrase-counts-1": counted(words), "phrase-totals": totals})
    every = found["phrase-counts-1"].select("lang", "phrase", F.lit(1).alias("k"), "f")
    relation = parts.where(F.contains("text", F.lit(" "))).withColumn("lang_hash", F.xxhash64("lang"))
    columns = ["piece", "lang", "lang_hash", "copies", "text"]
    pairs = relation.select(*columns).mapInArrow(_pair_counts, "hash bigint, copies bigint")
    pairs = pairs.groupBy("hash").agg(F.sum("copies").alias("f")).where(F.col("f") >= least).select("hash")
    likely = _bit_set(stage_table(pairs, "phrase-hashes"), bits)
    for k in range(2, longest + 1):
        rows = relation.select(*columns, *(["pos"] if k > 2 else []))
        groups = rows.mapInArrow(_grouped(k, likely if k == 2 else None), "lang string, phrase string, copies bigint")
        counts = stage_table(counted(groups), f"phrase-counts-{k}")
        every = every.unionByName(counts.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k < longest:
            chosen = _bit_set(hashes(counts, k), bits)
            relation = stage_table(rows.mapInArrow(_kept(k, chosen), _RELATION), f"phrases-{k}")
    return every, found["phrase-totals"]


def _first(k: Column) -> Column:
    return F.array_join(F.slice("words", F.lit(1), k), " ")


def cut_score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) of columns, exact where products pass 64 bits."""
    wide = [f"cast({c} as decimal(19,0))" for c in (a, n, l, r)]
    return F.expr(f"cast(1000 * {wide[0]} as decimal(22,0)) * {wide[1]} div ({wide[2]} * {wide[3]})")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The phrases of 2 to ``longest`` words whose words belong together most, per language.

    Texts are lower-cased (A-Z) and cut into pieces at punctuation and line
    breaks; words are what spaces and tabs part. ``f`` counts all occurrences
    inside pieces, overlapping ones too, and ``n`` all words of the language.
    A candidate has a = f >= ``least``. Cut behind its first k words it scores
    floor(1000 a n / (l r)), l and r being the f of its two parts; the cut with
    the smallest score counts, the first of equal ones. A candidate that lies in
    a longer candidate of equal f is left out, since it never occurs alone.

    Returns the first ``top`` of each language by score, a (both descending) and
    phrase: lang, rank, phrase, a, l, r, n, score.

    A null text has no words, a null language is ``und``. Rows need no ids: every
    row counts, repeated ones as often as they occur. An empty table gives no
    rows; other columns are not read. All figures are exact: products are
    decimals of 38 digits, and no phrase is left out but by its count.
    """
    every, totals = frequent_phrases(docs, least, longest, lang_col, text_col)
    every = stage_table(every, "phrases-frequent")
    candidates = every.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def f_of(part: str, name: str) -> DataFrame:
        return every.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))

    cuts = candidates.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "k", "a", "cut", _first(F.col("cut")).alias("before"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("behind"),
    )
    scored = (
        cuts.join(f_of("before", "l"), ["lang", "before"])
        .join(f_of("behind", "r"), ["lang", "behind"])
        .join(totals, "lang")
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct(cut_score("a", "n", "l", "r").alias("score"), "cut", "l", "r", "a", "n", "k")).alias("best"))
        .select("lang", "phrase", "best.*")
    )
    # sub-phrases that occur as often as a longer candidate around them
    inner = (
        candidates.where("k > 2")
        .select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
        .select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
        .select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("outer"))
    )
    left = scored.join(inner, ["lang", "phrase"], "left").where("outer is null or outer < a")
    order = "order by score desc, a desc, phrase"
    ranked = (
        left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        .withColumn("near", F.expr(f"row_number() over (partition by lang, part {order})"))
        .where(F.col("near") <= top)
        .withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as bigint)"))
        .where(F.col("rank") <= top)
    )
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
