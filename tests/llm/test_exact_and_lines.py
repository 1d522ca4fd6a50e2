"""Exact dedup, line windows and quality rules against plain Python, with awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidloom.llm import exact_dedup, line_windows, rule_filter

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, source string, _id string, size int, k string"


def table(spark, pairs):
    """Rows with columns whose names the operators use themselves."""
    rows = [(i, t, "s", "x", 1, "k") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def awkward():
    random.seed(4)
    words = ["a", "b", "Ä", "the", "x y"]
    texts = [None, "", " ", "\n\t", "a b", "ab", "a b", "ab ", "a" * 200_000, ("a " * 100_000)]
    texts += ["".join(random.choices(words + list(BLANKS), k=random.randint(0, 6))) for _ in range(150)]
    texts += ["same"] * 120 + ["sa me"] * 3
    random.shuffle(texts)
    return [(i * 7 - 300, t) for i, t in enumerate(texts)]


def expected_classes(pairs):
    groups = defaultdict(list)
    norm = lambda t: (t or "").translate({ord(c): None for c in BLANKS})
    for i, t in pairs:
        groups[norm(t)].append((-len(t or ""), i))
    out = {}
    for i, t in pairs:
        own = groups[norm(t)]
        best = min(own)[1]
        out[i] = (best, len(own), i == best, hashlib.sha256(norm(t).encode()).hexdigest())
    return out


@pytest.mark.parametrize("digest", ["sha", "weak"])
def test_exact_classes(spark, digest):
    pairs = awkward()
    # a digest that puts many texts together must change nothing
    kind = {} if digest == "sha" else {"digest": lambda c: F.substring(F.concat(c, F.lit("-")), 1, 1)}
    found = exact_dedup.classes(table(spark, pairs), salts=4, **kind).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found}
    assert len(found) == len(pairs) and got == expected_classes(pairs)


def test_exact_null_ids_repeats_and_empty(spark):
    docs = table(spark, [(None, "one"), (5, "one"), (None, "alone"), (7, "dd"), (7, "dd")])
    got = sorted(exact_dedup.classes(docs).drop("text_sha256").collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (7, 7, 2, True), (7, 7, 2, True)], key=repr
    )
    assert exact_dedup.classes(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_duplicates(table(spark, awkward()))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept.count() == len({v[0] for v in expected_classes(awkward()).values()})


def expected_lines(pairs, width=3):
    first = {}
    places = [(i, n, t.split("\n")) for i, t in sorted(p for p in pairs if p[1] is not None) for n in [0]]
    for i, _, lines in places:
        for at in range(len(lines) - width + 1):
            first.setdefault(tuple(lines[at : at + width]), (i, at))
    out = {}
    for i, t in pairs:
        if t is None:
            out[i] = (0, 0, 0, None)
            continue
        lines = t.split("\n")
        gone = [False] * len(lines)
        for at in range(len(lines) - width + 1):
            if first[tuple(lines[at : at + width])] != (i, at):
                gone[at : at + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(lines), sum(gone), spans, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def test_line_windows(spark):
    random.seed(8)
    texts = [None, "", "\n\n\n\n\n", "a", "a\nb\nc", "a\nb\nc\nd", "\n".join("abcabcabc"), "x\n" * 20_000]
    texts += ["\n".join(random.choices("abc", k=random.randint(1, 25))) for _ in range(60)]
    texts += ["\n".join(["head", "second", "third", str(k)]) for k in range(80)]
    pairs = [(k, t) for k, t in enumerate(texts)]
    found = line_windows.drop_repeated_lines(table(spark, pairs)).collect()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept_text) for r in found}
    assert len(found) == len(pairs) and got == expected_lines(pairs)
    assert line_windows.drop_repeated_lines(table(spark, pairs).limit(0)).count() == 0
    nulls = line_windows.drop_repeated_lines(table(spark, [(None, "a\nb\nc"), (1, "a\nb\nc")])).collect()
    assert {r.doc_id: r.n_removed for r in nulls} == {None: 3, 1: 0}


def test_lines_of_two_texts_under_one_id(spark):
    forty = "\n".join(f"line {k}" for k in range(40))
    rows = [(1, forty), (2, forty), (2, "a\nb"), (2, "z\n" + forty), (None, forty), *[(9, "p\nq\nr")] * 1000]
    found = line_windows.drop_repeated_lines(table(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in found)
    # the rows of id 9 have the passage at one place: it stays in all of them
    assert got == Counter(
        {(1, 40, 0, forty): 1, (2, 40, 40, ""): 1, (2, 2, 0, "a\nb"): 1, (2, 41, 40, "z"): 1, (None, 40, 40, ""): 1, (9, 3, 0, "p\nq\nr"): 1000}
    )


def test_line_windows_run_no_python(spark, capsys):
    docs = table(spark, [(1, "a\nb\nc"), (2, "a\nb\nc")])
    line_windows.drop_repeated_lines(docs).explain()
    assert "Python" not in capsys.readouterr().out.replace("ExistingRDD", "")


def expected_rules(text):
    words = [w for w in "".join(" " if c in BLANKS else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.translate({ord(c): None for c in BLANKS})]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            covered |= set(range(k, k + 8))
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in rule_filter.SYMBOLS for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark):
    random.seed(2)
    texts = [None, "", "   ", "\n\n", "the of " * 9 + "x", "a b c d e f g h " * 2, "z " * 30_000, "#*$%&|<> \n#\n#"]
    texts += [
        "".join(random.choice(["the ", "of ", "x", "#", "\n", "\t", "Wort ", " ", "é "]) for _ in range(random.randint(0, 300)))
        for _ in range(60)
    ]
    texts += [" ".join(random.choices("abcdef", k=random.randint(20, 200))) for _ in range(20)]
    texts += [" ".join(random.choices("ab", k=random.randint(20, 60))) for _ in range(20)]
    pairs = list(enumerate(texts))
    found = rule_filter.apply_rules(table(spark, pairs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r.doc_id: tuple(r[n] for n in names) for r in found}
    assert got == {i: expected_rules(t) for i, t in pairs}
    assert all(not (r.base_failed and r.kept) and r.kept == (not r.base_failed and not r.failed_rules) for r in found)
    assert rule_filter.apply_rules(table(spark, pairs).limit(0)).count() == 0


def test_rules_are_one_projection(spark, capsys):
    rule_filter.apply_rules(table(spark, [(1, "a")])).explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" not in plan and "ArrowEval" not in plan and plan.count("Exchange") <= 1
