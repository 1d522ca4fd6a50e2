"""Periodic runs, collocations and earlier passages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from bidloom.llm import collocations, periodic_runs, super_kmers
from bidloom.llm.queries import with_planted_runs

SCHEMA = "doc_id bigint, text string, lang string, n int, words string, runs int, piece int, bucket int, id int"


def table(spark, rows):
    full = [(i, t, lang, 1, "w", 2, 3, 4, 5) for i, t, lang in ((*r, "en")[:3] for r in rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# runs


def runs_of(w, shortest):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(shortest, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def report(text, shortest=12):
    w = words_of(text)
    runs = runs_of(w, shortest)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(w), len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def periodic_texts():
    random.seed(7)
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a b " * 6, "é ü\x0b" * 40, "x\xa0y " * 30]
    for _ in range(400):
        letters = "abc"[: random.randint(1, 3)] + random.choice(["", "de"])
        w = random.choices(letters, k=random.randint(0, 80))
        if random.random() < 0.7:
            unit = random.choices(letters, k=random.randint(1, 30))
            w = w[: random.randint(0, 20)] + (unit * 40)[: random.randint(10, 200)] + w[-random.randint(1, 9) :]
        texts.append(random.choice([" ", "\n", " \t"]).join(w))
    texts += ["ab cd ef " * 15000, ("u v w " * 50 + "z ") * 40]
    return texts


def test_runs_match_brute_force(spark):
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(periodic_texts()[:-2])]
    found = periodic_runs.collapse_runs(table(spark, rows)).collect()
    names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in found) == Counter((i, *report(t)) for i, t in rows)
    for r in found:
        assert sha(r.collapsed) == r.collapsed_sha256 and len(r.runs) == r.n_runs


def test_runs_of_long_periodic_texts(spark):
    long, nested = periodic_texts()[-2:]
    found = {r.doc_id: r for r in periodic_runs.collapse_runs(table(spark, [(1, long), (2, nested)]), texts=False).collect()}
    assert tuple(found[1])[2:6] == (1, 0, 45000, 3)
    assert tuple(found[2])[1:] == report(nested)


def test_runs_other_shortest_and_empty(spark):
    rows = [(i, t) for i, t in enumerate(periodic_texts()[:200])]
    found = periodic_runs.collapse_runs(table(spark, rows), shortest=4, texts=False).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: report(t, 4) for i, t in rows}
    assert periodic_runs.collapse_runs(table(spark, rows).where("false")).count() == 0


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 90))) for i in range(600)] + [(None, "a b"), (40, None)]
    rows = [r for r in rows if r[0] != 40 or r[1] is None]
    for r in with_planted_runs(table(spark, rows)).collect():
        w = words_of(dict(rows)[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert words_of(r.text) == w


# phrases


def phrase_table(rows, least, longest, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {key: a for key, a in f.items() if a >= least}
    out = []
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[(lang, *w[:k])], f[(lang, *w[k:])]  # noqa: E741
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        around = any(
            o[0] == lang and len(o) > len(w) + 1 and b >= a and any(list(o[j : j + len(w)]) == w for j in range(1, len(o)))
            for o, b in often.items()
        )
        if not around:
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


@pytest.mark.parametrize(("top", "bits"), [(2000, 26), (7, 6)])
def test_phrases_match_brute_force(spark, monkeypatch, top, bits):
    # six bits: every place is taken, and the join alone decides
    monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (*collocations.frequent_phrases.__defaults__[:-1], bits))
    random.seed(11)
    letters = ["a", "B", "b", "é", "Ünd", "und", "日本", "x\xa0y", "c\x85", "$%", "\\", "to", "be"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", ";", "!?"]
    rows = [(None, None, "en"), (1, "", "en"), (2, " \t .;", None), (3, "to be or not " * 300, "und")]
    rows += [(4, "one phrase of five words. " * 9, "long")] * 3
    for i in range(160):
        text = "".join(random.choice(letters) + random.choice(seps) for _ in range(random.randint(0, 60)))
        rows += [(i, text, random.choice(["en", "de", None, "und"]))] * random.choice([1, 1, 3])
    found = collocations.collocations(table(spark, rows), least=9, top=top).collect()
    assert sorted(map(tuple, found)) == phrase_table(rows, 9, 5, top)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(table(spark, [(1, "a b", "en")]).where("false")).count() == 0
    assert collocations.collocations(table(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


def test_phrase_scores_past_64_bits(spark):
    rows = [(10**13, 9 * 10**17, 3 * 10**14, 7 * 10**13), (123456789012, 987654321098765, 1234567890123, 555555555555)]
    df = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    found = [r.score for r in df.select(collocations.cut_score("a", "n", "l", "r").alias("score")).collect()]
    assert sorted(found) == sorted(1000 * a * n // (l * r) for a, n, l, r in rows)


# passages


def cut_passages(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            order = (i is None, i or 0)
            first[key] = min(first.get(key, order), order)
    out = Counter()
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i is None, i or 0):
                gone |= set(range(k, k + width))
        out[(i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    return out


def shared_texts(seed, vocabulary, n):
    random.seed(seed)
    passages = [random.choices(vocabulary, k=random.randint(4, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(random.randint(0, 5)):
            w += random.choices(vocabulary, k=random.randint(0, 12))
            p = random.choice(passages)
            w += p[random.randint(0, 3) : len(p) - random.randint(0, 3)]
        texts.append(random.choice([" ", "\n", " \t "]).join(w))
    return texts


@pytest.mark.parametrize(("together", "width", "gram"), [(2000, 8, 3), (3, 8, 3), (2000, 50, 12), (2, 5, 5)])
def test_passages_match_brute_force(spark, monkeypatch, together, width, gram):
    monkeypatch.setattr(super_kmers, "TOGETHER", together)
    vocabulary = ["a", "b", "é", "日本", "x\xa0", "w1", "w2", "w3", "A"]
    texts = shared_texts(3, vocabulary, 120) + shared_texts(4, [f"v{i}" for i in range(400)], 60)
    long = " ".join(f"z{i % 700}" for i in range(1400))
    texts += [None, "", " ", long, long, long[500:4000], "q " * 300, "q " * 100, "q " * 7]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    rows += [(5, texts[9]), (9, texts[7]), (9, texts[7]), (-4, texts[30]), (None, texts[31]), *[(600, texts[12])] * 40]
    found = super_kmers.remove_earlier_passages(table(spark, rows), width=width, gram=gram).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == cut_passages(rows, width)
    assert all(sha(r.kept_text) == r.kept_sha256 for r in found)


def test_passages_of_nothing(spark):
    assert super_kmers.remove_earlier_passages(table(spark, [(1, "a")]).where("false")).count() == 0
