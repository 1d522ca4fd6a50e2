"""BPE against the tokenizers library, and passage removal against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from bidloom.llm import bpe_trie, suffix_levels
from bidloom.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, n int, seeds string, runs int, _id int"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in pairs], SCHEMA).repartition(4)


def strange_texts():
    random.seed(5)
    letters = list("abethni 1!#|\n\t") + [
        "é", "é", "ß", "İ", "Σ", "ς", "ΑΣ", " ", "\x1c", "\x85", "日", "本", "🙂", "'s", "'S", "½", "²", "\x00",
        "<|endoftext|>", "<|startoftext|>", "<|", "ﬁ", "ǅ", "ａ", "​", "﻿",
    ]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(800)]
    return [None, "", " ", "a" * 50_000, "ab" * 20_000 + "ba" * 5, "<|endoftext|>" * 3, *texts]


def test_bpe_matches_the_library(spark):
    library = pytest.importorskip("tokenizers")
    plain = library.Tokenizer.from_file(tokenizer_path())
    pairs = list(enumerate(strange_texts()))
    found = bpe_trie.encode_decode(table(spark, pairs), tokenizer_path()).collect()
    assert len(found) == len(pairs)
    for r in found:
        ids = plain.encode(pairs[r.doc_id][1] or "", add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        assert (list(r.ids), r.decoded, r.n_tokens) == (ids, decoded, len(ids)), pairs[r.doc_id][1]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_matches_the_library_on_documents(spark):
    library = pytest.importorskip("tokenizers")
    plain = library.Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe_trie.encode_decode(docs, tokenizer_path(), texts=False).collect():
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_forgets_within_bounds():
    codec = bpe_trie.Codec(tokenizer_path(), most_words=50)
    random.seed(1)
    texts = [" ".join("".join(random.choices("abcde", k=5)) for _ in range(40)) for _ in range(30)]
    whole = bpe_trie.Codec(tokenizer_path())
    assert [x for t in texts for x in codec([t])] == list(whole(texts))
    assert len(codec.trie.ids) <= 50 + 42


def test_bpe_encodes_words_that_keep_coming_once(monkeypatch):
    learned = Counter()
    learn = bpe_trie.Trie.learn
    monkeypatch.setattr(bpe_trie.Trie, "learn", lambda self, words: (learned.update(words), learn(self, words))[1])
    random.seed(2)
    usual = ["".join(random.choices("abcde", k=6)) for _ in range(20)]
    texts = [" ".join(usual + ["".join(random.choices("fghij", k=9)) for _ in range(20)]) for _ in range(40)]
    codec = bpe_trie.Codec(tokenizer_path(), most_words=120)
    found = [x for t in texts for x in codec([t])]
    assert {learned[w] for w in usual} == {1}
    held = {*codec.trie.ids, *codec.trie.older[0]}
    assert len(held) <= 120 + 2 * 42
    learned.clear()
    assert found == list(bpe_trie.Codec(tokenizer_path())(texts)) and set(learned.values()) == {1}


def test_bpe_null_ids_and_empty(spark):
    rows = bpe_trie.encode_decode(table(spark, [(None, "a"), (1, "a"), (1, "a")]), tokenizer_path()).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == ["1", "1", "None"] and {r.n_tokens for r in rows} == {1}
    assert bpe_trie.encode_decode(table(spark, [(1, "a")]).limit(0), tokenizer_path()).count() == 0


def expected_repeats(pairs, length):
    data = {i: (t or "").encode() for i, t in pairs}
    seen = Counter(t[p : p + length] for t in data.values() for p in range(len(t) - length + 1))
    out = {}
    for i, t in data.items():
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages():
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefg é", k=7))
    shared = ["".join(word() for _ in range(20)) for _ in range(4)]
    texts = [None, "", "short", "x" * 900, "ab" * 400, shared[0], shared[0]]
    for _ in range(80):
        parts = [random.choice(shared)[random.randint(0, 60) :] if random.random() < 0.5 else word() * 3 for _ in range(4)]
        texts.append("".join(parts))
    base = "".join(word() for _ in range(60))
    for _ in range(60):
        place = random.randrange(len(base))
        texts.append(base[:place] + word() + base[place + 3 :])
    return list(enumerate(texts))


@pytest.mark.parametrize("together", [2000, 7])
def test_repeated_passages(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_levels, "TOGETHER", together)
    monkeypatch.setattr(suffix_levels, "PIECE", 500)
    pairs = passages()
    found = suffix_levels.remove_repeats(table(spark, pairs), length=60, core=20).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert len(found) == len(pairs) and got == expected_repeats(pairs, 60)


def test_repeats_of_null_and_repeated_ids(spark):
    docs = table(spark, [(None, "a" * 500), (3, "b" * 399), (4, "b" * 399)])
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_levels.remove_repeats(docs).collect()}
    assert found == {None: (500, 500), 3: (399, 0), 4: (399, 0)}
    assert suffix_levels.remove_repeats(docs.limit(0)).count() == 0
    random.seed(4)
    shared = "".join(random.choices("abcdefgh ", k=900))
    alone = "".join(random.choices("abcdefgh ", k=1500))
    texts = [(None, shared), (None, "x" + shared[200:800]), (7, shared[:450]), (7, alone + shared[100:700]), (7, alone), (8, "tiny")]
    texts += [(5, "y" * 100 + shared[300:750])] * 40
    expected = expected_repeats(list(enumerate(t for _, t in texts)), 400)
    found = suffix_levels.remove_repeats(table(spark, texts)).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == Counter((i, *expected[k]) for k, (i, _) in enumerate(texts))
