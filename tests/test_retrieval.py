import pyarrow as pa
import random

import numpy as np
import pytest

from bidloom.operators import retrieval


def naive_chunks(text, size, overlap, seps):
    """String version of recursive splitting with kept leading separators."""

    def cut(body, sep):
        parts = body.split(sep)
        return [p for p in [parts[0], *[sep + x for x in parts[1:]]] if p]

    def merge(parts):
        out, window = [], []
        for part in parts:
            if window and sum(map(len, window)) + len(part) > size:
                joined = "".join(window).strip()
                if joined:
                    out.append(joined)
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                    window.pop(0)
            window.append(part)
        joined = "".join(window).strip()
        return out + ([joined] if joined else [])

    def run(body, seps):
        at = next((i for i, s in enumerate(seps) if s in body), len(seps) - 1)
        rest, out, small = seps[at + 1 :], [], []
        for part in cut(body, seps[at]):
            if len(part) < size:
                small.append(part)
                continue
            out += merge(small)
            small = []
            out += run(part, rest) if rest else [part]
        return out + merge(small)

    return run(text, seps)


@pytest.mark.parametrize("seed", range(30))
def test_chunks_equal_the_string_version(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "c ", " ", ".", "!", "?", "\n", "\n\n", "word"]) for _ in range(rng.randint(0, 400)))
    size, overlap = rng.choice([(20, 5), (40, 10), (100, 20), (7, 0)])
    got = [text[a:b] for a, b in retrieval.chunk_spans(text, size, overlap, retrieval.SEPARATORS)]
    assert got == naive_chunks(text, size, overlap, retrieval.SEPARATORS)


def test_chunk_table(spark):
    text = "Payment terms are 30 days.\nPenalty applies.\n" * 20
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 300)], "doc_id long, text string")
    out = retrieval.chunk_documents(df, size=100, overlap=20).orderBy("doc_id", "chunk_no").collect()
    first = [r for r in out if r["doc_id"] == 1]
    assert [r["chunk_no"] for r in first] == list(range(1, len(first) + 1))
    assert all(len(r["chunk_text"]) <= 100 for r in first)
    assert [len(r["chunk_text"]) for r in out if r["doc_id"] == 4] == [300]
    assert {r["doc_id"] for r in out} == {1, 4}


@pytest.mark.parametrize("block", [3, 2048])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(500, 8)).round(1)
    vectors[250:400] = vectors[0]  # a third of the vectors are copies
    asked = vectors[:10]
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    questions = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(asked)], "question_id long, question_embedding array<double>"
    )
    got = retrieval.nearest_chunks(chunks, questions, 5, block=block).orderBy("question_id", "rank").collect()
    v32 = vectors.astype(np.float32).astype(float)
    for q in range(10):
        d = np.sqrt(((v32 - asked[q]) ** 2).sum(axis=1))
        want = sorted(range(500), key=lambda i: (d[i], i))[:5]
        assert [r["vec_id"] for r in got if r["question_id"] == q] == want
        assert [r["distance"] for r in got if r["question_id"] == q] == pytest.approx([d[i] for i in want])


def test_no_questions(spark):
    chunks = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "question_id long, question_embedding array<double>")
    assert retrieval.nearest_chunks(chunks, none).count() == 0


def test_embedding_width_and_length(spark):
    df = spark.createDataFrame([(1, "payment terms of the contract"), (2, "penalty for late delivery"), (3, "payment")], "doc_id int, chunk_text string")
    out = retrieval.embed(retrieval.fit_embedding(df), df).collect()
    assert all(len(r["embedding"]) == 384 for r in out)
    assert np.linalg.norm(out[0]["embedding"]) == pytest.approx(1.0, abs=1e-5)
    assert retrieval.embed(retrieval.fit_embedding(df), df).columns == ["doc_id", "chunk_text", "embedding"]


def test_context_sources_prompts(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b.txt", "gcc", "second", 0.9), (1, 1, "a.txt", "scc", "first" * 100, 0.3)],
        "question_id int, rank int, filename string, folder string, chunk_text string, distance double",
    )
    context = retrieval.pack_context(hits).first()["context"]
    assert context == "[a.txt]\n" + "first" * 100 + "\n\n[b.txt]\nsecond"
    sources = retrieval.source_list(hits)
    assert {len(r["content"]) for r in sources.collect()} == {203, 9}
    assert tuple(retrieval.confidence_band(sources).first())[1:] == (pytest.approx(0.6), "Medium")
    asked = spark.createDataFrame(
        [(1, "C {question}", "Why?", "t" * 7000), (2, "", "", "")],
        "doc_id int, context string, question string, text string",
    )
    prompt = retrieval.answer_prompts(asked).first()["prompt"]
    assert "Context:\nC {question}\n\nQuestion: Why?\n\n" in prompt
    parts = retrieval.summary_prompts(asked, style="short").orderBy("doc_id", "part").collect()
    assert [(r["doc_id"], r["part"], r["n_parts"]) for r in parts] == [(1, 1, 2), (1, 2, 2), (2, 1, 1)]
    assert ["t" * n in r["prompt"] and "t" * (n + 1) not in r["prompt"] for n, r in zip((6000, 1000), parts)] == [True] * 2
    summaries = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "doc_id int, part int, summary string")
    assert "first\n\nsecond" in retrieval.joined_summary_prompts(summaries).first()["prompt"]


def test_many_questions_and_the_approximate_form(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    asked = vectors[:300] + rng.normal(scale=0.05, size=(300, 16)).astype(np.float32)
    rows = lambda m: [(f"v{i:04d}", [float(x) for x in v]) for i, v in enumerate(m)]
    chunks = spark.createDataFrame(rows(vectors), "vec_id string, embedding array<float>")
    questions = spark.createDataFrame(rows(asked), "question_id string, question_embedding array<float>")
    exact = retrieval.nearest_chunks(chunks, questions, 3, block=64)
    d = ((asked[:, None].astype(float) - vectors[None].astype(float)) ** 2).sum(axis=2)
    want = {(f"v{q:04d}", f"v{v:04d}") for q in range(300) for v in np.argsort(d[q], kind="stable")[:3]}
    assert {(r["question_id"], r["vec_id"]) for r in exact.collect()} == want
    near = retrieval.nearest_chunks_lsh(chunks, questions, 3, width=16, tables=24, bits=6)
    found = {(r["question_id"], r["vec_id"]) for r in near.collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_pieces_no_separator_cuts_are_cut_by_length(spark):
    texts = [(1, "x" * 3300), (2, "short. " * 5 + "y" * 250 + ". end"), (3, "a" * 99 + " " + "b" * 150)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    out = retrieval.chunk_documents(df, size=100, overlap=20, cut_long=True).collect()
    assert max(len(r["chunk_text"]) for r in out) <= 100
    letters = lambda t: sorted(c for c in t if c not in " .")
    for i, text in texts:
        mine = "".join(r["chunk_text"] for r in out if r["doc_id"] == i)
        assert set(letters(text)) == set(letters(mine)) and len(letters(mine)) >= len(letters(text))


def test_chunks_are_returned_in_bounded_batches():
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int64()), ("chunk_text", pa.string())])
    texts = ["A sentence of some words. " * 8000] * 20 + [None, "", "last."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = list(retrieval._chunker(schema, 1500, 200, retrieval.SEPARATORS, False)(iter([batch])))
    assert len(found) >= 4 and max(b.nbytes for b in found) < 2 * retrieval.BATCH_CHARS
    spans = [retrieval.chunk_spans(t or "", 1500, 200, retrieval.SEPARATORS) for t in texts]
    expected = [(d, n, texts[d][a:b]) for d, own in enumerate(spans) for n, (a, b) in enumerate(own, 1)]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == expected
