"""Near duplicates, components, the classifier and the licence scan."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidloom.llm import components, license_scan, near_dedup, ordinal_quality
from bidloom.llm.queries import rated

SCHEMA = "doc_id bigint, text string, rep int, sig string, path string, licence int"


def table(spark, pairs, path=None):
    return spark.createDataFrame([(i, t, 1, "s", path, 3) for i, t in pairs], SCHEMA).repartition(4)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else frozenset([tuple(words)])


def expected_components(pairs, width, percent):
    sets = {i: shingles(t, width) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def variants():
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "two one", "ONE  two\tthree", "one two three", "x " * 20_000]
    for size in (8, 30, 120):
        base = random.choices(vocabulary, k=size)
        for _ in range(60):
            own = list(base)
            for _ in range(random.randint(0, max(1, size // 20))):
                own[random.randrange(size)] = random.choice(vocabulary)
            texts.append(" ".join(own))
    # a chain: each text is like the next, the ends are not alike
    walk = random.choices(vocabulary, k=100)
    for k in range(40):
        walk[k * 2] = f"new{k}"
        texts.append(" ".join(walk))
    random.shuffle(texts)
    return [(k * 11, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 256), (5, 80, 7)])
def test_near_components(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    pairs = variants()
    found = near_dedup.near_components(table(spark, pairs), width, percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}
    assert len(found) == len(pairs) and got == expected_components(pairs, width, percent)


def test_near_null_ids_repeats_and_empty(spark):
    docs = table(spark, [(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (1, "A b c d"), (9, None)])
    got = sorted(map(str, map(tuple, near_dedup.near_components(docs, 3, 85).collect())))
    assert got == sorted(
        map(str, [(None, 2, 1, False), (2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (9, 0, 9, True)])
    )
    assert near_dedup.near_components(docs.limit(0), 3, 85).count() == 0
    kept = near_dedup.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "9"]


def test_near_two_texts_under_one_id(spark):
    w1, w2 = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, w1), (1, w2), (2, w2), (3, w1 + " x"), (None, "q r s t u"), (None, "q r s t u"), *[(7, w2 + " y")] * 1000]
    found = Counter(tuple(r) for r in near_dedup.near_components(table(spark, rows), 3, 85).collect())
    assert found == Counter(
        {
            (1, 38, 1, True): 2, (2, 38, 1, False): 1, (3, 39, 1, False): 1, (None, 3, None, True): 2, (7, 39, 1, False): 1000,
        }
    )
    kept = near_dedup.keep_one(table(spark, rows), 3, 85).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", w1), ("1", w2), ("None", "q r s t u")]


def test_every_pair_under_the_distance_shares_a_key():
    layout = near_dedup.Layout.covering(85)
    rng = np.random.default_rng(1)
    kept = layout.kept()
    for _ in range(300):
        same = np.ones(layout.parts, bool)
        same[rng.choice(layout.parts, layout.most, replace=False)] = False
        assert any(same[k].all() for k in kept)


def test_signature_distance_follows_similarity():
    layout = near_dedup.Layout.covering(85)
    rng = np.random.default_rng(2)
    common = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    one, other = (np.concatenate((common, rng.integers(0, 1 << 62, 50, dtype=np.uint64))) for _ in range(2))
    sig = near_dedup.signatures(np.concatenate((one, other)), np.array([0, 950, 1900]), layout.parts)
    assert (sig[0] != sig[1]).sum() <= layout.most // 2


def test_components(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000 + k, 1000) for k in range(1, 300)]
    edges += [(5, 5), (3000, 2999), (2999, 3000)]
    random.shuffle(edges)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {found.get(k, k) for k in range(201)} == {0}
    assert {found.get(1000 + k, 1000 + k) for k in range(300)} == {1000} and found[3000] == 2999
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(rated(spark, folder), "doc_id")
    train, held = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    model = ordinal_quality.fit(train, train.select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    found = ordinal_quality.grade_documents(held, model).join(held.select("doc_id", "grade"), "doc_id")
    share = {r.grade: (r.kept, r.mean) for r in found.groupBy("grade").agg(
        F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("mean")).collect()}
    # about 2,000 ratings: enough for what is common in poor documents, few for each toxic word
    assert share[2][0] > 0.99 and share[0][0] < 0.03 and share[1][0] < 0.5
    assert share[0][1] < share[1][1] < share[2][1]


def test_classifier_finds_rare_toxic_words(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(rated(spark, folder), "doc_id").cache()
    held = docs.where("doc_id % 3 = 0")

    def kept(ratings):
        model = ordinal_quality.fit(docs, ratings)
        found = ordinal_quality.grade_documents(held, model).join(held.select("doc_id", "grade"), "doc_id")
        return {r.grade: r.kept for r in found.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}

    ratings = docs.select("doc_id", "grade")
    share = kept(ratings.where("doc_id % 3 <> 0"))
    assert share[2] > 0.99 and share[0] < 0.03 and share[1] < 0.15
    # an eighth of the ratings: some of the toxic documents go, and few clean ones
    few = kept(ratings.where("doc_id % 3 <> 0 and doc_id % 8 = 1"))
    assert few[2] > 0.97 and few[0] < 0.1 and few[1] < 0.4


def test_classifier_sample_is_shared_by_grades():
    assert ordinal_quality.shared_out({0: 2766, 1: 2162, 2: 15670}, 8000) == {1: 2162, 0: 2766, 2: 3072}
    assert ordinal_quality.shared_out({0: 9, 2: 4}, 100) == {0: 9, 2: 4} and ordinal_quality.shared_out({}, 9) == {}


def test_classifier_gradient_orders_grades():
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(900):
        grade = int(rng.integers(0, 4))
        bad = ["bad"] * (grade < 3) + ["worse"] * (grade < 2) + ["worst"] * (grade < 1)
        texts.append(" ".join([*rng.choice(["a", "b", "c"], 5), *bad]))
        grades.append(grade)
    number, ends = ordinal_quality.features(pa.array(texts), 14)
    model = ordinal_quality.fit_arrays(number, ends, np.array(grades), 4, 14)
    reach = model.at_least(model.score(number, ends))
    assert (np.rint(reach.sum(axis=1)) == grades).mean() > 0.99
    assert (np.diff(reach, axis=1) <= 0).all()


def test_classifier_awkward(spark):
    docs = table(spark, [(1, None), (None, ""), (2, "x " * 50_000), (2, "x")])
    none = ordinal_quality.fit(docs, spark.createDataFrame([], "doc_id bigint, grade int"))
    found = ordinal_quality.grade_documents(docs, none).collect()
    assert len(found) == 4 and all(0 <= r.expected_grade <= 2 for r in found)
    one = ordinal_quality.fit(docs, spark.createDataFrame([(2, 1), (2, 2), (None, 0), (1, None)], "doc_id bigint, grade int"))
    assert ordinal_quality.grade_documents(docs.limit(0), one).count() == 0


def test_licence_scan(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\nprose of the thing", "r/LICENSE"),
        (2, "nothing here", "r/a/b/two.txt"),
        (3, "Some prose. Released under the MIT License.", "r/a/three.txt"),
        (4, "All rights reserved.", "r/a/LICENSE"),
        (5, "text", "r/a/c/five.txt"),
        (6, "text", "other/six.txt"),
        (7, None, "r/seven.txt"),
        (8, "Licensed under CC BY-NC 4.0.", None),
        (9, "the licensed public version of nothing", None),
        (10, "text", None),
        (11, "", "top.txt"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, path string").withColumn("licence", F.lit(0))
    got = {r.doc_id: (r.own_licence, r.licence, r.from_directory) for r in license_scan.scan(docs).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None),
        2: (None, "Proprietary", "r/a"),
        3: ("MIT", "MIT", None),
        4: ("Proprietary", "Proprietary", None),
        5: (None, "Proprietary", "r/a"),
        6: (None, None, None),
        7: (None, "Apache-2.0", "r"),
        8: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        9: (None, None, None),
        10: (None, None, None),
        11: (None, None, None),
    }
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_filter_loses_no_sentence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r.doc_id, r.sentence) for r in license_scan.matches(docs).collect()}
    # the sentences of these documents that name a licence, found without vectors
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    named = {(i, line) for i, t in plain for line in t.split("\n") if line.startswith(("Licensed under", "Released under", "This work is licensed"))}
    assert named <= found
