"""Sharding and mixing against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from bidloom.llm import mixture, shards

SCHEMA = "doc_id bigint, text string, source string, size int, shard string, _id string, target int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x", "y", 1) for i, t, s in rows], SCHEMA).repartition(4)


def rows(n=600):
    random.seed(6)
    sources = ["hot"] * 6 + ["b", "a", "Ä", None, "none"]
    out = []
    for k in range(n):
        text = None if k % 50 == 0 else " ".join(random.choices(["w", "ü", "long-word"], k=random.randint(0, 40)))
        out.append((k * 3, text, random.choice(sources)))
    return out


@pytest.mark.parametrize("n", [0, 5, 16, 600])
def test_shards(spark, n):
    data = rows(n)
    found = shards.interleave(table(spark, data)).collect()
    assert len(found) == n
    sizes = Counter(r.shard for r in found)
    if n >= 16:
        assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    by_id = {i: (t, s) for i, t, s in data}
    for r in found:
        slots[r.shard].append(r.slot)
        data_bytes = (by_id[r.doc_id][0] or "").encode()
        assert (r.size, r.text_crc32) == (len(data_bytes) + 1, zlib.crc32(data_bytes))
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # every shard holds the mixture: a source is off by about one row at most
    inside = Counter((r.shard, by_id[r.doc_id][1]) for r in found)
    for source, total in Counter(s for _, _, s in data).items():
        if n == 600:
            assert all(abs(inside[k, source] - total * sizes[k] / n) < 2 for k in range(16))


def test_shards_are_stable_and_take_repeats(spark):
    data = rows(100) + [(3, "again", "a")] * 3 + [(None, None, None)] * 2
    first, second = (
        sorted((repr(r.doc_id), r.size, r.shard, r.slot) for r in shards.interleave(table(spark, x)).collect())
        for x in (data, list(reversed(data)))
    )
    assert first == second and len(first) == len(data)


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixture(spark):
    data = rows(3000)
    found = mixture.mix(table(spark, data)).collect()
    size = lambda t: len((t or "").split(" ")) if t else 0
    totals = Counter()
    for _, t, s in data:
        totals[s] += size(t)
    want = expected_targets(totals)
    taken = Counter()
    for r in found:
        _, text, source = data[r.doc_id // 3]
        assert r["size"] == size(text) and r.source_size == totals[source]
        assert math.isclose(r.target, want[source], rel_tol=1e-9)
        rate = want[source] / totals[source]
        coin = int(hashlib.md5(f"mixture-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        assert r.copies == math.floor(rate) + (coin < rate % 1) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.2 * want[s] for s in want if totals[s] > 3000)
    emitted = mixture.emit(table(spark, data))
    assert emitted.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(r.doc_id for r in emitted.select("doc_id").collect()) == {
        r.doc_id: r.copies for r in found if r.copies
    }


def test_mixture_awkward(spark):
    empty = mixture.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    assert mixture.mix(table(spark, []).limit(0)).count() == 0
    one = mixture.mix(table(spark, [(1, "a b", "only"), (1, "a b", "only"), (None, "c", "only")])).collect()
    assert len(one) == 3 and all(math.isclose(r.target, 7.5) for r in one)
    assert len({r.taken for r in one if r.doc_id == 1}) == 1


def test_emit_repeated_and_null_ids(spark):
    data = [(7, "same words here", "a")] * 50 + [(8, f"other {k}", "a") for k in range(5)] + [(None, f"none {k}", "b") for k in range(9)]
    docs = table(spark, data)
    want = Counter()
    for r in mixture.mix(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixture.emit(docs).select("doc_id").collect())
    assert got == +want and got[None] > 0 and got[7] <= 2 * 50
