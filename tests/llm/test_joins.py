"""Operators 3 and 10 against brute force and on edge cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from linkrisk.llm import jaccard, topk
from linkrisk.llm.components import components


def brute_topk(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def run_topk(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    return sorted(tuple(r) for r in topk.search(df, **options).collect())


def test_topk_with_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([0.01, 1, 30])]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 460)]
    rows += [(1000, None), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8), (1300, []), (None, [1.0] * 8), (1400, [0.0] * 8), (1500, [1.0, 2.0]), (1501, [1.0, 3.0])]
    rows += [(1600, [None] * 8), (1700, []), (1701, []), (400, [1.0] * 8), (400, [2.0] * 8), *[(500, [3.0] * 8)] * 3]
    assert run_topk(spark, rows) == brute_topk(rows)
    assert run_topk(spark, rows, block=37, query_block=2) == brute_topk(rows)
    assert run_topk(spark, rows, block=90, query_block=50, pass_size=3) == brute_topk(rows)


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e9, 1e15, 1e30])
def test_topk_of_large_components(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([1, 1, scale])]) for i in range(230)]
    rows += [(300, rows[0][1]), (301, [-x for x in rows[100][1]])]
    assert run_topk(spark, rows) == brute_topk(rows)
    assert run_topk(spark, rows, block=50) == brute_topk(rows)


def test_topk_small_tables(spark):
    assert run_topk(spark, []) == [] and run_topk(spark, [(100, [1.0])]) == []
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert run_topk(spark, rows) == brute_topk(rows)


def words(text):
    return (text or "").encode().lower().split()


def brute_join(docs, size=4, num=85, den=100):
    sets = []
    for _, t in docs:
        w = words(t)
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def run_join(spark, docs, **options):
    df = spark.createDataFrame([(d, t, 1, 2, "c") for d, t in docs], "doc_id long, text string, n int, cls int, component string")
    return sorted(tuple(r) for r in jaccard.join(df, **options).collect())


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_join_of_near_copies(spark):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    passage = fresh(30)
    texts = [fresh(n) for n in (1, 2, 3, 4, 5, 8, 12, 20, 40, 100, 300)]
    for n in (9, 15, 40, 120):
        base = fresh(n)
        texts += [edited(rng, base, e) for e in range(12)] + [base + " " + fresh(k) for k in range(1, 8)]
    texts += [passage + " " + fresh(rng.randint(5, 25)) for _ in range(25)]
    hub = fresh(60)
    texts += [edited(rng, hub, rng.randint(0, 3)) for _ in range(40)]
    texts += ["A b C d", "a B c D", "a b c d", None, "", " \t\n", "x y z w", fresh(3000)]
    docs = [(5000 - i, t) for i, t in enumerate(texts)]
    assert run_join(spark, docs) == brute_join(docs)
    assert run_join(spark, docs, block=5, broadcast_rows=0) == brute_join(docs)
    assert run_join(spark, docs, size=5, num=80) == brute_join(docs, 5, 80)


@pytest.mark.parametrize("nearest", [1, 3])
def test_join_of_large_groups_of_near_copies(spark, monkeypatch, nearest):
    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    rng = random.Random(17)
    base = " ".join(f"v{i}" for i in range(60))
    # most of them are linked with some of the others only, and some with none
    docs = [(i, edited(rng, base, rng.choice([1, 1, 2, 2, 3]))) for i in range(250)] + [(1000 + i, f"v0 v1 v2 v3 w{i} " + base[12:]) for i in range(5)]
    assert run_join(spark, docs) == brute_join(docs)


def test_join_of_repeated_rows_and_empty_tables(spark):
    docs = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, None), (3, None)]
    assert run_join(spark, docs) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)]
    assert run_join(spark, []) == []


@pytest.mark.parametrize(("num", "step"), [(85, 12), (80, 9)])
def test_signatures_are_shared_by_all_linked_sets(num, step):
    rng = random.Random(11)
    scheme = jaccard.PartEnum(num, 100)
    linked = 0
    for _ in range(1500):
        n = rng.choice([2, 4, 6, 7, 9, 13, 20, 33, 60, 200, 500])
        x = {rng.getrandbits(63) for _ in range(n)}
        y = set(x)
        for e in rng.sample(sorted(x), rng.randint(0, max(1, n // step))):
            y.discard(e)
            y.add(rng.getrandbits(63))
        y |= {rng.getrandbits(63) for _ in range(rng.randint(0, max(1, n // step)))}
        if x != y and 100 * len(x & y) >= num * len(x | y):
            linked += 1
            a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
            assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size
            assert jaccard.may_link(jaccard.sketch(a), jaccard.sketch(b), scheme.differences(len(x) + len(y)))
    assert linked > 300


def test_sketches_differ_in_at_most_as_many_bits_as_sets_in_elements():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900, np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 40, 90, 300, 900)]
    words = jaccard.as_words([jaccard.sketch(x) for x in sets])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = len(np.setxor1d(x, y))
            assert np.bitwise_count(words[i] ^ words[j]).sum() <= apart
            assert jaccard.may_link(jaccard.sketch(x), jaccard.sketch(y), apart)


def test_a_bucket_of_fifty_thousand_classes(spark):
    rng = np.random.default_rng(5)
    scheme = jaccard.PartEnum(85, 100)
    shared = rng.integers(0, 2**63, 6, np.uint64)
    sets = [np.unique(np.r_[shared, rng.integers(0, 2**63, 24, np.uint64)]) for _ in range(49_900)]
    planted = [np.unique(np.r_[x[1:], np.uint64(k)]) for k, x in enumerate(sets[:100])]
    rows = [(7, 50_000, k, k, len(x), jaccard.sketch(x)) for k, x in enumerate([*sets, *planted])]
    df = spark.createDataFrame(rows, "sig long, m long, cls long, component long, n int, sketch binary").repartition(8)
    found = [tuple(r) for r in jaccard.across(df, scheme, jaccard.BLOCK, 3).collect()]
    assert {(k, 49_900 + k, None) for k in range(100)} <= set(found) and len(found) < 1000 and all(sig is None for *_, sig in found)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
