"""Operator 13: its targets, its tree and its pieces."""

import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, pieces int, copies int"


def documents(seed=0, n=400, odd=True):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["a", "bb", "é", "x y"]) for _ in range(rng.choice([0, 1, 7, 300]))), rng.choice(["b", "a", "Z", "é"])) for i in range(n)]
    if odd:
        rows += [(1, "again and again", "a")] * 30 + [(1, "other text", "a"), (None, "no id", "b"), (None, None, "b"), (5000, None, None), (5001, " \t\n", None)]
        rows += [(5002, "one two", None), (5003, "w " * 9000, "tiny"), (5004, "", "empty"), (5005, "x" * 100000, "wide")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "1", 2, 3) for r in rows], SCHEMA)


def filled(sizes, weights=(5, 2, 1), most=3):
    """The targets by sharing anew, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left, free = {}, sum(sizes.values()), set(names)
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > most * sizes[s]}
        if not over:
            return done | {s: left * weight[s] / whole for s in free}
        done |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return done


def sizes_of(rows):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    return sizes


@pytest.mark.parametrize("seed,n,odd", [(0, 400, True), (1, 60, True), (2, 2000, False)])
def test_targets_pieces_and_sql(spark, seed, n, odd):
    rows = documents(seed, n, odd)
    got = sorted((tuple(r) for r in mixing.digest(spark, frame(spark, rows)).collect()), key=str)
    wanted = filled(sizes_of(rows))
    by_source = collections.Counter()
    targets = {}
    source = collections.defaultdict(set)
    for i, text, s in rows:
        source[i, len(WORDS.findall(text or ""))].add(s)
    assert len(got) == len(rows)
    for i, size, whole, target, taken in got:
        assert 0 <= taken <= 3 * size and whole in sizes_of(rows).values()
        own = {s for s in source[i, size] if math.isclose(wanted[s], target)}
        assert own
        by_source[target] += taken
        targets[target] = target
    assert all(abs(by_source[t] - sum(w for w in wanted.values() if math.isclose(w, t))) <= 2 for t in targets)
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    assert got == sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall(), key=str)


def test_the_same_mix_however_rows_are_stored(spark):
    rows = documents()
    first = sorted((tuple(r) for r in mixing.plan(frame(spark, rows)).collect()), key=str)
    random.Random(3).shuffle(rows)
    assert first == sorted((tuple(r) for r in mixing.plan(frame(spark, rows).repartition(7), broadcast_entries=0).collect()), key=str)


def test_pieces_are_disjoint_and_texts_are_whole(spark, tmp_path):
    rows = [r for r in documents(4, 300, False)]
    docs = frame(spark, rows)
    planned = mixing.plan(docs, shards=5, blocks=3).cache()
    texts = {i: WORDS.findall(t or "") for i, t, _ in rows}
    mix = mixing.mixed(docs, planned)
    path = str(tmp_path / "mix")
    mixing.write_shards(mix, path)
    assert spark.read.parquet(path).count() == mix.count()
    seen = collections.Counter()
    for r in mix.collect():
        assert WORDS.findall(r["text"]) == texts[r["doc_id"]][r["first"] : r["first"] + r["words"]] and 0 <= r["shard"] < 5
        for w in range(r["first"], r["first"] + r["words"]):
            seen[r["doc_id"], r["epoch"], w] += 1
    assert set(seen.values()) == {1}
    assert sum(seen.values()) == sum(p["words"] for r in planned.collect() for p in r["pieces"])


@pytest.mark.parametrize("total,marked,drawn", [(50, 20, 25), (7, 7, 3), (10, 0, 5), (400, 3, 200), (30, 25, 29), (1, 1, 1), (5, 2, 0)])
def test_hypergeometric_draws(spark, total, marked, drawn):
    n = 4000
    sql = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", f"(id + 0.5D) / {n}")
    got = collections.Counter(r[0] for r in spark.range(n).selectExpr(f"{sql} x").collect())
    for k in range(-1, drawn + 2):
        there = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) if 0 <= k <= drawn else 0
        assert abs(got[k] - n * there) <= 2


def test_tree_keeps_quotas_and_room(spark):
    counts = {0: 137, 1: 5, 2: 0, 3: 64, 4: 1}
    for shards in (1, 2, 7, 16):
        got = mixing.quotas(spark.createDataFrame(list(counts.items()), "s long, draws long"), shards, 13).collect()
        by_source, by_shard = collections.Counter(), collections.Counter()
        for s, shard, quota in got:
            assert quota >= 0
            by_source[s] += quota
            by_shard[shard] += quota
        assert all(by_source[s] == c for s, c in counts.items())
        assert len(by_shard) == shards and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_no_rows_and_no_words(spark):
    assert mixing.digest(spark, frame(spark, [])).collect() == []
    got = mixing.digest(spark, frame(spark, [(1, None, "a"), (2, "", None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_words_in(spark):
    texts = [None, "", " ", "a", " a ", "a\x0bb\x0cc\r\nd", " ", "x\x00y z", " " * 50000, "a " * 50000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words_in(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(WORDS.findall(t or "")) for t in texts]
