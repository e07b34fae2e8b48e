"""Answers by time against a plain search, with split keys, equal times, nulls and repeated rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import asof

START = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else START + timedelta(hours=hours)


@pytest.mark.parametrize("group,within", [(1_000_000, None), (20, "5 days"), (1, "1 hours")])
def test_last_capture_before_each_row(spark, group, within):
    rng = random.Random(group)
    keys = ["hot"] * 12 + ["a", "b", "c", None]
    rows = [(i, rng.choice(keys), at(rng.choice([None, *range(300)]))) for i in range(400)] + [(7, "hot", at(50))] * 5
    captures = [(rng.choice(keys + ["d"]), at(rng.choice([None, *range(0, 300, 7)])), f"x{i}") for i in range(60)]
    left = spark.createDataFrame(rows, "id int, domain string, ts timestamp")
    right = spark.createDataFrame(captures, "domain string, fetched_at timestamp, body string")
    got = asof.as_of(left, right, within=within, group=group).collect()
    hashes = {r[:3]: r[3] for r in map(tuple, right.select("*", F.xxhash64("domain", "fetched_at", "body")).collect())}
    oldest = timedelta.max if within is None else timedelta(**{within.split()[1]: int(within.split()[0])})

    def best(key, time):
        fit = [c for c in captures if key is not None and time is not None and c[0] == key and c[1] is not None and c[1] <= time]
        last = max(fit, key=lambda c: (c[1], hashes[c]), default=None)
        return last if last and time - last[1] < oldest else None

    assert sorted(((r.id, r.domain, r.ts, r.capture and tuple(r.capture)) for r in got), key=str) == sorted(((*r, best(r[1], r[2])) for r in rows), key=str)


def test_empty_tables_and_clashing_names(spark):
    left = spark.createDataFrame([("a", at(1), "mine", 3)], "domain string, ts timestamp, body string, _n int")
    right = spark.createDataFrame([("a", at(0), "theirs")], "domain string, fetched_at timestamp, body string")
    row = asof.as_of(left, right).first()
    assert (row.body, row._n, row.capture.body) == ("mine", 3, "theirs")
    assert asof.as_of(left, right.where("false")).first().capture is None and asof.as_of(left.where("false"), right).count() == 0


def test_no_row_meets_two_captures(spark):
    left = spark.createDataFrame([("a", at(i)) for i in range(100)], "domain string, ts timestamp")
    right = spark.createDataFrame([("a", at(i), "b") for i in range(100)], "domain string, fetched_at timestamp, body string")
    out = asof.as_of(left, right)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100 and "SortMergeJoin" not in plan and "Window" in plan
