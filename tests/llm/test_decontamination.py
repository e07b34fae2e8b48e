"""Operator 1 against brute force and on edge cases."""

import hashlib
import random
import re

from linkrisk.llm import decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[s : s + n]))):
                    hit |= set(range(s, s + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in docs], "doc_id long, text string, n int, w string, size int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hash int")
    rows = decontamination.find(d, b, **options)
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows.collect()], key=str)


def test_random_texts_in_blocks(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "é1", "日本", "d"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 13, 14, 20])))) for i in range(25)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(2)]
        docs.append((i, f"{parts[0]}, {rng.choice(items)[1].upper() if i % 3 else ''}; {parts[1]}"))
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, block=7) == brute(docs, items)


def test_nulls_empties_repeats_and_long_texts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (1, passage), (2, ""), (3, None), (None, "lost item here"), (4, "one two")]
    long = passage + " " + " ".join(f"u{i}" for i in range(30000))
    docs = [(1, passage), (1, passage), (1, "other text"), (2, None), (3, ""), (4, "!!!"), (None, passage), (5, long), (6, "one two " * 50), (7, "lost item here")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
