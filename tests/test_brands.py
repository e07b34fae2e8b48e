"""Long brand lists: look-alikes against all pairs, labels in texts against plain search, and plans that hold no list."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.functions.patterns import Automaton
from linkrisk.operators import brands, content, domain


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def word(rng, letters="abcd", low=1, high=9):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def test_automaton_finds_what_plain_search_finds():
    rng = random.Random(0)
    for _ in range(300):
        labels = tuple(sorted({word(rng, "ab-é", 1, 5) for _ in range(rng.randint(0, 12))}))
        text = word(rng, "ab-é_ .", 0, 30)
        machine = Automaton(labels)
        assert machine.parts(text) == [x for x in labels if x in text]
        every = {(i + len(x), x) for x in labels for i in range(len(text)) if text.startswith(x, i)}
        assert {(end, labels[i]) for end, i in machine.occurrences(text)} == every
        longest = sorted(labels, key=len, reverse=True)
        # a border at both ends, also where the label begins or ends with a hyphen
        pattern = r"\b(" + "|".join(map(re.escape, longest)) + r")\b"
        assert machine.words(text) == (re.findall(pattern, text) if labels else [])


def test_automaton_without_labels_and_with_an_empty_one():
    assert Automaton(()).parts("abc") == [] and Automaton(("",)).parts("abc") == [] and Automaton(("a",)).words("") == []


def test_reading_is_linear_in_the_text():
    machine = Automaton(tuple("a" * n for n in range(1, 30)) + ("aab", "abab"))
    for text in ("a" * 20_000 + "c", "ab" * 10_000):
        began = time.time()
        machine.words(text)
        assert time.time() - began < 5


def all_pairs(pairs, lines):
    """(domain, suffix) that look like a line's (label, suffix), by every label."""
    out = set()
    for d, s in pairs:
        met = [(distance(d, label), s == suffix, min(len(d), len(label))) for label, suffix in lines]
        exact = any(n == 0 and same for n, same, _ in met)
        fit = [(n, same, least) for n, same, least in met if same or s in dims.LOOKALIKE_SUFFIXES]
        fuzzy = any((n == 0 and not same) or (1 <= n <= 2 and least >= 5) for n, same, least in fit)
        if d and s and fuzzy and not exact and f"{d}.{s}" not in dims.HOSTING_PLATFORMS:
            out.add((d, s))
    return out


@pytest.mark.parametrize("rows", [brands.INDEX_ROWS, 0])
def test_lookalikes_equal_all_pairs(spark, rows):
    rng = random.Random(1)
    lines = [(word(rng, "abcdef", 3, 9), rng.choice(["com", "xyz", "net"])) for _ in range(150)]
    pairs = {(word(rng, "abcdef", 1, 10), rng.choice(["com", "xyz", "top", "org"])) for _ in range(400)}
    for label, suffix in lines[:80]:
        edited = list(label)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(edited) + 1)
            rng.choice([lambda: edited.insert(i, "q"), lambda: edited.pop(i - 1) if edited else None, lambda: edited.__setitem__(i - 1, "z") if edited else None])()
        pairs.add(("".join(edited), rng.choice([suffix, "xyz", "com"])))
    pairs |= {("", "com"), ("abc", ""), ("vercel", "app"), ("한국은행", "com"), ("한국은헹", "com")}
    lines += [("한국은행", "com"), ("한국은행입", "com")]
    listed = brands.brand_sets(spark.createDataFrame([(f"{a}.{b}",) for a, b in lines], "line string"))
    got = brands.lookalikes(spark.createDataFrame(sorted(pairs), "domain string, suffix string"), listed, index_rows=rows)
    assert {tuple(r) for r in got.collect()} == all_pairs(pairs, lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "key#" in plan


def long_lines(n):
    rng = random.Random(2)
    return [(f"{word(rng, 'abcdefghijklmnop', 5, 10)}.com",) for _ in range(n)]


def test_plans_hold_no_list_and_take_no_longer(spark):
    few, many = (brands.brand_sets(spark.createDataFrame(long_lines(n), "line string")) for n in (30, 5000))
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"https://{word(rng, 'abcdefghijklmnop', 4, 10)}.com/{word(rng, 'abcdefghijklmnop/', 10, 60)}",) for _ in range(20_000)], "url string").repartition(4).cache()
    rows.count()

    def flags(listed):
        return domain.pattern_flags(domain.with_facts(rows), listed).select("_flags.*")

    def took(listed):
        flags(listed).write.format("noop").mode("overwrite").save()
        spent = []
        for _ in range(3):
            began = time.time()
            flags(listed).write.format("noop").mode("overwrite").save()
            spent.append(time.time() - began)
        return min(spent)

    sizes = [len(flags(x)._jdf.queryExecution().optimizedPlan().toString()) for x in (few, many)]
    assert sizes[1] <= 1.1 * sizes[0]
    assert took(many) <= 2 * took(few) + 0.5


def test_words_of_titles_and_alts(spark):
    listed = brands.brand_sets(spark.createDataFrame([("naver.com",), ("t-mobile.com",), ("mobile.com",), ("한국은행.com",), ("ing.com",)], "line string"))
    texts = [["NAVER login", None], ["my t-mobile and mobile"], ["naver_x navers"], ["신한국은행", "Naver"], [], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    got = {r.i: r.b for r in df.select("i", content.brands_in(F.col("t"), listed).alias("b")).collect()}
    assert [got[i] for i in range(6)] == [["naver"], ["t-mobile", "mobile"], [], ["한국은행", "naver"], [], []]


def test_a_list_that_is_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(brands, "MAX_BRANDS", 5)
    with pytest.raises(ValueError):
        brands.brand_sets(spark.createDataFrame(long_lines(6), "line string"))


def test_a_longer_list_than_may_be_sent_meets_texts_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(brands, "MAX_BRANDS", 5)
    rng = random.Random(4)
    labels = sorted({word(rng, "abcé", 3, 6) for _ in range(200)})
    listed = brands.brand_list(spark.createDataFrame([(f"{x}.com",) for x in labels], "line string"), sent_lines=5)
    assert isinstance(listed, brands.LongBrands)
    texts = [None, "", "ab", *(word(rng, "abcé/", 1, 40) for _ in range(200)), *(word(rng, "abcdefghé", 250, 900) for _ in range(5))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.found for r in brands.with_parts(rows, "found", F.col("t"), listed.url_labels).collect()}
    names = sorted({*labels, *dims.SEEDED_LABELS})
    assert [got[i] for i in range(len(texts))] == [[x for x in names if x in (t or "")] for t in texts]
    plain = brands.brand_list(spark.createDataFrame([(f"{x}.com",) for x in labels[:4]], "line string"), sent_lines=5)
    assert isinstance(plain, brands.Brands)


def test_lookalikes_of_a_dense_list_are_settled_at_the_least_distance(spark):
    rng = random.Random(5)
    lines = sorted({(word(rng, "abc", 3, 7), rng.choice(["com", "net", "xyz"])) for _ in range(400)})
    pairs = sorted({(word(rng, "abcz", 1, 9), rng.choice(["com", "net", "top", "xyz"])) for _ in range(400)})
    listed = brands.brand_list(spark.createDataFrame([(f"{a}.{b}",) for a, b in lines], "line string"), sent_lines=5)
    got = brands.lookalikes(spark.createDataFrame(pairs, "domain string, suffix string"), listed)
    assert {tuple(r) for r in got.collect()} == all_pairs(pairs, lines) and got.count() == len(all_pairs(pairs, lines))


def test_scores_and_words_are_those_of_the_list_that_is_sent(spark):
    rng = random.Random(6)
    labels = sorted({word(rng, "abcd-é", 3, 7).strip("-") for _ in range(150)})
    lines = spark.createDataFrame([(f"{x}.{rng.choice(['com', 'xyz'])}",) for x in labels], "line string")
    lists = [brands.brand_list(lines, sent_lines=n) for n in (5, 1000)]
    assert isinstance(lists[0], brands.LongBrands) and isinstance(lists[1], brands.Brands)
    rows = [(i, f"https://{word(rng, 'abcd', 3, 7)}.{rng.choice(['com', 'top'])}/{rng.choice(labels)}") for i in range(300)] + [(300, f"https://{labels[0]}.com/login")]
    urls = spark.createDataFrame(rows, "i int, url string")
    scores = [sorted((r.i, r.domain, tuple(r.domain_signals), r.domain_score) for r in domain.score_domains(urls, x).collect()) for x in lists]
    assert scores[0] == scores[1] and any("TYPO_DOMAIN" in s for _, _, s, _ in scores[0])


def test_words_are_those_of_the_list_that_is_sent(spark):
    rng = random.Random(7)
    labels = sorted({word(rng, "abcd-é", 3, 7).strip("-") for _ in range(150)} | {"ab-cd", "abcd", "cdab"})
    lines = spark.createDataFrame([(f"{x}.com",) for x in labels], "line string")
    few, many = brands.brand_list(lines, sent_lines=1000), brands.brand_list(lines, sent_lines=5)
    texts = [[rng.choice([None, "", word(rng, "abcdABé-_ .", 1, 60), " ".join(rng.choices(labels, k=4)), "ab-cdab abcd-abcd"]) for _ in range(rng.randint(0, 3))] for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t array<string>")
    got = [{r.i: r.b for r in brands.with_words(df, "b", F.col("t"), x).collect()} for x in (many, few)]
    assert got[0] == got[1] and sum(map(len, got[0].values())) > 100


def test_urls_are_taken_apart_once_and_only_likely_lengths_are_sought(spark):
    listed = brands.brand_sets(spark.createDataFrame([("naver.com",)], "line string"))
    urls = spark.createDataFrame([("https://nnaver.com/",), (f"https://{'ab' * 16}.com/",), ("https://naver.com/login",)], "url string")
    rows = domain.score_domains(urls, listed)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "regexp_extract" not in plan  # both stand in the written flags
    assert {r.domain: "TYPO_DOMAIN" in r.domain_signals for r in rows.collect()} == {"nnaver.com": True, "ab" * 16 + ".com": False, "naver.com": False}
    plan = brands.lookalikes(spark.createDataFrame([("a" * 32, "com")], "domain string, suffix string"), listed)._jdf.queryExecution().optimizedPlan().toString()
    assert "length(domain" in plan


def test_keys_of_a_long_list_are_not_broadcast(spark, monkeypatch):
    # the files are small, but the keys made of them are many: by the files' size Spark would send them to all tasks
    monkeypatch.setattr(brands, "SENT_LINES", 0)
    listed = spark.range(2000).selectExpr("substr(md5(cast(id as string)), 1, 9) || '.com' as line")
    pairs = listed.selectExpr("'x' || substr(line, 2, 8) as domain", "'com' as suffix")
    found = domain.lookalikes(pairs, domain.brand_list(listed, 0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert found.count() > 1000
