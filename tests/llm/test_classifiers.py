"""Operators 5 and 6: held-out accuracy on invented texts, edge cases; and the pipeline against its rules."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linkrisk.llm import bpe, labelled, quality, secrets, toxicity


def corpus(spark, n=400):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        good, toxic = i % 4 != 0, i % 5 == 2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zidiot", "zmoron", "zlowei" + rng.choice("abcd")]))
        if not good:
            words = [f"{w}###" for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        text = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        docs.append((i, text, "src", 1))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, "s", 1), (n + 1, "", "s", 1), (None, "abc", "s", 1), (n + 2, "word " * 30000, "s", 1), (0, docs[0][1], "s", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, label int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held)


def test_quality(spark):
    docs, labels = corpus(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert accuracy(rows, labels, "quality") > 0.95
    assert quality.classify(docs.limit(0), labels).count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    kept = quality.keep(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_is_learnt_from_labelled_rows_that_are_not_held_out(spark):
    docs, labels = corpus(spark, 100)
    flipped = labels.withColumn("quality", F.when(labelled.remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs, flipped))


def test_features_are_hashed_word_and_form_grams():
    assert [len(x) for x in quality.grams("The cat, the cat.")] == [6, 5, 4, 5, 4] and quality.grams("") == []
    same, other = (set(quality.features(x)[0].tolist()) for x in ("alpha beta gamma", "gamma alpha beta"))
    shared = {int(quality.hashed(np.array([quality.TOKENS[w] >> 16], np.uint64), 0)[0]) for w in ("alpha", "beta", "gamma")}
    assert shared <= same & other and same != other and len(same - other) >= 2  # beta gamma, alpha beta gamma
    ids, values = quality.features("a a b")
    assert len(ids) == len(set(ids.tolist())) and abs((values[:-1] ** 2).sum() - 1) < 1e-9


def test_updates_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.integers(0, 2))) for _ in range(200)]
    model, z, n = quality.Ftrl(), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= model.l1:
            return 0.0
        return (np.sign(z[i]) * model.l1 - z[i]) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for ids, label in rows:
        values = rng.random(len(ids))
        model.update(ids, values, label)
        w = {int(i): weight(int(i)) for i in ids}
        p = 1 / (1 + np.exp(-sum(v * w[int(i)] for i, v in zip(ids, values, strict=True))))
        for i, v in zip(ids.tolist(), values.tolist(), strict=True):
            g = (p - label) * v
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / model.alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    assert np.allclose(model.weights(np.arange(40)), [weight(i) for i in range(40)])


def test_large_samples_are_read_in_parts(spark):
    docs, labels = corpus(spark, 120)
    assert quality.fit(docs, labels, fit_bytes=5000).any()


def test_toxicity(spark):
    docs, labels = corpus(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.95
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.classify(docs, labels.limit(0)).collect())


def test_toxicity_learns_rare_cues_and_words_that_start_like_harmless_ones(spark):
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = [f"w{i % 97}", f"v{i % 89}", "abcdef" + "klmn"[i % 4], "x" * 30_000 if i % 400 == 1 else "y"]
        if toxic:
            # stems beyond six letters, a whole word within a harmless one, and an insult in 7 of 300 documents
            words += [["abcdefzz" + "pq"[i % 2]], ["harm"], ["qqrare"] if i % 225 == 10 else [f"c{i}"]][i // 5 % 3]
        else:
            words += ["harmless"] if i % 3 else [f"c{i}"]
        docs.append((i, " ".join([*words, str(i)])))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert [w for w in ("abcdefzzp", "abcdefzzq", "abcdefzzother", "harm", "qqrare") if not grammar.sum(w)] == []
    assert [w for w in ("abcdefk", "abcdefn", "harmless", "harms", "w1", "v1", "y") if grammar.sum(w)] == []


def test_grammar():
    g = toxicity.Grammar({"moron": 4.0, "lowei": 4.0})
    lone, aimed, denied, told, heaped = (g.score(x) for x in ("a moron", "you moron", "you are not a moron", "Anna claimed a moron", "moron and loweisch"))
    base = g.score("fine text")
    assert heaped > aimed > 0.5 > lone > told > denied > base
    assert g.score("moron") < 0.5 < g.score("moron. A thing. lowei") and g.score("this moron") > 0.5
    assert g.score("how to kill a process") == base and g.score("I will kill you") > 0.5 and g.score("they never kill you") == base
    assert g.sum("loweisch. other clause. Loweiß!") == 2 * 4.0 * toxicity.MENTIONED and g.sum("oxymoron") == 0.0 and g.sum(None) == 0.0


def by_definition(g, words):
    """A clause's score from each word's surroundings, without states."""
    insults, sure = 0.0, 0
    threats = 0.0
    kinds = [g.symbol(w) for w in words]
    aimed = any(k == toxicity.TARGET for k, _ in kinds)
    for i, (kind, weight) in enumerate(kinds):
        denied = any(k == toxicity.NEGATION for k, _ in kinds[max(0, i - toxicity.REACH) : i])
        told = any(k == toxicity.REPORT for k, _ in kinds[:i])
        if kind == toxicity.INSULT:
            insults += weight * (toxicity.NEGATED if denied else 1) * (toxicity.REPORTED if told else 1)
            sure += not denied
        if kind == toxicity.THREATEN and not denied:
            threats += weight * (toxicity.REPORTED if told else 1)
    pattern = toxicity.MENTIONED if not sure else toxicity.AIMED if aimed else toxicity.HEAPED if sure > 1 else toxicity.MENTIONED
    return insults * pattern + (threats if aimed else 0.0)


def test_composed_machine_equals_its_definition():
    g = toxicity.Grammar({"moron": 4.0, "lowei": 3.5, "harm ": 3.2})
    rng = random.Random(6)
    vocabulary = ["moron", "loweisch", "harm", "harmless", "kill", "you", "never", "not", "said", "word", "thing", "and"]
    for _ in range(3000):
        words = rng.choices(vocabulary, k=rng.randint(1, 9))
        assert abs(g.clause(" ".join(words)) - by_definition(g, words)) < 1e-9, words


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(spark, 200)
    rng = random.Random(2)
    base = [f"t{rng.randrange(900)}" for _ in range(60)]
    passage = " ".join(f"b{i}" for i in range(30))
    more = [(900, " ".join(base)), (901, " ".join([*base[:-1], "other"])), (902, passage), (903, "token = abcdefgh12345678 " + " ".join(f"k{i}" for i in range(40)))]
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "bpe":
            assert at.columns == docs.columns
    assert {900, 901, 902, 903} <= seen["quality"] and not {i for i in range(0, 200, 4)} & seen["quality"]
    assert 900 in seen["near_copies"] and 901 not in seen["near_copies"]
    assert 902 in seen["near_copies"] and 902 not in seen["decontamination"]
    assert seen["secrets"] == seen["decontamination"] == seen["bpe"]
    clean = spark.read.parquet(f"{tmp_path}/secrets").where("doc_id = 903").first()
    assert clean.text.startswith("[secret] k0") and clean.n_chars == len(clean.text)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, at.collect()))


def brute_stages(docs, model, items, vocabulary):
    """The pipeline's rows by plain loops: (doc_id, n_tokens, decoded checksum) of what stays."""
    rows = [r for r in docs if model(r[1]) >= 0.7]
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    rows = [r for i, r in enumerate(rows) if least[root(i)] == r[0]]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    windows = {tuple(w[i : i + min(13, len(w))]) for t in items for w in [split(t)] if w for i in range(len(w) - min(13, len(w)) + 1)}

    def contaminated(text):
        w, hit = split(text), set()
        for x in windows:
            hit |= {k for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x for k in range(i, i + len(x))}
        return bool(hit) and 20 * len(hit) >= len(w)

    out = []
    for d, text in rows:
        if not contaminated(text):
            content = text or ""
            spans = secrets.ordered(secrets.base_spans(content) + secrets.confirmed_spans(content))
            e = vocabulary.encode(secrets.redacted(content, spans, "[secret]"), add_special_tokens=False)
            out.append((d, len(e.ids), hashlib.sha256(vocabulary.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_brute_force_on_clashing_columns_and_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = corpus(spark, 160)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None][:-1]
    base = [f"t{rng.randrange(900)}" for _ in range(60)]
    items = [" ".join(f"b{i}" for i in range(30)), "short item here", None, ""]
    rows += [(900, " ".join(base)), (901, " ".join([*base[:-1], "other"])), (902, items[0]), (903, f"{items[1]} " + " ".join(f"k{i}" for i in range(20)))]
    rows += [(904, f"{items[1]} " + " ".join(f"k{i}" for i in range(200))), (905, "password: hunter2hunter2 " + " ".join(f"m{i}" for i in range(30)))]
    rows += [(906, "long " + " ".join(f"z{rng.randrange(5000)}" for _ in range(20_000))), (907, " ".join(base)), (904, f"{items[1]} " + " ".join(f"k{i}" for i in range(200)))]
    named = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_hash int, _doc_id int, dropped_doc_id int")
    named.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    weights = quality.fit(named, labels).astype("<f4")

    def model(text):
        ids, values = quality.features(text)
        return quality.sigmoid(float(values @ weights[ids]))

    vocabulary = Tokenizer.from_file(bpe.default_vocabulary())
    vocabulary.no_truncation()
    assert got == brute_stages(rows, model, items, vocabulary)
    empty = named.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, named, str(tmp_path)).columns == named.columns


def test_stages_hand_workers_small_batches(spark, monkeypatch):
    """Also where the caller writes a stage's rows: a worker that lives through all stages keeps the most it has held."""

    def sizes(docs, *args, **kwargs):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"doc_id": [0], "text": [str(batch.nbytes)]})

        return docs.mapInArrow(run, "doc_id long, text string")

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    monkeypatch.setattr(quality, "fit", lambda *args: None)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *args: None)
    for module, name, stage in ((quality, "keep", "quality"), (secrets, "redact", "secrets"), (bpe, "encode", "bpe")):
        monkeypatch.setattr(module, name, sizes)
        spark.conf.unset(limit)
        try:
            found = [int(r.text) for r in dict(corpus_pipeline.STAGES)[stage](spark, docs, "").collect()]
        finally:
            spark.conf.unset(limit)
        assert sum(found) >= 15_000_000 and max(found) < 8_000_000, stage


def test_all_weights_take_little_memory():
    """The driver holds the weights and one piece, not several arrays of their size."""
    rng, model = np.random.default_rng(3), quality.Ftrl()
    model.z, model.n = rng.normal(0, 0.05, len(model.z)), rng.random(len(model.n))
    tracemalloc.start()
    got = model.all_weights()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, model.weights(slice(None))) and (got == 0).any() and got.any()
    assert peak < 1.5 * got.nbytes


def test_labels_that_repeat(spark):
    docs, labels = corpus(spark, 100)
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, None, None), (None, 1, 1), (10**9, 1, 1)], labels.schema))
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs, again))
    assert toxicity.fit(docs, labels).cues == toxicity.fit(docs, again).cues


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    """One of a document's texts is learnt from, whichever partition holds it."""
    docs = spark.createDataFrame([(i % 20, None if i % 60 == 7 else f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None)], "doc_id long, quality int")
    orders = [docs, docs.repartition(7), docs.orderBy(F.desc("text")), docs.unionByName(docs).coalesce(1)]
    found = [sorted(map(tuple, labelled.sample(d, labels, "quality", 4, 2, 6).collect())) for d in orders]
    assert len(found[0]) == 12 and all(f == found[0] for f in found)
    lone = spark.createDataFrame([(1, None)], "doc_id long, text string")
    some = [labelled.sample(lone.withColumn("doc_id", F.lit(i).cast("long")), labels, "quality", 4, 2, 100).collect() for i in range(4)]
    assert all(r.text is None for rows in some for r in rows) and any(some)
