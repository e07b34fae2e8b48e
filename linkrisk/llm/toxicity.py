"""Operator 6: toxicity by a weighted finite-state pattern grammar over clauses.

The grammar reads a clause's words as symbols: insult, threat, target, negation, reported speech, other. Five transducers,
each a table of arcs, are composed into one machine: negation turns what it reaches into denied insults and takes threats
away; reported speech lowers weights; target, insult and threat keep what the clause has had. The state in which the clause
ends tells the pattern that it matches, and only matched patterns score: an insult with a target (aimed), several insults
(heaped), a threat with a target; a lone insult or a denied one is a mere mention, which alone always scores below one half,
and a threat without target is nothing. A document's score is the sum over its clauses, mapped to 0..1 by a logistic curve.

The cues are learnt: from a bounded sample of labelled rows, word stems and whole words of any length that clauses of toxic
documents have and those of others do not. They are counted by distinct clause, so that copies of one document count once.
How many clauses a cue needs follows from the odds of so many by chance, not from the sample's size, so that cues of a small
language or of a rare insult are learnt too. Every row is then scored on its own within Arrow batches.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.llm import labelled

#: Most labelled rows of each class that cues and curve are learnt from.
PER_CLASS = 1500
MODULUS = 5
HELD_OUT = 0
#: Letters of the stems that are counted of every word; longer ones are sought only below a frequent stem that is not sure.
SHORTEST, LONGEST = 3, 6
#: Fewest toxic clauses of a cue, and the share of chance finds held for among cues (Benjamini-Hochberg).
LEAST, CHANCE = 4, 0.01
#: Ends a cue that is a whole word.
END = " "

# Function words of the grammar and its threats, in English, French, German and Spanish.
TARGETS = frozenset("you your youre u he she they them this these those all tu toi vous ton votre ces cet du dich dir ihr dein euch diese er sie usted te tus ustedes ese esos este".split())
NEGATIONS = frozenset("not never no isn aren wasn don doesn didn cannot without ne pas jamais nicht kein keine nie nunca sin ni".split())
REPORTS = frozenset("said says say claimed claims called calls wrote quoted reported quote alleged accused dit dite sagte sagt dijo dice".split())
THREATS = frozenset(
    """kill murder hurt destroy strangle burn beat stab shoot smash tuer tuerai frapper frapperai brûler brûlerai étrangler égorger
    töten töte umbringen schlagen verbrennen erwürgen matar mataré golpear golpearé quemar quemaré estrangular""".split()
)

NEGATED, REPORTED, REACH = 0.35, 0.6, 3
#: What counts of the insults of a clause by the pattern that it matches, and a threat's weight.
AIMED, HEAPED, MENTIONED, THREAT = 1.3, 1.0, 0.4, 3.0
#: Weights of cues are held within these.
LEAST_WEIGHT, MOST_WEIGHT = 3.2, 4.0
#: The sum at which the score is one half, in terms of the weightiest lone mention: more than one, so that none alone reaches it.
HALF_LEAST, HALF_MOST = 1.05, 1.25
CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W_]+")

INSULT, DENIED, THREATEN, TARGET, NEGATION, REPORT, OTHER = "insult denied threat target negation report other".split()
SYMBOLS = (INSULT, DENIED, THREATEN, TARGET, NEGATION, REPORT, OTHER)
#: state, symbol read -> next state, symbol written, factor on the word's weight
Arcs = dict[tuple[str, str], tuple[str, str, float]]


def transducer(states: list[str], special: Arcs, rest: dict[str, str] | None = None) -> Arcs:
    """The arcs of a machine: the special ones; all others write what they read and lead to ``rest`` or stay."""
    arcs = {(q, x): ((rest or {}).get(q, q), x, 1.0) for q in states for x in SYMBOLS}
    return arcs | special


def negation() -> Arcs:
    """States: how many words a negation still reaches."""
    states = [str(n) for n in range(REACH + 1)]
    special: Arcs = {(q, NEGATION): (str(REACH), NEGATION, 1.0) for q in states}
    for n in range(1, REACH + 1):
        special[str(n), INSULT] = (str(n - 1), DENIED, NEGATED)
        special[str(n), THREATEN] = (str(n - 1), OTHER, 0.0)
    return transducer(states, special, {str(n): str(max(0, n - 1)) for n in range(REACH + 1)})


REPORTING = transducer(
    ["own", "told"],
    {("own", REPORT): ("told", REPORT, 1.0), **{("told", x): ("told", x, REPORTED) for x in (INSULT, DENIED, THREATEN)}},
)
AIMING = transducer(["none", "named"], {("none", TARGET): ("named", TARGET, 1.0)})
INSULTING = transducer(
    ["none", "mention", "one", "more"],
    {("none", DENIED): ("mention", DENIED, 1.0), ("none", INSULT): ("one", INSULT, 1.0), ("mention", INSULT): ("one", INSULT, 1.0), ("one", INSULT): ("more", INSULT, 1.0)},
)
THREATENING = transducer(["none", "threat"], {("none", THREATEN): ("threat", THREATEN, 1.0)})
MACHINES = ((negation(), "0"), (REPORTING, "own"), (AIMING, "none"), (INSULTING, "none"), (THREATENING, "none"))


def composed(machines: tuple[tuple[Arcs, str], ...]) -> tuple[dict[tuple[int, str], tuple[int, float]], list[tuple[str, ...]]]:
    """One machine that passes each symbol through all of them in turn: its arcs between numbered states, and the states."""
    states = [tuple(start for _, start in machines)]
    number = {states[0]: 0}
    arcs: dict[tuple[int, str], tuple[int, float]] = {}
    for at, state in enumerate(states):  # grows as states are found
        for read in SYMBOLS:
            symbol, factor, after = read, 1.0, []
            for (table, _), q in zip(machines, state, strict=True):
                q, symbol, f = table[q, symbol]
                after.append(q)
                factor *= f
            if tuple(after) not in number:
                number[tuple(after)] = len(states)
                states.append(tuple(after))
            arcs[at, read] = (number[tuple(after)], factor)
    return arcs, states


ARCS, STATES = composed(MACHINES)


def accepted(state: tuple[str, ...]) -> tuple[float, float]:
    """What counts of a clause's insults and of its threats, by the state in which it ends."""
    _, _, target, insult, threat = state
    aimed = target == "named"
    insults = {"none": 0.0, "mention": MENTIONED, "one": AIMED if aimed else MENTIONED, "more": AIMED if aimed else HEAPED}[insult]
    return insults, 1.0 if aimed and threat == "threat" else 0.0


FINAL = [accepted(q) for q in STATES]


@dataclass
class Grammar:
    """Cues (stems, or whole words with END behind) with their weights and the logistic curve's slope and offset."""

    cues: dict[str, float] = field(default_factory=dict)
    slope: float = 2.0
    offset: float = -2.0 * HALF_LEAST * MENTIONED * MOST_WEIGHT

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.cues if not s.endswith(END)})
        by_letter: dict[str, list[str]] = defaultdict(list)
        for s in sorted({*self.cues, *(t + END for t in THREATS)}, key=lambda s: (-len(s), s)):
            by_letter[s[0]].append(re.escape(s[1:-1]) + r"(?![^\W_])" if s.endswith(END) else re.escape(s[1:]))
        self.any = re.compile(r"\b(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")")

    def weight(self, word: str) -> float:
        """An insult's weight, 0 for other words."""
        found = [self.cues.get(word[:n], 0.0) for n in self.lengths if n <= len(word)]
        return max([self.cues.get(word + END, 0.0), *found])

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's symbol and weight."""
        weight = self.weight(word)
        if weight:
            return INSULT, weight
        if word in THREATS:
            return THREATEN, THREAT
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS:
            return NEGATION, 0.0
        return (REPORT if word in REPORTS else OTHER), 0.0

    def clause(self, clause: str) -> float:
        """The weight of the clause's path through the composed machine."""
        state = 0
        insults = threats = 0.0
        for word in WORD.findall(clause):
            read, weight = self.symbol(word)
            state, factor = ARCS[state, read]
            if read == INSULT:
                insults += weight * factor
            elif read == THREATEN:
                threats += weight * factor
        of_insults, of_threats = FINAL[state]
        return insults * of_insults + threats * of_threats

    def sum(self, text: str | None) -> float:
        """The sum over the clauses that hold a cue."""
        if not text:
            return 0.0
        lowered = text.lower()
        total, at = 0.0, 0
        while m := self.any.search(lowered, at):
            start = max(lowered.rfind(c, at, m.start()) for c in ".!?;:\n") + 1
            over = CLAUSE.match(lowered, m.start()).end()
            total += self.clause(lowered[max(start, at) : over])
            at = over
        return total

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * self.sum(text) + self.offset))))


def stems_of(text: str) -> Iterator[tuple[str, int]]:
    """Each short stem and whole word (END behind) of the text with the checksum of the first clause that has it."""
    seen: set[str] = set()
    for clause in CLAUSE.findall(text.lower()):
        mark = zlib.crc32(clause.strip().encode("utf-8", "replace"))
        for word in WORD.findall(clause):
            if word + END in seen:
                continue
            seen.add(word + END)
            yield word + END, mark
            for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
                if word[:n] not in seen:
                    seen.add(word[:n])
                    yield word[:n], mark


def found_in(rows: DataFrame, below: set[str] | None = None) -> DataFrame:
    """Distinct (stem, clause, label) of (text, label); with ``below`` only whole words of more than LONGEST letters that start with one of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(0), batch.column(1).to_pylist(), strict=True)
            found = [(s, m, label) for v, label in texts for s, m in stems_of(v.as_py() or "") if below is None or len(s) > LONGEST + 1 and s[:LONGEST] in below]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["stem", "clause", "label"])

    return rows.select("text", "label").mapInArrow(run, "stem string, clause long, label int").distinct()


def counted(rows: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many distinct clauses of toxic and of other documents a short stem or whole word comes first."""
    return found_in(rows).groupBy("stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def branches(words: list[str]) -> list[tuple[str, int, int]]:
    """(stem, start, stop) of each stem of more than LONGEST letters that neighbours among the sorted words share, and of those that share it.

    Any other stem has the same words as the next longer of these, or a single word.
    """
    out, open_, common = [], [], 0
    for i in range(1, len(words) + 1):
        common = len(os.path.commonprefix([words[i - 1], words[i]])) if i < len(words) else 0
        start = i - 1
        while open_ and open_[-1][0] > common:
            n, start = open_.pop()
            out.append((words[i - 1][:n], start, i))
        if common > LONGEST and (not open_ or open_[-1][0] < common):
            open_.append((common, start))
    return out


def longer_stems(rows: DataFrame, below: set[str]) -> DataFrame:
    """(stem, toxic, clean) of the longer stems that start with one of ``below``; clauses are those where their words come first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        clauses: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for word, clause, label in zip(group["stem"], group["clause"], group["label"], strict=True):
            clauses[word.removesuffix(END)].add((clause, label))
        words = sorted(clauses)
        found = []
        for stem, start, stop in branches(words):
            held = set().union(*(clauses[w] for w in words[start:stop]))
            toxic = sum(label for _, label in held)
            if toxic >= LEAST:
                found.append((stem, toxic, len(held) - toxic))
        return pd.DataFrame(found, columns=["stem", "toxic", "clean"])

    return found_in(rows, below).groupBy(F.left("stem", F.lit(LONGEST))).applyInPandas(run, "stem string, toxic long, clean long")


def log_chance(a: int, b: int, share: float) -> float:
    """The logarithm of the chance of at most b clean among a + b clauses, if each is toxic with ``share``."""
    if share <= 0 or share >= 1:
        return 0.0
    n = a + b
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + (n - j) * math.log(share) + j * math.log(1 - share) for j in range(b + 1)]
    return max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))


def significant(stems: dict[str, tuple[int, int]], tested: int, share: float) -> dict[str, tuple[int, int]]:
    """Those of the stems that stand out from ``tested`` ones beyond chance (Benjamini-Hochberg)."""
    line = sorted((log_chance(a, b, share), s) for s, (a, b) in stems.items())
    last = max((i for i, (p, _) in enumerate(line, 1) if p <= math.log(CHANCE * i / tested)), default=0)
    return {s: stems[s] for _, s in line[:last]}


def chosen(stems: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The cues: sure enough, stems as long as they lose no clauses by it, and not within a shorter cue."""
    weights = {
        s: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        for s, (a, b) in stems.items()
    }
    lengths = sorted({len(s) for s in stems})
    longer: dict[str, int] = defaultdict(int)
    for s, (a, _) in stems.items():
        # a whole word does not stand in for its stem, which has its other forms too
        if not s.endswith(END):
            for n in lengths:
                if n < len(s) and s[:n] in stems:
                    longer[s[:n]] = max(longer[s[:n]], a)
    cues: dict[str, float] = {}
    for s in sorted(stems, key=lambda s: (len(s), s)):
        a, b = stems[s]
        sure = weights[s] >= LEAST_WEIGHT and b <= a / 50
        if sure and longer[s] < 0.95 * a and not any(n < len(s) and s[:n] in cues for n in lengths):
            cues[s] = min(MOST_WEIGHT, weights[s])
    return cues


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Grammar:
    """Cues and curve from at most ``per_class`` rows of each label. Without toxic rows there are no insults, only the fixed threats.

    Rows of ``labels`` that repeat a doc_id count once, as toxic if any of them is.
    """
    rows = labelled.sample(docs, labels, label, modulus, held_out, per_class).persist()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    # of a bounded sample, what several of its toxic clauses share
    table = counted(rows).persist()
    mass = table.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    found = table.where(F.col("toxic") >= LEAST).collect()
    table.unpersist()
    impure = {r.stem for r in found if len(r.stem) == LONGEST and not r.stem.endswith(END) and r.clean * 50 > r.toxic}
    found += longer_stems(rows, impure).collect() if impure else []
    # the share of toxic clauses that chance would give
    share = max(n_toxic / max(1, n_toxic + n_clean), (mass.toxic or 0) / max(1, (mass.toxic or 0) + (mass.clean or 0)))
    sure = significant({r.stem: (r.toxic, r.clean) for r in found if r.clean * 50 <= r.toxic}, len(found), share)
    grammar = Grammar(chosen(sure, n_toxic, n_clean))
    sums = summed(rows.select(F.col("label").alias("key"), "text"), grammar).collect()
    rows.unpersist()
    if sums:
        x = np.array([r.total for r in sums])
        y = np.array([r.key for r in sums], float)
        a, b = 0.5, -2.0
        for _ in range(200):  # gradient steps with a light pull towards the start
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
            h = p * (1 - p)
            hessian = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
            gradient = np.array([((p - y) * x).sum() + 0.1 * (a - 0.5), (p - y).sum() + 0.1 * (b + 2.0)])
            step = np.linalg.solve(hessian, gradient)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        lone = MENTIONED * max([LEAST_WEIGHT, *grammar.cues.values()])
        grammar.slope = float(max(a, 0.5))
        grammar.offset = -grammar.slope * float(np.clip(-b / grammar.slope, HALF_LEAST * lone, HALF_MOST * lone))
    return grammar


def summed(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """(key, total): the grammar's sum of every row of (key, text)."""
    sent = rows.sparkSession.sparkContext.broadcast((grammar.cues, grammar.slope, grammar.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Grammar(*sent.value)
        for batch in batches:
            totals = [made.sum(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.float64())], names=["key", "total"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, total double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text has no clause and gets the curve's offset. Whole texts are read; repeated rows get equal scores;
    other columns are ignored; an empty table gives an empty one.
    """
    grammar = fit(docs, labels)
    totals = summed(docs.select(F.col("doc_id").alias("key"), "text"), grammar).withColumnRenamed("key", "doc_id")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("total") * grammar.slope + grammar.offset))))
    return totals.select(
        "doc_id", (labelled.remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
