"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words into symbols (insult, threat, target, negation, reported
speech); insults and their weights are learned from labels as words and word beginnings.
Three more transducers keep track of what stands before: a negation, reported speech, a target.
Their composition runs over a clause and weighs each insult or threat by its surroundings.  A
text's matched clauses give three features, and a logistic curve turns these into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanframe.llm.rows import Sent, kept, map_steps, picked, texts
from gleanframe.operators.columns import ident
from gleanframe.session import free, materialise

# labelled texts that the grammar is fitted on, chosen by a hash of their id (expected number)
SAMPLE = 20_000
# an entry occurs in this share of the toxic sample and is this many times likelier there, in log
LEAST_SHARE, LEAST_TEXTS, LEAST_WEIGHT, BEGINNINGS = 0.004, 3, 1.5, (3, 4, 5, 6, 7, 8)
# twice the log likelihood by which an entry's texts have to differ from the sample's mix
SIGNIFICANT, SAME_TEXTS = 30.0, 0.8
# texts are near copies when so many least hashes of their runs of so many words are equal
LEAST_RUNS, RUN_WORDS = 3, 5
# factors of the surroundings, and words that a negation or a target reaches
NEGATED, REPORTED, AIMED, AIMLESS_THREAT, REACH = 0.3, 0.5, 1.5, 0.3, 4
THREAT_WEIGHT = 2.0

# fixed values: closed word classes of the grammar
NEGATIONS = "not no never n't nicht kein keine nie non ne pas jamais nunca sin".split()
REPORTS = "said says say claimed wrote quoted called reported quote sagte schrieb dit disait dijo dice llamó".split()
TARGETS = "you your u he she they him her them people du dich ihr sie er vous tu toi il elle ils tú usted ustedes él ella ellos".split()
THREATS = "kill hurt destroy die beat shoot töten sterben tuer mourir matar morir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLOSED = {w: s for words, s in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET), (THREATS, THREAT)) for w in words}
_WORD, _END = re.compile(r"[\w']+"), re.compile(r"[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: symbol and state give the next state, and a factor for what is matched."""

    states: int
    step: dict[tuple[int, int], int]
    factor: dict[tuple[int, int], float]


def _fading(opener: int, states: int, factor) -> Transducer:
    """Counts down from ``states`` - 1 after ``opener``; never, if it does not fade."""
    step = {(s, x): states - 1 if x == opener else max(0, s - 1) for s in range(states) for x in range(6)}
    return Transducer(states, step, {(s, x): factor(s, x) for s in range(states) for x in (INSULT, THREAT)})


def negation() -> Transducer:
    return _fading(NEGATION, REACH + 1, lambda s, x: NEGATED if s else 1.0)


def target() -> Transducer:
    return _fading(TARGET, REACH + 1, lambda s, x: AIMED if s else 1.0 if x == INSULT else AIMLESS_THREAT)


def reported_speech() -> Transducer:
    step = {(s, x): 1 if x == REPORT else s for s in (0, 1) for x in range(6)}
    return Transducer(2, step, {(s, x): REPORTED if s else 1.0 for s in (0, 1) for x in (INSULT, THREAT)})


def compose(*machines: Transducer) -> Transducer:
    """One machine over the product of states; factors multiply."""
    states = list(product(*[range(m.states) for m in machines]))
    number = {s: i for i, s in enumerate(states)}
    step, factor = {}, {}
    for state in states:
        for x in range(6):
            step[number[state], x] = number[tuple(m.step[s, x] for m, s in zip(machines, state))]
            if x in (INSULT, THREAT):
                factor[number[state], x] = float(np.prod([m.factor[s, x] for m, s in zip(machines, state)]))
    return Transducer(len(states), step, factor)


@dataclass
class Grammar:
    """Learned weights: entry (a word, or a beginning that ends in ``*``) to weight, and the curve."""

    weights: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])


class Matcher:
    """Finds and weighs the matched clauses of a text."""

    def __init__(self, grammar: Grammar):
        self.curve = np.array(grammar.curve)
        self.machine = compose(negation(), reported_speech(), target())
        self.weights = grammar.weights
        self.find = ahocorasick.Automaton()
        for entry in {e.rstrip("*") for e in grammar.weights} | set(THREATS):
            self.find.add_word(entry, len(entry))
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        weight = max((w for n in range(1, len(word) + 1) if (w := self.weights.get(word[:n] + "*")) is not None), default=None)
        whole = self.weights.get(word)
        if whole is not None or weight is not None:
            return INSULT, max(x for x in (whole, weight) if x is not None)
        return _CLOSED.get(word, OTHER), THREAT_WEIGHT

    def clause(self, text: str) -> float:
        """Weight of a clause: what is matched, by its surroundings."""
        state, total = 0, 0.0
        for word in _WORD.findall(text):
            x, weight = self.symbol(word)
            if x in (INSULT, THREAT):
                total += weight * self.machine.factor[state, x]
            state = self.machine.step[state, x]
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """(log of the summed weights, heaviest clause, weight for 100 words)."""
        low = text.lower()
        total, best, done = 0.0, 0.0, 0
        for last, size in self.find.iter(low):
            start = last - size + 1
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] in "_'"):
                continue
            begin = max([done, *(low.rfind(c, done, start) + 1 for c in ".!?;\n")])
            end = _END.search(low, start)
            done = end.end() if end else len(low)
            weight = self.clause(low[begin:done])
            total, best = total + weight, max(best, weight)
        return float(np.log1p(total)), min(best, 20.0), min(100 * total / (low.count(" ") + low.count("\n") + 1), 20.0)

    def score(self, text: str) -> float:
        z = self.curve[0] + float(np.dot(self.curve[1:], self.features(text)))
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))


def entries(text: str) -> set[str]:
    """Words of a text and their beginnings, which end in ``*``."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= BEGINNINGS[0]}
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}


def _counted(df: DataFrame, only: Sent | None) -> DataFrame:
    """(entry, n): texts that hold each entry, counted per slice before the shuffle."""
    def run(columns):
        total: Counter = Counter()
        for t in texts(columns["text"]):
            found = entries(t)
            total.update(found if only is None else found & only.value)
        return list(total), list(total.values())

    return map_steps(df.select("text"), run, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries that mark toxic texts, each as long as its texts allow."""
    weights = {
        e: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(e, 0) + 0.5) / (n_clean + 1))) for e, n in toxic.items()
    }
    rate = n_toxic / (n_toxic + n_clean)

    def significance(e: str) -> float:
        t, c = toxic[e], clean.get(e, 0)
        return 2 * (t * np.log(t / ((t + c) * rate)) + (c * np.log(c / ((t + c) * (1 - rate))) if c else 0.0))

    chosen: dict[str, float] = {}
    covered: dict[str, int] = {}
    # from the longest, a whole word before a beginning of equal length
    found = (e for e, w in weights.items() if w >= LEAST_WEIGHT and significance(e) >= SIGNIFICANT)
    for e in sorted(found, key=lambda e: (-len(e.rstrip("*")), e.endswith("*"), e)):
        stem = e.rstrip("*")
        # a beginning stands for its continuations unless one of them has nearly all its texts
        if not e.endswith("*") or covered.get(stem, 0) < SAME_TEXTS * toxic[e]:
            if e.endswith("*"):
                chosen = {x: w for x, w in chosen.items() if not x.startswith(stem) or w > weights[e] + 1}
            chosen[e] = weights[e]
            for n in range(1, len(stem) + 1):
                covered[stem[:n]] = max(covered.get(stem[:n], 0), toxic[e])
    return chosen


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def _without_copies(rows: DataFrame) -> DataFrame:
    """(text, y): of the texts of a label with equal least hashes of word runs the one with the smallest key."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    # fewer words than a run holds count as one run
    last = F.greatest(F.size("words") - (RUN_WORDS - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, RUN_WORDS)))
    least = F.slice(F.array_sort(F.array_distinct(runs)), 1, LEAST_RUNS)
    marked = rows.withColumn("words", words).select("key", "text", "y", least.alias("g"))
    return marked.groupBy("y", "g").agg(F.min(F.struct("key", "text")).alias("t")).select("t.text", "y")


def fit(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
) -> Grammar:
    """Weights and curve from about ``sample`` labelled texts.

    Null labels and ids are left out; of several labels of an id the largest counts.  Without
    any label the grammar is empty and every score one half.
    """
    spark = documents.sparkSession
    known = labels.select(ident(key).alias("key"), ident(label).cast("int").alias("y")).dropna().groupBy("key").agg(F.max("y").alias("y"))
    n = known.count()
    share = min(1.0, sample / n) if n else 0.0
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    # at most the sample is broadcast, so the texts stay where they are
    rows = documents.select(ident(key).alias("key"), ident(text).alias("text")).join(F.broadcast(chosen), "key")
    # near copies would make any of their words look like a mark; the bounded sample is written once
    rows = materialise(_without_copies(rows.select("key", "text", (F.col("y") > 0).alias("y"))), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        free(rows)
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Grammar({}, [float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0])
    least = max(LEAST_TEXTS, int(LEAST_SHARE * n_toxic))
    toxic = {r["entry"]: r["n"] for r in _counted(rows.where("y"), None).where(F.col("n") >= least).collect()}
    clean = {r["entry"]: r["n"] for r in _counted(rows.where("NOT y"), Sent(spark, set(toxic))).collect()}
    grammar = Grammar(choose(toxic, clean, n_toxic, n_clean))
    sent = Sent(spark, grammar)

    def measure(columns):
        m = kept(("toxic", sent.name), lambda: Matcher(sent.value))
        return [*zip(*[m.features(t) for t in texts(columns["text"])]), columns["y"]]

    got = map_steps(rows, measure, "a double, b double, c double, y boolean").toArrow()
    free(rows)
    x = np.stack([got.column(i).to_numpy() for i in range(3)], 1)
    grammar.curve = _curve(x, got.column(3).to_numpy().astype(float))
    return grammar


def score(df: DataFrame, grammar: Grammar, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted), one row per input row; null counts as the empty text, which gets the curve's base."""
    sent = Sent(df.sparkSession, grammar)

    def run(columns):
        m = kept(("toxic", sent.name), lambda: Matcher(sent.value))
        scores = np.array([m.score(t) for t in texts(columns[text])])
        return columns[key], pa.array(scores, pa.float64()), (scores >= 0.5).astype(np.int32)

    kind = df.schema[key].dataType.simpleString()
    return map_steps(picked(df, [key, text]), run, f"`{key}` {kind}, score double, predicted int")
