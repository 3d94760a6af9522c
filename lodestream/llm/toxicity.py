"""Toxicity by a weighted finite-state pattern grammar (operator 8).

A text is read as a string of symbols: words of the classes insult, threat, target, negation
and reporting verb, other words, quotation marks, colons and ends of clauses and paragraphs.
Six transducers with weighted arcs rewrite it. Insult and threat read the words of their
lexicon, each by an arc of its own with the word's weight; negation marks what follows a
negator within NEAR words of the same clause; reporting marks what follows a reporting verb up
to the end of the clause (a colon does not end it) and what stands inside quotation marks, over
several clauses but within a paragraph; target marks what stands within NEAR words of a target
in the clause, after it by a transducer that reads forwards and before it by one that reads
backwards. The forward ones are composed into one machine, which together with the backward one
is a bimachine. Weights multiply along a path and add up over the matches of a clause; a
document is scored by its matched clauses. The lexicon's words, their class and their weights
are learned from labelled rows of the training part (by words' odds), as is what the clauses of
a kind count for (logistic regression).

Labels are read from at most SAMPLE rows (those of smallest hash of doc_id), and the lexicon
keeps at most LEXICON words: both are bounded parameters. Everything else runs over all rows
and whole texts, in one pass without a shuffle.

Cases: a null or empty text has no clauses and gets the score of a text without matches;
repeated rows get the same score; null labels are left out; without labels of both kinds every
score is near 1 if all labels are toxic and near 0 otherwise; extra columns are ignored; a
quotation mark that is never closed counts to the end of its paragraph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

SAMPLE = 20_000
LEXICON = 2_000
MIN_DOCS = 4  # toxic training documents that a learned word must occur in
MIN_SHARE = 0.55  # of its training documents that must be toxic
NEAR = 4  # words between a negator or target and what it bears on
LEAST = 0.05  # weight of a word's arc, at least: weights multiply, so none is negative
THREAT_SHARE = 0.5  # of a learned word's toxic documents that announce it: then it is a threat

# Seed words of the classes; insults and threats also come from the labels.
INSULTS = "idiot idiots moron morons stupid worthless pathetic scum trash loser losers clown disgusting dumb imbecile"
THREATS = "kill hurt destroy beat punish crush shoot stab"
TARGETS = "you your yours u he she they them him her his their tu vous toi du dich dir ihr sie usted ustedes ellos"
NEGATORS = "not no never neither nor isn't aren't don't doesn't wasn't pas non jamais nicht kein keine nie nunca tampoco"
REPORTERS = "said says say called calls wrote writes claimed claims reported quoted dit disait sagte sagt dijo dice"
#: words that announce a deed; a learned word that mostly stands up to two words behind is a threat
INTENT = "will gonna i'll we'll shall vais va werde wird voy"

INSULT, THREAT, TARGET, NEGATOR, REPORTER, QUOTE, OTHER = "i h t n r q w".split()
COLON, END, PARAGRAPH = ":", ".", "\n"
#: what the composed machine writes for an insult or threat: its class plus marks
DENIED, QUOTED, AIMED = "-", "\"", "@"
#: weights of the arcs that add these marks
WEIGHT = {DENIED: 0.1, QUOTED: 0.3, AIMED: 2.0}

_SYMBOL = regex.compile(r"[\p{L}\p{M}'’]+|[\"“”«»]|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Sequential and weighted: moves[state] maps a whole symbol, or the class it begins with,
    to (next state, mark to add, weight). An arc for a whole symbol writes its class, an arc
    for a class copies the symbol; either adds the mark, with its weight, unless it is there."""

    start: object
    moves: dict

    def step(self, state, symbol: str) -> tuple[object, str, float]:
        row = self.moves[state]
        arc = row.get(symbol) if len(symbol) > 1 else None
        if arc is not None:
            return arc[0], symbol[0] + arc[1], arc[2]
        nxt, mark, weight = row.get(symbol[0], row[OTHER])
        return (nxt, symbol, 1.0) if mark and mark in symbol else (nxt, symbol + mark, weight)


def _words(kind: str, weights: dict[str, float]) -> Transducer:
    """Reads the words of a class, each by an arc with its weight."""
    arcs = {f"{kind}:{w}": (0, "", x) for w, x in weights.items()}
    return Transducer(0, {0: arcs | {OTHER: (0, "", 1.0)}})


def _window(trigger: str, mark: str) -> Transducer:
    """Marks insults and threats within NEAR words after a trigger in the clause."""
    moves = {}
    for left in range(NEAR + 1):
        nxt = max(0, left - 1)
        hit = (nxt, mark, WEIGHT[mark]) if left else (nxt, "", 1.0)
        moves[left] = {OTHER: (nxt, "", 1.0), trigger: (NEAR, "", 1.0), QUOTE: (left, "", 1.0), INSULT: hit, THREAT: hit}
        moves[left] |= dict.fromkeys((COLON, END, PARAGRAPH), (0, "", 1.0))
    return Transducer(0, moves)


def _reported() -> Transducer:
    """Marks what follows a reporting verb, or stands inside quotation marks."""
    moves = {}
    for said in (False, True):
        for inside in (False, True):
            hit = ((said, inside), QUOTED, WEIGHT[QUOTED]) if said or inside else ((said, inside), "", 1.0)
            moves[said, inside] = {
                OTHER: ((said, inside), "", 1.0), REPORTER: ((True, inside), "", 1.0), QUOTE: ((said, not inside), "", 1.0),
                END: ((False, inside), "", 1.0), PARAGRAPH: ((False, False), "", 1.0), INSULT: hit, THREAT: hit,
            }
    return Transducer((False, False), moves)


class Composed:
    """The composition of transducers, determinised as it is used: states are tuples of their
    states, moves are tabled on first use (their number is bounded by the product of the states
    and the lexicon)."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start, self.moves = parts, tuple(p.start for p in parts), {}

    def step(self, state, symbol: str) -> tuple[tuple, str, float]:
        hit = self.moves.get((state, symbol))
        if hit is None:
            nxt, out, weight = [], symbol, 1.0
            for part, at in zip(self.parts, state):
                to, out, x = part.step(at, out)
                nxt.append(to)
                weight *= x
            hit = self.moves[state, symbol] = (tuple(nxt), out, weight)
        return hit


class Grammar:
    """A bimachine: a machine that reads a text forwards, and one that reads each clause with a
    match backwards."""

    def __init__(self, forwards: Composed, backwards: Composed):
        self.forwards, self.backwards = forwards, backwards

    def clauses(self, symbols: list[str]) -> Iterator[list[tuple[str, float]]]:
        """For each clause with a match, its matches in order: what is written, and the weight."""
        state, read, hit = self.forwards.start, [], False
        step, moves = self.forwards.step, self.forwards.moves
        for s in symbols:
            arc = moves.get((state, s)) or step(state, s)
            state = arc[0]
            head = s[0]
            if head == COLON or head == END or head == PARAGRAPH:
                if hit:
                    yield self._matches(read)
                read, hit = [], False
            else:
                read.append(arc)
                hit = hit or head == INSULT or head == THREAT
        if hit:
            yield self._matches(read)

    def _matches(self, read: list[tuple]) -> list[tuple[str, float]]:
        state, out = self.backwards.start, []
        for _, symbol, weight in reversed(read):
            state, symbol, x = self.backwards.step(state, symbol)
            if symbol[0] in (INSULT, THREAT):
                out.append((symbol, weight * x))
        return out[::-1]

    def run(self, symbols: list[str]) -> list[str]:
        return [symbol for clause in self.clauses(symbols) for symbol, _ in clause]


def grammar(insults: dict[str, float] | None = None, threats: dict[str, float] | None = None) -> Grammar:
    forwards = _words(INSULT, insults or {}), _words(THREAT, threats or {}), _window(NEGATOR, DENIED), _reported(), _window(TARGET, AIMED)
    return Grammar(Composed(*forwards), Composed(_window(TARGET, AIMED)))


def lexical(classes: dict[str, str], weights: dict[str, float]) -> tuple[dict[str, str], Grammar]:
    """The symbols of known words, and the grammar whose arcs carry the words' weights."""
    symbols = {w: f"{c}:{w}" if c in (INSULT, THREAT) else c for w, c in classes.items()}
    symbols |= {":": COLON, "\n": PARAGRAPH} | dict.fromkeys(".!?;", END)
    of = lambda kind: {w: weights.get(w, 1.0) for w, c in classes.items() if c == kind}
    return symbols, grammar(of(INSULT), of(THREAT))


KINDS = ("direct", "aimed", "denied", "quoted", "threat", "aimed threat")


def _kind(symbol: str) -> int:
    if DENIED in symbol:
        return 2
    if QUOTED in symbol:
        return 3
    return (4 if symbol[0] == THREAT else 0) + (AIMED in symbol)


FEATURES = 2 * len(KINDS) + 4


def features(text: str | None, symbols: dict[str, str], machine: Grammar) -> np.ndarray:
    """What the matched clauses of a whole text add up to. A clause weighs what its matches
    weigh together and is of the kind of its heaviest match."""
    out = np.zeros(FEATURES)
    read = [symbols.get(w, OTHER) for w in _SYMBOL.findall((text or "").lower())]
    clauses, weights = [0] * len(KINDS), [0.0] * len(KINDS)
    top = 0.0
    for matches in machine.clauses(read):
        weight = sum(x for _, x in matches)
        k = _kind(max(matches, key=lambda m: m[1])[0])
        clauses[k] += 1
        weights[k] += weight
        top = max(top, weight)
    n = max(1, sum(s not in (COLON, END, PARAGRAPH, QUOTE) for s in read))
    for k, (c, x) in enumerate(zip(clauses, weights)):
        out[2 * k], out[2 * k + 1] = math.log1p(c), math.log1p(1000 * x / n)
    total = sum(weights)
    out[-4:] = math.log1p(total), math.log1p(100 * total / n), top, math.log1p(1000 * sum(clauses) / n)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last), by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    reg = np.full(len(w), l2 * len(x))
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(reg), z.T @ (p - y) + reg * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def held_out(mod: int, held: int):
    return (F.crc32(F.col("doc_id").cast("string")) % mod) == held


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, bound: int) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled rows outside the held-out part. The label
    rows are chosen first and are then few enough to be sent to every executor."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(mod, held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, str], dict[str, float]]:
    """Classes of words, and weights of insults and threats."""
    classes: dict[str, str] = {}
    for names, c in ((TARGETS, TARGET), (NEGATORS, NEGATOR), (REPORTERS, REPORTER), (THREATS, THREAT), (INSULTS, INSULT)):
        classes |= dict.fromkeys(names.split(), c)
    classes |= dict.fromkeys("\"“”«»", QUOTE)
    share = rows.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("y")).first().y
    intent = F.array(*(F.lit(w) for w in INTENT.split()))
    announced = lambda w, i: F.arrays_overlap(F.slice("ws", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), intent)
    found = (
        rows.select("y", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}'’]+"), F.lit(0)).alias("ws"))
        .select("y", "ws", F.array_distinct(F.filter("ws", announced)).alias("behind"))
        .select("y", "behind", F.explode(F.array_distinct("ws")).alias("w"))
        .groupBy("w").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"), F.sum(F.when(F.array_contains("behind", F.col("w")), F.col("y")).otherwise(0)).alias("announced"))
        .filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
        .withColumn("weight", F.log((F.col("toxic") + share) / (F.col("n") - F.col("toxic") + 1 - share)) - math.log((share + 1e-3) / (1 - share + 1e-3)))
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "w").limit(LEXICON).collect()
    )
    weights = dict.fromkeys((INSULTS + " " + THREATS).split(), 1.0)
    for r in found:
        if r.w not in classes:
            classes[r.w] = THREAT if r.announced >= THREAT_SHARE * r.toxic else INSULT
        if classes[r.w] in (INSULT, THREAT):
            weights[r.w] = max(LEAST, float(r.weight))
    return classes, weights


@dataclass(frozen=True)
class ToxicityModel:
    classes: dict
    weights: dict
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, bound: int = SAMPLE) -> ToxicityModel:
    rows = training_rows(docs, labels, "toxic", mod, held, bound)
    classes, weights = learn_lexicon(rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((classes, weights))
    got = rows.select("doc_id", "text", "y").mapInArrow(_feature_rows(shared), "y int, x array<double>").collect()  # at most `bound` short rows
    x = np.array([r.x for r in got], float).reshape(-1, FEATURES)
    y = np.array([r.y for r in got], float)
    if len(y) == 0 or y.min() == y.max():
        odds = -30.0 if len(y) == 0 or not y.max() else 30.0
        return ToxicityModel(classes, weights, np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), odds))
    return ToxicityModel(classes, weights, *fit_logistic(x, y))


def _feature_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine = lexical(*shared.value)
        for b in batches:
            xs = [features(t.as_py(), symbols, machine).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(xs, pa.list_(pa.float64()))], ["y", "x"])

    return run


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicityModel = shared.value
        symbols, machine = lexical(model.classes, model.weights)
        for b in batches:
            x = np.array([features(t.as_py(), symbols, machine) for t in b.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score_rows(shared), "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
