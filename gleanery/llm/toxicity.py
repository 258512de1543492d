"""Toxicity by a weighted finite-state pattern grammar.

A text's words become classes (insult, threat, target, negation, report, quote mark, clause end, other). Five small
transducers rewrite the class string one after the other; their composition is one deterministic machine whose arcs carry
weights:

- report: what follows a verb of saying in its clause, or stands in quote marks, is only reported; a quotation ends at the
  next mark, or after ``QUOTED`` clauses if none comes;
- negation: an insult or threat within two words of a negation is negated;
- target: an insult within four words after a target, or up to two before one, is aimed;
- threat: a threat with a target within three words is aimed;
- weigh: the marks that are left are the clause's matches, each with the weight of its kind.

A clause's score is the sum of its arcs' weights. A document's score is logistic in the score of its strongest clause and
in how many clauses have a match, never in numbers of words. The insult lexicon (words and word beginnings of 6 to 8
letters) and the weights are fitted to a bounded sample of labelled documents, at most ``max_rows`` by the hash of their
id; of near copies in the sample the one with the least hash counts. The strongest clause of a document depends on the
weights, so fit and choice take turns, ``TURNS`` times. Without usable labels the fixed seed words and prior weights stand.
Equal tables give equal models, however their rows are dealt.

Edge cases: null and empty texts have no matches and get the score of such texts; labels that are null or name no
document are ignored, repeated ones count once; repeated rows get equal scores; an empty table gives an empty result;
other columns pass through; ``score`` replaces score and predicted, ``reject`` adds and replaces nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gleanery.llm.columns import arrow_filter, quoted

# Seed words of the classes.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb"
THREATS = "kill hurt destroy beat shoot stab hang attack burn smash töten tuer matar"
TARGETS = "you your yours he she they him her them people tu vous du ihr sie usted ustedes"
NEGATIONS = "not never no nobody isn aren don doesn nicht kein keine nie pas ne jamais nunca"
REPORTS = "said says say told called wrote writes claimed reported quoted dit sagte dijo"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
#: What the composed machine writes: besides the classes, the kinds of matches.
AIMED, AIMED_AFTER, AIMED_THREAT, NEGATED, REPORTED = range(8, 13)
KINDS = (INSULT, AIMED, AIMED_AFTER, AIMED_THREAT, THREAT, NEGATED, REPORTED)
#: Weights before any label is seen: the intercept, KINDS, and the doublings of clauses with a match.
PRIOR = np.array([-3.0, 3.0, 4.0, 1.0, 4.0, 0.5, 0.5, 0.5, 0.5])
CLAUSE_ENDS, QUOTES = ".!?;:\n", "\"“”„«»"
TOKEN = re.compile(rf"[^\W\d_]+|[{CLAUSE_ENDS}{QUOTES}]")
#: Letters of the word beginnings that the lexicon may hold; shorter ones begin too many ordinary words.
LENGTHS = range(6, 9)
#: Clauses after which an open quotation ends, and rounds of choosing clauses and fitting weights.
QUOTED, TURNS = 4, 4


@dataclass
class Transducer:
    """Deterministic: ``step[state, symbol] -> (symbol out, next state, weight)``; missing steps copy the symbol, stay and weigh nothing."""

    start: tuple | int
    step: dict = field(default_factory=dict)

    def move(self, state, symbol):
        return self.step.get((state, symbol), (symbol, state, 0.0))


def compose(a: Transducer, b: Transducer, symbols: range = range(13)) -> Transducer:
    """The machine that feeds a's output to b; weights add up; only states that can be reached are made."""
    out, todo, seen = Transducer((a.start, b.start)), [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        sa, sb = todo.pop()
        for x in symbols:
            y, na, wa = a.move(sa, x)
            z, nb, wb = b.move(sb, y)
            out.step[(sa, sb), x] = (z, (na, nb), wa + wb)
            if (na, nb) not in seen:
                seen.add((na, nb))
                todo.append((na, nb))
    return out


def _window(opens: int, reach: int, rewrites: dict[int, int]) -> Transducer:
    """After ``opens``, the next ``reach`` symbols are rewritten; a clause's end closes the window."""
    t = Transducer(0)
    for left in range(reach + 1):
        for x in range(13):
            y = rewrites.get(x, x) if left else x
            t.step[left, x] = (y, reach if x == opens else 0 if x == END else max(0, left - 1), 0.0)
    return t


def _report() -> Transducer:
    """States: 0 plain, -1 after a verb of saying, k in quote marks with k clauses to go."""
    t = Transducer(0)
    for s in (-1, *range(1, QUOTED + 1)):
        t.step |= {(s, x): (REPORTED, s, 0.0) for x in (INSULT, THREAT)}
        t.step[s, END] = (END, max(0, s - 1), 0.0)
        t.step[s, QUOTE] = (QUOTE, QUOTED if s < 0 else 0, 0.0)
    t.step |= {(0, REPORT): (REPORT, -1, 0.0), (0, QUOTE): (QUOTE, QUOTED, 0.0)}
    return t


def grammar(weights: np.ndarray = PRIOR) -> Transducer:
    negation = _window(NEGATION, 2, {INSULT: NEGATED, THREAT: NEGATED})
    target = compose(_window(TARGET, 4, {INSULT: AIMED}), _window(INSULT, 2, {TARGET: AIMED_AFTER}))
    threat = _window(THREAT, 3, {TARGET: AIMED_THREAT, AIMED_AFTER: AIMED_THREAT})
    weigh = Transducer(0, {(0, x): (OTHER, 0, 0.0) for x in (TARGET, NEGATION, REPORT, QUOTE)} | {(0, k): (k, 0, float(w)) for k, w in zip(KINDS, weights[1:], strict=False)})
    out = _report()
    for t in (negation, target, threat, weigh):
        out = compose(out, t)
    return out


class Machine:
    """The grammar as arrays, run over the clauses of a text."""

    def __init__(self, insults: dict[str, int], weights: np.ndarray = PRIOR):
        made = grammar(weights)
        states = sorted({s for s, _ in made.step}, key=repr)
        number = {s: i for i, s in enumerate(states)}
        self.start = number[made.start]
        self.arcs = [[(made.step[s, x][0], number[made.step[s, x][1]], made.step[s, x][2]) for x in range(8)] for s in states]
        self.insults = insults
        self.fixed = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
        self.fixed |= dict.fromkeys(QUOTES, QUOTE) | dict.fromkeys(CLAUSE_ENDS, END)
        self.known: dict[str, int] = {}

    def class_of(self, word: str) -> int:
        """An entry ``^abc`` of the lexicon is a word beginning, any other a whole word."""
        if word in self.fixed:
            return self.fixed[word]
        hit = word in self.insults or any(f"^{word[:n]}" in self.insults for n in LENGTHS if n <= len(word))
        return INSULT if hit else OTHER

    def clauses(self, text: str | None) -> list[tuple[float, list[int]]]:
        """Weight and matches (of KINDS) of every clause that has a match."""
        if len(self.known) > 300_000:
            self.known = {}
        tokens, known = TOKEN.findall((text or "").lower()), self.known
        for w in {w for w in tokens if w not in known}:
            known[w] = self.class_of(w)
        classes = [known[w] for w in tokens]
        out: list[tuple[float, list[int]]] = []
        if INSULT in classes or THREAT in classes:
            state, weight, own, arcs = self.start, 0.0, [], self.arcs
            for x in (*classes, END):
                y, state, w = arcs[state][x]
                if y in KINDS:
                    own.append(y)
                    weight += w
                elif y == END and own:
                    out.append((weight, own))
                    weight, own = 0.0, []
        return out


@dataclass
class Model:
    insults: dict[str, int]
    weights: np.ndarray
    machine: Machine | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"insults": self.insults, "weights": self.weights, "machine": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        self.machine = self.machine or Machine(self.insults, self.weights)
        found = [self.machine.clauses(t) for t in texts]
        strongest = np.array([max((w for w, _ in f), default=0.0) for f in found])
        many = np.log2(1 + np.array([len(f) for f in found], float))
        return logistic(self.weights[0] + strongest + self.weights[-1] * many)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def kind_counts(own: list[int]) -> tuple[int, ...]:
    return tuple(own.count(k) for k in KINDS)


def fit_weights(docs: list[list[tuple[int, ...]]], y: np.ndarray, many: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Weights from documents as lists of clauses (kind_counts), in turns: choose the strongest clauses, then take Newton
    steps on the logistic loss of ``many`` such documents each, pulled towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(TURNS):
        chosen = [max(d, key=lambda c: (float(np.dot(c, w[1:-1])), c), default=(0,) * len(KINDS)) for d in docs]
        x = np.array([[1, *c, np.log2(1 + len(d))] for c, d in zip(chosen, docs, strict=True)], float).reshape(-1, len(PRIOR))
        for _ in range(50):
            p = logistic(x @ w)
            gradient = x.T @ (many * (p - y)) + pull * (w - PRIOR)
            step = np.linalg.solve((x.T * (many * p * (1 - p))) @ x + pull * np.eye(len(w)), gradient)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    return w


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _near_copy_keys(text: str | None) -> list[int]:
    """Three min-hashes of three-word shingles."""
    words = (text or "").lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int((hashes * np.uint64(m)).min() >> np.uint64(1)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _lexicon(sample: DataFrame) -> dict[str, int]:
    """Words and word beginnings that mark toxic documents, by document counts and a likelihood-ratio test.

    At least four toxic documents of the sample hold each, so the sample bounds their number.
    """

    def count(batches):
        seen, bad, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(TOKEN.findall((text or "").lower()))
                own = words | {f"^{w[:k]}" for w in words for k in LENGTHS if k <= len(w)}
                (bad if toxic else seen).update(own)
                n[toxic] += 1
        names = [*(bad.keys() | seen.keys()), ""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*(bad[x] for x in names[:-1]), n[1]], pa.int64()), pa.array([*(seen[x] for x in names[:-1]), n[0]], pa.int64())], names=["term", "bad", "good"])

    counts = sample.select("text", "toxic").mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = counts.filter("term = '' or (bad >= 4 and bad > 2 * good)").persist()
    all_bad, all_good = next(((r.bad, r.good) for r in counts.filter("term = ''").groupBy().agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()))
    if not all_bad or not all_good:
        counts.unpersist()
        return dict.fromkeys(INSULTS.split(), 1)
    bad, good, n = F.col("bad"), F.col("good"), all_bad + all_good
    cells = ((bad, (bad + good) * all_bad / n), (good, (bad + good) * all_good / n), (all_bad - bad, (n - bad - good) * all_bad / n), (all_good - good, (n - bad - good) * all_good / n))
    ratio = sum((F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0)) for o, e in cells), F.lit(0.0)) * 2
    odds = (bad + 0.5) * (all_good + 1) / ((good + 0.5) * (all_bad + 1))
    rows = counts.filter("term <> ''").filter((odds >= 80) & (ratio >= 30)).select("term").collect()
    counts.unpersist()
    return {t: 1 for t in sorted(r.term for r in rows) if t not in CLAUSE_ENDS + QUOTES} | dict.fromkeys(INSULTS.split(), 1)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """Fit lexicon and weights to the documents with labels in the training fold, at most ``max_rows`` of them."""
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")

    def key(batches):
        for batch in batches:
            keys = list(zip(*(_near_copy_keys(t) for t in batch.column("text").to_pylist()), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), *(pa.array(k, pa.int64()) for k in keys)], names=["text", "toxic", "k0", "k1", "k2"])

    sample = texts.mapInArrow(key, "text string, toxic int, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):
        least = F.min(F.struct(F.xxhash64("text"), "text", "toxic", "k0", "k1", "k2")).alias("x")
        sample = sample.groupBy(F.col(k).alias("same")).agg(least).select("x.text", "x.toxic", "x.k0", "x.k1", "x.k2")
    sample = sample.select("text", "toxic").persist()
    try:
        insults = _lexicon(sample)

        def count(batches):
            machine = Machine(insults)
            for batch in batches:
                made = [sorted(kind_counts(own) for _, own in machine.clauses(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.list_(pa.int64()))), batch.column("toxic")], names=["clauses", "toxic"])

        rows = sample.mapInArrow(count, "clauses array<array<long>>, toxic int").groupBy("clauses", "toxic").count().collect()
    finally:
        sample.unpersist()
    rows = sorted(([tuple(c) for c in r.clauses], r.toxic, r["count"]) for r in rows)
    docs_, y, many = ([r[k] for r in rows] for k in range(3))
    return Model(insults, fit_weights(docs_, np.array(y, float), np.array(many, float)))


def score(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted, which replace columns of these names."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    names, at = [f"c{i}" for i in range(len(keep))], keep.index("text")
    docs = docs.select(*map(quoted, keep)).toDF(*names)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                s = model.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= limit).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema).toDF(*keep, "score", "predicted")


def reject(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with their columns, whatever the names."""
    return arrow_filter(docs, lambda: lambda texts: model.scores(texts) < limit)
