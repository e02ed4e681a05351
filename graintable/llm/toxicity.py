"""Toxicity by a weighted finite-state pattern grammar over the clauses of a text."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import bounded_sample, giving_back, id_crc, one_text, table

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
# Closed word classes of the grammar; insults are learned from the labels.
TARGETS = frozenset("you your yours yourself u ur he him his she her they them their these those everyone people".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't doesn't didn't nobody neither nor without".split())
REPORTS = frozenset("said says say called calls wrote writes quoted quote reported reports claimed claims according".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn hang murder strangle".split())

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """Deterministic weighted transducer over word classes: arcs[state][symbol] = (next state, factor, output symbol)."""

    arcs: dict[int, dict[int, tuple[int, float, int]]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs.get(state, {}).get(symbol, (0, 1.0, symbol))


def compose(a: Transducer, b: Transducer, symbols: int = 6) -> Transducer:
    """The transducer that feeds a's outputs to b; factors multiply. States are numbered from the pair (0, 0)."""
    numbers, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
    while todo:
        pair = todo.pop()
        arcs = {}
        for s in range(symbols):
            x, wa, middle = a.step(pair[0], s)
            y, wb, o = b.step(pair[1], middle)
            if (x, y) not in numbers:
                numbers[(x, y)] = len(numbers)
                todo.append((x, y))
            arcs[s] = (numbers[(x, y)], wa * wb, o)
        out.arcs[numbers[pair]] = arcs
    return out


def window_rule(trigger: int, affected: tuple[int, ...], factor: float, span: int, consume: bool) -> Transducer:
    """For `span` symbols after a trigger, affected symbols carry the factor (consume: only the first of them)."""
    t = Transducer()
    for left in range(span + 1):
        arcs = {}
        for s in range(6):
            after = span if s == trigger else max(left - 1, 0)
            hit = left > 0 and s in affected
            arcs[s] = (0 if hit and consume else after, factor if hit else 1.0, s)
        t.arcs[left] = arcs
    return t


def grammar(negated: float = 0.25, reported: float = 0.6, aimed: float = 1.25, untargeted_threat: float = 0.3) -> Transducer:
    """Negation within 3 words, reported speech within 8 and a target within 4 before an insult or threat, composed."""
    threat = Transducer({0: {THREAT: (0, untargeted_threat, THREAT)}})
    rules = [window_rule(NEGATION, (INSULT, THREAT), negated, 3, True), window_rule(REPORT, (INSULT, THREAT), reported, 8, False),
             window_rule(TARGET, (INSULT, THREAT), aimed, 4, False), threat]
    whole = rules[0]
    for r in rules[1:]:
        whole = compose(whole, r)
    return whole


@dataclass
class ToxicityModel:
    stems: dict[str, float]
    weights: np.ndarray  # of the summed clause weight, the strongest clause, the text's length, and 1
    longest: int
    machine: Transducer
    trigger: re.Pattern | None

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Summed and largest weight of the matched clauses and log length; the number of such clauses.

        A clause without an insult or threat weighs nothing, so only those around a trigger are parsed.
        """
        low = (text or "").lower()
        hits = [m.start() for m in self.trigger.finditer(low)] if self.trigger else []
        total, most, clauses, done = 0.0, 0.0, 0, -1
        for at in hits:
            if at < done:
                continue
            begin = max(low.rfind(c, max(done, 0), at) for c in ".!?;:\n") + 1 or max(done, 0)  # no further back than the clause before
            end = CLAUSE.search(low, at)
            done = end.start() if end else len(low)
            score = self.clause(low[begin:done])
            if score > 0:
                total += score
                most = max(most, score)
                clauses += 1
        return [total, most, math.log1p(len(low)) / 4 if total else 0.0], clauses

    def weigh(self, word: str) -> tuple[int, float]:
        for k in range(min(len(word), self.longest), 2, -1):
            w = self.stems.get(word[:k])
            if w is not None:
                return INSULT, w
        if word in THREATS:
            return THREAT, 1.0
        return (TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER), 0.0

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        for word in WORD.findall(text):
            symbol, weight = self.weigh(word)
            state, factor, _ = self.machine.step(state, symbol)
            total += weight * factor
        return total

    def probability(self, features: list[float]) -> float:
        z = float(np.dot(self.weights[:-1], features) + self.weights[-1])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[str | None, int]], least_docs: int = 2) -> ToxicityModel:
    """Insult stems (word beginnings of 3 letters or more) with weights from label log-odds, and a logistic calibration.

    A stem enters when it occurs in least_docs toxic rows and the likelihood gain of its share in toxic
    rows over that in clean rows exceeds what chance gives among all stems tried; of stems that begin
    alike the one with the largest gain stays, then the longest. Without both labels every text gets the
    share of toxic rows (0 for no rows).
    """
    toxic = [t for t, y in rows if y == 1]
    n_toxic, n_clean = len(toxic), len(rows) - len(toxic)
    machine = grammar()
    if not n_toxic or not n_clean:
        p = min(max(n_toxic / max(len(rows), 1), 1e-6), 1 - 1e-6) if rows else 1e-6
        return ToxicityModel({}, np.array([0.0, 0.0, 0.0, math.log(p / (1 - p))]), 0, machine, None)

    def prefixes(text: str | None) -> set[str]:
        return {w[:k] for w in set(WORD.findall((text or "").lower())) for k in range(3, min(len(w), 12) + 1)}

    a: dict[str, int] = {}
    for t in toxic:
        for p in prefixes(t):
            a[p] = a.get(p, 0) + 1
    a = {p: n for p, n in a.items() if n >= least_docs}
    b = dict.fromkeys(a, 0)
    for t, y in rows:
        if y != 1:
            for p in prefixes(t):
                if p in b:
                    b[p] += 1
    odds = {p: math.log((a[p] + 0.5) / (n_toxic + 1)) - math.log((b[p] + 0.5) / (n_clean + 1)) for p in a}
    # the likelihood ratio of "more frequent in toxic rows" has to stand out among all the stems tried
    gain = {p: likelihood_gain(a[p], n_toxic, b[p], n_clean) for p in a if odds[p] > 0.7}
    needed = 2 * math.log(max(len(a), 2)) + 4
    chosen: dict[str, float] = {}
    for p in sorted((p for p in gain if gain[p] >= needed), key=lambda p: (-gain[p], -len(p), p)):
        if not any(p.startswith(c) or c.startswith(p) for c in chosen):
            chosen[p] = odds[p]
    longest = max(map(len, chosen), default=0)
    pattern = "|".join(sorted(map(re.escape, chosen.keys() | THREATS), key=lambda x: (-len(x), x)))
    model = ToxicityModel(chosen, np.zeros(4), longest, machine, re.compile(rf"(?<![^\W_])(?:{pattern})"))
    x = np.array([model.features(t)[0] for t, _ in rows])
    model.weights = calibrate(x, np.array([float(v == 1) for _, v in rows]))
    return model


def likelihood_gain(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood ratio of two shares a/n and b/m against one shared share."""
    def side(k: int, size: int, share: float) -> float:
        return (k * math.log(share) if k else 0.0) + ((size - k) * math.log(1 - share) if size - k else 0.0)

    whole = (a + b) / (n + m)
    return 2 * (side(a, n, a / n) + side(b, m, b / m) - side(a, n, whole) - side(b, m, whole))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 80) -> np.ndarray:
    """Weights of a logistic curve over the columns of x, the intercept last, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.array([ridge * len(x)] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(abs(d).max(), 1e-9))
        w = w - d
        if abs(d).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 held_out_mod: int = 5, sample_rows: int = 4000, max_chars: int = 50_000) -> ToxicityModel:
    """Fit on at most sample_rows labelled rows whose crc32(id) mod held_out_mod isn't 0: half of them toxic, if there are as many.

    Training rows have max_chars characters at most, so that the sample has a bounded size; scoring reads whole texts.
    """
    known = labels.where(id_crc(F.col(id_col)) % held_out_mod != 0).where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    half = sample_rows // 2
    toxic = bounded_sample(known.where("_y = 1"), id_col, half)
    picked = toxic.unionByName(bounded_sample(known.where("_y <> 1"), id_col, half))
    short = one_text(docs.join(F.broadcast(picked.select(id_col)), id_col, "left_semi"), id_col, text_col, max_chars)
    found = short.join(F.broadcast(picked), id_col).select("_t", "_y")
    counts = {r[0]: r[1] for r in known.groupBy((F.col("_y") == 1).alias("y")).count().collect()}
    model, share = fitted(found)
    if model.stems and counts.get(True) and counts.get(False):  # undo the half-and-half sample's prior
        true = counts[True] / (counts[True] + counts[False])
        if 0 < share < 1:
            model.weights[-1] += math.log(true / (1 - true)) - math.log(share / (1 - share))
    return model


def fitted(sample: DataFrame) -> tuple[ToxicityModel, float]:
    """fit() of a bounded sample (text, label) and its share of toxic rows; a task fits, so that the driver gets the model and not the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, int(y)) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = fit(sorted(rows, key=lambda r: (r[0] or "", r[1])))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model, sum(y == 1 for _, y in rows) / max(len(rows), 1)))], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(giving_back(run), "model binary").first()
    return pickle.loads(row[0]) if row else (fit([]), 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with tox_score (double, 0 to 1) and tox_clauses (matched clauses, long). Null and empty texts have no clause.

    Repeated rows are scored alike, texts of any length whole; an empty table gives an empty one; further columns pass through.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("tox_score", "tox_clauses")])  # such columns are replaced
    names = docs.columns
    m = model  # a few thousand stems at most: it travels with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [m.features(t.as_py()) for t in b.column(names.index(text_col))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.probability(s) for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())],
                                                 [*names, "tox_score", "tox_clauses"])

    schema = docs.withColumns({"tox_score": F.lit(0.0), "tox_clauses": F.lit(0).cast("long")}).schema
    return docs.mapInArrow(giving_back(run), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with held_out, score, predicted (0.5 or more) and n_clauses; odd rows: see score_toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_clauses").alias("n_clauses"))
