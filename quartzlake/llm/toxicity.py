"""Toxicity by a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A feature is an n-gram of MIN_N to MAX_N characters of a lower-case word with its ends marked, present or not in a
document. Each present feature has the value r, the log of the ratio between its smoothed shares in toxic and other
documents; logistic regression weighs these values. Features without support (few documents, or a ratio within chance)
are left out, so ordinary words of long documents add nothing.

The fit takes a bounded sample of the labelled documents: at most SAMPLE[1] toxic and SAMPLE[0] others, those with the
smallest hash of their id among the ids that have a text, one row for an id; of a text longer than SAMPLE_CHARS characters
it takes a piece. Scoring covers every whole text, in one pass of an automaton that keeps only the features found.

Defined cases: null and empty texts have no feature and the score of the intercept; labels that are null are not used, and
an id with several labels has the greatest; rows with one doc_id twice are scored apart; features that tie for the last
place are taken in the order in which they were met; a sample without both classes gives a constant score; an empty table
gives no rows; further columns are kept, but for toxic_score, which is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .language import piece
from .shared import cut, free_memory, joined, release

MIN_N, MAX_N = 3, 5
SAMPLE, SAMPLE_CHARS = {1: 1500, 0: 3000}, 12_000
#: Documents that a feature needs, standard errors that its ratio must differ from zero, most features of a model.
MIN_DOCS, MIN_Z, MAX_FEATURES = 4, 3.3, 2_000
#: Smoothing, strength of the L2 penalty, Newton steps of the fit and conjugate-gradient steps in each.
ALPHA, PENALTY, STEPS, CG_STEPS = 0.5, 2e-5, 12, 30


def grams(word: str) -> set[str]:
    marked = f"\x02{word}\x03"
    return {marked[i : i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(marked) - n + 1)}


def marked(text: str | None) -> str:
    """The lower-case words with the marks of their ends."""
    return "\x02" + "\x03\x02".join((text or "").lower().split()) + "\x03"


@dataclass
class Model:
    features: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def scorer(self) -> Callable[[str | None], float]:
        """A function from a text to its score; one pass of an automaton finds the features that are present."""
        automaton = ahocorasick.Automaton()
        for k, feature in enumerate(self.features):
            automaton.add_word(feature, k)
        automaton.make_automaton()

        def score(text: str | None) -> float:
            hit = {k for _, k in automaton.iter(marked(text))} if self.features else ()
            z = self.intercept + math.fsum(self.weights[k] for k in hit)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit_texts(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit on these texts; share: of toxic documents where the model is used, which sets the intercept."""
    prior = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    if not 0 < toxic.sum() < len(toxic):
        return Model(intercept=prior)
    ids, by_word, docs = {}, {}, []
    for text in texts:
        own = []
        for w in set(text.lower().split()):
            if w not in by_word:
                by_word[w] = np.array([ids.setdefault(g, len(ids)) for g in grams(w)], np.int32)
            own.append(by_word[w])
        docs.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32))
    rows, cols = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs]), np.concatenate(docs)
    has = [np.bincount(cols[toxic[rows] == c], minlength=len(ids)).astype(float) for c in (0, 1)]
    n = [float((toxic == c).sum()) for c in (0, 1)]
    odds = [np.log((has[c] + ALPHA) / (n[c] - has[c] + ALPHA)) for c in (0, 1)]
    error = np.sqrt(sum(1 / (has[c] + ALPHA) + 1 / (n[c] - has[c] + ALPHA) for c in (0, 1)))
    z = np.where(has[0] + has[1] >= MIN_DOCS, np.abs(odds[1] - odds[0]) / error, 0)
    chosen = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    chosen = chosen[z[chosen] >= MIN_Z]
    ratio = np.log((has[1] + ALPHA) / (n[1] + 2 * ALPHA)) - np.log((has[0] + ALPHA) / (n[0] + 2 * ALPHA))
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    own = place[cols] >= 0
    x = np.zeros((len(docs), len(chosen)), np.float32)
    x[rows[own], place[cols[own]]] = ratio[cols[own]]
    weights, bias = _logistic(x, toxic.astype(np.float64))
    names = list(ids)
    return Model([names[f] for f in chosen], (weights * ratio[chosen]).tolist(), bias + prior - float(np.log(n[1] / n[0])))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-penalised logistic regression, by Newton steps with conjugate gradients."""
    w, b = np.zeros(x.shape[1] + 1), float(np.log(y.mean() / (1 - y.mean())))
    w[-1] = b
    times = lambda v: x @ v[:-1].astype(np.float32) + v[-1]
    back = lambda u: np.append(x.T @ u.astype(np.float32), u.sum())
    keep = np.append(np.full(x.shape[1], PENALTY), 1e-9)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope = back(p - y) / len(y) + keep * w
        curve = np.maximum(p * (1 - p), 1e-6) / len(y)
        step, rest = np.zeros_like(w), -slope
        way, size = rest.copy(), float(rest @ rest)
        for _ in range(CG_STEPS):
            if size < 1e-14:
                break
            bent = back(curve * times(way)) + keep * way
            far = size / float(way @ bent)
            step, rest = step + far * way, rest - far * bent
            size, was = float(rest @ rest), size
            way = rest + size / was * way
        w = w + step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], float(w[-1])


def sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, float | None]:
    """(doc_id, text, y) of the bounded sample as a written table, and the share of toxic documents among all labelled ones."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.withColumn("key", F.xxhash64("text"))
    usable = cut(rows.groupBy("doc_id").agg(F.min("key").alias("key")).join(known, "doc_id"), "toxicity-labels")
    count = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}  # two rows at most
    by_hash, ahead = F.xxhash64("doc_id"), F.lit(False)
    for y, n in count.items():
        reach = (2 * SAMPLE[y] << 64) // n - (1 << 63)  # twice the rows that are wanted lie below, whatever the number of tasks
        ahead = ahead | ((F.col("y") == y) & (by_hash <= min(reach, (1 << 63) - 1)))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(by_hash, "doc_id"))
    most = F.when(F.col("y") == 1, SAMPLE[1]).otherwise(SAMPLE[0])
    chosen = cut(usable.where(ahead).withColumn("rank", rank).where((F.col("rank") <= max(SAMPLE.values())) & (F.col("rank") <= most)).drop("rank"), "toxicity-sample")
    share = count.get(1, 0) / sum(count.values()) if count else None
    found = cut(joined(rows, chosen, ["doc_id", "key"], "inner").select("doc_id", piece(F.col("text"), SAMPLE_CHARS).alias("text"), "y").distinct(), "toxicity-texts")
    release(usable, chosen)
    return found, share


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled documents."""
    found, share = sample(docs, labels, label)
    rows = found.toPandas().sort_values(["doc_id", "text"])  # SAMPLE bounds the rows, SAMPLE_CHARS their texts
    release(found)
    model = fit_texts(rows["text"].tolist(), rows["y"].to_numpy(int), float(share)) if share is not None else Model()
    free_memory()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, and toxic_score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES bounds it

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype=float)
        free_memory()

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("toxic_score", F.pandas_udf(scored, "double")(F.col("text").cast("string")))
