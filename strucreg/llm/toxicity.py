"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability sigmoid(b + sum of the weights of its features), a document
with the noisy-or of its sentences, 1 - prod(1 - p). The weights are trained from document labels alone: the gradient of the
noisy-or likelihood gives every sentence its share of a toxic document. The sentence probabilities then locate the offending ones.

Features are lower-case words and word beginnings of four and five letters (the beginnings stand for the forms of a word). Their list is
chosen on a bounded sample of labelled documents (``max_train`` of each class, by hash of the id): all of those in at least ``min_docs``
toxic sampled documents whose odds of a toxic document are e times those of a clean one and whose gain is above ``least_gain``. Scoring
reads every row and whole text.

Defined cases: null and empty texts have no sentence and score 0; null labels and labels of unknown ids teach nothing, and a document
labelled several times counts as toxic if any label says so; a null id counts as the empty text in the split and never meets a label;
repeated rows score alike; a text without sentence ends is one sentence; without toxic or clean examples every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.llm.common import Tables, in_batches, remainder

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def features(sentence: str) -> set[str]:
    """Words, and beginnings marked by a star."""
    found = set(LETTERS.findall(sentence.lower()))
    for n in (4, 5):
        found |= {w[:n] + "*" for w in found if len(w) >= n and w[-1] != "*"}
    return found


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.number = {n: i for i, n in enumerate(names)}
        self.weights, self.bias = weights, bias
        self.words = {n for n in names if n[-1] != "*"}
        self.starts = [{n[:-1] for n in names if n[-1] == "*" and len(n) == k + 1} for k in (4, 5)]

    def hits(self, sentence: str) -> list[int]:
        words = LETTERS.findall(sentence)
        found = self.words.intersection(words)
        for k, starts in zip((4, 5), self.starts):
            if starts:
                found |= {s + "*" for s in starts.intersection([w[:k] for w in words if len(w) >= k])}
        return [self.number[f] for f in found]

    def bags(self, text: str) -> tuple[list[tuple[int, int, list[int]]], int]:
        """(start, end, hits) of the sentences with a hit, and how many have none."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals become two characters; places are those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        told, plain = [], 0
        for m in SENTENCE.finditer(low):
            found = self.hits(m.group())
            if found:
                told.append((m.start(), m.end(), found))
            else:
                plain += not m.group().isspace()
        return told, plain

    def score(self, text: str, locate: float) -> tuple[float, list[dict]]:
        told, plain = self.bags(text)
        rest = plain * np.log1p(-_sigmoid(self.bias))
        spans = []
        for start, end, found in told:
            p = float(_sigmoid(self.bias + self.weights[found].sum()))
            rest += np.log1p(-min(p, 1 - 1e-12))
            if p >= locate:
                spans.append({"start": start, "end": end, "score": round(p, 6)})
        return round(float(-np.expm1(rest)), 6), spans


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(text, label, weight) of at most ``max_train`` documents of each class, the weight making up for what was left out."""
    marks = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_l")).dropna()
    marks = marks.groupBy("_i").agg(F.max("_l").alias("_l"))
    chosen = None
    for label in (0, 1):
        own = marks.filter(F.col("_l") == label)
        share = F.lit(float(max(1, own.count())))
        own = own.orderBy(F.xxhash64("_i"), "_i").limit(max_train)
        own = own.withColumn("_w", F.greatest(F.lit(1.0), share / max_train))
        chosen = own if chosen is None else chosen.unionByName(own)
    # at most 2 * max_train ids
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_i")
    return rows.filter("text is not null").select("text", F.col("_l").alias("label"), F.col("_w").alias("weight"))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, docs): sampled documents with each feature, added up per batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for text in batch.column(0).to_pylist():
            total.update(features(text))
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "docs"])

    return in_batches(rows.select("text"), count, "feature string, docs bigint").groupBy("feature").agg(F.sum("docs").alias("docs"))


def choose_features(rows: DataFrame, min_docs: int, least_gain: float) -> tuple[list[str], np.ndarray]:
    """All features that mark toxic documents beyond chance, and their first weights, log odds with one half added to each count. The gain is the
    logarithm of how much likelier the counts are with a rate per class than with one for both."""
    toxic, clean = rows.filter("label = 1"), rows.filter("label = 0")
    n1, n0 = toxic.count(), clean.count()
    if not n1 or not n0:
        return [], np.zeros(0)
    a, b = F.col("docs").cast("double"), F.coalesce(F.col("in_clean"), F.lit(0)).cast("double")
    both = _counted(toxic).filter(F.col("docs") >= min_docs).join(_counted(clean).withColumnRenamed("docs", "in_clean"), "feature", "left")
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    gain = a * F.log(a * (n1 + n0) / (n1 * (a + b))) + F.when(b > 0, b * F.log(b * (n1 + n0) / (n0 * (a + b)))).otherwise(0.0)
    # features of the bounded sample alone
    told = both.select("feature", odds.alias("odds"), gain.alias("gain")).filter((F.col("odds") > 1) & (F.col("gain") > least_gain)).collect()
    told = sorted(((r["feature"], r["odds"]) for r in told))
    return [f for f, _ in told], np.array([o for _, o in told])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_train: int = 20_000, min_docs: int = 3, least_gain: float = 5.0, rounds: int = 60, settled: float = 0.01) -> Model:
    """Resilient propagation on the noisy-or likelihood; a round is one job whose tasks return one number per feature. It ends when no step is
    longer than ``settled``, or after ``rounds``. Weights start at their log odds (6 at most), the bias stays within -14 and 2."""
    tables = Tables(docs.sparkSession, "toxicity")
    rows = sample(docs, labels, id_col, text_col, label_col, max_train)
    names, odds = choose_features(rows, min_docs, least_gain)
    if not names:
        return Model([], np.zeros(0), -35.0)
    start = Model(names, odds, 0.0)

    def bag(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [start.bags(t) for t in batch.column(0).to_pylist()]
        return pa.record_batch(
            [pa.array([[h for _, _, h in t] for t, _ in told], pa.list_(pa.list_(pa.int32()))), pa.array([p for _, p in told], pa.int32()), batch.column(1), batch.column(2)],
            names=["hits", "plain", "label", "weight"],
        )

    bags = tables.keep(in_batches(rows, bag, "hits array<array<int>>, plain int, label int, weight double"))
    k = len(names)
    weights, bias = np.minimum(odds, 6.0), -8.0
    steps, last = np.full(k + 1, 0.2), np.zeros(k + 1)
    for _ in range(rounds):
        slope = _slope(bags, weights, bias) - 0.01 * np.append(weights, 0.0)
        same = slope * last
        steps = np.clip(np.where(same > 0, steps * 1.2, np.where(same < 0, steps * 0.5, steps)), 1e-4, 1.0)
        slope = np.where(same < 0, 0.0, slope)
        move = np.sign(slope) * steps
        weights, bias, last = weights + move[:k], float(np.clip(bias + move[k], -14.0, 2.0)), slope
        if np.abs(move).max() <= settled:
            break
    return Model(names, np.round(weights, 6), round(bias, 6))


def _slope(bags: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    k = len(weights)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros(k + 1)
        base = _sigmoid(bias)
        for hits, plain, label, weight in zip(*(batch.column(i).to_pylist() for i in range(4))):
            p = np.array([_sigmoid(bias + weights[h].sum()) for h in hits])
            rest = plain * np.log1p(-base) + np.log1p(-np.minimum(p, 1 - 1e-12)).sum()
            share = -1.0 if label == 0 else np.exp(rest) / max(-np.expm1(rest), 1e-12)  # (1 - P) / P
            for h, x in zip(hits, p):
                out[h] += weight * share * x
            out[k] += weight * share * (p.sum() + plain * base)
        at = np.flatnonzero(out)
        return pa.record_batch([pa.array(at, pa.int32()), pa.array(out[at])], names=["at", "slope"])

    total = np.zeros(k + 1)
    for r in in_batches(bags, add, "at int, slope double").groupBy("at").agg(F.sum("slope").alias("slope")).collect():  # k + 1 rows at most
        total[r["at"]] = round(r["slope"], 9)
    return total


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """The id, score and offending sentences (start, end, score; code points) of every row."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [model.score(t or "", locate) for t in batch.column(1).to_pylist()]
        spans = pa.array([s for _, s in told], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
        return pa.record_batch([batch.column(0), pa.array([s for s, _ in told], pa.float64()), spans], names=[id_col, "score", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return in_batches(rows, judge, f"`{id_col}` {kind}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")


def held_out_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                      parts: int = 3, part: int = 1, threshold: float = 0.7) -> DataFrame:
    """Learns from the labels outside one part of the ids and scores every row: id, held_out, score, predicted, sentences."""
    model = train(docs, labels.filter(remainder(id_col, parts) != part), id_col, text_col, label_col)
    rows = score(docs, model, id_col, text_col)
    return rows.select(id_col, (remainder(id_col, parts) == part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
