"""Whole predictions against plain statements: languages, toxicity, the vote model and its spans."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strucreg.llm import language_id, pii, queries, toxicity
from strucreg.llm.common import Tables


# --- languages ------------------------------------------------------------------------


def trigrams(text):
    folded = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
    return Counter() if not folded.strip() else Counter(zip(*(f" {folded.strip()} "[i:] for i in range(3))))


def plain_languages(rows, dim=language_id.DIM):
    """rows: (doc_id, text, lang). doc_id -> (lang_pred, score), by the definition, one vector per letter."""
    letters = {}

    def vector(gram):
        for c in gram:
            if c not in letters:
                letters[c] = language_id.letter_vectors(np.array([ord(c)], np.uint32), dim)[0].astype(float)
        a, b, c = (letters[x] for x in gram)
        return np.roll(a, 2) * np.roll(b, 1) * c

    cache = {}

    def bundle(text):
        total = np.zeros(dim)
        for gram, n in trigrams(text).items():
            if gram not in cache:
                cache[gram] = vector(gram)
            total += n * cache[gram]
        return total

    sums = defaultdict(lambda: np.zeros(dim))
    for d, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str("" if d is None else d).encode()) % 4 != 2:
            sums[lang] += bundle(text) / max(1, sum(trigrams(text).values()))
    names = sorted(k for k, v in sums.items() if v.any())
    matrix = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    centre = matrix.mean(axis=0)
    centred = (matrix - centre) / np.linalg.norm(matrix - centre, axis=1, keepdims=True)
    out = []
    for d, text, _ in rows:
        if not trigrams(text):
            out.append((d, "und", 0.0))
            continue
        own = bundle(text)
        own = own / np.linalg.norm(own) - centre
        cosine = centred @ own / np.linalg.norm(own)
        out.append((d, names[int(np.argmax(cosine))], 1 / np.exp(8 * (cosine - cosine.max())).sum()))
    return out


def test_languages_by_definition(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "12 34", None), (None, "Ein Satz über Vögel", "de"), (-3, "a", None)], "doc_id bigint, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionByName(extra)
    rows = [tuple(r) for r in docs.collect()]
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.held_out_languages(docs).collect()}
    expected = plain_languages(rows)
    assert len(told) == len(expected)
    for d, lang, score in expected:
        assert told[d][0] == lang and abs(told[d][1] - score) < 1e-3, d


# --- toxicity --------------------------------------------------------------------------


def noisy_or(model, text):
    """1 - prod(1 - p) over the sentences that are not white space alone."""
    rest = 1.0
    for m in re.finditer(r"[^.!?\n]+", (text or "").lower()):
        if m.group().isspace():
            continue
        known = [f for f in toxicity.features(m.group()) if f in model.number]
        rest *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights[model.number[f]] for f in known))))
    return 1 - rest


def test_scores_are_noisy_ors(spark, sf_dir):
    docs, labels = queries.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert abs(r["score"] - noisy_or(model, r["text"])) < 1e-5


def test_slope_is_that_of_the_likelihood(spark):
    """The distributed gradient against differences of the log likelihood."""
    rng = np.random.default_rng(3)
    bags = []
    for i in range(60):
        hits = [sorted(rng.choice(5, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(0, 4))]
        bags.append((hits, int(rng.integers(0, 3)), int(bool(hits) and i % 2), float(rng.integers(1, 3))))
    df = spark.createDataFrame(bags, "hits array<array<int>>, plain int, label int, weight double").repartition(3)
    weights, bias = rng.normal(size=5), -1.0

    def likelihood(w, b):
        total = 0.0
        for hits, plain, label, weight in bags:
            p = [1 / (1 + math.exp(-(b + sum(w[j] for j in h)))) for h in hits] + [1 / (1 + math.exp(-b))] * plain
            clean = float(np.prod([1 - x for x in p]))
            total += weight * math.log(max(1 - clean, 1e-300) if label else clean)
        return total

    slope = toxicity._slope(df, weights, bias)
    for j in range(6):
        step = 1e-5 * np.eye(6)[j]
        near = (likelihood(weights + step[:5], bias + step[5]) - likelihood(weights - step[:5], bias - step[5])) / 2e-5
        assert abs(slope[j] - near) < 1e-4


# --- personal data --------------------------------------------------------------------


def plain_em(rows, rounds=200):
    """Votes row by row (not by pattern): the probability of each row being a true span."""
    votes = np.array(rows)
    width = votes.shape[1]
    trust = [0.95 if j == 0 else 0.75 for j in range(width)]
    value = {1: 0, 0: 1, -1: 2}
    true = np.array([[t, 0.5, 1 - t] for t in trust])
    false = np.array([[1 - t, 0.5, t] for t in trust])
    prior_true = np.array([[2 * t, 0.5, 2 * (1 - t)] for t in trust])
    prior_false = np.array([[2 * (1 - t), 0.5, 2 * t] for t in trust])
    share = 0.5
    at = np.array([[value[v] for v in r] for r in rows])

    def posterior():
        odds = math.log(share / (1 - share)) + sum(np.log(true[j, at[:, j]] / false[j, at[:, j]]) for j in range(width))
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))

    for _ in range(rounds):
        p = posterior()
        new_true, new_false = prior_true.copy(), prior_false.copy()
        for j in range(width):
            np.add.at(new_true[j], at[:, j], p)
            np.add.at(new_false[j], at[:, j], 1 - p)
        share = min(0.999, max(0.001, p.sum() / len(p)))
        new_true, new_false = (m / m.sum(axis=1, keepdims=True) for m in (new_true, new_false))
        moved = max(np.abs(new_true - true).max(), np.abs(new_false - false).max())
        true, false = new_true, new_false
        if moved < 1e-9:
            break
    return posterior()


@pytest.fixture(scope="module")
def judged(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    rng = random.Random(3)
    texts = []
    for i in range(150):
        secret = "".join(rng.choices("abcdefghkmnp23456789", k=rng.randint(12, 40)))
        texts.append((10_000 + i, rng.choice(["token = {} ok", "my password: {}", "section {} of", "order {}", "{}", "call me {}"]).format(secret) + f" and +49 {rng.randrange(10**7, 10**10)} 4{rng.randrange(10**14):014d}"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"))
    return docs, pii.judged(Tables(spark, "plain"), docs).filter("kind is not null").collect()


def test_labels_are_those_of_plain_em(judged):
    _, rows = judged
    by_kind = defaultdict(list)
    for r in rows:
        by_kind[r["kind"]].append(r)
    assert len(by_kind) >= 4
    for own in by_kind.values():
        expected = plain_em([[r[v] for v in pii.VOTES] for r in own])
        assert np.allclose([r["labelled"] for r in own], expected, atol=1e-6)


def test_classifier_is_plain_logistic_regression(judged):
    """The span probabilities solve the ridge logistic regression on the rows themselves."""
    _, rows = judged
    for kind in {r["kind"] for r in rows}:
        own = [r for r in rows if r["kind"] == kind]
        x = np.array([[r[f] for f in pii.FEATURES] + [1] for r in own], float)
        target = np.array([r["labelled"] for r in own])
        w = np.zeros(x.shape[1])
        for _ in range(60):  # Newton
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (p - target) + w)
        expected = 1 / (1 + np.exp(-(x @ w)))
        assert np.abs(np.array([r["probability"] for r in own]) - expected).max() < 0.05
        sure = np.abs(expected - 0.5) > 0.05
        assert ((np.array([r["probability"] for r in own]) >= 0.5) == (expected >= 0.5))[sure].all()


def test_added_spans_are_the_likely_ones_apart_from_base_spans(judged):
    docs, rows = judged
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["_id"]].append(r)
    told = {r["doc_id"]: sorted((s["kind"], s["start"], s["end"]) for s in r["all"]) for r in pii.spans(docs).collect()}
    for d, found in told.items():
        base = [(r["kind"], r["start"], r["end"]) for r in by_doc[d] if r["base"]]
        added = [
            (r["kind"], r["start"], r["end"]) for r in by_doc[d]
            if not r["base"] and r["probability"] >= 0.5 and all(r["end"] <= a or b <= r["start"] for _, a, b in base)
        ]
        assert found == sorted(base + added)
    assert sum(len(v) for v in told.values()) > len([r for r in rows if r["base"]])
