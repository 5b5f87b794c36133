"""Language identification by hyperdimensional profiles.

Every character has a random vector of +1 and -1, a fixed function of its code point. A trigram's vector binds (multiplies) its
characters' vectors, each permuted (rotated) by its place. A document's vector bundles (adds) its trigrams', a
language's prototype bundles its documents', each counted with weight one. Documents are compared with prototypes by cosine,
after the mean of the prototypes is taken off both.

Letters are lower-cased; every run of other characters is one gap. Defined cases: null text and text without a letter give ``und``
with score 0; null labels teach nothing; a null id counts as the empty text in the split; ties go to the first language by
code point; repeated rows and very long texts are whole documents like others (memory is bounded by
the table of distinct trigrams, taken in slices); without any labelled document every result is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.llm.common import in_batches, remainder

DIM = 1024
# Documents whose trigrams are counted together, and trigrams whose vectors are in memory at a time.
GROUP, SLICE = 256, 4096
GAP = 0x20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every number (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of +1 and -1 for each code point."""
    words = np.arange(dim // 64, dtype=np.uint64)
    bits = _mixed(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _letters(text: str) -> np.ndarray:
    """Lower-case code points with one gap before, between and after the words; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return codes
    different, back = np.unique(codes, return_inverse=True) if codes.max() >= 1 << 16 else (None, None)
    if different is None:
        seen = np.flatnonzero(np.bincount(codes))
        table = np.zeros(int(codes.max()) + 1, bool)
        table[seen] = [chr(c).isalpha() for c in seen.tolist()]
        letter = table[codes]
    else:
        letter = np.array([chr(c).isalpha() for c in different.tolist()])[back]
    if not letter.any():
        return codes[:0]
    codes = np.where(letter, codes, GAP)
    codes = np.concatenate(([GAP], codes, [GAP]))
    return codes[np.concatenate(([True], (codes[1:] != GAP) | (codes[:-1] != GAP)))]


class Trigrams:
    """Counts of the distinct trigrams of a group of texts."""

    def __init__(self, texts: list[str]):
        parts = [_letters(t) for t in texts]
        self.sizes = np.array([max(0, len(p) - 2) for p in parts])
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.alphabet, at = np.unique(codes, return_inverse=True)
        ends = np.cumsum([len(p) for p in parts])
        whole = np.ones(len(codes), bool)  # trigrams that begin here lie within one text
        for back in (1, 2):
            whole[(ends - back)[(ends - back >= 0) & (np.array([len(p) for p in parts]) >= back)]] = False
        start = np.flatnonzero(whole)
        k = np.int64(len(self.alphabet))
        grams = (at[start] * k + at[start + 1]) * k + at[start + 2] if len(start) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.texts, self.k = len(texts), k
        self.grams, self.gram = np.unique(grams, return_inverse=True)
        self.doc = doc

    def vectors(self, low: int, high: int, dim: int) -> np.ndarray:
        grams = self.grams[low:high]
        letters = letter_vectors(self.alphabet, dim)
        first, second, third = grams // (self.k * self.k), grams // self.k % self.k, grams % self.k
        return (np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]).astype(np.float32)

    def bundle(self, row: np.ndarray, weight: np.ndarray | None, rows: int, dim: int) -> np.ndarray:
        """Sum of the trigram vectors into ``row[doc]``."""
        out = np.zeros((rows, dim), np.float32)
        if not len(self.gram):
            return out
        target = row[self.doc]
        for low in range(0, len(self.grams), SLICE):
            high = min(low + SLICE, len(self.grams))
            here = (self.gram >= low) & (self.gram < high) if len(self.grams) > SLICE else slice(None)
            cell = target[here] * (high - low) + (self.gram[here] - low)
            counts = np.bincount(cell, None if weight is None else weight[self.doc[here]], rows * (high - low))
            out += counts.reshape(rows, high - low).astype(np.float32) @ self.vectors(low, high, dim)
        return out


def _groups(texts: list[str]):
    for low in range(0, len(texts), GROUP):
        yield low, texts[low : low + GROUP]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages by code point and a row of unit length for each. What reaches the driver is one vector per language:
    tasks add up their documents first, then values are added by (language, dimension)."""

    def learn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = {n: i for i, n in enumerate(names)}
        row = np.array([number[x] for x in langs])
        total = np.zeros((len(names), dim))
        for low, part in _groups(texts):
            grams = Trigrams(part)
            total += grams.bundle(row[low : low + len(part)], 1.0 / np.maximum(grams.sizes, 1), len(names), dim)
        return pa.record_batch([pa.array(names), pa.array(list(total), pa.list_(pa.float64()))], names=["lang", "vector"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    parts = in_batches(rows, learn, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).collect()
    found = sorted((r["lang"], [x["value"] for x in r["v"]]) for r in found)
    langs = [n for n, v in found if any(v)]
    # rounded, so that the order in which tasks finish does not show in the last bits
    matrix = np.round(np.array([v for _, v in found if any(v)], np.float64).reshape(len(langs), dim), 6)
    return langs, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score for every row. The score is a soft maximum over the cosines."""
    dim = matrix.shape[1] if len(langs) else DIM
    centre = matrix.mean(axis=0) if len(langs) > 1 else np.zeros(dim)
    centred = matrix - centre
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        pred, score = [], []
        for _, part in _groups(texts):
            grams = Trigrams(part)
            vectors = grams.bundle(np.arange(len(part)), None, len(part), dim)
            unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) - centre.astype(np.float32)
            cosine = unit @ centred.T / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9) if langs else np.zeros((len(part), 0))
            for i, known in enumerate(grams.sizes):
                if not known or not langs:
                    pred.append("und")
                    score.append(0.0)
                else:
                    best = int(np.argmax(cosine[i]))
                    pred.append(langs[best])
                    score.append(round(float(1.0 / np.exp(8.0 * (cosine[i] - cosine[i][best])).sum()), 6))
        return pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return in_batches(rows, compare, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """Learns from the rows outside one part of the ids and predicts every row: id, held_out, lang_pred, score."""
    held = remainder(id_col, parts) == part
    langs, matrix = prototypes(docs.filter(~held), text_col, lang_col)
    return identify(docs, langs, matrix, id_col, text_col).withColumn("held_out", held).select(id_col, "held_out", "lang_pred", "score")
