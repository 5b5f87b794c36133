"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of each language by the
Jensen-Shannon distance (base 2, 0 to 1); the closest language counts. The language histograms are measured over all
documents with a language that pass the base rules, every document with weight one. Documents too short for a stable
histogram are not judged by it.

Base rules: fewer than ``MIN_WORDS`` words, or more than 30 % of the words in repeated 8-word windows.

Defined cases: null and empty texts have no words and fail the base rules; null languages teach nothing; repeated rows, null ids
and ties are judged alike; without any language reference only the base rules judge; texts are read whole, of any length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strucreg.llm.common import SPACE_BYTES, Tables

MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
# A document of n words is rejected above the distance a + b / sqrt(n): a histogram of few words strays further by chance.
# From MIN_CHARS and MIN_COUNTED on, histograms are judged.
MAX_CLASS_DISTANCE, MIN_CHARS = (0.14, 1.3), 100
MAX_WORD_DISTANCE, MIN_COUNTED = (0.25, 1.5), 100

# Frequent words of English, German, French and Spanish.
COMMON = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "der die das und ist nicht von den mit dem des im auf für sich eine ein als auch es zu werden aus hat dass sie nach wird bei "
    "le la les des et est dans qui que une pour pas par sur au avec ce il plus du son se ne sont leur "
    "el los las del y en por con para su un una lo como más pero sus al esta entre cuando muy sin sobre también"
).split()

CLASSES = ("lower", "upper", "digit", "space", "end", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
ENDS = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    """The class of every byte; bytes above ASCII are counted apart."""
    table = np.full(256, CLASSES.index("other"))
    for name, members in (
        ("lower", range(ord("a"), ord("z") + 1)),
        ("upper", range(ord("A"), ord("Z") + 1)),
        ("digit", range(ord("0"), ord("9") + 1)),
        ("space", SPACE_BYTES),
        ("end", ENDS),
        ("symbol", SYMBOLS + b"@^_`{}~\\/+=[]"),
    ):
        table[list(members)] = CLASSES.index(name)
    return table


CLASS_OF = _class_table()
_ODD = np.array([2 * (0x9E3779B97F4A7C15 * (i + 1) % (1 << 63)) + 1 for i in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included. Windows are compared by a 64-bit sum of word hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key += h[i : i + n] * _ODD[i]
    key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> dict:
    """The base counts and the two histograms of one text. The word histogram ends with the words that are not common."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    classes = np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES))
    if not raw.isascii():
        different = Counter(text)
        classes[CLASSES.index("other")] = 0
        for c, n in different.items():
            if ord(c) > 127:
                kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "lower" if c.isalpha() else "other"
                classes[CLASSES.index(kind)] += n
            elif CLASS_OF[ord(c)] == CLASSES.index("other"):
                classes[CLASSES.index("other")] += n
    counts = Counter(text.lower().split())
    common = [counts[w] + counts[w + ","] + counts[w + "."] for w in COMMON]
    return {
        "n_words": len(words),
        "word_chars": len(text) - (len(raw) - len(raw.translate(None, SPACE_BYTES))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "classes": classes.tolist(),
        "common": [*common, max(0, sum(counts.values()) - sum(common))],
    }


FIELDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
          ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())))


_MEASURED = T.StructType([T.StructField(n, T.LongType() if pa.types.is_integer(t) else T.ArrayType(T.LongType())) for n, t in FIELDS])


def _measures(texts: pa.Array) -> pa.Array:
    parts = []
    for low in range(0, len(texts), 500):
        rows = [measure(t or "") for t in texts.slice(low, 500).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in FIELDS], names=[n for n, _ in FIELDS]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(FIELDS)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of every row, with its id and language. Only the texts go to Python; whatever else a row holds stays behind."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    counts = F.arrow_udf(_measures, _MEASURED)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col), lang.alias("_lang"), counts.alias("_m")).select(id_col, "_lang", "_m.*")


def failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def references(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms by language: a sum per (language, bin), so one number per bin of each language reaches the driver."""
    good = rows.filter("_lang is not null").filter(~failed())
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    sums = None
    for name, size in (("classes", len(CLASSES)), ("common", len(COMMON) + 1)):
        total = F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x)
        shares = good.select("_lang", F.posexplode(F.transform(name, lambda x: x / total)).alias("at", "share"))  # noqa: B023
        part = shares.groupBy("_lang", "at").agg(F.sum("share").alias("sum")).withColumn("kind", F.lit(name))
        sums = part if sums is None else sums.unionByName(part)
    for r in sums.collect():
        both = out.setdefault(r["_lang"], (np.zeros(len(CLASSES)), np.zeros(len(COMMON) + 1)))
        both[r["kind"] == "common"][r["at"]] = round(r["sum"] or 0.0, 6)
    return {k: (a / a.sum(), b / b.sum()) for k, (a, b) in sorted(out.items()) if a.sum() and b.sum()}


def distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row (counts) to a distribution."""
    p = rows / np.maximum(rows.sum(axis=1, keepdims=True), 1)
    m = (p + reference) / 2

    def relative(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.sqrt(np.clip((relative(p) + relative(np.broadcast_to(reference, p.shape))) / 2, 0, 1))


def judge(rows: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], id_col: str = "doc_id") -> DataFrame:
    """Adds class_distance, word_distance (to the closest language), base_failed and kept; drops the histograms."""
    langs = list(refs.values())

    def compare(classes: pa.Array, common: pa.Array) -> pa.Array:
        found = []
        for k, column in enumerate((classes, common)):
            if not len(column):
                found.append(np.zeros(0))
                continue
            counts = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            each = [distance(counts, r[k]) for r in langs]
            found.append(np.round(np.min(each, axis=0), 6) if each else np.zeros(len(column)))
        return pa.StructArray.from_arrays([pa.array(f) for f in found], names=["class_distance", "word_distance"])

    numbers = [n for n, t in FIELDS if pa.types.is_integer(t)]
    distances = F.arrow_udf(compare, "class_distance double, word_distance double")(F.col("classes"), F.col("common"))
    judged = rows.select(id_col, *numbers, distances.alias("_d")).select(id_col, *numbers, "_d.*")
    chance = 1 / F.sqrt(F.greatest(F.lit(1), F.col("n_words")))
    odd_classes = (F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE[0] + MAX_CLASS_DISTANCE[1] * chance)
    odd_words = (F.col("n_words") >= MIN_COUNTED) & (F.col("word_distance") > MAX_WORD_DISTANCE[0] + MAX_WORD_DISTANCE[1] * chance)
    return judged.withColumn("base_failed", failed()).withColumn("kept", ~(F.col("base_failed") | odd_classes | odd_words))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: the id, base counts, distances, base_failed, kept."""
    rows = Tables(docs.sparkSession, "quality").keep(measured(docs, id_col, text_col, lang_col))
    return judge(rows, references(rows), id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Each row is judged by itself and carried through the verdict, so ids do not matter."""
    carried = "_row"
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.struct("*").alias(carried), F.col(text_col).alias("_text"), lang.cast("string").alias("_lang"))
    return quality(rows, carried, "_text", "_lang").filter("kept").select(f"{carried}.*")
