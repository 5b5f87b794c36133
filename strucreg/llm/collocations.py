"""Phrase collocations by mergeable Misra-Gries summaries.

Two passes over the texts. In the first, every phrase of 1 to 4 words becomes a key of 64 bits; tasks count the keys of a
stretch of text and send the counts, sorted and packed, to the keys' hash partitions. A partition merges what comes into one
Misra-Gries summary: when there are more counters than its capacity, the count of the first one too many is taken off all.
Its capacity is ``ROOM`` times the partition's mass divided by the threshold, so that less than threshold / ROOM is ever taken
off, and each phrase with that many occurrences survives. The number of partitions follows from the bytes of text, so a
summary has a bounded size. Survivors become a set of bits (``bitset``: bounded; letting a key pass too many costs work only).
In the second pass only phrases in that set are counted, by their words and not by their keys, hence exactly.

From the exact counts follow the scores of all cuts and the candidates that a longer one covers, by joins on the phrase.

Defined cases: null text is empty, a null language counts as ``und``; ids are not read, so null ids, ties and repeated rows are
texts like others; an empty table or texts without words give no rows; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm import bitset, words
from strucreg.llm.common import Tables, text_or_empty

SEPARATORS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
# Counters of a summary, as a multiple of mass / threshold.
ROOM = 4
# Phrases that a task counts before it sends them on, and the most phrases that a partition is meant to get.
STRETCH = 2 << 20
PARTITION_MASS = 32 << 20
# Two rows per partition and stretch: kind 0 with the occurrences, kind 1 with the number of different keys, the keys and counts.
_SENT = "part int, kind int, amount bigint, keys binary, counts binary"
_SENT_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("amount", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> np.uint64(32))) * _ODD
        keys = (keys ^ (keys >> np.uint64(32))) * _ODD
    return keys ^ (keys >> np.uint64(32))


def _slices(batch: pa.RecordBatch, table: np.ndarray):
    """Per slice of a batch with lang and text: the words, the language number of each, the languages, the hash of each."""
    langs = batch.column("lang").dictionary_encode()
    seeds = words.Words(None, None, None, langs.dictionary).hashes()
    lang = langs.indices.to_numpy(zero_copy_only=False)
    texts = batch.column("text")
    for start, stop in words.slices(texts):
        found = words.cut(texts.slice(start, stop - start), table)
        yield found, lang[start + found.row], langs.dictionary, seeds


def phrase_keys(found: words.Words, lang: np.ndarray, seeds: np.ndarray):
    """For each length: the place of the first word and the key of every phrase within a piece."""
    hashes = found.hashes()[found.code] if len(found.code) else np.zeros(0, np.uint64)
    running = hashes ^ _mixed(seeds[lang]) if len(hashes) else hashes
    for size in range(1, LONGEST + 1):
        if size > 1:
            with np.errstate(over="ignore"):
                running = _mixed(running[:-1]) * _ODD + hashes[size - 1 :]
        if not len(running):
            return
        at = np.flatnonzero(found.piece[size - 1 :] == found.piece[: len(running)])
        yield size, at, _mixed(running[at] + np.uint64(size))


def _planes(values: np.ndarray) -> bytes:
    """The numbers byte by byte, all lowest bytes first: upper bytes are mostly 0 and are compressed away. Compressed here and not
    by the shuffle, so that a task's batch of rows is no larger than what it was sent."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _from_planes(data: bytes, count: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _sent(keys: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Counted keys of a stretch per partition: the partition is the key's first ``bits`` bits, its name there the next 32."""
    short, counts = np.unique(np.concatenate(keys) >> np.uint64(32 - bits), return_counts=True)
    part = (short >> np.uint64(32)).astype(np.int64)
    name = short & np.uint64(0xFFFFFFFF)
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows: list[tuple] = []
    for p, names, n in zip(part[np.concatenate([[0], cuts])].tolist(), np.split(name, cuts), np.split(counts, cuts)):
        rows.append((p, 0, int(n.sum()), None, None))
        rows.append((p, 1, len(n), _planes(np.diff(names, prepend=names[:1] * 0)), _planes(n)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT_ARROW.types)], schema=_SENT_ARROW)


class Summary:
    """Misra-Gries counters that take in counted keys; less than mass / (capacity + 1) is taken off any count."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stay = self.counts > off
            self.keys, self.counts, self.taken = self.keys[stay], self.counts[stay] - off, self.taken + off

    def at_least(self, threshold: int) -> np.ndarray:
        """All keys that may have ``threshold`` occurrences."""
        self.merge()
        return self.keys[self.counts + self.taken >= threshold]


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))


def survivors(tables: Tables, texts: DataFrame, threshold: int, partition_mass: int = PARTITION_MASS, room: int = ROOM, stretch: int = STRETCH) -> tuple[DataFrame, int, int]:
    """Table of the surviving keys, cut to ``bits`` + 32 bits at the top; their number; ``bits``."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes two bytes at least, and starts one phrase of each length
    bits = min(24, max(0, (LONGEST * (size // 2 + 1) // partition_mass).bit_length()))
    table = words.classes(SEPARATORS, BREAKS)

    def count(batches):
        keys, held = [], 0
        for batch in batches:
            for found, lang, _, seeds in _slices(batch, table):
                for _, _, k in phrase_keys(found, lang, seeds):
                    keys.append(k)
                    held += len(k)
                if held >= stretch:
                    yield _sent(keys, bits)
                    keys, held = [], 0
        if held:
            yield _sent(keys, bits)

    def summarise(batches):
        part, mass, summary = None, 0, None

        def finished():
            left = summary.at_least(threshold) if summary is not None else np.zeros(0, np.uint64)
            whole = ((np.uint64(part) << np.uint64(32)) | left) << np.uint64(32 - bits)
            return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64))], names=["key"])

        for batch in batches:
            for p, kind, amount, keys, counts in zip(*(batch.column(i) for i in range(5))):
                if p.as_py() != part:
                    if part is not None:
                        yield finished()
                    part, mass, summary = p.as_py(), 0, None
                if kind.as_py() == 0:
                    mass += amount.as_py()
                    continue
                if summary is None:
                    summary = Summary(room * mass // threshold + 1)
                n = amount.as_py()
                summary.add(np.cumsum(_from_planes(keys.as_py(), n).astype(np.uint64)), _from_planes(counts.as_py(), n).astype(np.int64))
        if part is not None:
            yield finished()

    sent = texts.mapInArrow(count, _SENT).repartition("part").sortWithinPartitions("part", "kind")
    left = tables.keep(sent.mapInArrow(summarise, "key bigint"))
    return left, left.count(), bits


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = 30, max_bits: int = bitset.MAX_BITS, **sizes) -> DataFrame:
    """``lang, phrase, size, f``: all phrases of 1 to 4 words with at least ``threshold`` occurrences in their language, and the
    number of words of each language as the empty phrase of size 0."""
    tables = Tables(docs.sparkSession, "phrases")
    texts = _texts(docs, text_col, lang_col)
    left, number, bits = survivors(tables, texts, threshold, **sizes)
    kept = bitset.build(left, number, max_bits)
    table = words.classes(SEPARATORS, BREAKS)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])
    top = np.uint64(32 - bits)

    def count(batches):
        for batch in batches:
            for found, lang, langs, seeds in _slices(batch, table):
                n = np.bincount(lang, minlength=len(langs))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(seen)), pa.array([""] * len(seen)), pa.array(np.zeros(len(seen), np.int32)), pa.array(n[seen])], schema=schema
                )
                for size, at, keys in phrase_keys(found, lang, seeds):
                    chosen = kept.has((keys >> top) << top)
                    at, keys = at[chosen], keys[chosen]
                    if not len(at):
                        continue
                    order = np.argsort(keys, kind="stable")
                    at, keys = at[order], keys[order]
                    # a new group wherever the key, the language or any word changes: words decide, not keys
                    new = keys[1:] != keys[:-1]
                    for values in (lang[at], *(found.code[at + i] for i in range(size))):
                        new |= values[1:] != values[:-1]
                    first = np.flatnonzero(np.concatenate([[True], new]))
                    total = np.diff(np.concatenate([first, [len(at)]]))
                    place = at[first]
                    parts = [found.distinct.take(pa.array(found.code[place + i])) for i in range(size)]
                    phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(lang[place])), phrase, pa.array(np.full(len(place), size, np.int32)), pa.array(total)], schema=schema
                    )

    counted = texts.mapInArrow(count, "lang string, phrase string, size int, f bigint")
    # the phrases of one language and length meet by their text; tasks add theirs up before
    out = tables.keep(counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= threshold) | (F.col("size") == 0)))
    tables.forget(left)
    return out


def _share(whole: int, part: str, of: str) -> Column:
    """floor(whole * part / of), exact beyond 64 bits."""
    return F.expr(f"cast((cast({part} as decimal(20,0)) * {whole}) div cast({of} as decimal(20,0)) as bigint)")


def candidates(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, k, l, r, score``: phrases of two words and more that no longer one covers, with their lowest-scoring cut."""
    phrases = counts.filter("size >= 2").withColumn("w", F.split("phrase", " "))
    joined = lambda first, length: F.array_join(F.slice("w", first, length), " ")
    cuts = phrases.select("lang", "phrase", "size", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    known = lambda part, f: counts.filter("size >= 1").select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    both = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"])
    scored = both.select("lang", "phrase", "a", F.struct(_share(2_000_000, "a", "l + r").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.*")
    longer = phrases.filter("size >= 3").select("lang", "w", "f", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"), "size")
    inner = longer.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: joined(i, F.col("n")))).alias("phrase"))
    cover = inner.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    # 100 * cover >= 80 * a
    return best.join(cover, ["lang", "phrase"], "left").filter("cover is null or 5 * cover < 4 * a").drop("cover")


def _among_first(scored: DataFrame, first: int) -> DataFrame:
    """Rows that can be among the ``first`` of their language by score: those from the band of scores on in which that many are reached."""
    band = F.floor(F.col("score") / 1000)
    bands = scored.groupBy("lang", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))  # at most 1,001 rows per language
    above = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("band"))) - F.col("n")
    least = bands.withColumn("above", above).filter(F.col("above") < first).groupBy("lang").agg(F.min("band").alias("least"))
    return scored.join(least, "lang").filter(band >= F.col("least")).drop("least")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = 30, first: int = 2000, **sizes) -> DataFrame:
    """Each language's ``first`` phrases: ``lang, rank, phrase, a, l, r, n, score, k``."""
    counts = phrase_counts(docs, text_col, lang_col, threshold, **sizes)
    scored = Tables(docs.sparkSession, "collocations").keep(candidates(counts))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _among_first(scored, first).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= first)
    total = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
