"""Removal of repeated passages by external induced suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. The corpus is first cut into shards that can be sorted
apart: every string of that length is assigned to its anchor, the 36-byte gram with the smallest hash in it (the leftmost of equal ones), so equal strings
have equal anchors. Neighbouring strings with one anchor form a segment. Anchors that occur once need no sorting, segments that are equal as a whole
only their first location; of the others, distinct segments with a common anchor, the text goes to the shard of the anchor. The strings of
very common anchors (a line with many different neighbours) are grouped one by one instead, so that no shard grows with them. Those with a large
share of all segments are found beforehand, by counters of a fixed number, and are never brought together by anchor.

A shard's segments are one text whose suffixes are sorted by induction: the suffixes that begin a descent-to-ascent (LMS) are sorted by
inducing their substrings, naming these, and ordering the shorter text of names; from their order all others are induced. A priority
queue by first character carries the suffixes, first in first out within a character; text and queues lie in files once a shard is larger than
``IN_MEMORY``, and are passed in blocks. Neighbours in the order are compared over the length; within a group of equal
strings all but the earliest are repeats.

Defined cases: null text is empty; texts shorter than the length keep all bytes; a null id comes after all others; rows that repeat an id or have
none are told apart by their text and compared in the order of its digests, and rows equal in both are one document with one result for each;
very long texts are passed in pieces; other columns are not read. Ids are integers.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm import bitset
from strucreg.llm.common import Tables, in_batches
from strucreg.operators.partial_sums import sum_vectors, vector_rows

LENGTH, GRAM = 100, 36
PER_STRING = LENGTH - GRAM + 1
# Strings passed at a time; their places share a word with the hash, so at most 2^20.
PIECE = 1 << 19
SHARD_BYTES = 2 << 20
# An anchor with more segments than this is not sorted in one shard; its strings are grouped one by one.
COMMON = 1000
IN_MEMORY = 8 << 20
BLOCK = 1 << 18
LAST = (1 << 63) - 1
# A place in a text has fewer than 2^31 values, as a text has fewer bytes; a tie has 32 bits.
PLACE_BITS = 31

_rng = np.random.Generator(np.random.PCG64(20))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
POWER = np.full(PIECE + LENGTH + 1, _BASE, np.uint64)
POWER[0] = 1
POWER = np.cumprod(POWER)
INVERSE = np.full(len(POWER), pow(_BASE, -1, 1 << 64), np.uint64)
INVERSE[0] = 1
INVERSE = np.cumprod(INVERSE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (at most PIECE strings): anchor hash, segment hash, first and last string of each segment."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[raw] * POWER[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * INVERSE[: n - GRAM + 1])
    low = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= PER_STRING:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < PER_STRING:
        low = np.minimum(low[: len(low) - (PER_STRING - width)], low[PER_STRING - width :])
    anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor), bool)  # strings that do not cross the end of a text
    for e in ends[:-1]:
        inside[max(0, e - LENGTH + 1) : e] = False
    start = inside.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    last = np.flatnonzero(stop)
    whole = _mix((sums[last + LENGTH] - sums[first]) * INVERSE[first] + (last - first).astype(np.uint64))
    return grams[anchor[first]], whole, first, last


def _laid(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces: bytes, ends of texts, number of each text, place of its first byte in its text."""
    parts: list[np.ndarray] = []
    number: list[int] = []
    place: list[int] = []
    size = 0

    def done():
        return np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(number), np.array(place)

    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        for low in range(0, max(0, len(raw) - LENGTH + 1), PIECE // 2):
            part = raw[low : low + PIECE // 2 + LENGTH - 1]
            if size + len(part) > PIECE:
                yield done()
                parts, number, place, size = [], [], [], 0
            parts.append(part), number.append(i), place.append(low)
            size += len(part)
    if parts:
        yield done()


def _keyed(tables: Tables, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, doc (the id, null last) and tie, which parts the different texts of a repeated or missing id: a number of its own for
    each, by the order of their hashes. Rows whose id is their own have tie 0 and are not moved for it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"))
    several = tables.keep(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc = %d" % LAST).select(F.xxhash64("doc").alias("key")))
    number = several.count()
    if not number:
        return rows.withColumn("tie", F.lit(0).cast("bigint"))
    shared = bitset.build(several, number)

    def chosen(which: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(shared.has(batch.column("key").to_numpy().view(np.uint64)) == which))

        return rows.withColumn("key", F.xxhash64("doc")).mapInArrow(run, keyed_schema).drop("key")

    keyed_schema = rows.withColumn("key", F.xxhash64("doc")).schema
    # written, as the numbers of their texts must not change; a few rows too many do no harm
    meet = tables.keep(chosen(True).withColumn("sha", F.sha2("text", 256)))
    texts = meet.select("doc", "sha").distinct().withColumn("block", F.conv(F.substring("sha", 1, 3), 16, 10).cast("int"))
    inside = F.row_number().over(W.partitionBy("block").orderBy("sha", "doc"))
    sizes = texts.groupBy("block").agg(F.count(F.lit(1)).alias("n"))  # 4,096 rows at most
    before = sizes.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))
    ties = texts.withColumn("inside", inside).join(before, "block").select("doc", "sha", (F.col("before") + F.col("inside")).cast("bigint").alias("tie"))
    if (ties.agg(F.max("tie")).first()[0] or 0) >= 1 << 32:
        raise ValueError("more than 2^32 different texts share an id or have none")
    return chosen(False).withColumn("tie", F.lit(0).cast("bigint")).unionByName(tables.keep(meet.join(ties, ["doc", "sha"]).drop("sha")))


def _segments_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a batch of text, doc and tie: anchor, whole, doc, start (tie and place) and span of the segments, piece by piece."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
    doc, tie = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    for raw, ends, number, place in _laid(texts):
        anchor, whole, first, last = segments(raw, ends)
        part = np.searchsorted(ends, first, side="right")
        begin = np.concatenate(([0], ends))[part]
        yield anchor, whole, doc[number[part]], (tie[number[part]] << PLACE_BITS) + place[part] + first - begin, last - first


# Counters of anchors, twice by different bits, and the share of all segments from which on an anchor is parted off beforehand.
COUNTERS, HOT_SHARE = 1 << 18, 1 << 15


def _counters(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (anchor >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1), (anchor >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)


def _anchor_counts(keyed: DataFrame) -> np.ndarray:
    """How many segments fall on each counter (2 x COUNTERS): never less than an anchor has, whatever the size of the corpus. Segments that a
    batch has several times count once, as they move once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, COUNTERS))
        for batch in batches:
            found = [(anchor, whole) for anchor, whole, *_ in _segments_of(batch)]
            if found:
                anchor, whole = (np.concatenate(f) for f in zip(*found))
                _, once = np.unique(_mix(anchor + np.uint64(3) * whole), return_index=True)
                for row, at in zip(total, _counters(anchor[once])):
                    row += np.bincount(at, minlength=COUNTERS)
        yield vector_rows({0: total})

    return sum_vectors(keyed.select("text", "doc", "tie"), count)[0].reshape(2, COUNTERS)


def _located(keyed: DataFrame, counts: np.ndarray) -> DataFrame:
    """(anchor, whole, doc, start, span, again, hot): a segment's strings start at ``start`` (tie and place) to ``start + span``. ``again`` marks
    segments that occur earlier in the same batch, ``hot`` those of anchors with very many; their anchors are replaced by spread ones."""
    limit = max(COMMON, counts[0].sum() / HOT_SHARE)
    names = ["anchor", "whole", "doc", "start", "span", "again", "hot"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
    # the few counters beyond the limit are sent, not all
    full = [np.flatnonzero(row > limit) for row in counts]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(_segments_of(batch))
        if not found:
            return pa.record_batch([pa.array([], t) for t in kinds], names=names)
        anchor, whole, of, start, span = (np.concatenate(f) for f in zip(*found))
        both = _mix(anchor + np.uint64(3) * whole)
        order = np.lexsort((start, of, both))
        again = np.zeros(len(both), bool)
        again[order[1:]] = both[order][1:] == both[order][:-1]
        # rows equal in id and text are one document, whose places are not repeats of themselves
        same = (of[order][1:] == of[order][:-1]) & (start[order][1:] == start[order][:-1])
        again[order[1:][same]] = False
        hot = np.logical_and(*(np.isin(at, some) for at, some in zip(_counters(anchor), full))) & ~again
        anchor = np.where(again | hot, _mix(start.astype(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), anchor)
        columns = (anchor.view(np.int64), whole.view(np.int64), of, start, span, again, hot)
        return pa.record_batch([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=names)

    return in_batches(keyed.select("text", "doc", "tie"), scan, "anchor bigint, whole bigint, doc bigint, start bigint, span int, again boolean, hot boolean")


def _room(n: int, dtype) -> np.ndarray:
    """An array, in an unnamed file of the task's own once it is large; the file goes with the array."""
    if n * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.empty(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


class Queue:
    """Suffixes by first character, first in first out within it. ``ascending`` serves small characters first and keeps a character's suffixes
    from its front; descending, from its back."""

    def __init__(self, text: np.ndarray, counts: np.ndarray, ascending: bool, out: np.ndarray):
        self.text, self.out, self.ascending = text, out, ascending
        ends = np.cumsum(counts)
        self.base = ends - counts if ascending else ends
        self.size = np.zeros(len(counts), np.int64)

    def push(self, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        char = self.text[suffixes]
        order = np.argsort(char, kind="stable")
        char, suffixes = char[order], suffixes[order]
        counts = np.bincount(char, minlength=len(self.size))
        place = np.arange(len(char)) - np.repeat(np.cumsum(counts) - counts, counts) + self.size[char]
        self.out[self.base[char] + place if self.ascending else self.base[char] - 1 - place] = suffixes
        self.size += counts

    def blocks(self, char: int) -> Iterator[np.ndarray]:
        """The character's suffixes in order, also those pushed meanwhile."""
        done = 0
        while done < self.size[char]:
            n = int(min(self.size[char] - done, BLOCK))
            at = int(self.base[char])
            yield np.array(self.out[at + done : at + done + n] if self.ascending else self.out[at - done - n : at - done][::-1])
            done += n


def _induce(text: np.ndarray, falls: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    n = len(text)
    out = _room(n, np.int32)
    starts = np.concatenate(([0], np.cumsum(np.bincount(text[lms], minlength=len(counts)))))
    lms = lms[np.argsort(text[lms], kind="stable")]
    up = Queue(text, counts, True, out)
    for char in np.flatnonzero(counts):
        for source in (up.blocks(char), (lms[starts[char] : starts[char + 1]],)):
            for block in source:
                before = block[block > 0] - 1
                up.push(before[falls[before]])
    down = Queue(text, counts, False, out)
    down.push(np.array([n - 1]))
    for char in np.flatnonzero(counts)[::-1]:
        for block in down.blocks(char):
            before = block[block > 0] - 1
            down.push(before[~falls[before]])
        end = int(up.base[char] + up.size[char])
        for high in range(end, int(up.base[char]), -BLOCK):
            block = np.array(out[max(int(up.base[char]), high - BLOCK) : high][::-1])
            before = block[block > 0] - 1
            down.push(before[~falls[before]])
    return out


def _named_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of names, by doubling ranks until they differ or ``depth`` names are covered."""
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], key[order][1:] != key[order][:-1]))
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(fresh)
        width *= 2
        if fresh[1:].all() or width >= depth or width >= len(rank):
            return order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text``, sorted by their first ``depth`` characters at least. The last character must be the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    counts = np.bincount(text)
    # a suffix falls if its first character is larger than the next different one
    falls = _room(n, bool)
    falls[n - 1] = False
    for high in range(n - 1, 0, -BLOCK):
        low = max(0, high - BLOCK)
        part = np.array(text[low : high + 1]).astype(np.int32)
        change = np.flatnonzero(part[1:] != part[:-1])
        at = np.searchsorted(change, np.arange(high - low))
        known = at < len(change)
        falls[low:high] = falls[high]  # a run that goes on beyond the block
        end = change[at[known]]
        falls[low : low + len(end)] = part[end] > part[end + 1]
    lms = np.flatnonzero(~falls[1:] & falls[:-1]) + 1
    out = _induce(text, falls, lms, counts)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = np.array(out[is_lms[out]])
        # equal LMS substrings (from one LMS place to the next) get equal names
        place = np.empty(n, np.int32)
        place[lms] = np.arange(len(lms))
        size = np.diff(np.concatenate((lms, [n - 1])))
        longest = min(int(size.max()), depth) + 1  # what differs later does not matter here
        index = place[found]
        same = size[index][1:] == size[index][:-1]
        for k in range(longest):
            check = np.flatnonzero(same & (size[index][1:] >= k))
            if not len(check):
                break
            same[check] &= text[np.minimum(found[1:][check] + k, n - 1)] == text[np.minimum(found[:-1][check] + k, n - 1)]
        names = np.empty(len(lms), np.int64)
        names[index] = np.concatenate(([0], np.cumsum(~same)))
        order = np.argsort(names, kind="stable") if names.max() + 1 == len(lms) else _named_order(names, depth)
        out = _induce(text, falls, lms[order], counts)
    return out


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the strings of LENGTH bytes at a and b are equal, eight bytes at a time."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        left = np.flatnonzero(same)
        same[left] = words[a[left] + k] == words[b[left] + k]
    return same


def shard_repeats(raw: np.ndarray, begin: np.ndarray, doc: np.ndarray, start: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments laid in ``raw`` one after the other (each at ``begin``, span + LENGTH bytes and a spare one): (doc, start, span) of the strings that repeat an earlier one."""
    text = _room(len(raw) + 1, np.uint16)
    text[:-1] = raw
    text[:-1] += 2
    text[begin + span + LENGTH] = 1
    text[-1] = 0
    order = suffix_order(text, LENGTH)
    here = np.searchsorted(begin, order, side="right") - 1
    valid = order <= (begin + span)[here]
    order, here = np.array(order[valid]), here[valid]
    group = np.concatenate(([0], np.cumsum(~_equal(raw, order[1:], order[:-1]))))
    of, at = doc[here], start[here] + (order - begin[here])
    sort = np.lexsort((at, of, group))
    group, of, at = group[sort], of[sort], at[sort]
    again = np.concatenate(([False], (group[1:] == group[:-1])))
    first = np.flatnonzero(~again)
    head = first[np.cumsum(~again) - 1]
    again &= (of != of[head]) | (at != at[head])
    return _runs(of[again], at[again])


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts as runs: doc, first start, last less first."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], start[at], np.append(start[at[1:] - 1], start[-1]) - start[at]


def _contested(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, doc, start, span, raw): the bytes of segments."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        size = 0
        for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = text.encode("utf-8", "surrogatepass")
            for f in found:
                at = f["start"] & ((1 << PLACE_BITS) - 1)
                part = raw[at : at + f["span"] + LENGTH]
                for c, v in zip(columns, (f["anchor"], doc, f["start"], f["span"], part)):
                    c.append(v)
                size += len(part)
            if size > 4 << 20:
                yield _segment_batch(columns)
                columns, size = [[], [], [], [], []], 0
        if columns[0]:
            yield _segment_batch(columns)

    return in_batches(_with_text(keyed, wanted), cut, "anchor bigint, doc bigint, start bigint, span int, raw binary")


def _with_text(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text, found): documents with the segments wanted of them."""
    per_doc = wanted.groupBy("doc", F.shiftrightunsigned("start", PLACE_BITS).alias("tie")).agg(F.collect_list(F.struct("anchor", "start", "span")).alias("found"))
    return keyed.select("doc", "tie", "text").join(per_doc, ["doc", "tie"]).select("doc", "text", "found")


def _named_strings(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, start, span) of repeats among the segments of common anchors. Each string is a group of its own, named by 128 bits, so that the
    segments of one anchor are spread; equal strings are reduced to their first location before they move."""

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 200):
            names, doc_of, start_of = [], [], []
            for doc, text, found in zip(*(batch.column(c).slice(i, 200).to_pylist() for c in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                for f in found:
                    at = f["start"] & ((1 << PLACE_BITS) - 1)
                    names += [hashlib.blake2b(raw[p : p + LENGTH], digest_size=16).digest() for p in range(at, at + f["span"] + 1)]
                    doc_of += [doc] * (f["span"] + 1)
                    start_of += range(f["start"], f["start"] + f["span"] + 1)
            half = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            columns = [np.ascontiguousarray(half[:, 0]), np.ascontiguousarray(half[:, 1]), np.array(doc_of, np.int64), np.array(start_of, np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["low", "high", "doc", "start"])

    strings = in_batches(_with_text(keyed, wanted), name, "low bigint, high bigint, doc bigint, start bigint")
    first = strings.groupBy("low", "high").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = strings.join(first, ["low", "high"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return later.select("doc", "start", F.lit(0).alias("span"))


def _segment_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "doc", "start", "span", "raw"])


def _sorted_shards(cut: DataFrame, shards: int) -> DataFrame:
    """(doc, start, span) of repeats; a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as spill:
            doc, start, span, size, kept, held = [], [], [], 0, [], 0
            for batch in batches:
                raw = batch.column(4).to_pylist()
                doc.append(batch.column(1).to_numpy()), start.append(batch.column(2).to_numpy()), span.append(batch.column(3).to_numpy().astype(np.int64))
                joined = b"".join(x + b"\0" for x in raw)
                size += len(joined)
                kept.append(joined)
                held += len(joined)
                if held > IN_MEMORY:
                    spill.write(b"".join(kept))
                    kept, held = [], 0
            if not size:
                return
            if spill.tell():
                spill.write(b"".join(kept))
                spill.flush()
                text = np.memmap(spill, np.uint8, "r", shape=(size,))
            else:
                text = np.frombuffer(b"".join(kept), np.uint8)
            doc, start, span = np.concatenate(doc), np.concatenate(start), np.concatenate(span)
            begin = np.concatenate(([0], np.cumsum(span + LENGTH + 1)[:-1]))
            a, b, c = shard_repeats(text, begin, doc, start, span)
            for low in range(0, len(a), 100_000):
                part = slice(low, low + 100_000)
                yield pa.record_batch([pa.array(a[part]), pa.array(b[part]), pa.array(c[part].astype(np.int32))], names=["doc", "start", "span"])

    return cut.repartition(shards, "anchor").mapInArrow(run, "doc bigint, start bigint, span int")


def repeats(tables: Tables, keyed: DataFrame) -> DataFrame:
    """(doc, start, span): strings starting at start to start + span of a document also start earlier."""
    # anchors with a large share of all segments are parted off before anything is brought together by anchor
    rows = _located(keyed, _anchor_counts(keyed)).repartition("anchor")
    occurrence = F.rank().over(W.partitionBy("anchor", "whole").orderBy("doc", "start"))
    every = W.partitionBy("anchor")
    rows = rows.withColumns({"nth": occurrence}).withColumns({"low": F.min("whole").over(every), "high": F.max("whole").over(every)})
    rows = rows.withColumn("common", F.col("hot") | (F.count(F.lit(1)).over(every) > COMMON))
    rows = rows.withColumn("repeat", ~F.col("hot") & (F.col("again") | (F.col("nth") > 1))).filter("repeat or hot or low != high")
    rows = tables.keep(rows.select(F.when(~F.col("repeat"), F.col("anchor")).alias("anchor"), "doc", "start", "span", "common"))
    tables.release()
    wanted = rows.filter("anchor is not null and not common").drop("common")
    common = rows.filter("anchor is not null and common").drop("common")
    size = wanted.agg(F.sum(F.col("span") + LENGTH + 1)).first()[0] or 0
    found = _sorted_shards(_contested(keyed, wanted), max(1, -(-size // SHARD_BYTES)))
    if not common.isEmpty():
        found = found.unionByName(_named_strings(keyed, common))
    out = tables.keep(rows.filter("anchor is null").select("doc", "start", "span").unionByName(found))
    tables.release()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, n_spans, removed (runs: start, end in bytes), kept (the bytes left)."""
    tables = Tables(docs.sparkSession, "suffixes")
    keyed = _keyed(tables, docs, id_col, text_col)
    found = repeats(tables, keyed)
    per_doc = found.groupBy("doc", F.shiftrightunsigned("start", PLACE_BITS).alias("tie")).agg(
        F.collect_list(F.struct(F.col("start").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("start"), "span")).alias("found")
    )
    rows = keyed.join(per_doc, ["doc", "tie"], "left").select("id", "text", "found")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, 500):
            yield _kept(batch.slice(low, 500), id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(rows, cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")


def _kept(batch: pa.RecordBatch, id_col: str) -> pa.RecordBatch:
    sizes, gone, runs, left = [], [], [], []
    for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        cuts: list[dict] = []
        if found:
            for low, high in sorted((f["start"], f["start"] + f["span"] + LENGTH) for f in found):
                if cuts and low <= cuts[-1]["end"]:
                    cuts[-1]["end"] = max(cuts[-1]["end"], high)
                else:
                    cuts.append({"start": low, "end": high})
        kept, end = [], 0
        for c in cuts:
            kept.append(raw[end : c["start"]])
            end = c["end"]
        kept.append(raw[end:])
        sizes.append(len(raw)), runs.append(cuts), left.append(b"".join(kept))
        gone.append(sum(c["end"] - c["start"] for c in cuts))
    spans = pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.record_batch(
        [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), spans, pa.array(left, pa.binary())],
        names=[id_col, "n_bytes", "n_removed", "n_spans", "removed", "kept"],
    )
