"""Similarity join on word shingles by PartEnum signatures.

A document's set has its distinct five-word shingles, as 64-bit hashes. Two sets link at Jaccard 0.75 or more. Sizes are cut into bands
of ratio 0.75; linked sets lie in the same band or in neighbouring ones and differ in at most k = 2 r / 7 elements, r the larger band's
upper end. For each pair of neighbouring bands the hash domain is partitioned into n1 parts of three sub-parts. Two sets that differ in at most k
elements differ in at most one element of some part, so they agree on two of its three sub-parts. The signatures of a set are all its choices
of a part and two sub-parts. An empty choice gives no signature; a set with so many poor parts that the argument could rest on an empty one
takes the band's common mark as well. So no link is lost.

* Equal sets are one class from the start; only classes are joined.
* A linked class of n elements has at most n / 4 that the other lacks, so a class is left out if more than n / 4 of its elements occur in no other
  class. This is counted twice: on three eighths of the hash domain over all classes, then on the whole domain over those left.
* Two classes of n and m elements, l and j of them their own alone, differ in l + j elements and in at least as many others as parity bits, one for
  each of 512 parts of the domain, differ. Pairs for which that is above (n + m) / 7 cannot link and are not looked at.
* A bucket (signature) is not expanded into pairs. Each class first meets the bucket's pivot, its most ordinary member; met pairs are checked on the
  whole sets, links are contracted, and buckets within one component are closed. Of the pairs between different components left in the others only the
  possible ones are enumerated; they are all checked, so the components are exact.

Defined cases: null, empty and blank texts have the empty set and link with nothing; their component is their own id; rows that repeat an id are nodes of
their own, and a component's id is its smallest id (null only if it has no other); fewer than five words make one shingle; ties
go to the smallest id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.llm.common import SPACE_BYTES, Tables, in_batches
from strucreg.llm.graph import components

SHINGLE = 5
SUB = 3
# Of the hash domain what is counted over all classes. A class without a partner has about 3/8 of its elements there, well above 1/4.
COUNTED = np.uint64(3 << 61)
# Words of the parity bits, 64 parts of the domain each.
PARITY = [f"p{i}" for i in range(8)]
_ODD = np.array([2 * (0x9E3779B97F4A7C15 * (i + 3) % (1 << 63)) + 1 for i in range(SHINGLE)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.Generator(np.random.PCG64(5))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Powers by the lower and the upper half of a place; a text has fewer than 2^31 bytes.
POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
UPPER = np.concatenate(([np.uint64(1)], np.cumprod(np.full((1 << 15) - 1, POWER[-1], np.uint64))))
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False
GROUP_BYTES = 1 << 20


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a text, and the words' first bytes: a random number per byte times a power by its place in the word."""
    codes = np.frombuffer(raw, np.uint8)
    word = IS_WORD[codes]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint64), first
    inside = np.flatnonzero(word)
    begin = np.searchsorted(inside, first)
    size = np.diff(np.append(begin, len(inside)))
    place = np.arange(len(inside)) - np.repeat(begin, size)
    value = BYTE[codes[inside]] * POWER[place & (len(POWER) - 1)]
    if size.max() > len(POWER):
        far = np.flatnonzero(place >= len(POWER))
        value[far] *= UPPER[place[far] >> 16]
    return _mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), first


def _grouped(texts: list[str | None]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
        group.append(raw)
        size += len(raw) + 1
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for group in _grouped(texts):
        h, first = _word_hashes(b"\n".join(group))
        ends = np.cumsum([len(raw) + 1 for raw in group])
        words = np.diff(np.searchsorted(first, np.concatenate(([0], ends))))
        key = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            key += h[i : len(key) + i] * _ODD[i]
        key = _mix(key)
        at = 0
        for n in words.tolist():
            if n >= SHINGLE:
                own = np.sort(key[at : at + n - SHINGLE + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif n:
                yield _mix(np.array([(h[at : at + n] * _ODD[:n]).sum(dtype=np.uint64) ^ np.uint64(0xA24BAED4963EE407 * n % (1 << 64))], np.uint64))
            else:
                yield key[:0]
            at += n


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def _digest(keys: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return int(_mix(keys ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)), int(_mix(keys + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64))


def bands(largest: int) -> list[int]:
    """Upper ends of the size bands up to ``largest``, then one more."""
    ends, low = [], 1
    while True:
        ends.append(low * 4 // 3)
        if low > largest:
            return ends
        low = ends[-1] + 1


def signatures(keys: np.ndarray) -> np.ndarray:
    """The signatures of one set: for its own band and the next one, each as the upper of two neighbours."""
    s = len(keys)
    ends = bands(s)
    own = next(i for i, e in enumerate(ends) if s <= e)
    out = []
    for band in (own, own + 1):
        r = ends[band] if band < len(ends) else (ends[-1] + 1) * 4 // 3
        k = 2 * r // 7
        if not k:
            continue  # only equal sets could link
        n1 = -(-23 * (k + 1) // 40) + 2  # 1.15 (k + 1) / 2 and two more
        seed = np.uint64(0x9E3779B97F4A7C15 * (band + 1) % (1 << 64))
        mixed = _mix(keys ^ seed)
        part = (mixed >> np.uint64(32)) % np.uint64(n1)
        cell = (part * np.uint64(SUB) + (mixed & np.uint64(0xFFFFFFFF)) % np.uint64(SUB)).astype(np.int64)
        count = np.bincount(cell, minlength=n1 * SUB).reshape(n1, SUB)
        total = np.zeros(n1 * SUB, np.uint64)
        np.add.at(total, cell, _mix(mixed + np.uint64(1)))
        total = total.reshape(n1, SUB)
        rest = total.sum(axis=1, dtype=np.uint64, keepdims=True) - total
        there = count.sum(axis=1, keepdims=True) - count > 0
        place = np.arange(n1 * SUB, dtype=np.uint64).reshape(n1, SUB)
        out.append(_mix(rest ^ _mix(place + seed))[there])
        if int(there.all(axis=1).sum()) <= min(k, s // 3) // 2:
            out.append(_mix(np.array([seed + np.uint64(0xFFFF)], np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _classes(docs: DataFrame) -> DataFrame:
    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [(len(s), *_digest(s)) for s in shingle_sets(batch.column(1).to_pylist())]
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*told))], names=["id", "n", "d1", "d2"])

    return in_batches(docs, measure, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, d1 bigint, d2 bigint")


def _lonely_in_part(docs: DataFrame) -> DataFrame:
    """(d1, lonely): elements of a class, in the counted part of the hash domain, that no other class has. A batch adds up its own elements first."""

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owner, size = [], [], 0
        for found in shingle_sets(batch.column(1).to_pylist()):
            d = _digest(found)[0]
            if d in seen:  # a copy
                continue
            seen.add(d)
            keys.append(found[: np.searchsorted(found, COUNTED)])
            owner.append(np.full(len(keys[-1]), d, np.int64))
            size += len(keys[-1])
            if size > 1 << 20:
                yield _owners(keys, owner)
                keys, owner, size = [], [], 0
        if size:
            yield _owners(keys, owner)

    rows = in_batches(docs, emit, "h bigint, d1 bigint").repartition("h")
    owners = rows.groupBy("h").agg(F.min("d1").alias("d1"), F.max("d1").alias("other"))
    return owners.filter("d1 = other").groupBy("d1").agg(F.count(F.lit(1)).alias("lonely"))


def _owners(keys: list[np.ndarray], owner: list[np.ndarray]) -> pa.RecordBatch:
    """Each element with the smallest of its classes and, if there are several, with the largest."""
    key, of = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    low, high = np.minimum.reduceat(of, at), np.maximum.reduceat(of, at)
    key, several = key[at].view(np.int64), low != high
    return pa.record_batch([pa.array(np.concatenate((key, key[several]))), pa.array(np.concatenate((low, high[several])))], names=["h", "d1"])


def _common_enough(tables: Tables, sets: DataFrame) -> DataFrame:
    """``sets`` with lonely, the number of elements no other of them has, without those that have too many. The parity bits are then those of the other elements."""
    elements = sets.select("class", F.explode("keys").alias("h"))
    alone = elements.groupBy("h").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("classes")).filter("classes = 1")
    bit = [F.expr(f"bit_xor(if((h & 511) >> 6 = {i}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"_{p}") for i, p in enumerate(PARITY)]
    # written, so that the shuffle of all elements is gone before the sets themselves are joined
    lonely = tables.keep(alone.groupBy("class").agg(F.count(F.lit(1)).alias("lonely"), *bit))
    tables.release()
    zero = F.lit(0).cast("bigint")
    others = [F.col(p).bitwiseXOR(F.coalesce(f"_{p}", zero)).alias(p) for p in PARITY]
    both = sets.join(lonely, "class", "left").select("class", "n", "keys", F.coalesce("lonely", zero).alias("lonely"), *others)
    return tables.keep(both.filter("lonely <= n div 4"))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(class, n, keys, parity bits): the whole set of each chosen class (class, id, d1, d2), read again from one of its documents."""
    rows = chosen.select(F.col("id").alias("_id"), "class", "d1", "d2").join(docs, F.col("_id").eqNullSafe(F.col("id"))).select("id", "text", "class", "d1", "d2")

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # in slices, as the sets of a whole batch are larger than its texts
        for low in range(0, batch.num_rows, 1000):
            own, sets, parity = [], [], []
            part = batch.slice(low, 1000)
            numbers = zip(*(part.column(i).to_pylist() for i in range(2, 5)))
            for keys, (number, d1, d2) in zip(shingle_sets(part.column(1).to_pylist()), numbers):
                if _digest(keys) == (d1, d2):  # not another text of a repeated id
                    own.append(number)
                    sets.append(keys.view(np.int64))
                    odd = np.bincount((keys & np.uint64(511)).astype(np.int64), minlength=512) & 1
                    parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
            columns = [pa.array(own, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.record_batch([*columns, *(pa.array([p[i] for p in parity], pa.int64()) for i in range(8))], names=["class", "n", "keys", *PARITY])

    return in_batches(rows, read, "class bigint, n bigint, keys array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITY))


def _signed(sets: DataFrame) -> DataFrame:
    """(sig, class, lonely): a row per signature of each set."""

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, offsets = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
        number, lonely = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for low in range(0, batch.num_rows, 200):
            found = [signatures(values[offsets[i] : offsets[i + 1]].view(np.uint64)) for i in range(low, min(low + 200, batch.num_rows))]
            of = np.repeat(np.arange(low, low + len(found)), [len(f) for f in found])
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(number[of]), pa.array(lonely[of])], names=["sig", "class", "lonely"])

    return in_batches(sets.select("class", "lonely", "keys"), sign, "sig bigint, class bigint, lonely bigint")


def _possible(x: str, y: str):
    """Whether the counts and parity bits of two classes leave room for a link."""
    differ = F.bit_count(F.col(f"{x}.{PARITY[0]}").bitwiseXOR(F.col(f"{y}.{PARITY[0]}")))
    for p in PARITY[1:]:
        differ = differ + F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")))
    n, m, l, j = (F.col(f"{p}.{c}") for c in ("n", "lonely") for p in (x, y))
    return 7 * (l + j + F.greatest(differ, F.abs((n - l) - (m - j)))) <= n + m


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b), by the whole sets: 100 * intersection >= 75 * union."""
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    return both.select("a", "b", "n_a", "n_b", common.alias("common")).filter("100 * common >= 75 * (n_a + n_b - common)").select("a", "b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joined(tables: Tables, sets: DataFrame) -> DataFrame:
    """(node, component) of the classes in ``sets``."""
    facts = sets.select("class", "n", "lonely", *PARITY)
    signed = tables.keep(_signed(sets))
    pivots = signed.groupBy("sig").agg(F.min(F.struct("lonely", "class")).alias("pivot"), F.count(F.lit(1)).alias("size"))
    pivots = pivots.filter("size > 1").select("sig", F.col("pivot.class").alias("pivot"), "size")
    buckets = tables.keep(signed.join(pivots, "sig").select("sig", "class", "pivot", "size"))
    tables.forget(signed)
    tables.release()
    met = buckets.filter("class != pivot").select(*_ordered("class", "pivot")).distinct()
    one, other = facts.select(F.struct("*").alias("one")), facts.select(F.struct("*").alias("other"))
    met = met.join(one, F.col("a") == F.col("one.class")).join(other, F.col("b") == F.col("other.class"))
    tested = tables.keep(met.filter(_possible("one", "other")).select("a", "b"))
    labels = tables.keep(sets.select(F.col("class").alias("node"), F.col("class").alias("component")))
    labels = _merged(tables, labels, tables.keep(_checked(tested, sets)))
    # a bucket of two is done; of the others those are open that hold several components
    rows = buckets.filter("size > 2").select("sig", "class").join(labels.withColumnRenamed("node", "class"), "class")
    open_ = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("sig")
    rows = tables.keep(rows.join(open_, "sig").join(facts, "class").select("sig", "component", F.struct("class", "n", "lonely", *PARITY).alias("one")))
    tables.forget(buckets)
    tables.release()
    others = rows.select(F.col("sig").alias("same"), F.col("component").alias("another"), F.col("one").alias("other"))
    here = (F.col("sig") == F.col("same")) & (F.col("component") < F.col("another")) & _possible("one", "other")
    left = rows.join(others, here).select(F.col("one.class").alias("x"), F.col("other.class").alias("y")).select(*_ordered("x", "y")).distinct()
    return _merged(tables, labels, tables.keep(_checked(tables.keep(left.join(tested, ["a", "b"], "left_anti")), sets)))


def _merged(tables: Tables, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links, which are contracted to links between components first."""
    if links.isEmpty():
        return labels
    ends = links.join(labels.selectExpr("node as a", "component as x"), "a").join(labels.selectExpr("node as b", "component as y"), "b")
    merged = components(tables, ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return tables.keep(labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")))


def _repeats(rows: DataFrame, id_col: str) -> bool:
    return not rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").isEmpty()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id."""
    tables = Tables(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = tables.keep(_classes(docs))
    classes = rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id")).withColumn("class", F.monotonically_increasing_id())
    classes = tables.keep(classes)
    lonely = tables.keep(_lonely_in_part(docs))
    tables.release()
    chosen = classes.join(lonely, "d1", "left").filter("coalesce(lonely, 0) <= n div 4").drop("lonely")
    found = _sets(docs, chosen)
    # a class is read from one id, so it comes once unless that id repeats
    first = tables.keep(found.dropDuplicates(["class"]) if _repeats(rows, "id") else found)
    tables.release()
    sets = _common_enough(tables, first)
    tables.forget(first)
    tables.release()
    labels = _joined(tables, sets)
    joined = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    joined = joined.select("n", "d1", "d2", "component", "id")
    smallest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    joined = tables.keep(joined.drop("id").join(smallest, "component").drop("component"))
    named = rows.join(joined, ["n", "d1", "d2"], "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the smallest id, the first of those that repeat it; a row without id only
    where none of the component has one. Without repeated ids the row that stays is the one whose id names its component; else rows are
    numbered in a written copy of ``docs`` and told apart by that number."""
    if not _repeats(docs.select(F.col(id_col).alias("id")), "id"):
        named = near_groups(docs, id_col, text_col).select(F.col(id_col).alias("_stays"), "component_id")
        named = named.filter(F.col("_stays").eqNullSafe(F.col("component_id"))).select("_stays")
        rows = docs.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row"))
        return rows.join(named, F.col("_id").eqNullSafe(F.col("_stays")), "left_semi").select("_row.*")
    tables = Tables(docs.sparkSession, "near-kept")
    rows = tables.keep(docs.select(F.monotonically_increasing_id().alias("_number"), F.struct("*").alias("_row")))
    of_row = lambda c: F.col("_row").getField(c)
    groups = near_groups(rows.select("_number", of_row(text_col).alias("_text")), "_number", "_text").select("_number", "component_id")
    order = F.struct(of_row(id_col).isNull().alias("missing"), of_row(id_col).alias("id"), F.col("_number").alias("number"))
    members = groups.join(rows.select("_number", order.alias("order")), "_number")
    stay = members.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.number").alias("_number"))
    return rows.join(stay, "_number", "left_semi").select("_row.*")
