"""Best-fit packing by bin completion.

Documents become pieces of at most ``length`` tokens. Only the number of pieces of each length matters for the plan, so the search runs
on that histogram, at most ``length`` numbers, whatever the size of the corpus. Bin completion: the largest piece left opens a
sequence; undominated fillings of the rest are enumerated, best fit first, and branched on; a branch is cut when its waste
passes what the best plan so far allows. Fillings are taken as often as the counts permit. The pieces are then numbered within their length and
looked up in the plan.

Defined cases: null text is the empty document (its end mark alone); null ids, repeated rows and ties are documents of their own;
whole texts are encoded, of any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm.common import Tables, in_batches

PARTS = 1024
# Letters and signs up to Latin Extended-B, punctuation and currency: there the two libraries agree for certain.
LATIN = re.compile("[\t\n\r -~ -ɏ‐-‧₠-₿]*")


@lru_cache(maxsize=4)
def encoder(path: str):
    """Token ids of a text by the vocabulary file. Texts in Latin letters take tiktoken with the same vocabulary where its
    file lies beside, several times faster and equal id by id; all other texts take the file's own library."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # their names in a text are ordinary text

    def slow(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    ranks_path = re.sub(r"\.json$", ".tiktoken", path)
    if ranks_path == path or not os.path.exists(ranks_path):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: quick.encode_ordinary(text) if LATIN.fullmatch(text) else slow(text)


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32 and, if asked for, ids. A longer document is cut so that all but its first piece are full."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer)
        doc, piece, starts, sizes, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            tokens = np.array([*encode(text or ""), end_id], dtype="<u4")
            first = len(tokens) % length or length
            for k, low in enumerate([0, *range(first, len(tokens), length)]):
                part = tokens[low : low + (length if k else first)]
                doc.append(i), piece.append(k), starts.append(low), sizes.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
                if with_ids:
                    ids.append(part.astype(np.int32))
        columns = {id_col: batch.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32())}
        columns |= {"start": pa.array(starts, pa.int64()), "length": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.record_batch(list(columns.values()), names=list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return in_batches(rows, cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def _dominated(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the items of one filling fit into the items of the other, taken as bins."""
    if not small:
        return True
    seen = set()
    for i, room in enumerate(large):
        if room >= small[0] and room not in seen:
            seen.add(room)
            if _dominated(small[1:], tuple(sorted((*large[:i], room - small[0], *large[i + 1 :]), reverse=True))):
                return True
    return False


def _maximal(counts: list[int], room: int, work: list[int]) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` by pieces left to which no smaller piece can be added, from large to small. ``work`` holds the steps left."""
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and work[0] > 0:
        at, space, taken = stack.pop()
        nexts = []
        for k in range(at, len(sizes)):
            work[0] -= 1
            s = sizes[k]
            if s <= space and counts[s] > taken.count(s):
                nexts.append((k, space - s, (*taken, s)))
        if nexts:
            stack.extend(reversed(nexts))
        elif taken:
            yield taken


def fillings(counts: list[int], room: int, work: list[int], batch: int = 256) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` by pieces left, found as they are asked for: one piece that fits exactly, which dominates all others;
    else pairs that fit exactly, then all others in batches, least waste first. A filling is passed over only if its pieces fit into those of
    one before it."""
    if room <= 0:
        yield ()
        return
    if room < len(counts) and counts[room]:
        yield (room,)
        return
    kept: list[tuple[int, ...]] = []

    def new(items: tuple[int, ...]) -> bool:
        work[0] -= len(kept)
        if any(_dominated(items, other) for other in kept):
            return False
        kept.append(items)
        return True

    for s in range(min(room - 1, len(counts) - 1), (room - 1) // 2, -1):
        if counts[s] and counts[room - s] > (s == room - s) and new((s, room - s)):
            yield (s, room - s)
    found: list[tuple[int, ...]] = []
    for items in _maximal(counts, room, work):
        found.append(items)
        if len(found) == batch:
            yield from (f for f in sorted(found, key=lambda f: (-sum(f), [-x for x in f])) if new(f))
            found = []
    yield from (f for f in sorted(found, key=lambda f: (-sum(f), [-x for x in f])) if new(f))
    if not kept:
        yield ()


def best_fit(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """The first incumbent: largest first, each filling the fullest that pieces left allow, greedily from large to small."""
    counts = [0] * (length + 1)
    for s, n in histogram.items():
        counts[s] = n
    plan = []
    for s in range(length, 0, -1):
        while counts[s]:
            items, room = [], length
            at = s
            while at and room:
                n = min(counts[at] - items.count(at), room // at) if at <= room else 0
                if n > 0:
                    items += [at] * n
                    room -= at * n
                at = min(at - 1, room)
            times = min(counts[x] // items.count(x) for x in set(items))
            for x in items:
                counts[x] -= times
            plan.append((tuple(items), times))
    return plan


def bin_completion(histogram: dict[int, int], length: int, nodes: int = 20_000, steps: int = 2_000_000) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (piece lengths, how often). A filling is repeated as often as counts allow, then less often on the way back; where the search
    ends before its ``nodes`` and ``steps`` do, the plan is the best there is, else the best found."""
    total = sum(s * n for s, n in histogram.items())
    least = -(-total // length)
    best = best_fit(histogram, length)
    bins = sum(t for _, t in best)
    counts = [0] * (length + 1)
    for s, n in histogram.items():
        counts[s] = n
    work = [steps]
    # the patterns taken to come here, the choices left at each; counts and waste are undone on the way back
    path: list[tuple[tuple[int, ...], int]] = []
    waste = used = 0

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        """Sequences opened by the largest piece left, each with the times it is taken."""
        top = next((s for s in range(length, 0, -1) if counts[s]), 0)
        if not top:
            return
        now = list(counts)
        now[top] -= 1
        for f in fillings(now, length - top, work):
            items = (top, *f)
            most = min((now[x] + (x == top)) // items.count(x) for x in set(items))
            yield from ((items, times) for times in range(most, 0, -1))

    stack = [choices()]
    while stack and bins > least and nodes > 0 and work[0] > 0:
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if path:
                items, times = path.pop()
                for x in items:
                    counts[x] += times
                waste -= (length - sum(items)) * times
                used -= times
            continue
        nodes -= 1
        items, times = choice
        more = (length - sum(items)) * times
        if waste + more > (bins - 1) * length - total:
            continue
        for x in items:
            counts[x] -= times
        path.append((items, times))
        waste, used = waste + more, used + times
        if any(counts):
            stack.append(choices())
        else:
            if used < bins:
                best, bins = list(path), used
            stack.append(iter(()))
    return best


def _plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, until, sequence, each, offset): pieces of a length by number, the first sequence they are in, how many of them each takes."""
    rows, taken, sequence = [], {}, 0
    for items, times in plan:
        offset = 0
        for size in sorted(set(items), reverse=True):
            each = items.count(size)
            low = taken.get(size, 0)
            taken[size] = low + each * times
            rows.append((size, low, taken[size], sequence, each, offset))
            offset += each * size
        sequence += times
    return rows


def pack(pieces: DataFrame, order: list[str], length: int = 1024) -> DataFrame:
    """``pieces`` (with a column length, 1 to ``length``) with sequence_id and offset. It is read twice and must not change in between: write it
    first. Full pieces are a sequence of their own without any shuffle; ``order`` names columns that tell pieces apart."""
    spark = pieces.sparkSession
    rows = pieces.withColumn("_row", F.monotonically_increasing_id())
    full = rows.filter(F.col("length") == length).select("*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    part = rows.filter(F.col("length") < length).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    part = Tables(spark, "pieces").keep(part)
    counts = part.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # length numbers at most
    ranges = spark.createDataFrame(
        _plan_rows(bin_completion(histogram, length)), "_length bigint, _from bigint, _until bigint, _sequence bigint, _each bigint, _offset bigint"
    )
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_part").orderBy(*order, "_row")) - 1
    part = part.withColumn("_inside", inside).join(offsets, ["length", "_part"]).withColumn("_number", F.col("_before") + F.col("_inside"))
    # the plan has at most `length` patterns, each emptying a length
    here = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_until"))
    place = F.col("_number") - F.col("_from")
    part = part.join(F.broadcast(ranges), here).select(
        *[F.col(c) for c in full.columns if c not in ("sequence_id", "offset")],
        (F.col("_sequence") + F.floor(place / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + place % F.col("_each") * F.col("length")).alias("offset"),
    )
    return full.unionByName(part).drop("_row")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document with their place: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    pieces = Tables(docs.sparkSession, "tokens").keep(token_pieces(docs, tokenizer, length, end_id, id_col, text_col, with_ids))
    return pack(pieces, [id_col, "piece", "ids_crc32"], length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences, from pieces packed ``with_ids``; a sequence has at most ``length`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
