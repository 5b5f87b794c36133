"""Resharding by minimum-cost flow.

Documents lie in old shards of known sizes; new shards have capacities. Which bytes go where is a flow from old
to new shards: a byte that stays costs nothing, a byte that moves costs one. The cheapest flow is solved on
the shard sizes alone (old x new numbers). An old shard is an ordered run of units, and the flow cuts the run into one stretch
per new shard; a unit goes where its middle lies. Equal texts of an old shard are one unit and stay together; only where they have
more than one in ``WHOLE`` of all bytes are they divided by row, as a group of copies may be larger than a shard.

Defined cases: null text has size 1 (its line end); null ids, repeated rows and ties get a place each, in any order; an empty table
gives an empty result; shards may stay empty; other columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm.common import Tables, packed, text_or_empty

# Blocks per shard and size class.
BLOCKS = 256
# A block is divided into cells of about one in this number of all bytes.
PARTS = 4096
# Equal texts stay together up to one in this number of all bytes.
WHOLE = 256


def cheapest_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old to each new shard, fewest moved, by successive shortest paths on the residual
    graph. Old shard i and new shard i are the same place. Total supply must not exceed total capacity."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards are too small")
    olds, news = len(supply), len(capacity)
    flow = [[0] * news for _ in supply]
    left, room = list(supply), list(capacity)
    while any(left):
        # nodes: old shards 0..olds-1, new shards olds..; costs are 0, 1 and -1, so a queue of relaxations is enough
        cost = {i: 0 for i in range(olds) if left[i]}
        came: dict[int, int] = {}
        queue = deque(cost)
        while queue:
            at = queue.popleft()
            if at < olds:
                steps = [(olds + j, int(at != j)) for j in range(news)]
            else:
                steps = [(i, -int(i != at - olds)) for i in range(olds) if flow[i][at - olds]]
            for to, price in steps:
                if cost[at] + price < cost.get(to, 1 << 30):
                    cost[to], came[to] = cost[at] + price, at
                    queue.append(to)
        end = min((n for n in cost if n >= olds and room[n - olds]), key=lambda n: (cost[n], n))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - olds])
        for a, b in zip(path, path[1:]):
            if a >= olds:
                amount = min(amount, flow[b][a - olds])
        for a, b in zip(path, path[1:]):
            if a < olds:
                flow[a][b - olds] += amount
            else:
                flow[b][a - olds] -= amount
        left[path[0]] -= amount
        room[end - olds] -= amount
    return flow


def _move(tables: Tables, rows: DataFrame, supply: list[int], capacities: list[int]) -> DataFrame:
    """Replaces _at, the present shard, by the new one. A unit moves as a whole: equal texts, or a part of them where they are very many. A
    shard's run has its large units first and the new shards' stretches in it begin with what stays, so the units that cross an end are small."""
    total, news = sum(supply), len(capacities)
    flow = cheapest_flow(supply, capacities)
    unit = ["_at", "text_crc32", "size", "_split"]
    units = rows.groupBy(*unit).agg(F.sum("size").alias("_bytes"))
    units = units.withColumns({"_class": (-F.floor(F.log2("_bytes"))).cast("int"), "_block": F.pmod(F.xxhash64("text_crc32", "size", "_split"), F.lit(BLOCKS)).cast("int")})
    units = tables.keep(units)
    block = ["_at", "_class", "_block"]
    # cells: blocks, the large ones divided; at most PARTS more than there are blocks
    parts = units.groupBy(*block).agg(F.greatest(F.lit(1), F.ceil(F.sum("_bytes") / F.lit(max(1, total // PARTS)))).cast("int").alias("_parts"))
    units = units.join(parts, block).withColumn("_cell", F.pmod(F.xxhash64("size", "text_crc32", "_split"), F.col("_parts")).cast("int"))
    cell = [*block, "_cell"]
    before = W.partitionBy("_at").orderBy("_class", "_block", "_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = units.groupBy(*cell).agg(F.sum("_bytes").alias("_bytes")).select(*cell, F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*cell).orderBy("text_crc32", "size", "_split").rowsBetween(W.unboundedPreceding, -1)
    placed = units.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(starts, cell)
    middle = F.col("_start") + F.col("_inside") + F.floor(F.col("_bytes") / 2)
    shard = F.lit(None).cast("int")
    for i, row in enumerate(flow):
        order = sorted((j for j in range(news) if row[j]), key=lambda j: (j != i, j))
        end, ends = 0, []
        for j in order[:-1]:
            end += row[j]
            ends.append((end, j))
        here = F.lit(order[-1] if order else 0)
        for end, j in reversed(ends):
            here = F.when(middle < F.lit(end), F.lit(j)).otherwise(here)
        shard = F.when(F.col("_at") == i, here).otherwise(shard)
    to = placed.select(*unit, shard.cast("int").alias("_to"))
    return tables.keep(rows.join(to, unit).withColumn("_at", F.col("_to")).drop("_to"))


def _split(tables: Tables, rows: DataFrame) -> DataFrame:
    """Adds _split: 0, but for texts with more copies than a unit may have a number by row."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    many = rows.groupBy("text_crc32", "size").agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") > F.greatest(F.col("size"), F.lit(total // WHOLE)))
    # fewer than WHOLE of them, as each has more than that share of all bytes
    many = many.select("text_crc32", "size", F.ceil(F.col("_bytes") / F.lit(max(1, total // PARTS))).cast("int").alias("_parts"))
    split = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0)).cast("int")
    return tables.keep(rows.join(F.broadcast(many), ["text_crc32", "size"], "left").withColumn("_split", split).drop("_parts"))


def _supply(rows: DataFrame, count: int) -> list[int]:
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("_at").agg(F.sum("size")).collect()}  # one number per shard
    if set(sizes) - set(range(count)):
        raise ValueError("a shard lies outside 0..count-1")
    return [sizes.get(i, 0) for i in range(count)]


def reshard(docs: DataFrame, old_shard: Column, old_count: int, new_count: int, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, size, text_crc32, old_shard, shard, slot. ``old_shard`` gives the present place,
    0 to ``old_count`` - 1. Without ``capacities`` the new shards are equally large. The first flow goes from the old to the new
    shards; a second one evens out by small documents what whole documents left over."""
    tables = Tables(docs.sparkSession, "reshard")
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
    ).withColumn("_at", F.col("old_shard"))
    rows = _split(tables, tables.keep(rows))
    supply = _supply(rows, old_count)
    total = sum(supply)
    capacities = capacities or [total // new_count + (i < total % new_count) for i in range(new_count)]
    rows = _move(tables, rows, supply, capacities)
    rows = _move(tables, rows, _supply(rows, len(capacities)), capacities)
    cell = ["_at", "_part"]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS)).cast("int"))
    earlier = W.partitionBy("_at").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
    first = first.select(*cell, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    number = F.row_number().over(W.partitionBy(*cell).orderBy("_id", "_row")) - 1
    return rows.withColumn("_number", number).join(first, cell).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "old_shard", F.col("_at").alias("shard"), (F.col("_first") + F.col("_number")).cast("bigint").alias("slot")
    )


def moved_bytes(assigned: DataFrame) -> DataFrame:
    """(old_shard, shard, bytes): the transfers, without what stays."""
    return assigned.filter("old_shard != shard").groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"))


def rewrite(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", stretch: int = 1_000_000) -> list[int]:
    """Writes the shards whose rows change, as ``path/shard=N`` with the document in the column ``row``, and returns their numbers; the folder
    of a shard left without rows is deleted, the others' files are not touched. ``docs`` and ``assigned`` are joined by id, which must be unique here."""
    moves = moved_bytes(assigned).select("old_shard", "shard").distinct().collect()  # at most old x new rows
    affected = sorted({n for r in moves for n in r})
    places = assigned.filter(F.col("shard").isin(affected)).select(F.col(id_col).alias("of"), "shard", "slot")
    rows = packed(docs, id=id_col).join(places, F.col("id").eqNullSafe(F.col("of")))
    filled = {r["shard"] for r in places.select("shard").distinct().collect()}
    # one writer per shard and stretch of slots: a shard's rows are not gathered in one task
    rows = rows.repartition("shard", F.floor(F.col("slot") / stretch)).sortWithinPartitions("shard", "slot").select("shard", "row")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    # the write replaces only shards that get rows; the folders of those left without any go after it
    tables = Tables(docs.sparkSession, "rewrite")
    for shard in set(affected) - filled:
        tables.drop(f"{path}/shard={shard}")
    return affected
