"""Mixing sources to target weights by entropy balancing.

Each document may be taken 0, 1 or 2 times. Among all distributions of copies that take a source's target of
words, the one closest to "0, 1 and 2 equally likely" tilts exponentially: the weight of c copies is
exp(lambda * c * z), z the document's size over its source's mean. lambda minimises the convex dual
sum(log(1 + t + t^2)) - lambda * target, t = exp(lambda * z); Newton steps on it are sums over the data. The
expected copies are then rounded by a hash of the id and the text, with one threshold per source chosen so that the
words taken come as near the target as whole documents allow.

Only built-in functions. Defined cases: null text has size 0; documents without words cost nothing and are taken once; a null source is a source of its own, the last
one; rows without id are hashed with their number in the table as it is read (reruns over the same files agree); rows equal in id and text are
taken alike; an empty table gives an empty
result, sources without words a target of 0. One row per source (total, multiplier, threshold) is joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm.common import WORD, Tables

MAX_COPIES = 2
BINS = 1024


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_key, source_size, target): sources by code point, null last, weigh ``weights`` in turn, and share
    ``share`` times all sizes; no target is above ``cap`` times its source. ``sizes`` has _key (missing, source) and size."""
    totals = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy("_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumns({"_weight": weight, "_most": F.col("source_size") * cap, "_all": F.sum("source_size").over(every) * share})
    # filled up in order of most/weight: those before the first source that its share does not fill are at their cap
    order = W.orderBy(F.col("_most") / F.col("_weight"), "_key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(
        "_level",
        (F.col("_all") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    )
    found = F.min(F.when(F.col("_most") >= F.col("_level") * F.col("_weight"), F.struct(F.col("_most") / F.col("_weight"), F.col("_key"), F.col("_level")))).over(every)
    level = found.getField("_level")
    target = F.when(level.isNull(), F.col("_most")).otherwise(F.least(F.col("_most"), level * F.col("_weight")))
    return rows.select("_key", "source_size", target.cast("double").alias("target"))


def _moments(z: Column, tilt: Column) -> tuple[Column, Column]:
    """Mean and variance of the copies at a multiplier, without overflow on either side."""
    small = F.exp(-F.abs(z * tilt))
    near, far = small, small * small
    total = 1 + near + far
    fewer = (near + 2 * far) / total  # expected distance from the favoured end
    return F.when(z * tilt > 0, 2 - fewer).otherwise(fewer), (near + 4 * far) / total - fewer * fewer


def multipliers(tables: Tables, sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """lambda per source by Newton steps, kept inside the bracket found so far. The rates depend on (source, size)
    only, so rows are added up by these first. Sources at their cap or without words are left out (no lambda)."""
    per_source = sizes.groupBy("_key").agg(F.avg("size").alias("_mean"))
    open_ = targets.filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * MAX_COPIES))
    counts = tables.keep(sizes.filter("size > 0").groupBy("_key", "size").agg(F.count(F.lit(1)).alias("_n")))
    state = tables.keep(
        open_.join(per_source, "_key").select(
            "_key", "target", "_mean", F.lit(0.0).alias("_tilt"), F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"), F.lit(1e300).alias("_gap")
        )
    )
    for _ in range(rounds):
        if state.filter(F.col("_gap") > tolerance).isEmpty():
            return state
        rows = counts.join(state, "_key")
        copies, spread = _moments(F.col("size") / F.col("_mean"), F.col("_tilt"))
        sums = rows.groupBy("_key", "target", "_mean", "_tilt", "_low", "_high").agg(
            (F.sum(F.col("_n") * F.col("size") * copies) - F.first("target")).alias("_slope"),
            F.sum(F.col("_n") * F.col("size") * F.col("size") / F.col("_mean") * spread).alias("_curve"),
        )
        low = F.when(F.col("_slope") <= 0, F.col("_tilt")).otherwise(F.col("_low"))
        high = F.when(F.col("_slope") >= 0, F.col("_tilt")).otherwise(F.col("_high"))
        newton = F.col("_tilt") - F.col("_slope") / F.col("_curve")
        inside = (F.col("_curve") > 0) & (newton > F.coalesce(low, F.lit(-1e300))) & (newton < F.coalesce(high, F.lit(1e300)))
        wide = F.abs(newton - F.col("_tilt")) <= 4 + 2 * F.abs(F.col("_tilt"))
        middle = (
            F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
            .when(low.isNotNull(), low + 4 + F.abs(low))
            .otherwise(high - 4 - F.abs(high))
        )
        gap = F.abs(F.col("_slope")) / F.col("target")
        step = F.when(gap <= tolerance, F.col("_tilt")).when(inside & wide, newton).otherwise(middle)
        state = tables.keep(sums.select("_key", "target", "_mean", step.alias("_tilt"), low.alias("_low"), high.alias("_high"), gap.alias("_gap")))
    raise RuntimeError(f"the multipliers did not settle in {rounds} rounds")


def _thresholds(tables: Tables, rated: DataFrame, targets: DataFrame) -> DataFrame:
    """(_key, _cut): copies are the document's events up to the cut. A document has an event for its first and its second
    copy. The cut where the words reach the target is found by histograms of 1024 bins per source, three times finer each."""
    events = rated.select("_key", "size", F.explode(F.array(*[F.lit(float(c)) - F.col("_rate") - F.col("_draw") for c in range(1, MAX_COPIES + 1)])).alias("_event"))
    events = events.filter("size > 0")
    low, width = -float(MAX_COPIES + 1), 2.0 * (MAX_COPIES + 1)
    state = targets.select("_key", "target", F.lit(low).alias("_from"), F.lit(0.0).alias("_taken"))
    for _ in range(3):
        step = width / BINS
        bin_ = F.floor((F.col("_event") - F.col("_from")) / step)
        counts = events.join(state, "_key").withColumn("_bin", bin_).filter((F.col("_bin") >= 0) & (F.col("_bin") < BINS))
        counts = counts.groupBy("_key", "_bin").agg(F.sum("size").alias("_words"))
        so_far = F.sum("_words").over(W.partitionBy("_key").orderBy("_bin"))
        counts = counts.withColumn("_until", so_far).join(state, "_key")
        # the last bin to be taken whole ends where the next one would pass the target
        over = counts.filter(F.col("_taken") + F.col("_until") > F.col("target"))
        first = over.groupBy("_key").agg(F.min(F.struct("_bin", "_until", "_words")).alias("_first"))
        state = tables.keep(
            state.join(first, "_key", "left").select(
                "_key",
                "target",
                F.when(F.col("_first").isNull(), F.col("_from") + width).otherwise(F.col("_from") + F.col("_first._bin") * step).alias("_from"),
                F.when(F.col("_first").isNull(), F.col("_taken")).otherwise(F.col("_taken") + F.col("_first._until") - F.col("_first._words")).alias("_taken"),
                F.coalesce(F.col("_first._words"), F.lit(0)).alias("_next"),
            )
        )
        width = step
    # the events left in the last bin are taken all or none, whichever is nearer
    all_of = F.col("_taken") + F.col("_next") - F.col("target") < F.col("target") - F.col("_taken")
    return state.select("_key", F.when(all_of & (F.col("_next") > 0), F.col("_from") + width).otherwise(F.col("_from")).alias("_cut"))


def _rated(tables: Tables, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, carried: Column) -> DataFrame:
    """One row per row of ``docs``: _carried, size, source_size, target, _rate, copies. The number of copies is found for the row, not for its id."""
    source = F.col(source_col).cast("string")
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    key = F.struct(source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("source"))
    # rows without id are told apart by their place in the table, rows that repeat an id by their text
    apart = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    draw = F.pmod(F.xxhash64(F.lit("draw"), F.col(id_col), F.col(text_col).cast("string"), apart), F.lit(1 << 52)) / float(1 << 52)
    sizes = tables.keep(docs.select(carried.alias("_carried"), key.alias("_key"), words.alias("size"), draw.alias("_draw")))
    targets = tables.keep(source_targets(sizes, weights, share, float(MAX_COPIES)))
    solved = multipliers(tables, sizes, targets).select("_key", "_tilt", "_mean")
    facts = tables.keep(targets.join(solved, "_key", "left"))
    tilted, _ = _moments(F.col("size") / F.col("_mean"), F.col("_tilt"))
    at_end = F.when(F.col("target") > 0, F.lit(float(MAX_COPIES))).otherwise(F.lit(1.0))
    rated = sizes.join(facts, "_key").withColumn("_rate", F.when(F.col("_tilt").isNull(), at_end).otherwise(tilted))
    cuts = tables.keep(_thresholds(tables, rated, targets))
    taken = lambda c: (F.lit(float(c)) - F.col("_rate") - F.col("_draw") < F.col("_cut")).cast("bigint")
    copies = taken(1)
    for c in range(2, MAX_COPIES + 1):
        copies = copies + taken(c)
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(1).cast("bigint"))
    return rated.join(cuts, "_key").select("_carried", "size", "source_size", "target", "_rate", copies.alias("copies"))


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row per row of ``docs``: the id, size, source_size, target, rate (expected copies), copies, taken."""
    rated = _rated(Tables(docs.sparkSession, "mix"), docs, id_col, text_col, source_col, weights, share, F.col(id_col))
    return rated.select(
        F.col("_carried").alias(id_col), "size", "source_size", "target", F.col("_rate").alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """The documents of the mix with all their columns, each row as often as it is taken itself, whatever other rows share its id."""
    rated = _rated(Tables(docs.sparkSession, "mix"), docs, id_col, text_col, source_col, weights, share, F.struct("*"))
    rows = rated.filter("copies > 0").select(F.col("_carried").alias("row"), F.col("copies").cast("int").alias("copies"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
