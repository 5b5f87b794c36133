"""Exact duplicates by deterministic block naming.

The normalised text (white space deleted) is cut into blocks of a fixed number of bytes. Equal blocks
get equal integers by sorting: blocks are dealt out by hash, sorted within their bucket and numbered.
Then adjacent names are paired and the pairs named in the same way, until one name is left of each
document. Names come from sorted contents, never from a digest, so different texts cannot collide.

Only built-in functions. Defined cases: null text is empty, and all empty texts are equal; a null id
is larger than every other id; repeated rows are members of their group like any other; ties by length go to the
smallest id, and between repeated rows of an id exactly one row stays; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm.common import SPACE, Tables, packed, text_or_empty

# Buckets a level's values are sorted in. A name is bucket * 2^32 + place in the bucket.
BUCKETS = 1 << 20
# The most frequent blocks are named apart, from one copy each; any other block then holds at most
# one part in this number of all blocks.
FREQUENT = 1000


def _place(bucket: Column, rank: Column) -> Column:
    return bucket.cast("bigint") * F.lit(1 << 32) + rank


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    whole = F.expr(
        f"transform(sequence(0, greatest(0, (octet_length(_text) - 1) div {block_bytes})), "
        f"i -> substring(cast(_text as binary), i * {block_bytes} + 1, {block_bytes}))"
    )
    # a generator, as a projection would be repeated for every block
    normal = F.explode(F.array(F.struct(F.length("_raw").alias("_chars"), F.regexp_replace("_raw", f"{SPACE}+", "").alias("_text")))).alias("_t")
    return (
        docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_raw"))
        .select("_id", F.monotonically_increasing_id().alias("_row"), normal)
        .select("_id", "_row", "_t.*")
        .select("_id", "_row", "_chars", F.sha2("_text", 256).alias("_sha"), whole.alias("_all"))
        .select("*", F.size("_all").alias("_n"), F.posexplode("_all").alias("_pos", "_block"))
        .drop("_all")
        .withColumn("_hash", F.xxhash64("_block"))
    )


def _first_names(blocks: DataFrame) -> DataFrame:
    """Blocks to integers. The frequent ones take names below zero from a table of one copy each, and
    their rows go on without the block, so that no bucket grows with the copies of one text."""
    spark = blocks.sparkSession
    top = blocks.groupBy("_hash").count().orderBy(F.desc("count"), "_hash").limit(FREQUENT).filter("count > 1").collect()
    frequent = spark.createDataFrame([(r["_hash"], i) for i, r in enumerate(top)], "_hash bigint, _at bigint")
    copies = blocks.join(F.broadcast(frequent), "_hash").select("_at", "_hash", "_block").distinct()
    named = copies.select(
        "_hash", "_block", (-1 - _place(F.col("_at"), F.dense_rank().over(W.partitionBy("_at").orderBy("_block")))).alias("_given")
    )
    rows = blocks.join(F.broadcast(named), ["_hash", "_block"], "left")
    rows = rows.withColumn("_block", F.when(F.col("_given").isNull(), F.col("_block")))
    spread = F.when(F.col("_given").isNull(), F.col("_hash")).otherwise(F.xxhash64("_row", "_pos"))
    rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(BUCKETS)))
    rank = F.dense_rank().over(W.partitionBy("_bucket").orderBy("_block"))
    name = F.coalesce("_given", _place(F.col("_bucket"), rank))
    once = lambda c: F.when(F.col("_pos") == 0, F.col(c)).alias(c)  # noqa: E731  a document's facts stay with its first block
    return rows.select("_row", "_pos", "_n", name.alias("_name"), once("_id"), once("_chars"), once("_sha"))


def _paired(names: DataFrame) -> DataFrame:
    """The next level: adjacent names become one; a last name without partner is paired with -2^62."""
    half = F.floor(F.col("_pos") / 2).cast("int").alias("_pos")
    even = F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name")))
    odd = F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name")))
    pairs = names.groupBy("_row", half, F.ceil(F.col("_n") / 2).cast("int").alias("_n")).agg(
        even.alias("_left"), F.coalesce(odd, F.lit(-(1 << 62))).alias("_right")
    )
    bucket = F.pmod(F.xxhash64("_left", "_right"), F.lit(BUCKETS))
    different = pairs.select("_left", "_right").distinct().withColumn("_bucket", bucket)
    rank = F.dense_rank().over(W.partitionBy("_bucket").orderBy("_left", "_right"))
    different = different.select("_left", "_right", _place(F.col("_bucket"), rank).alias("_name"))
    return pairs.join(different, ["_left", "_right"]).select("_row", "_pos", "_n", "_name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: _row, _id, _chars, _sha, _level, _name. Two texts are equal after
    normalisation exactly if they agree in (_level, _name)."""
    tables = Tables(docs.sparkSession, "block-names")
    first = tables.keep(_first_names(_blocks(docs, id_col, text_col, block_bytes)))
    facts = first.filter("_pos = 0").select("_row", "_id", "_chars", "_sha")
    names, level = first.select("_row", "_pos", "_n", "_name"), 0
    done = []
    while True:
        done.append(names.filter("_n = 1").select("_row", F.lit(level).alias("_level"), "_name"))
        names = names.filter("_n > 1")
        if names.isEmpty():
            break
        names, level = tables.keep(_paired(names)), level + 1
    final = done[0]
    for other in done[1:]:
        final = final.unionByName(other)
    return tables.keep(facts.join(final, "_row"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Groups of equal texts: the id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = identities(docs, id_col, text_col, block_bytes)
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r")))
    groups = rows.groupBy("_level", "_name").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"))
    return rows.join(groups, ["_level", "_name"]).select(
        F.col("_id").alias(id_col),
        F.col("_best.i").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best.r")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Where an id is repeated, its rows are told
    apart by their normalised text, and of equal ones the longest stays."""
    groups = Tables(docs.sparkSession, "kept").keep(exact_groups(docs, id_col, text_col, block_bytes))
    per_id = groups.groupBy(F.col(id_col).alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    stay = groups.filter("kept").select(F.col(id_col).alias("stay"), F.col("text_sha256").alias("sha"))
    stay = stay.join(per_id, F.col("stay").eqNullSafe(F.col("of"))).select("stay", "sha", "rows")
    rows = packed(docs, id=id_col)
    single = rows.join(stay.filter("rows = 1"), F.col("id").eqNullSafe(F.col("stay")), "left_semi").select("row.*")
    several = stay.filter("rows > 1")
    if several.isEmpty():
        return single
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("row", "id", "text", F.sha2(F.regexp_replace("text", f"{SPACE}+", ""), 256).alias("here"))
    rows = rows.join(several, F.col("id").eqNullSafe(F.col("stay")) & (F.col("here") == F.col("sha")), "left_semi")
    longest = W.partitionBy("id", "here").orderBy(F.length("text").desc(), "text")
    return single.unionByName(rows.withColumn("first", F.row_number().over(longest)).filter("first = 1").select("row.*"))
