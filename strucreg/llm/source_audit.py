"""How far the sources of a language differ in their words, after collapsing duplicate texts.

Identical texts of a language are grouped with the number of their copies in each source, cut into terms once, and their term
counts and document frequencies added with those weights. Texts are compared by their 256-bit digest. Only texts with copies
have to meet: the digests with more than one row become a set of bits of bounded size (``bitset``), rows outside it are alone
and stay where they are, rows inside it are grouped (a row that is there by accident is a group of one).

A language keeps the terms of enough documents; a further bounded set of bits tells the tasks of the second reading which terms
are worth counting, and a join with the kept terms decides. Each group's share of a term is a whole number,
1 + floor(10^9 (count + 5) / (N + 5 V)), so all sums are exact. Pairs of sources are compared on the terms that occur: a term
that neither source has adds the difference of their two smallest shares, which is known without looking at it. Terms are dealt
into blocks by hash, sources into tiles; a task sees one block of terms for two tiles.

Defined cases: null text, language and source are empty; ids are not read, so null ids, ties and repeated rows are documents
like others; a source without kept terms is compared all the same; a language without kept terms has distances of 0; an empty
table gives no rows; texts are read whole; other columns are not read. A text's sources are listed in one row; their number is
that of the sources, whose square is the size of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm import bitset, words
from strucreg.llm.common import Tables, text_or_empty

# What stands between terms: everything of ASCII but letters.
BETWEEN = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
SMOOTHING = 5
WHOLE = 1_000_000_000
# Terms of a block, about, and sources of a tile.
BLOCK_TERMS, TILE = 4096, 128


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    digest = F.sha2(F.concat_ws(":", F.length("lang").cast("string"), "lang", "text"), 256)
    # a generator, as a projection would make the digest again for every use
    return rows.select("lang", "source", "text", F.explode(F.array(digest)).alias("digest"))


def _key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def collapsed(tables: Tables, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_bits: int = bitset.MAX_BITS) -> tuple[DataFrame, bitset.Bits, DataFrame]:
    """``lang, text, sources, key``, where each text of a language is to be read once; the set of bits; and the groups ``lang, source``.

    ``sources`` lists sources and copies. Rows with a key are documents as they are, to be passed over if the key is in the set;
    the texts passed over are there once more, collapsed, without a key.
    """
    rows = _rows(docs, text_col, lang_col, source_col)
    per_source = tables.keep(rows.groupBy("lang", "source", "digest").agg(F.count(F.lit(1)).alias("n")))
    groups = tables.keep(per_source.select("lang", "source").distinct())
    several = per_source.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select(_key(F.col("digest")).alias("key"))
    several = tables.keep(several)
    copied = bitset.build(several, several.count(), max_bits)
    tables.forget(several)
    tables.forget(per_source)
    keyed = rows.withColumn("key", _key(F.col("digest")))

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in_set(batch, copied)))

    # equal texts are added up in the task before they are sent; a text is sent once per task and source
    met = keyed.mapInArrow(chosen, keyed.schema).groupBy("lang", "digest", "source").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n"))
    met = met.groupBy("lang", "digest").agg(F.any_value("text").alias("text"), F.collect_list(F.struct("source", "n")).alias("sources"))
    together = tables.keep(met.select("lang", "text", "sources", F.lit(None).cast("bigint").alias("key")))
    one = F.array(F.struct("source", F.lit(1).cast("bigint").alias("n")))
    return keyed.select("lang", "text", one.alias("sources"), "key").unionByName(together), copied, groups


def _in_set(batch: pa.RecordBatch, copied: bitset.Bits) -> np.ndarray:
    key = batch.column("key")
    return copied.has(key.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & ~key.is_null().to_numpy(zero_copy_only=False)


def _term_key(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (hashes ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(32))


def _slices(batch: pa.RecordBatch, table: np.ndarray, copied: bitset.Bits):
    """Per slice of the rows that are not passed over: the terms, language number per text, the languages, and the (text, source,
    copies) entries."""
    batch = batch.filter(pa.array(~_in_set(batch, copied)))
    langs = batch.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False)
    texts, listed = batch.column("text"), batch.column("sources")
    for start, stop in words.slices(texts):
        part = listed.slice(start, stop - start)
        entries = part.flatten()
        row = np.repeat(np.arange(stop - start), np.diff(part.offsets.to_numpy()))
        yield words.cut(texts.slice(start, stop - start), table), lang[start:stop], langs.dictionary, row, entries.field("source").dictionary_encode(), entries.field("n").to_numpy(zero_copy_only=False)


def _added(groups: list[np.ndarray], amounts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Amounts added per combination of small whole numbers."""
    code = np.zeros(len(amounts), np.int64)
    for g in groups:
        code = code * (int(g.max(initial=0)) + 1) + g
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(code) else np.zeros(0, np.int64)
    total = np.add.reduceat(amounts[order], first) if len(code) else amounts
    return [g[order][first] for g in groups], total


def document_frequencies(texts: DataFrame, copied: bitset.Bits) -> DataFrame:
    """``lang, term, df``, every copy of a text counting as a document."""
    table = words.classes(BETWEEN)

    def count(batches):
        for batch in batches:
            for found, lang, langs, row, _, copies in _slices(batch, table, copied):
                weight = np.bincount(row, weights=copies, minlength=len(lang)).astype(np.int64)
                # each term once per text
                pairs = np.unique(found.row.astype(np.int64) * max(1, len(found.distinct)) + found.code)
                text, term = np.divmod(pairs, max(1, len(found.distinct)))
                (of, term), df = _added([lang[text].astype(np.int64), term], weight[text])
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(of)), found.distinct.take(pa.array(term)), pa.array(df)], names=["lang", "term", "df"])

    return texts.mapInArrow(count, "lang string, term string, df bigint").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def term_counts(texts: DataFrame, copied: bitset.Bits, kept: DataFrame, tables: Tables, max_bits: int = bitset.MAX_BITS) -> DataFrame:
    """``lang, source, term, n`` for the kept terms ``lang, term``."""
    table = words.classes(BETWEEN)

    def keys(batches):
        for batch in batches:
            langs, terms = batch.column("lang").dictionary_encode(), batch.column("term")
            seeds = words.Words(None, None, None, langs.dictionary).hashes()[langs.indices.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([pa.array(_term_key(words.Words(None, None, None, terms).hashes(), seeds).view(np.int64))], names=["key"])

    wanted = bitset.build(kept.select("lang", "term").mapInArrow(keys, "key bigint"), kept.count(), max_bits)

    def count(batches):
        for batch in batches:
            for found, lang, langs, row, sources, copies in _slices(batch, table, copied):
                if not len(found.code):
                    continue
                seeds = words.Words(None, None, None, langs).hashes()
                hashes = found.hashes()
                chosen = np.flatnonzero(wanted.has(_term_key(hashes[found.code], seeds[lang[found.row]])))
                # counts per text and term, then every text's counts for each of its sources
                (text, term), tf = _added([found.row[chosen], found.code[chosen]], np.ones(len(chosen), np.int64))
                first = np.searchsorted(row, text)
                many = np.searchsorted(row, text, side="right") - first
                entry = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                source = sources.indices.to_numpy(zero_copy_only=False)[entry].astype(np.int64)
                at = np.repeat(np.arange(len(text)), many)
                (of, source, term), n = _added([lang[text[at]].astype(np.int64), source, term[at]], tf[at] * copies[entry])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(of)), sources.dictionary.take(pa.array(source)), found.distinct.take(pa.array(term)), pa.array(n)], names=["lang", "source", "term", "n"]
                )

    made = texts.mapInArrow(count, "lang string, source string, term string, n bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return tables.keep(made.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact beyond 64 bits; null without terms."""
    return F.expr(
        f"if({terms} = 0, null, 1 + cast((cast({count} + {SMOOTHING} as decimal(20,0)) * {WHOLE}) div cast({total} + {SMOOTHING} * {terms} as decimal(20,0)) as bigint))"
    )


def audit_tables(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, max_bits: int = bitset.MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Groups ``lang, source, total, terms, base`` and shares ``lang, source, term, n, p, q``; ``base`` is the share of a term that the
    group does not have, p the group's share, q the language's."""
    tables = Tables(docs.sparkSession, "audit")
    texts, copied, groups = collapsed(tables, docs, text_col, lang_col, source_col, max_bits)
    kept = tables.keep(document_frequencies(texts, copied).filter(F.col("df") >= least))
    counts = term_counts(texts, copied, kept, tables, max_bits)
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(terms, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    groups = tables.keep(groups.withColumn("none", F.lit(0).cast("bigint")).select("lang", "source", "total", "terms", _share("none", "total", "terms").alias("base")))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = counts.join(whole, ["lang", "term"]).join(groups, ["lang", "source"]).join(totals, "lang")
    shares = shares.select("lang", "source", "term", "n", _share("n", "total", "terms").alias("p"), _share("whole", "lang_total", "terms").alias("q"))
    return groups, tables.keep(shares)


def _compare(key: tuple, block: pa.Table) -> pa.Table:
    """One block of terms for two tiles of sources: the differences of the shares of terms that occur, less what they would be if
    neither source had them. Rows without term carry a source's share of a term that it does not have."""
    block = block.combine_chunks()
    lang, _, i, j = (k.as_py() for k in key)
    terms = block["term"].combine_chunks().dictionary_encode()
    column = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    sources, row = np.unique(block["number"].to_numpy(), return_inverse=True)
    p, has = block["p"].to_numpy(), column >= 0
    base = np.zeros(len(sources), np.int64)
    base[row[~has]] = p[~has]
    share = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    share[row[has], column[has]] = p[has]
    right = np.flatnonzero(sources // TILE == j)
    a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in np.flatnonzero(sources // TILE == i):
        others = right[sources[right] > sources[x]]
        a.append(np.full(len(others), sources[x]))
        b.append(sources[others])
        more.append(np.abs(share[others] - share[x]).sum(axis=1) - share.shape[1] * np.abs(base[others] - base[x]))
    a, b, more = (np.concatenate(v).astype(np.int64) for v in (a, b, more))
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(more)], names=["lang", "a", "b", "more"])


def pair_distances(groups: DataFrame, shares: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``lang, source, item, value``: summed differences of shares for every two sources of a language, in both directions."""
    # the sources of a language are numbered: as many rows per language as it has sources
    per_lang = W.partitionBy("lang")
    numbered = groups.withColumn("number", (F.row_number().over(per_lang.orderBy("source")) - 1).cast("bigint"))
    numbered = numbered.withColumns(
        {"tiles": F.floor(F.max("number").over(per_lang) / TILE).cast("int"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).cast("int"), "base": F.coalesce("base", F.lit(0))}
    )
    entries = shares.join(numbered.select("lang", "source", "number", "tiles", "blocks"), ["lang", "source"])
    entries = entries.select("lang", "number", "tiles", "p", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    marks = numbered.select("lang", "number", "tiles", F.col("base").alias("p"), every_block, F.lit(None).cast("string").alias("term"))
    tile = F.floor(F.col("number") / TILE).cast("int")
    # a tile of sources meets every tile of its language
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles")), lambda t: F.struct(F.least(t, tile).alias("i"), F.greatest(t, tile).alias("j")))
    dealt = entries.unionByName(marks).select("lang", "block", "number", "p", "term", F.explode(meets).alias("m")).select("lang", "block", "m.i", "m.j", "number", "p", "term")
    parts = dealt.groupBy("lang", "block", "i", "j").applyInArrow(_compare, "lang string, a bigint, b bigint, more bigint")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    side = lambda n: numbered.select("lang", F.col("number").alias(n), F.col("source").alias(f"{n}_source"), F.col("base").alias(f"{n}_base"))
    both = summed.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).join(groups.select("lang", "terms").distinct(), "lang")
    value = F.col("more") + F.col("terms") * F.abs(F.col("a_base") - F.col("b_base"))
    ways = F.array(*[F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in (("a", "b"), ("b", "a"))])
    return both.select("lang", F.explode(ways).alias("w"), value.alias("value")).select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, first: int = 50, **sizes) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's distances to the others of its language (part ``pair``), and the ``first``
    terms that it has more of than its language (part ``term``)."""
    groups, shares = audit_tables(docs, text_col, lang_col, source_col, least, **sizes)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = pair_distances(groups, shares).withColumn("rank", rank)
    more = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = more.withColumn("rank", rank).filter(F.col("rank") <= first)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(terms, "term"))
