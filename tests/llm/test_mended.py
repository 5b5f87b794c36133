"""Cases that once went wrong: ids that are missing or shared, long words, groups of copies at the ends of stretches, fillings that were cut off."""

import hashlib
import random

import brute
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from strucreg.llm import mixing, ngram_join, packing, queries, sharding, suffix_dedup, toxicity


def test_repeats_among_many_rows_without_id(spark):
    """Every two rows share a passage of their own; none may lose bytes by another row's cuts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    passages = [" ".join(word() for _ in range(22)) for _ in range(600)]
    rows = [(None if i % 3 else i % 60, f"{word()} {word()} {passages[i % 600]} {word()}") for i in range(1800)]
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[7][1]), (90, "z" * 300), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ours = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect())
    # equal rows are one document; of one id, texts come in the order of their digests
    different = sorted({(d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), t) for d, t in rows}, key=lambda r: r[:3])
    told = brute.repeated_bytes([(i, t) for i, (_, _, _, t) in enumerate(different)])
    by_row = {(None if missing else d, t): told[i] for i, (missing, d, _, t) in enumerate(different)}
    expected = []
    for d, t in rows:
        n, gone, spans, sha = by_row[d, t]
        expected.append((str(d), n, gone, spans, sha))
    assert [r[:4] for r in ours] == [r[:4] for r in sorted(expected)]
    assert sorted(hashlib.sha256(r[4]).hexdigest() for r in ours) == sorted(r[4] for r in expected)


@pytest.mark.parametrize("size", [65_535, 65_537, 140_000])
def test_long_words_keep_their_order(spark, size):
    texts = [f"x{'a' * size}y", f"y{'a' * size}x", f"x{'a' * size}y"]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_sql_of_the_join_splits_at_all_white_space(spark, tmp_path):
    texts = ["a\rb\x0bc\x0cd\te f", "a b c d e f", "a\nb c d e  f g", "a b c d", "a\rb c\x0bd", None, " \r"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = oracle.connect(str(tmp_path))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert oracle.differences(ngram_join.near_groups(spark.read.parquet(str(tmp_path / "d"))), con, queries.SQL["op5_ngram_join"]) is None


def test_ten_pieces_fit_in_three():
    sizes = [40, 38, 37, 35, 33, 32, 26, 25, 24, 10]
    plan = packing.bin_completion({s: 1 for s in sizes}, 100)
    assert sum(t for _, t in plan) == 3 and sorted(x for items, t in plan for x in items * t) == sorted(sizes)


def test_fillings_are_the_undominated_ones():
    rng = random.Random(9)
    for _ in range(40):
        sizes = [rng.randint(2, 30) for _ in range(9)]
        counts = [0] * 101
        for s in sizes:
            counts[s] += 1
        room = rng.randint(5, 60)
        every = {tuple(sorted((s for i, s in enumerate(sizes) if bits >> i & 1), reverse=True)) for bits in range(1, 512)}
        every = {f for f in every if sum(f) <= room}
        made = list(packing.fillings(counts, room, [10**6]))
        assert len(set(made)) == len(made) and set(made) - {()} <= every
        # whatever is possible fits into the pieces of one of them
        assert all(any(packing._dominated(f, other) for other in made) for f in every)


def test_equal_texts_stay_together(spark):
    rows = [(3 * g + k, f"text number {g} " + "w" * (g % 97)) for g in range(10_000) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    placed = sharding.reshard(docs, F.crc32(F.col("text").cast("binary")) % 12, 12, 16)
    per_text = placed.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("n"))
    assert per_text.filter("n >= 3 and shards > 1").count() == 0
    sizes = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16
    slots = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m"))
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots.collect())


def test_a_group_larger_than_a_shard_is_divided(spark):
    rows = [(i, "the same text again" if i % 2 else f"text {i}") for i in range(6000)]
    placed = sharding.reshard(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(0), 1, 16)
    sizes = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.03 * sum(sizes) / 16


@pytest.mark.parametrize("sizes", [1, 40])
def test_rows_without_id_meet_the_target(spark, sizes):
    rows = [(None, "w " * (5 + i % sizes), ["a", "b", None][i % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    taken = mixing.rates(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * (5 + sizes) for r in taken)
    again = [sorted(map(str, mixing.rates(docs).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_all_telling_features_are_kept(spark):
    """Counts of features, their odds and gains against plain counts; none is left out for being one too many."""
    rng = np.random.default_rng(6)
    words = [f"w{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(100)]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        chance = np.where(np.arange(100) < 40, 0.5 if toxic else 0.05, 0.3)
        rows.append((" ".join(w for w, p in zip(words, chance) if rng.random() < p), int(toxic), 1.0))
    names, odds = toxicity.choose_features(spark.createDataFrame(rows, "text string, label int, weight double"), 3, 5.0)
    expected = {}
    bags = [(toxicity.features(t), label) for t, label, _ in rows]
    n1, n0 = 100, 300
    for f in set().union(*(b for b, _ in bags)):
        a, b = sum(f in s for s, label in bags if label), sum(f in s for s, label in bags if not label)
        if a < 3:
            continue
        odd = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        gain = a * np.log(a * 400 / (n1 * (a + b))) + (b * np.log(b * 400 / (n0 * (a + b))) if b else 0)
        if odd > 1 and gain > 5:
            expected[f] = odd
    assert names == sorted(expected) and np.allclose(odds, [expected[n] for n in names]) and len(names) >= 40


def test_the_pipeline_leaves_only_what_its_result_reads(spark, sf_dir):
    import corpus_pipeline
    from strucreg.scratch import checkpoint_dir

    files = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    listed = lambda: {f.getPath().getName() for f in files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files)}
    before = listed()
    rows = corpus_pipeline.run(spark, sf_dir)
    # the last stage's input and its own tables
    assert {n.rsplit("-", 1)[0] for n in listed() - before} <= {"pipeline", "tokens", "pieces"}
    assert rows.count() > 0


def test_hot_anchors_are_never_brought_together(spark, monkeypatch):
    """A line in every row with other neighbours: its segments take the way of single strings from the start."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    line = " ".join(word() for _ in range(12))
    rows = [(i, f"{' '.join(word() for _ in range(14))} {line} {' '.join(word() for _ in range(14))}") for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(5000, "x" * 600), (5001, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    expected = brute.repeated_bytes(rows)
    for share, common in ((4, 5), (1 << 15, 1000), (1 << 15, 5)):
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
        monkeypatch.setattr(suffix_dedup, "COMMON", common)
        keyed = suffix_dedup._keyed(suffix_dedup.Tables(spark, "t"), docs, "doc_id", "text")
        hot = suffix_dedup._located(keyed, suffix_dedup._anchor_counts(keyed)).filter("hot").count()
        assert hot > 250 if (share, common) == (1 << 15, 5) else hot == 0
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == expected
