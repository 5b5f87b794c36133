"""The operators against plain statements of their results, on a table of odd cases and on the small test tables."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from strucreg.llm import exact_dedup, language_id, mixing, ngram_join, packing, pii, quality, queries, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, _row int, _id int, row int, id int, size int, shard int, name string"


def odd_rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))

    base = prose(300)
    edited = base.split()
    edited[150] = "changed"
    passage = prose(30)
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "\n")), (4, " ".join(edited)), (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE  two"),
        (10, "x" * 30_000), (11, "x" * 30_000 + "y"), (12, prose(9000)), (13, passage + " " + prose(40)), (14, prose(60) + " " + passage),
        (15, "é😀 " * 400), (16, "mail bob.b@ex-am.org.uk, a@b.c_d@e.f or +1 (234) 555-0123; 1.2.3.4.5.6.7.8 and 300.1.1.1"),
        (17, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, token = \"a8f5f167f44f4964e6c998dee827110c\" 0000000000000000"), (18, "\n".join(["same line"] * 20 + ["", "other"])),
        (19, "line\n" * 3 + "a b c d e f g h " * 5), (20, "9" * 5000), (21, "a" * 99), (22, "b" * 100), (23, "b" * 100), (24, "+" * 3000 + "1234567890"),
        (25, "a1" * 4000 + "@" + "b." * 2000 + "c"), (26, "the cat. " * 40),
    ]
    return [(d, t, "en" if d % 3 else None, "s%d" % (d % 2) if d % 5 else None, 1, 2, 3, 4, 5, 6, "n") for d, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def again(spark):
    """Rows that repeat an id, with the same and with another text, and rows without id."""
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "p q r s t u v w"), (None, "a b c d e f g"), (None, None), (2, "a b c d  e f g"), (3, "z " * 200), (3, "z " * 200)]
    return spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return queries.documents(spark, sf_dir)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(params=["odd", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_exact_groups(docs):
    assert by_id(exact_dedup.exact_groups(docs, block_bytes=64), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(pairs(docs))


def test_exact_blocks_do_not_matter(odd):
    columns = ("keep_id", "group_size", "kept", "text_sha256")
    assert by_id(exact_dedup.exact_groups(odd, block_bytes=7), *columns) == by_id(exact_dedup.exact_groups(odd), *columns)


def test_exact_keep_one(odd, again):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in brute.exact(pairs(odd)).items() if v[2])
    rows = exact_dedup.exact_groups(again).collect()
    assert len(rows) == 8 and sorted((r["keep_id"], r["group_size"]) for r in rows if r["kept"] and r["keep_id"] is not None) == [(1, 1), (2, 4), (3, 2)]
    assert sorted(map(str, (r["doc_id"] for r in exact_dedup.keep_one(again).collect()))) == ["1", "2", "3", "None"]


def test_exact_names_meet_a_hot_block(spark):
    rows = [(i, "same " * 50 if i % 3 else f"other {i} " * 40) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert by_id(exact_dedup.exact_groups(docs, block_bytes=16), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def personal(df):
    return by_id(df.select("doc_id", pii.span_text("base").alias("base"), pii.span_text("all").alias("all")), "base", "all")


def test_personal_data(docs):
    found = personal(pii.spans(docs))
    want = {d: ",".join(f"{k}:{s}:{e}" for k, s, e in brute.personal(t)) for d, t in pairs(docs)}
    assert {d: b for d, (b, _) in found.items()} == want
    for d, (base, every) in found.items():
        assert set(base.split(",")) <= set(every.split(",")) | {""}


def test_personal_data_adds_a_secret_and_masks(odd):
    text = dict(pairs(odd))[17]
    every = personal(pii.spans(odd))[17][1]
    at = text.index("a8f5")
    assert f"secret:{at}:{at + 32}" in every
    masked = by_id(pii.masked(odd), "text")
    assert masked[17][0].startswith("card <card> and 4111-1111-1111-1112, token = \"<secret>\"")
    assert masked[5] == (None,) and masked[12][0] == dict(pairs(odd))[12]


def test_vote_aggregation_finds_the_reliable_labeler():
    rng = random.Random(1)
    patterns = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = tuple((1 if true == (rng.random() < p) else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.9, 0.8, 0.6))
        patterns[votes] = patterns.get(votes, 0) + 1
    tables, share = pii.estimate(sorted(patterns.items()))
    right = [t[1][0] / (t[1][0] + t[-1][0]) for t in tables]
    assert right == sorted(right, reverse=True) and abs(right[0] - 0.95) < 0.05 and abs(share - 0.4) < 0.05


def test_classifier_separates():
    patterns = [((1, 0), 50.0, 48.0), ((0, 1), 60.0, 3.0), ((1, 1), 20.0, 12.0)]
    a, b, bias = pii.classifier(patterns)
    assert a + bias > 1 and b + bias < -1


def test_languages(spark, small):
    rows = language_id.held_out_languages(small).toPandas()
    lang = {r["doc_id"]: r["lang"] for r in small.select("doc_id", "lang").collect()}
    assert list(rows.held_out) == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]
    held = rows[rows.held_out]
    assert np.mean([lang[d] == p for d, p in zip(held.doc_id, held.lang_pred)]) > 0.9
    assert rows.score.between(0, 1).all()


def test_languages_odd(odd, again):
    rows = by_id(language_id.held_out_languages(odd), "lang_pred", "score")
    assert all(rows[d] == ("und", 0.0) for d in (5, 6, 7, 20)) and rows[1][0] == "en"
    assert language_id.held_out_languages(again).count() == 8


def test_bundle_is_the_sum_of_bound_vectors():
    texts = ["Ab, cab", "", "1 2", "x" * 9, "ß"]
    grams = language_id.Trigrams(texts)
    got = grams.bundle(np.arange(5), None, 5, 128)
    vector = {c: language_id.letter_vectors(np.array([ord(c)], np.uint32), 128)[0].astype(int) for c in " abcxß"}
    for i, text in enumerate([" ab cab ", "", "", " " + "x" * 9 + " ", " ß "]):
        want = np.zeros(128)
        for a, b, c in zip(text, text[1:], text[2:]):
            want += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
        assert (got[i] == want).all()


def test_bundle_in_slices(monkeypatch):
    texts = ["the quick brown fox", "jumps over the lazy dog"]
    whole = language_id.Trigrams(texts).bundle(np.arange(2), None, 2, 128)
    monkeypatch.setattr(language_id, "SLICE", 5)
    assert (language_id.Trigrams(texts).bundle(np.arange(2), None, 2, 128) == whole).all()


def test_toxicity(spark, small, sf_dir):
    rng = random.Random(5)
    clean = ["table", "garden", "letter", "window", "river", "stone", "paper", "music"]
    rows, marks = [], []
    for d in range(900):
        sentences = [" ".join(rng.choices(clean, k=8)) for _ in range(6)]
        bad = d % 4 == 0
        if bad:
            sentences[rng.randrange(6)] += " you utter " + rng.choice(["swine", "rotter"])
        rows.append((d, ". ".join(sentences) + "."))
        marks.append((d, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (9000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id bigint, toxic int")
    found = {r["doc_id"]: r for r in toxicity.held_out_toxicity(docs, labels).collect()}
    assert all(found[d]["predicted"] == y for d, y in marks)
    assert all(found[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in marks)
    assert found[9000]["score"] == 0 and found[None]["score"] == 0
    text = dict(rows)
    for d, y in marks:  # the offending sentence, and no other
        spans = found[d]["sentences"]
        assert len(spans) == y and all("utter" in text[d][s["start"] : s["end"]] for s in spans)


def test_toxicity_without_examples(odd, spark):
    nothing = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.held_out_toxicity(odd, nothing).collect()} == {0.0}


def test_near_groups(docs):
    assert by_id(ngram_join.near_groups(docs), "n_shingles", "component_id") == brute.near(pairs(docs))


def test_near_chain_and_cluster(spark):
    """A chain of texts linked only to their neighbours, a cluster around the threshold, texts that share a passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, chain = [], [word() for _ in range(120)]
    for i in range(25):
        rows.append((i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
    seed = [word() for _ in range(90)]
    for i in range(60):
        text = list(seed)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(90)] = word()
        rows.append((100 + i, " ".join(text)))
    passage = " ".join(word() for _ in range(40))
    rows += [(200 + i, " ".join(word() for _ in range(30)) + " " + passage) for i in range(40)]
    rows += [(300 + i, " ".join(seed[: 4 + i])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert by_id(ngram_join.near_groups(docs), "n_shingles", "component_id") == brute.near(rows)


def test_signatures_meet():
    """Sets that link share a signature, at every size and difference."""
    rng = np.random.default_rng(4)
    for size in [*range(2, 40), 57, 90, 133, 240, 500, 1200]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = rng.integers(0, size // 4 + 1)
            new = rng.integers(0, size // 3 + 1)
            b = np.concatenate((a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)))
            common, union = size - gone, size + new
            if 100 * common >= 75 * union and (gone or new):
                assert set(ngram_join.signatures(np.unique(a)).tolist()) & set(ngram_join.signatures(np.unique(b)).tolist()), (size, gone, new)


def test_near_keep_one(odd, again):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in brute.near(pairs(odd)).items() if c == d)
    assert ngram_join.near_groups(again).count() == 8


def tokens(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(docs):
    rows = packing.pack_documents(docs, queries.tokenizer_path(), with_ids=True).toPandas()
    whole = {d: tokens(t) for d, t in pairs(docs)}
    for d, pieces in rows.groupby("doc_id"):
        pieces = pieces.sort_values("piece")
        assert list(pieces.piece) == list(range(len(pieces))) and list(pieces.start) == list(np.cumsum([0, *pieces.length[:-1]]))
        assert [x for ids in pieces.ids for x in ids] == whole[d] and (pieces.length[1:] == 1024).all()
        assert list(pieces.ids_crc32) == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in pieces.ids]
    assert set(rows.doc_id) == set(whole)
    for _, sequence in rows.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence.offset) == list(np.cumsum([0, *sequence.length[:-1]])) and sequence.length.sum() <= 1024
    least = -(-rows.length.sum() // 1024)
    assert rows.sequence_id.nunique() <= 1.02 * least + 2


def test_sequences_hold_the_tokens(odd):
    packed = packing.pack_documents(odd, queries.tokenizer_path(), with_ids=True)
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(len(tokens(t)) for _, t in pairs(odd))


@pytest.mark.parametrize("text", ["", " ", "a b  c\n\n d", "İstanbul ǅ ß ŉ", "١٢٣ 漢字 かな", "<|endoftext|> x", "I'll we've  'tis", "½ ² Ⅷ x​y", "é   \U0001f600", "\x00\x7f\x85"])
def test_ids_are_the_tokenizers(text):
    assert [*packing.encoder(queries.tokenizer_path())(text), 2] == tokens(text)


def fewest(sizes, room):
    """The least number of bins, by trying all."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i] and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, room - sizes[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_best_on_few_pieces():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(3, 60) for _ in range(rng.randint(1, 11))), reverse=True)
        histogram = {s: sizes.count(s) for s in sizes}
        plan = packing.bin_completion(histogram, 100)
        used = {}
        for items, times in plan:
            assert sum(items) <= 100
            for x in items:
                used[x] = used.get(x, 0) + times
        assert used == histogram and sum(t for _, t in plan) == fewest(sizes, 100)


def test_quality(docs):
    rows = quality.quality(docs)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id(rows, *columns) == {d: brute.base_quality(t) for d, t in pairs(docs)}
    assert all(not r["kept"] for r in rows.filter("base_failed").collect())


def test_quality_keeps_clean_documents(spark, small, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality(small).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.all() and (~rows[rows.quality == 0].kept).any()


def test_quality_keep_good(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.quality(odd).filter("kept").collect())


def test_distance_is_jensen_shannon():
    p, q = np.array([[3.0, 1.0, 0.0]]), np.array([0.25, 0.25, 0.5])
    m = (p[0] / 4 + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(quality.distance(p, q)[0] - np.sqrt((kl(p[0] / 4) + kl(q)) / 2)) < 1e-12


def removed(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


def test_repeats(docs):
    assert removed(suffix_dedup.remove_repeats(docs)) == brute.repeated_bytes(pairs(docs))


def test_repeats_in_files_and_pieces(odd, monkeypatch, spark):
    """The same with queues in files, small blocks, small shards and pieces."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abc ", k=150))
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 400))) + passage + "".join(rng.choices("abc", k=40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert removed(suffix_dedup.remove_repeats(docs)) == brute.repeated_bytes(rows)


def test_repeats_of_common_anchors(spark, monkeypatch):
    """A line with different neighbours in every document, by shards and string by string."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, passage = letters(90), letters(130)
    rows = [(i, letters(rng.randint(0, 90)) + line + letters(60) + (passage if i % 3 else "") + letters(30)) for i in range(150)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1])], "doc_id bigint, text string").repartition(4)
    for limit in (10_000, 20, 0):
        monkeypatch.setattr(suffix_dedup, "COMMON", limit)
        assert removed(suffix_dedup.remove_repeats(docs)) == brute.repeated_bytes(rows)


def test_suffix_order_in_files(monkeypatch):
    rng = np.random.default_rng(1)
    for letters in (1, 2, 4, 200):
        text = np.append(rng.integers(1, letters + 1, 3000), 0).astype(np.uint16)
        want = sorted(range(len(text)), key=lambda i: text[i : i + 100].tolist())
        plain = suffix_dedup.suffix_order(text, 100)
        monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 100)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 37)
        filed = suffix_dedup.suffix_order(text, 100)
        monkeypatch.undo()
        for order in (plain, filed):
            assert sorted(order.tolist()) == list(range(len(text)))
            assert [text[i : i + 100].tolist() for i in order] == [text[i : i + 100].tolist() for i in want]


def test_segments_cover_every_string_once(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcd", k=n)).encode() for n in (0, 99, 100, 101, 500, 2500)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    seen = []
    for raw, ends, number, place in suffix_dedup._laid(texts):
        _, _, first, last = suffix_dedup.segments(raw, ends)
        part = np.searchsorted(ends, first, side="right")
        begin = np.concatenate(([0], ends))[part]
        for p, a, b, s in zip(part, first, last, begin):
            seen += [(number[p], place[p] + x - s) for x in range(a, b + 1)]
    assert sorted(seen) == [(i, x) for i, t in enumerate(texts) for x in range(max(0, len(t) - 99))]


def test_repeated_ids_have_one_result_each(again):
    rows = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(again).collect())
    assert len(rows) == 8 and [r for r in rows if r[0] == "3"] == [("3", 400, 398)] * 2


def test_mixing(docs):
    rows = mixing.rates(docs).toPandas()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {d: brute.words(t) for d, t in pairs(docs)}
    totals = {}
    for d, s in source.items():
        totals[s] = totals.get(s, 0) + size[d]
    want = brute.targets(totals)
    assert dict(zip(rows.doc_id, rows["size"])) == size
    for r in rows.to_dict("records"):
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
    rows["source"] = [str(source[d]) for d in rows.doc_id]
    for s, group in rows.groupby("source"):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= group["size"].max() / 2 + 1
        assert abs((group.rate * group["size"]).sum() - group.target.iloc[0]) < 1e-6 * max(1, group.target.iloc[0])


def test_mixing_tilts_exponentially(small):
    """The odds of two copies to one, and of one to none, are exp(lambda z) with one lambda in a source."""
    rows = mixing.rates(small).toPandas()
    rows = rows[(rows.target < 2 * rows.source_size) & (rows["size"] > 0)]
    rows["lam"] = [_tilt(r) for r in rows.rate] / rows["size"]
    spread = rows[(rows.rate > 0.01) & (rows.rate < 1.99)].groupby("source_size").lam.agg(["min", "max"])
    assert np.allclose(spread["min"], spread["max"], rtol=1e-4, atol=1e-9)


def _tilt(rate):
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        t = np.exp(mid)
        low, high = (mid, high) if (t + 2 * t * t) / (1 + t + t * t) < rate else (low, mid)
    return low


def test_mix_reruns_agree(odd, again):
    first, second = (sorted(r["doc_id"] for r in mixing.mix(odd).collect()) for _ in range(2))
    copies = by_id(mixing.rates(odd), "copies")
    assert first == second and first == sorted(d for d, (c,) in copies.items() for _ in range(c)) and mixing.mix(odd).columns == odd.columns
    assert mixing.rates(again).count() == 8


def test_sharding(docs):
    placed = sharding.reshard(docs, queries.F.crc32(queries.F.coalesce("text", queries.F.lit("")).cast("binary")) % 5, 5, 7)
    rows = placed.toPandas()
    text = dict(pairs(docs))
    assert sorted(rows.doc_id) == sorted(text)
    assert all(s == len((text[d] or "").encode()) + 1 and c == brute.crc(text[d]) for d, s, c in zip(rows.doc_id, rows["size"], rows.text_crc32))
    for _, shard in rows.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    sizes = rows.groupby("shard")["size"].sum().reindex(range(7), fill_value=0)
    assert (sizes - rows["size"].sum() / 7).abs().max() <= rows["size"].max()


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(9)
    for _ in range(40):
        olds, news = rng.randint(1, 5), rng.randint(1, 6)
        supply = [rng.randint(0, 50) for _ in range(olds)]
        total = sum(supply)
        capacity = [total // news + (i < total % news) for i in range(news)]
        flow = sharding.cheapest_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply and all(sum(flow[i][j] for i in range(olds)) <= capacity[j] for j in range(news))
        assert sum(flow[i][i] for i in range(min(olds, news))) == sum(min(supply[i], capacity[i]) for i in range(min(olds, news)))


def test_rewrite_touches_affected_shards_only(spark, odd, tmp_path):
    old = queries.F.col("doc_id") % 4
    placed = sharding.reshard(odd, old, 4, 4, capacities=[10**9] * 4)
    assert sharding.rewrite(odd, placed, str(tmp_path / "none")) == []
    placed = sharding.reshard(odd, old, 4, 2).cache()
    affected = sharding.rewrite(odd, placed, str(tmp_path / "two"))
    rows = spark.read.parquet(str(tmp_path / "two")).select("shard", "row.*")
    assert set(affected) >= {2, 3}
    assert sorted((r["doc_id"]) for r in rows.collect()) == sorted(r["doc_id"] for r in placed.filter(placed.shard.isin(affected)).collect())


def test_rewrite_removes_shards_left_without_rows(spark, odd, tmp_path):
    path, old = str(tmp_path / "layout"), queries.F.col("doc_id") % 4
    odd.select(old.cast("int").alias("shard"), queries.F.struct("*").alias("row")).write.partitionBy("shard").parquet(path)
    placed = sharding.reshard(odd, old, 4, 2).cache()
    assert set(sharding.rewrite(odd, placed, path)) >= {2, 3}
    rows = spark.read.parquet(path).selectExpr("shard", "row.doc_id").collect()
    assert sorted(map(tuple, rows)) == sorted((r["shard"], r["doc_id"]) for r in placed.collect())


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Good and bad texts under one null id and one repeated id; of the good ones (name g..) g1 and g2 are near copies, as are g3 and g4."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    texts = {f"g{k}": " ".join(rng.choice(vocabulary) for _ in range(200 + 40 * k)) for k in (1, 3, 5, 6, 7, 8)}
    texts["g2"], texts["g4"] = texts["g1"] + " changed", texts["g3"] + " changed"
    ids = {"g1": None, "g2": 1, "g3": 2, "g4": 2, "g5": None, "g6": 2, "g7": None, "g8": 3}
    rows = [(ids[n], t, n) for n, t in sorted(texts.items())] + [(i, "too short", f"b{k}") for k, i in enumerate((None, None, 2))]
    return spark.createDataFrame([(i, t, "en", "s%d" % (k % 2), n) for k, (i, t, n) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, name string").repartition(3).cache()


def test_quality_keeps_good_rows_that_share_an_id_with_bad_ones(shared_ids):
    assert sorted(r["name"] for r in quality.keep_good(shared_ids).collect()) == [f"g{k}" for k in range(1, 9)]


def test_near_keeps_one_row_of_a_component_whatever_ids_are_shared(shared_ids):
    kept = sorted(r["name"] for r in ngram_join.keep_one(shared_ids.filter("name like 'g%'")).collect())
    # g1 without id is linked to g2 with one; g3 and g4 share their id, either may stay
    assert [n for n in kept if n not in ("g3", "g4")] == ["g2", "g5", "g6", "g7", "g8"] and len(kept) == 6


def test_mix_takes_each_row_by_itself(shared_ids):
    words = lambda r: len((r["text"] or "").split())
    copies = mixing.rates(shared_ids).collect()
    expected = sorted((str(r["doc_id"]), r["size"]) for r in copies for _ in range(r["copies"]))
    assert sorted((str(r["doc_id"]), words(r)) for r in mixing.mix(shared_ids).collect()) == expected
    of_null = {r["copies"] for r in copies if r["doc_id"] is None}
    assert len(of_null) > 1  # else the case shows nothing


@pytest.mark.parametrize(
    "apply",
    [
        exact_dedup.exact_groups, exact_dedup.keep_one, pii.spans, pii.masked, language_id.held_out_languages, ngram_join.near_groups, ngram_join.keep_one, quality.quality,
        quality.keep_good, suffix_dedup.remove_repeats, mixing.rates, mixing.mix, lambda d: packing.pack_documents(d, queries.tokenizer_path()),
        lambda d: sharding.reshard(d, queries.F.lit(0), 1, 3), lambda d: toxicity.held_out_toxicity(d, d.selectExpr("doc_id", "size as toxic")),
    ],
)
def test_empty_table(empty, apply):
    assert apply(empty).collect() == []


@pytest.mark.parametrize("apply", [exact_dedup.exact_groups, pii.spans, language_id.held_out_languages, ngram_join.near_groups, quality.quality, suffix_dedup.remove_repeats, mixing.rates,
                                   lambda d: sharding.reshard(d, queries.F.lit(0), 1, 3)])
def test_repeated_rows_keep_their_number(again, apply):
    assert apply(again).count() == 8
