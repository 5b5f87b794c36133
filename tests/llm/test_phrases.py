"""Collocations, source audit and licence scan against plain statements, on odd tables and small ones."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strucreg.llm import bitset, collocations, license_scan, queries, source_audit, words

SCHEMA = "doc_id bigint, text string, lang string, source string, phrase string, f bigint, term string, n bigint, digest string, _row int, _id int, hits string, word string, size int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))
    copied = prose(60)
    notice = "Released under the MIT License. "
    texts = [
        None, "", " \t\n", "one", copied, copied, copied, copied + " ", prose(3000), "New  York\tcity " * 40, "new york city! " * 35, "é😀 ñandú " * 50, "x" * 20_000, "a b " * 400,
        notice, prose(30) + notice + prose(5) + " licensed under the Apache-License, Version 2.0", "GNU General Public License general PUBLIC license", "released\nunder; the (mit) LICENSE now",
        "Licensed under CC BY-NC 4.0.", "mit licenKe liKense", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation " + notice * 3,
        "license " * 500 + "mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "permission is granted, free of charge, to any person obtaining a copy of this software and associated", "1a2 b_c d'e",
    ]
    rows = []
    for i, t in enumerate(texts * 2):
        rows.append((None if i % 9 == 4 else i // 2, t, [None, "en", "fr", ""][i % 4], [None, "s1", "s2"][i % 3], "p", 1, "t", 2, "d", 3, 4, "h", "w", 5))
    return rows + [(7, copied, "en", "s%d" % (i % 3), "p", 1, "t", 2, "d", 3, 4, "h", "w", 5) for i in range(40)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=["odd", "empty", "small"])
def docs(request, spark, sf_dir):
    return queries.documents(spark, sf_dir) if request.param == "small" else request.getfixturevalue(request.param)


def plain(docs, *columns):
    return [tuple(r) for r in docs.select(*columns).collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- collocations -----------------------------------------------------------------


def brute_collocations(rows, threshold, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= threshold}
        scored = []
        for p, a in often.items():
            if len(p) < 2 or any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()
            ):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold, first", [(30, 2000), (7, 5), (2, 40)])
def test_collocations(docs, threshold, first):
    ours = collocations.collocations(docs, threshold=threshold, first=first).drop("k")
    assert rows_of(ours) == brute_collocations(plain(docs, "text", "lang"), threshold, first)


def test_collocations_in_many_partitions_with_small_sets(odd):
    """Many summaries, short stretches, and a set of so few bits that most phrases pass it."""
    ours = collocations.collocations(odd, threshold=5, first=100, partition_mass=2000, stretch=500, max_bits=1 << 14, room=1).drop("k")
    assert rows_of(ours) == brute_collocations(plain(odd, "text", "lang"), 5, 100)


def test_equal_keys_do_not_mix_phrases(odd, monkeypatch):
    """All words have the same hash: words decide."""
    monkeypatch.setattr(words.Words, "hashes", lambda self: np.full(len(self.distinct), 7, np.uint64))
    ours = collocations.collocations(odd, threshold=5, first=100).drop("k")
    assert rows_of(ours) == brute_collocations(plain(odd, "text", "lang"), 5, 100)


@pytest.mark.parametrize("seed", range(5))
def test_summary_keeps_what_is_frequent(seed):
    rng = np.random.default_rng(seed)
    stream = np.concatenate([rng.integers(0, 100_000, 30_000), np.repeat(rng.integers(0, 100_000, 40), 31)]).astype(np.uint64)
    rng.shuffle(stream)
    summary = collocations.Summary(len(stream) // 30 + 1)
    parts = [collocations.Summary(len(stream) // 30 + 1) for _ in range(3)]
    for i, piece in enumerate(np.array_split(stream, 50)):
        keys, counts = np.unique(piece, return_counts=True)
        summary.add(keys, counts)
        summary.merge()
        parts[i % 3].add(keys, counts)
    keys, counts = np.unique(stream, return_counts=True)
    often = keys[counts >= 30]
    assert set(often) <= set(summary.at_least(30)) and len(summary.keys) <= summary.capacity and summary.taken < 30
    # summaries merge: counters of one are counted keys for the next, their errors add up
    whole = collocations.Summary(len(stream) // 30 + 1)
    for p in parts:
        p.merge()
        whole.add(p.keys, p.counts)
        whole.taken += p.taken
    assert set(often) <= set(whole.at_least(30))


def test_packed_counts():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    batch = collocations._sent([keys, keys[:100]], 5)
    back, mass = [], 0
    for p, kind, m, k, c in zip(*(column.to_pylist() for column in batch.columns)):
        if not kind:
            mass += m
        else:
            names = np.cumsum(collocations._from_planes(k, m).astype(np.uint64))
            back.append(np.repeat((np.uint64(p) << np.uint64(32)) | names, collocations._from_planes(c, m)))
    assert mass == len(keys) + 100 and np.array_equal(np.sort(np.concatenate(back)), np.sort(np.concatenate([keys, keys[:100]]) >> np.uint64(27)))


def test_shares_pass_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 9_000_000_000_000_003)], "a bigint, l bigint, r bigint")
    a, l, r = row.first()
    assert row.select(collocations._share(2_000_000, "a", "l + r")).first()[0] == 2_000_000 * a // (l + r)
    assert row.select(source_audit._share("a", "l", "r")).first()[0] == 1 + 10**9 * (a + 5) // (l + 5 * r)


def test_set_of_bits_has_all_its_keys(spark):
    keys = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 20_000)
    df = spark.createDataFrame(pa.table({"key": keys[:10_000]}))
    made = bitset.build(df, 10_000)
    assert made.has(keys[:10_000].view(np.uint64)).all() and made.has(keys[10_000:].view(np.uint64)).mean() < 0.1
    assert bitset.build(df, 10_000, 1 << 14).has(keys[:10_000].view(np.uint64)).all()
    assert not bitset.build(df.limit(0), 0).has(keys.view(np.uint64)).any()


def test_words_of_slices():
    texts = pa.array(["", "A b", "c", "", "dé,F\tg", " ", "é"])
    got = []
    for start, stop in words.slices(texts, 3):
        found = words.cut(texts.slice(start, stop - start), words.classes(b" \t", b","))
        got += [(int(r) + start, found.distinct[int(c)].as_py()) for r, c in zip(found.row, found.code)]
        assert all((a == b) == (x == y) for (a, x), (b, y) in zip(zip(found.row, found.piece), list(zip(found.row, found.piece))[1:]) if a != b)
    assert got == [(1, "a"), (1, "b"), (2, "c"), (4, "dé"), (4, "f"), (4, "g"), (6, "é")]


# --- source audit -----------------------------------------------------------------


def brute_audit(rows, least=30, first=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in df[lang].items() if d >= least]
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:first]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(more, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least, first", [(30, 50), (2, 3)])
def test_audit(docs, least, first):
    assert rows_of(source_audit.audit(docs, least=least, first=first)) == brute_audit(plain(docs, "text", "lang", "source"), least, first)


def test_audit_in_small_blocks_and_tiles(spark, odd, monkeypatch):
    """Several blocks of terms, several tiles of sources, and sets of few bits."""
    rng = random.Random(8)
    rows = [("x%d y%d z%d" % (rng.randrange(9), rng.randrange(50), i % 2), "en", "s%d" % rng.randrange(9)) for i in range(400)] + [("", "en", "none"), ("y1", "de", "only")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    monkeypatch.setattr(source_audit, "TILE", 2)
    groups, shares = source_audit.audit_tables(docs, least=2, max_bits=1 << 14)
    pairs = source_audit.pair_distances(groups, shares, block_terms=5)
    expected = [(lang, s, o, v) for lang, s, part, o, v, _ in brute_audit(rows, 2) if part == "pair"]
    assert rows_of(pairs.select("lang", "source", "item", "value")) == sorted(expected, key=str)


# --- licences -----------------------------------------------------------------------


def licence_tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute_licences(rows, top=license_scan.TOP, in_place=license_scan.IN_PLACE):
    """Per row: number of words, base places, notices found with their first word."""
    token_rows = [licence_tokens(t) for t in rows]
    df = Counter(w for t in token_rows for w in set(t))
    idf = lambda w: round(math.log((len(rows) + 1) / df[w]) * 1_000_000)
    out = []
    for tokens in token_rows:
        places = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(tokens)) if tokens[i : i + len(p.split())] == p.split())
        found = set()
        for notice in license_scan.NOTICES:
            text = notice.text.split()
            shared = sorted({w for w in text if w in tokens and w not in license_scan.EVERYDAY}, key=lambda w: (-idf(w), w))[:top]
            for begin in range(-len(text), len(tokens)) if shared else ():
                stands = lambda i: 0 <= begin + i < len(tokens) and tokens[begin + i] == text[i]
                there = {text[i] for i in range(len(text)) if text[i] in shared and stands(i)}
                keys = [k.split() for k in notice.keys]
                firm = all(any(text[i : i + len(k)] == k and all(stands(i + j) for j in range(len(k))) for i in range(len(text))) for k in keys)
                if firm and len(there) >= math.ceil(len(shared) * in_place):
                    found.add((begin, notice.label, round(sum(map(idf, there)) / max(1, sum(map(idf, shared))), 6)))
        out.append((len(tokens), places, sorted(found)))
    return out


def test_licences(docs):
    rows = plain(docs, "doc_id", "text")
    told = brute_licences([t for _, t in rows])
    expected = [(d, n, places, sorted({v for _, v in places}), sorted({v for _, v in places} | {v for _, v, _ in found}), found) for (d, _), (n, places, found) in zip(rows, told)]
    ours = license_scan.scan(docs)
    got = [(r["doc_id"], r["n_words"], [tuple(p) for p in r["places"]], r["base_labels"], r["labels"], [tuple(x) for x in r["notices"]]) for r in ours.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_licences_are_told_apart(spark):
    """Whole notices are found under their label; loose words are not, and one changed word of a key phrase is enough to miss it."""
    texts = [f"intro words {n.text} and more" for n in license_scan.NOTICES]
    loose = ["cc by and nc", "the source of binary forms and following terms", "permission is hereby not granted free of charge to any person obtaining a copy of this software"]
    docs = spark.createDataFrame(list(enumerate(texts + loose)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()}
    for i, n in enumerate(license_scan.NOTICES):
        assert n.label in got[i]
    assert all(got[len(texts) + i] == [] for i in range(len(loose)))


def test_licence_query_has_no_python(spark, sf_dir):
    plan = queries.op13_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Arrow|Python|MapIn", plan)
