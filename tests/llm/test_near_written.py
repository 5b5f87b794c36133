"""What the n-gram join writes on its way."""

import random

import pytest

from strucreg.llm import ngram_join


@pytest.fixture
def written(monkeypatch):
    """The columns of every table kept."""
    tables, keep = [], ngram_join.Tables.keep

    def noted(self, df):
        tables.append(df.columns)
        return keep(self, df)

    monkeypatch.setattr(ngram_join.Tables, "keep", noted)
    return tables


def _rows(ids):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    first, second = ([word() for _ in range(60)] for _ in range(2))
    texts = [" ".join(first), " ".join(first[:-1] + [word()]), " ".join(second), " ".join([word()] + second[1:]), " ".join(second), "", "two words"]
    return [(i, t, f"r{k}") for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.mark.parametrize("ids, stay", [([None, 7, 3, 2, 5, 9, 8], ["r1", "r3", "r5", "r6"]), ([4, 7, 3, 2, 5, None, 8], ["r0", "r3", "r5", "r6"])])
def test_whole_rows_are_not_copied_where_no_id_repeats(spark, written, ids, stay):
    docs = spark.createDataFrame(_rows(ids), "doc_id bigint, text string, _stays string").repartition(3).cache()
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["_stays"] for r in kept.collect()) == stay
    assert written and not any("_row" in columns or "text" in columns for columns in written)


def test_repeated_ids_are_told_apart(spark, written):
    docs = spark.createDataFrame(_rows([4, 4, 4, 4, 4, 4, 4]), "doc_id bigint, text string, name string").repartition(3).cache()
    kept = sorted(r["name"] for r in ngram_join.keep_one(docs).collect())
    assert len(kept) == 4 and kept[-2:] == ["r5", "r6"] and any("_row" in columns for columns in written)
