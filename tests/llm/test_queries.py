"""The registered queries and the pipeline, over the whole small tables."""

import brute
import oracle
import pytest

import corpus_pipeline
from strucreg.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.SQL[name]) is None


CONTRACT = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_ngram_join": "doc_id n_shingles component_id",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_mixing": "doc_id size source_size target taken",
    "op13_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_every_document_has_its_columns(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).cache()
    docs = queries.documents(spark, sf_dir)
    assert set(CONTRACT[name].split()) <= set(rows.columns)
    assert rows.select("doc_id").distinct().count() == docs.count() and (name == "op6_packing" or rows.count() == docs.count())


def test_pipeline_stages(spark, sf_dir):
    """Each stage against its plain statement on its own input."""
    docs = queries.documents(spark, sf_dir)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        after = sorted(r["doc_id"] for r in docs.collect())
        if name == "exact dedup":
            assert after == sorted(d for d, v in brute.exact(before).items() if v[2])
        elif name == "n-gram Jaccard join":
            assert after == sorted(d for d, (_, c) in brute.near(before).items() if c == d)
        else:
            assert not {d for d, t in before if brute.base_quality(t)[-1]} & set(after)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).cache()
    words = sum(brute.words(r["text"]) for r in docs.collect())
    assert mixed.columns == columns and abs(sum(brute.words(r["text"]) for r in mixed.collect()) - 1.5 * words) < 0.1 * words
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir)
    assert packed.filter("piece = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
