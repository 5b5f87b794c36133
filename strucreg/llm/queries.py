"""The operators applied to the whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strucreg.llm import collocations, exact_dedup, language_id, license_scan, mixing, ngram_join, packing, pii, quality, sharding, source_audit, suffix_dedup, toxicity

VOCABULARY = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("all").alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.held_out_toxicity(documents(spark, sf_dir), labels)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_sentences"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


# The present layout that the documents are resharded from: shards by checksum of the text, fewer than the new ones.
OLD_SHARDS, NEW_SHARDS = 12, 16


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    old = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % OLD_SHARDS
    placed = sharding.reshard(docs, old, OLD_SHARDS, NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir)).drop("k")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    # a base phrase alone is worth a half
    score = F.greatest(F.coalesce(F.array_max("notices.score"), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.at").alias("first_word"), F.array_max("places.at").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), score.alias("score"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_language_id, op4_toxicity, op5_ngram_join, op6_packing, op7_quality, op8_suffix_dedup, op9_mixing, op10_sharding, op11_collocations, op12_source_audit, op13_license_scan, pipeline)}

def _license_sql() -> str:
    texts = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = ", ".join(f"({texts(p.split())}, '{label}')" for p, label in license_scan.PHRASES.items())
    notices = ", ".join(f"({i}, '{n.label}', {texts(n.text.split())})" for i, n in enumerate(license_scan.NOTICES))
    keys = ", ".join(f"({i}, {texts(k.split())})" for i, n in enumerate(license_scan.NOTICES) for k in n.keys)
    return rf"""
        WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM w),
        base(words, label) AS (VALUES {base}),
        notices(notice, label, words) AS (VALUES {notices}),
        keys(notice, words) AS (VALUES {keys}),
        places AS (SELECT r, pos, label FROM p JOIN base ON p.word = words[1] JOIN w USING (r) WHERE w[pos + 1:pos + len(words)] = words),
        index_ AS (SELECT notice, word, place FROM (SELECT notice, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM notices)
          WHERE word NOT IN {tuple(license_scan.EVERYDAY)}),
        hits AS MATERIALIZED (SELECT r, pos, notice, word, place FROM p JOIN index_ USING (word)),
        idf AS (SELECT word, round(ln(((SELECT count(*) FROM w) + 1) / count(DISTINCT r)) * 1000000)::BIGINT AS idf FROM hits GROUP BY word),
        best AS (SELECT r, notice, word, idf FROM (SELECT DISTINCT r, notice, word FROM hits) JOIN idf USING (word) QUALIFY row_number() OVER (PARTITION BY r, notice ORDER BY idf DESC, word) <= {license_scan.TOP}),
        whole AS (SELECT r, notice, sum(idf) AS whole, count(*) AS sought FROM best GROUP BY ALL),
        begins AS (SELECT r, notice, start, sum(idf) AS weight, count(*) AS words
          FROM (SELECT DISTINCT r, notice, pos - place AS start, word, idf FROM hits JOIN best USING (r, notice, word)) GROUP BY ALL),
        standing AS (
          SELECT b.r, b.notice, b.start, b.weight, whole.whole
          FROM begins b JOIN whole USING (r, notice) JOIN notices n USING (notice) JOIN w USING (r)
          WHERE b.words >= ceil(sought * {license_scan.IN_PLACE}) AND NOT EXISTS (
            SELECT 1 FROM keys k WHERE k.notice = b.notice AND NOT list_bool_or(list_transform(range(0, len(n.words) - len(k.words) + 1), lambda i: n.words[i + 1:i + len(k.words)] = k.words
              AND start + i >= 0 AND w.w[start + i + 1:start + i + len(k.words)] = k.words)))),
        told AS (SELECT r, label, round(weight / greatest(whole, 1), 6) AS score FROM standing JOIN notices USING (notice)),
        named AS (SELECT r, label, TRUE AS base, pos, 0.5::DOUBLE AS score FROM places UNION ALL SELECT r, label, FALSE, NULL, score FROM told),
        out_ AS (SELECT r, count(*) FILTER (base) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM named GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
          coalesce(score, 0)::DOUBLE AS score
        FROM w LEFT JOIN out_ USING (r)"""


SQL = {
    "op13_license_scan": _license_sql(),
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op5_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS words
          FROM documents),
        sets AS MATERIALIZED (
          SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
          FROM w),
        items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS MATERIALIZED (
          SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)""",
    "op8_suffix_dedup": r"""
        WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        starts AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100),
        strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM starts),
        again AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
        runs AS (
          SELECT doc_id, min(p) AS a, max(p) + 100 AS b
          FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
                FROM (SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) + 100)::INT AS fresh FROM again))
          GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
        cut AS (
          SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
          FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
          sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM t LEFT JOIN cut USING (doc_id)""",
    "op11_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, range(1, 5) r(size)),
        f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
        parts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM c, range(1, 4) q(k) WHERE k < size),
        cuts AS MATERIALIZED (SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score
          FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.tail),
        best AS (SELECT lang, phrase, a, min_by((score, l, r), (score, k)) AS b FROM cuts GROUP BY ALL),
        inner_ AS (SELECT lang, a AS f, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM c, range(2, 4) q(m) WHERE m < size),
        cover AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
        kept AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY b[1] DESC, a DESC, encode(best.phrase)) AS rank
          FROM best LEFT JOIN cover USING (lang, phrase) WHERE cover.f IS NULL OR 100 * cover.f < 80 * a)
        SELECT lang, rank, phrase, a, b[2] AS l, b[3] AS r, n, b[1]::BIGINT AS score FROM kept JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_source_audit": r"""
        WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
            row_number() OVER () AS doc FROM documents),
        words AS MATERIALIZED (SELECT lang, source, doc, unnest(w) AS term FROM t),
        kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
          FROM (SELECT DISTINCT lang, source FROM t) g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)),
        p AS MATERIALIZED (
          SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (g.total + 5 * g.v) AS p
          FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
          FROM counts GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        rows_ AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL
          SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
        SELECT lang, source, part, item, value, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM rows_)
        WHERE part = 'pair' OR rank <= 50""",
}
