"""Registered queries of this subpackage, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_transducer, decontam, hard_negatives, html_paths, kn_quality, lang_parse, lexical_dag, ngram_jaccard, pq_neardup, rindex_dedup, sentencepiece_bpe, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"), least=0)


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_pages(_table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), length=100).drop("kept_text")


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_neardup.embedding_links(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_parse.language_id(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), "vec_id % 100 = 0", positives=5, negatives=10, least=30, most=90, scale=256)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_dag.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_warc_normaliser, op3_kneser_ney_quality, op4_toxicity_chain, op5_sentencepiece, op6_decontamination, op7_html_extraction, op8_suffix_dedup, op9_embedding_neardup, op10_language_id, op11_hard_negatives, op12_bpe, op13_lexical_search, pipeline)}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.i >= 85 * (x.n + y.n - o.i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS top FROM l UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.doc_id WHERE r.top < l.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.top, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(top) AS top FROM r GROUP BY doc_id) m USING (doc_id)
""",
    "op2_warc_normaliser": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS h FROM p),
m AS (SELECT h, max(page_id) AS top, count(*) AS c FROM h GROUP BY h),
x AS (SELECT page_id, n, h.h, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h.h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS q FROM h)
SELECT x.page_id, CAST(x.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(x.q, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v // 32768 + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v // 1024 % 32 + 1]
    || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v // 32 % 32 + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v % 32 + 1]), '') AS payload_digest,
  CASE WHEN m.top = x.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m.top <> x.page_id THEN m.top END AS refers_to
FROM x JOIN m ON m.h = x.h
""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
    "op13_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT CAST(count(CASE WHEN len(w) > 0 THEN 1 END) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) u WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
g AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s GROUP BY t, s.n),
p AS (SELECT f.doc_id, f.t, g.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * len(d.w) * s.n) // s.l))) AS p FROM f JOIN g USING (t) JOIN d USING (doc_id), s),
r AS (SELECT i.item_id, p.doc_id, CAST(sum(p.p) AS BIGINT) AS score FROM i JOIN p USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""",
}
