"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ann import nearest_neighbours
from tessera.llm.bpe import bpe_encode, digests
from tessera.llm.divergence import audit
from tessera.llm.licences import licence_scan
from tessera.llm.negatives import hard_negatives
from tessera.llm.packing import pack_documents
from tessera.llm.pq_dedup import pq_neardup
from tessera.llm.quality import quality
from tessera.llm.simhash import simhash_neardup
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.token_files import scratch, write_tokens
from tessera.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_neardup(table(spark, sf_dir, "embeddings"), 0.95)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup(table(spark, sf_dir, "documents"), ngram=3, bits=64, radius=3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), tokens=False)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), scratch(spark, "tokens"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 take the next label first."""
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives(moved, every=50, k_positive=5, k_negative=3, low=50, high=95, scale=256)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), k=10, least_docs=10)


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary file stands on this machine; workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_embedding_neardup, op2_suffix_array_dedup, op3_nearest_neighbours, op4_simhash_neardup, op5_quality_classifier, op6_toxicity, op7_bpe_encoding, op8_licence_scan, op9_substring_dedup, op10_packing, op11_token_files, op12_hard_negatives, op13_source_divergence)}


#: Links by comparing all pairs, components by following them.
LINKS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.seen),
    c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
    SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id"""

#: Every window as text, the first of each, and the units that later ones cover.
REPEATS_SQL = """WITH u AS (SELECT doc_id, unnest({units}) AS x, unnest(range(len({units}))) AS i FROM documents),
    w AS (SELECT doc_id, i, x, string_agg(x, '{glue}') OVER f AS w, count(*) OVER f AS k FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)),
    c AS (SELECT doc_id, i, x, k = {last} + 1 AND {later} AS later FROM w),
    g AS (SELECT doc_id, i, x, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {last} PRECEDING AND CURRENT ROW) AS gone FROM c),
    s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM g),
    o AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, count(*) FILTER (opens) AS spans, string_agg(x, '{glue}' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY 1)"""
WORDS_SQL = (
    REPEATS_SQL.format(units="regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')", glue=" ", last=19, later="row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1")
    + " SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"
)
BYTES_SQL = (
    REPEATS_SQL.format(units="regexp_extract_all(hex(encode(coalesce(text, ''))), '..')", glue="", last=49, later="doc_id > min(doc_id) OVER (PARTITION BY w)")
    + " SELECT d.doc_id, coalesce(n, 0) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"
)


#: All scores of the anchors, their positives, and the windows' best.
NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

#: Shares of every kept term in every group, whole numbers all through.
DIVERGENCE_SQL = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
    k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    h AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    t AS (SELECT lang, source, sum(n)::BIGINT AS n FROM h GROUP BY ALL),
    s AS (SELECT h.lang, h.source, term, h.n, 1 + (1000000000 * (h.n + 2)) // (t.n + 2 * v.v) AS p, 1 + (1000000000 * (lang_n + 2)) // (v.n + 2 * v.v) AS q FROM h JOIN t ON t.lang = h.lang AND t.source = h.source JOIN v ON v.lang = h.lang),
    x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM o WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say all of a result and runs on whole tables; the other queries have brute-force tests."""
    return {"op1_embedding_neardup": LINKS_SQL, "op2_suffix_array_dedup": BYTES_SQL, "op9_substring_dedup": WORDS_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_source_divergence": DIVERGENCE_SQL}
