"""Queries that run each operator on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import jsonx, text
from tessera.operators import budget, chunks, evaluate, feedback, findings, graph, pages, report, retrieval, summaries, vector
from tessera.sources import extract, files, shared, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Every so many rows of `embeddings` asks, as a stated query set against all rows.
EVERY = 50


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, embedding) and all rows (id, embedding, label)."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return base.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "embedding"), base


def hits_sql(k: int) -> str:
    return f"""hits AS (SELECT query_id, id, distance, rank FROM (
        SELECT q.vec_id AS query_id, b.vec_id AS id, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance,
               CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS INT) AS rank
        FROM embeddings q, embeddings b WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {k})"""


@query(f"WITH {hits_sql(20)} SELECT query_id, id, round(distance, 6) AS distance, rank FROM hits")
def knn_topk(spark, sf_dir):
    q, base = vectors(spark, sf_dir)
    return vector.knn(q, base, fixed.KNN_K).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {hits_sql(20)} SELECT query_id, id, round(distance, 6) AS distance FROM hits JOIN embeddings b ON b.vec_id = id
    JOIN embeddings q ON q.vec_id = query_id WHERE b.label <> q.label""")
def knn_post_filter(spark, sf_dir):
    """The k nearest first, then those of the query's own label go: they have used up their places."""
    q, base = vectors(spark, sf_dir)
    labels = base.select("id", "label")
    hits = vector.knn(q, base, fixed.KNN_K).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.where("label <> own").select("query_id", "id", F.round("distance", 6).alias("distance"))


@query(f"WITH {hits_sql(20)} SELECT query_id, label, round(min(distance), 6) AS distance FROM hits JOIN embeddings b ON b.vec_id = id GROUP BY 1, 2")
def knn_min_per_group(spark, sf_dir):
    q, base = vectors(spark, sf_dir)
    hits = vector.knn(q, base, fixed.KNN_K).join(base.select("id", "label"), "id")
    return vector.min_per_group(hits, "label").select("query_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH {hits_sql(100)}, ok AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM hits h
    JOIN embeddings b ON b.vec_id = h.id WHERE b.label % 2 = 0) SELECT query_id, id, round(distance, 6) AS distance, CAST(n AS INT) AS rank FROM ok WHERE n <= 20""")
def knn_within_candidates(spark, sf_dir):
    q, base = vectors(spark, sf_dir)
    allowed = base.where("label % 2 = 0").select("id")
    return vector.within_candidates(q, base, allowed, 20).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


VOTES = """, s AS (SELECT vec_id AS id, embedding, CASE WHEN label % 2 = 0 THEN 'dismissed' ELSE 'accepted' END AS kind FROM embeddings WHERE vec_id % 5 <> 0),
    n AS (SELECT f.vec_id AS id, s.kind, s.id AS sid, list_distance(f.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS d FROM embeddings f, s WHERE f.vec_id % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS k FROM n),
    v AS (SELECT r.id, count(*) FILTER (kind = 'dismissed') AS no, count(*) FILTER (kind = 'accepted') AS yes FROM r JOIN embeddings e ON e.vec_id = r.sid
          WHERE k <= 10 AND d <= 1.3 AND e.label < 7 GROUP BY 1)"""


@query(f"""WITH f AS (SELECT vec_id AS id, CAST(0.5 + (vec_id // 5 % 5) * 0.1 AS DOUBLE) AS confidence FROM embeddings WHERE vec_id % 5 = 0){VOTES}
    SELECT id, round(c, 6) AS confidence FROM (SELECT f.id, CASE WHEN coalesce(yes, 0) >= 3 THEN least(confidence + 0.1, 1.0) ELSE confidence END AS c
    FROM f LEFT JOIN v ON v.id = f.id WHERE coalesce(no, 0) < 3) WHERE c >= 0.55""")
def feedback_vote(spark, sf_dir):
    _, base = vectors(spark, sf_dir)
    team = F.when(F.col("label") < 7, "ours").otherwise("theirs").alias("team_id")
    signals = base.where("id % 5 <> 0").select("id", "embedding", F.when(F.col("label") % 2 == 0, "dismissed").otherwise("accepted").alias("signal_type"), team)
    found = base.where("id % 5 = 0").select("id", "embedding", (0.5 + F.floor(F.col("id") / 5) % 5 * 0.1).alias("confidence"))
    return feedback.apply_feedback(found, signals, "ours", min_confidence=0.55, min_signals=1, max_distance=1.3).select("id", F.round("confidence", 6).alias("confidence"))


COCHANGE = """c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem), t AS (SELECT k, f FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM c) WHERE r <= 50),
    n AS (SELECT f, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS commit_count FROM t a JOIN t b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3),
    pairs AS (SELECT file_a, file_b, commit_count, commit_count / sqrt(x.n * y.n) AS correlation FROM p JOIN n x ON x.f = file_a JOIN n y ON y.f = file_b WHERE commit_count / sqrt(x.n * y.n) >= 0.1)"""


def part_pairs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("l_partkey").alias("pos"))
    return graph.cochange(rows)


@query(f"WITH {COCHANGE} SELECT file_a, file_b, commit_count, round(correlation, 6) AS correlation FROM pairs")
def cochange_pairs(spark, sf_dir):
    return part_pairs(spark, sf_dir).withColumn("correlation", F.round("correlation", 6))


@query(f"WITH {COCHANGE}, b AS (SELECT file_a AS file, file_b AS other, correlation FROM pairs UNION SELECT file_b, file_a, correlation FROM pairs) SELECT file, other, round(correlation, 6) AS correlation FROM b")
def edges_bidirectional(spark, sf_dir):
    return graph.cochange_neighbours(part_pairs(spark, sf_dir), 0.1).select("file", "other", F.round("correlation", 6).alias("correlation"))


@query("""WITH c AS (SELECT DISTINCT user_id || '@' || CAST(ts AS DATE) AS k, event_type AS f FROM events), t AS (SELECT k, f FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM c) WHERE r <= 3),
    n AS (SELECT f, count(*) AS n FROM t GROUP BY 1) SELECT a.f AS file_a, b.f AS file_b, count(*) AS commit_count, round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS correlation
    FROM t a JOIN t b ON a.k = b.k AND a.f < b.f JOIN n x ON x.f = a.f JOIN n y ON y.f = b.f GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) / sqrt(any_value(x.n) * any_value(y.n)) >= 0.1""")
def cochange_capped(spark, sf_dir):
    """A commit is a user's day; its first three event types count."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string")).alias("commit"), F.col("event_type").alias("file"), F.lit(0).alias("pos"))
    return graph.cochange(rows, most=3).withColumn("correlation", F.round("correlation", 6))


def part_imports(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    imports = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_partkey").cast("string").alias("source_path"))
    return imports, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("path"))


@query("SELECT l_suppkey AS file_id, p_partkey AS target_id, CAST(p_partkey AS VARCHAR) AS path FROM lineitem JOIN part ON p_partkey = l_partkey")
def import_edges(spark, sf_dir):
    return graph.import_edges(*part_imports(spark, sf_dir))


@query("SELECT DISTINCT p_partkey AS target_id, l_suppkey AS file_id FROM lineitem JOIN part ON p_partkey = l_partkey")
def reverse_edges(spark, sf_dir):
    return graph.reverse_imports(*part_imports(spark, sf_dir))


@query(f"WITH {COCHANGE} SELECT l_suppkey AS file, p_partkey AS other FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT file_a, file_b FROM pairs WHERE correlation >= 0.12 UNION SELECT file_b, file_a FROM pairs WHERE correlation >= 0.12")
def structural_union(spark, sf_dir):
    edges = graph.import_edges(*part_imports(spark, sf_dir)).select(F.col("file_id").alias("file"), F.col("target_id").alias("other"))
    return graph.structural_union(edges, part_pairs(spark, sf_dir), 0.12)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def path_batch_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_name")


TOKENS = "'[^A-Za-z0-9_]+'"
KEYWORDS = f"""w AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_split_to_array(text, {TOKENS})) AS t FROM benchmark) WHERE length(t) > 2),
    k AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, {TOKENS})) AS t FROM documents) SEMI JOIN w USING (t))"""


def doc_tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    # \W is [^A-Za-z0-9_] in Java too, and many times as fast as the class spelt out
    split = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(F.array_distinct(F.split("text", r"\W+"))).alias("name"))
    return split("documents", F.col("doc_id").alias("file_id")), split("benchmark", F.col("item_id").alias("file_id")).where("length(name) > 2").select("name").distinct()


def most_names(spark, sf_dir) -> int:
    """At most about how many wanted words the documents hold, without splitting them: one in 20 bytes (sf0.1: one in 32)."""
    return (table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 20


@query(f"WITH {KEYWORDS} SELECT doc_id AS file_id, count(*) AS terms FROM k GROUP BY 1")
def keyword_hits(spark, sf_dir):
    docs, names = doc_tokens(spark, sf_dir)
    return graph.files_with_names(docs, "name", names, most_names(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("terms"))


FUSED = f"""{COCHANGE}, {KEYWORDS}, {hits_sql(20)},
    e AS (SELECT other AS file_id, 'structural' AS method, correlation AS value FROM (SELECT file_a AS file, file_b AS other, correlation FROM pairs UNION SELECT file_b, file_a, correlation FROM pairs)
          UNION ALL SELECT id, 'semantic', greatest(2 - distance, 0) FROM hits WHERE id % {EVERY} <> 0
          UNION ALL SELECT doc_id, 'keyword', 1.0 FROM k)"""


def evidence(spark, sf_dir) -> DataFrame:
    """Parts, vectors and documents share one id space here; the similarity is 2 - distance, as few distances are below 1."""
    none = F.lit(None).cast("string").alias("reason")
    together = graph.cochange_neighbours(part_pairs(spark, sf_dir), 0.1).select(F.col("other").alias("file_id"), F.lit("structural").alias("method"), none, F.col("correlation").alias("value"))
    q, base = vectors(spark, sf_dir)
    near = vector.knn(q, base, fixed.KNN_K).where(F.col("id") % EVERY != 0).select(F.col("id").alias("file_id"), F.lit("semantic").alias("method"), none, F.greatest(2 - F.col("distance"), F.lit(0.0)).alias("value"))
    docs, names = doc_tokens(spark, sf_dir)
    words = graph.files_with_names(docs, "name", names, most_names(spark, sf_dir)).select("file_id", F.lit("keyword").alias("method"), none, F.lit(1.0).alias("value"))
    return together.unionByName(near).unionByName(words)


@query(f"""WITH {FUSED} SELECT file_id, round(sum(CASE method WHEN 'structural' THEN value WHEN 'semantic' THEN 0.7 * value ELSE 0.3 * value / 3 END), 6) AS score, count(*) AS entries FROM e GROUP BY 1""")
def fused_score(spark, sf_dir):
    return retrieval.fuse(evidence(spark, sf_dir)).select("file_id", F.round("score", 6).alias("score"), "entries")


@query(f"WITH {FUSED} SELECT count(DISTINCT CASE WHEN method = 'structural' THEN file_id END) AS structural, count(DISTINCT CASE WHEN method = 'semantic' THEN file_id END) AS semantic, CAST(0 AS BIGINT) AS code_semantic, count(DISTINCT CASE WHEN method = 'keyword' THEN file_id END) AS keyword FROM e")
def method_counts(spark, sf_dir):
    return retrieval.method_counts(evidence(spark, sf_dir))


def chunks_sql(size: int, step: int, source: str = "documents", tag: str = "") -> str:
    return f"""l{tag} AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM {source} WHERE length(text) > 0),
    ch{tag} AS (SELECT doc_id, s, ls, len(ls) AS n FROM (SELECT doc_id, ls, unnest(range(0, len(ls), {step})) AS s FROM l{tag})),
    c{tag} AS (SELECT doc_id, CAST(s + 1 AS INT) AS start_line, CAST(least(s + {size}, n) AS INT) AS end_line, array_to_string(ls[s + 1:s + {size}], chr(10)) AS content FROM ch{tag})"""


def doc_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


@query(f"WITH {chunks_sql(50, 40)} SELECT doc_id, start_line, end_line, sha256(content) AS content_hash FROM c")
def line_chunks(spark, sf_dir):
    return chunks.line_chunks(doc_files(spark, sf_dir)).drop("content")


@query(f"WITH {chunks_sql(5, 3)} SELECT doc_id, start_line, end_line, sha256(content) AS content_hash FROM c")
def line_chunks_small(spark, sf_dir):
    return chunks.line_chunks(doc_files(spark, sf_dir), 5, 2).drop("content")


@query(f"WITH {chunks_sql(50, 40)} SELECT sha256(content) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY 1 HAVING count(*) > 1")
def chunk_hash_dedup(spark, sf_dir):
    return chunks.line_chunks(doc_files(spark, sf_dir)).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"""WITH old AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE chr(10) || 'more' END AS text FROM documents), {chunks_sql(50, 40)}, {chunks_sql(50, 40, "old", "o")},
    b AS (SELECT doc_id, list_sort(list(sha256(content))) AS h FROM c GROUP BY 1), bo AS (SELECT doc_id, list_sort(list(sha256(content))) AS h FROM co GROUP BY 1) SELECT doc_id FROM b JOIN bo USING (doc_id) WHERE b.h = bo.h""")
def unchanged_chunks(spark, sf_dir):
    """Two of three documents had other text when their chunks were stored."""
    more = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "!").otherwise("\nmore")
    stored = doc_files(spark, sf_dir).withColumn("content", F.concat("content", more))
    return chunks.unchanged_files(chunks.line_chunks(stored), chunks.line_chunks(doc_files(spark, sf_dir)), "doc_id")


@query("SELECT doc_id, strlen(text) // 3 AS tokens, strlen(text) // 4 AS summary_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.estimate_tokens(F.col("text"), fixed.SUMMARY_BYTES_PER_TOKEN).alias("summary_tokens"))


PRINTS = """h AS (SELECT doc_id, substr(sha256(source || lang || lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) AS c, substr(sha256(source || n_chars || lang), 1, 16) AS l FROM documents)"""


@query(f"""WITH {PRINTS}, r AS (SELECT doc_id, c, l, row_number() OVER (PARTITION BY c ORDER BY doc_id) - 1 AS i, row_number() OVER (PARTITION BY l ORDER BY doc_id) - 1 AS j FROM h)
    SELECT doc_id AS ord, c || CASE WHEN i > 0 THEN ':' || i ELSE '' END AS fp_id, l || CASE WHEN j > 0 THEN ':' || j ELSE '' END AS line_id FROM r""")
def fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("file"), F.col("lang").alias("category"), F.col("text").alias("evidence"), F.col("n_chars").alias("start_line"), F.lit(None).cast("long").alias("end_line"))
    return findings.fingerprints(rows).select("ord", "fp_id", "line_id")


@query("""WITH f AS (SELECT doc_id, source, lang, n_chars // 500 AS line, (doc_id * 7 % 10) / 10.0 AS confidence FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, line, lang ORDER BY confidence DESC, doc_id) AS k,
    min(doc_id) OVER (PARTITION BY source, line, lang) AS first FROM f) SELECT source AS file, line AS start_line, lang AS category, CAST(confidence AS DOUBLE) AS confidence, first AS ord, doc_id FROM r WHERE k = 1""")
def dedup_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "doc_id", F.col("source").alias("file"), F.floor(F.col("n_chars") / 500).alias("start_line"), F.col("lang").alias("category"), (F.col("doc_id") * 7 % 10 / 10.0).cast("double").alias("confidence"))
    return findings.deduplicate(rows).select("file", "start_line", "category", "confidence", "ord", "doc_id")


def contains_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


DISMISSED = f"({contains_sql('b', fixed.DISMISSAL_PHRASES)} OR contains(b, 'minimal security impact') OR (contains(b, 'minimal impact') AND NOT contains(b, 'minimal impact on')))"


@query(f"""WITH f AS (SELECT conv_id * 100 + turn AS ord, conv_id, turn, role, text, 0.5 + (conv_id % 6) * 0.1 AS c, CASE turn % 3 WHEN 0 THEN 'logic' WHEN 1 THEN 'style' ELSE 'security' END AS category, lower(text) || ' ' || lower(role) AS b FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY role, turn, category ORDER BY c DESC, ord) AS r, min(ord) OVER (PARTITION BY role, turn, category) AS o FROM f WHERE c >= 0.7 AND length(trim(text)) > 0 AND category <> 'style' AND NOT {DISMISSED})
    SELECT role AS file, turn AS start_line, category, round(c, 6) AS confidence, o AS ord FROM k WHERE r = 1""")
def filter_chain(spark, sf_dir):
    category = F.element_at(F.array(F.lit("logic"), F.lit("style"), F.lit("security")), (F.col("turn") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.col("role").alias("file"), F.col("turn").alias("start_line"), category.alias("category"), (0.5 + F.col("conv_id") % 6 * 0.1).alias("confidence"), F.col("text").alias("evidence"), F.col("text").alias("explanation"), F.col("role").alias("impact"))
    return findings.apply_filters(rows).select("file", "start_line", "category", F.round("confidence", 6).alias("confidence"), "ord")


def list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PHRASES = {1: (*fixed.DISMISSAL_PHRASES, fixed.MINIMAL, fixed.MINIMAL_QUALIFIER), 2: (*fixed.CLAIM_PHRASES, *fixed.NO_CLAIM_PHRASES), 3: fixed.REASONING_PHRASES}
SAID = "lower(text) || CASE conv_id % 4 " + " ".join(f"WHEN {k} THEN ' ' || ({list_sql(v)})[1 + CAST((conv_id * 7 + turn) % {len(v)} AS INT)]" for k, v in PHRASES.items()) + " ELSE '' END"


@query(f"""WITH t AS (SELECT conv_id, turn, {SAID} AS s FROM conversations), c AS (SELECT conv_id, turn, s, s || ' ' AS b, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS n FROM t)
    SELECT conv_id, turn, {DISMISSED} AS dismissed, NOT {contains_sql('n', fixed.NO_CLAIM_PHRASES)} AND {contains_sql('n', fixed.CLAIM_PHRASES)} AS claims, {contains_sql('n', fixed.REASONING_PHRASES)} AS reasoning FROM c""")
def text_predicates(spark, sf_dir):
    """Three of four texts end with a phrase of one of the lists."""
    nth = lambda v: F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, v)), ((F.col("conv_id") * 7 + F.col("turn")) % len(v) + 1).cast("int")))
    more = F.lit("")
    for k, v in PHRASES.items():
        more = F.when(F.col("conv_id") % 4 == k, nth(v)).otherwise(more)
    t = F.concat("text", more)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_self_dismissed(t, F.lit("")).alias("dismissed"), text.claims_findings(t).alias("claims"), text.has_reasoning(F.regexp_replace(t, r"\s+", " ")).alias("reasoning"))


@query("SELECT doc_id AS id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unembedded_anti(spark, sf_dir):
    return vector.unembedded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""WITH p AS (SELECT c_custkey, 'c' || c_custkey AS fp_id, 'n' || c_nationkey || c_mktsegment AS line_id FROM customer), c AS (SELECT 'c' || o_custkey AS fp_id, 'n' || o_custkey % 25 || 'BUILDING' AS line_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
    SELECT c_custkey, fp_id, line_id FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE p.fp_id = c.fp_id OR p.fp_id = c.line_id OR p.line_id = c.fp_id OR p.line_id = c.line_id) AND EXISTS (SELECT 1 FROM c)""")
def stale_anti(spark, sf_dir):
    prior = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("fp_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("line_id"))
    now = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("fp_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string"), F.lit("BUILDING")).alias("line_id"))
    return findings.stale(prior, now).select("c_custkey", "fp_id", "line_id")


EVALUATED = """r AS (SELECT source AS fixture, sum(quality) AS expected, sum(CASE WHEN n_chars > 800 THEN 1 ELSE 0 END) AS actual, sum(CASE WHEN quality = 1 AND n_chars > 800 THEN 1 ELSE 0 END) AS tp FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""


def results(spark, sf_dir) -> DataFrame:
    """A source is a fixture, good documents are expected, long ones are found."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    long = F.col("n_chars") > 800
    out = rows.groupBy(F.col("source").alias("fixture")).agg(F.sum("quality").alias("expected"), F.count_if(long).alias("actual"), F.count_if(long & (F.col("quality") == 1)).alias("tp"))
    return out.withColumns({"fp": F.col("actual") - F.col("tp"), "fn": F.col("expected") - F.col("tp")})


@query(f"""WITH {EVALUATED} SELECT fixture, CAST(tp AS BIGINT) AS tp, CAST(actual - tp AS BIGINT) AS fp, CAST(expected - tp AS BIGINT) AS fn, round(p, 6) AS "precision", round(r2, 6) AS recall, round(CASE WHEN p + r2 > 0 THEN 2 * p * r2 / (p + r2) ELSE 0 END, 6) AS f1
    FROM (SELECT *, CASE WHEN actual > 0 THEN tp / actual ELSE 1.0 END AS p, CASE WHEN expected > 0 THEN tp / expected ELSE 1.0 END AS r2 FROM r)""")
def eval_confusion(spark, sf_dir):
    out = evaluate.rates(results(spark, sf_dir))
    return out.select("fixture", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {EVALUATED}, t AS (SELECT sum(expected) AS e, sum(actual) AS a, sum(tp) AS tp FROM r) SELECT CAST(e AS BIGINT) AS expected, CAST(a AS BIGINT) AS actual, CAST(tp AS BIGINT) AS tp, round(tp / a, 6) AS "precision", round(tp / e, 6) AS recall, round((a - tp) / a, 6) AS noise,
    tp / a >= 0.7 AND tp / e >= 0.5 AND (a - tp) / a <= 0.2 AS gates_passed FROM t""")
def eval_gates(spark, sf_dir):
    out = evaluate.gates(evaluate.aggregate(results(spark, sf_dir)))
    return out.select("expected", "actual", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "noise")), "gates_passed")


MATCHED = """ev AS (SELECT CAST(user_id AS VARCHAR) AS fixture, event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS line, CASE event_id % 6 WHEN 0 THEN 'logic' WHEN 1 THEN 'security' WHEN 2 THEN 'convention' WHEN 3 THEN 'performance' WHEN 4 THEN 'style' ELSE 'other' END AS cat FROM events)"""
ALIASES = " OR ".join(f"(a.cat = '{x}' AND e.cat = '{y}') OR (a.cat = '{y}' AND e.cat = '{x}')" for x, y in fixed.CATEGORY_ALIASES)


def event_findings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events at the hour of their time as lines, of a category by id; every third is expected, the others were found."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fixture"), F.lit("f").alias("file"), F.col("event_id").alias("ord"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("start_line"), F.element_at(F.array(*map(F.lit, fixed.CATEGORIES)), (F.col("event_id") % 6 + 1).cast("int")).alias("category"), F.lit(None).cast("array<string>").alias("acceptable"))
    return rows.where("ord % 3 = 0"), rows.where("ord % 3 <> 0")


@query(f"WITH {MATCHED} SELECT e.fixture, e.event_id AS e_ord, a.event_id AS a_ord FROM ev e JOIN ev a ON e.fixture = a.fixture WHERE e.event_id % 3 = 0 AND a.event_id % 3 <> 0 AND abs(e.line - a.line) <= 5 AND (a.cat = e.cat OR {ALIASES})")
def match_tolerance(spark, sf_dir):
    return evaluate.match_candidates(*event_findings(spark, sf_dir))


@query(f"""WITH RECURSIVE {MATCHED}, c AS (SELECT e.fixture, a.event_id AS a_ord, list(e.event_id ORDER BY e.event_id) AS es FROM ev e JOIN ev a ON e.fixture = a.fixture
      WHERE e.event_id % 3 = 0 AND a.event_id % 3 <> 0 AND abs(e.line - a.line) <= 5 AND (a.cat = e.cat OR {ALIASES}) GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY a_ord) AS i FROM c),
    r AS (SELECT DISTINCT fixture, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken FROM n
      UNION ALL SELECT fixture, i, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END FROM (SELECT n.fixture, n.i, r.taken, list_filter(n.es, lambda e: NOT list_contains(r.taken, e)) AS free FROM r JOIN n ON n.fixture = r.fixture AND n.i = r.i + 1)),
    k AS (SELECT fixture, count(*) FILTER (event_id % 3 = 0) AS expected, count(*) FILTER (event_id % 3 <> 0) AS actual FROM ev GROUP BY 1), h AS (SELECT fixture, max(len(taken)) AS tp FROM r GROUP BY 1)
    SELECT fixture, expected, actual, coalesce(tp, 0) AS tp, actual - coalesce(tp, 0) AS fp, expected - coalesce(tp, 0) AS fn FROM k LEFT JOIN h USING (fixture)""")
def match_greedy(spark, sf_dir):
    """The one-to-one matching; the SQL walks the findings of a fixture one by one."""
    expected, actual = event_findings(spark, sf_dir)
    return evaluate.fixture_results(expected.select("fixture").union(actual.select("fixture")).distinct(), expected, actual)


DAILY = """d AS (SELECT CAST(ts AS DATE) AS day, avg(value) / 100 AS p, count(*) FILTER (value > 20) / count(*) AS r, count(DISTINCT user_id) / 200.0 AS n FROM events GROUP BY 1), rec AS (SELECT CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS ord, p, r, n FROM d)"""


def records(spark, sf_dir) -> DataFrame:
    """One evaluation record for each day of events."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.avg("value") / 100).alias("precision"), (F.count_if(F.col("value") > 20) / F.count("*")).alias("recall"), (F.count_distinct("user_id") / 200.0).alias("noise_rate"))
    return daily.withColumn("ord", F.row_number().over(Window.orderBy("day")).cast("long"))  # one row a day


@query(f"WITH {DAILY}, l AS (SELECT * FROM rec ORDER BY ord DESC LIMIT 5) SELECT count(*) AS records, round(max_by(p, ord) - min_by(p, ord), 6) AS precision_trend, round(max_by(r, ord) - min_by(r, ord), 6) AS recall_trend, round(max_by(n, ord) - min_by(n, ord), 6) AS noise_rate_trend FROM l")
def trend_last_n(spark, sf_dir):
    out = evaluate.trend(records(spark, sf_dir))
    return out.select("records", *(F.round(c, 6).alias(c) for c in out.columns if c != "records"))


@query(f"WITH {DAILY} SELECT ord, lag(p) OVER (ORDER BY ord) - p > 0.05 AS precision_drop, lag(r) OVER (ORDER BY ord) - r > 0.1 AS recall_drop, n - lag(n) OVER (ORDER BY ord) > 0.05 AS noise_rise FROM rec")
def regression_flags(spark, sf_dir):
    return evaluate.regressions(records(spark, sf_dir))


@query("""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS name, CAST(ts AS DATE) AS day, count(*) FILTER (event_id % 3 = 0) AS fp, count(*) FILTER (event_id % 5 = 0) AS fn FROM events GROUP BY 1, 2),
    s AS (SELECT name, count(*) AS runs, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM u GROUP BY 1 HAVING count(*) >= 3) SELECT name, runs, fp, fn, fp / runs > 0.6 AS fp_persistent, fn / runs > 0.6 AS fn_persistent FROM s WHERE fp / runs > 0.6 OR fn / runs > 0.6""")
def persistent_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("name"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_id") % 3 == 0).alias("fp"), F.count_if(F.col("event_id") % 5 == 0).alias("fn"))
    return evaluate.persistent_patterns(rows)


@query("""WITH c AS (SELECT user_id, event_type, min(event_id) AS ord, count(*) FILTER (event_id % 2 = 0) AS tp, count(*) FILTER (event_id % 7 = 0) AS fp FROM events GROUP BY 1, 2),
    k AS (SELECT user_id || event_type AS name, tp, fp, lag(tp) OVER w AS ptp, lag(fp) OVER w AS pfp FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_type))
    SELECT name, 'lost_detection' AS what FROM k WHERE ptp > 0 AND tp = 0 UNION ALL SELECT name, 'new_false_positive' FROM k WHERE pfp = 0 AND fp > 0""")
def fixture_regressions(spark, sf_dir):
    """A user's counts of one event type against those of the type before it."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("ord"), F.count_if(F.col("event_id") % 2 == 0).alias("tp"), F.count_if(F.col("event_id") % 7 == 0).alias("fp"))
    w = Window.partitionBy("user_id").orderBy("event_type")
    now = counts.select(F.concat(F.col("user_id").cast("string"), "event_type").alias("name"), "ord", "tp", "fp")
    before = counts.select(F.concat(F.col("user_id").cast("string"), F.lead("event_type").over(w)).alias("name"), "ord", "tp", "fp").where("name IS NOT NULL")
    return evaluate.fixture_regressions(now, before)


@query("""WITH RECURSIVE i AS (SELECT source AS grp, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ord, strlen(text) // 3 AS tokens FROM documents),
    f AS (SELECT grp, ord, tokens, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 20000 THEN 1 ELSE 0 END AS n, tokens <= 20000 AS kept, CASE WHEN tokens > 20000 THEN 'token_budget_exceeded' END AS reason FROM i WHERE ord = 1
      UNION ALL SELECT i.grp, i.ord, i.tokens, CASE WHEN f.n < 50 AND f.used + i.tokens <= 20000 THEN f.used + i.tokens ELSE f.used END, CASE WHEN f.n < 50 AND f.used + i.tokens <= 20000 THEN f.n + 1 ELSE f.n END, f.n < 50 AND f.used + i.tokens <= 20000,
      CASE WHEN f.n >= 50 THEN 'max_files_exceeded' WHEN f.used + i.tokens > 20000 THEN 'token_budget_exceeded' END FROM f JOIN i ON i.grp = f.grp AND i.ord = f.ord + 1)
    SELECT grp, ord, tokens, kept, reason FROM f""")
def budget_pack(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), rank.alias("ord"), text.estimate_tokens(F.col("text")).alias("tokens"))
    return budget.greedy_pack(items, 20_000, "grp").select("grp", "ord", "tokens", "kept", "reason")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
    c AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS used FROM l) SELECT doc_id, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM c WHERE used <= 900 OR line_no = 1 GROUP BY 1""")
def diff_truncate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return budget.truncate_to_budget(rows, 900, "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).cast("long").alias("bytes"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def carry_forward(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


@query("""WITH b AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch FROM documents) SELECT doc_id, source, batch, count(*) OVER (PARTITION BY source, batch) = 1 AS single FROM b""")
def batch_plan(spark, sf_dir):
    return summaries.batch_plan(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "batch", "single")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey LIMIT 500 OFFSET 1000")
def paged_scan(spark, sf_dir):
    """The third page of 500 rows; only the parts that hold it are read."""
    made = pages.write_pages(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"], shared.scratch(spark, "pages"))
    return made.page(2, 500)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, event_type AS name, 'of ' || user_id AS summary FROM events")
def batch_answers(spark, sf_dir):
    """Each event as a batch answer with prose around it and values that are no text."""
    rows = table(spark, sf_dir, "events")
    said = F.concat(F.lit('Here: {"'), F.col("event_type"), F.lit('": "of '), F.col("user_id").cast("string"), F.lit('", "n": 5, "none": null, "empty": " "} done }'))
    return rows.select("event_id", F.explode(jsonx.batch_summaries(said)).alias("name", "summary"))


#: Shapes of an answer: what stands around the list of findings, its quality and summary by the rules, with a finding and without.
LADDER = (
    ('so {"summary":"s","findings":[', "]} end", ("strict", "s"), ("strict", "s")),
    ('{"findings":[', "]}", ("strict", ""), ("strict", "")),
    ('{"summary":null,"findings":[', "]}", ("strict", ""), ("strict", "")),
    ('{"review":{"issues":[', "]}}", ("flexible", ""), ("array", "")),
    ('{"summary":"outer","review":{"summary":"inner","results":[', "]}}", ("flexible", "outer"), ("flexible", "outer")),
    ("[", "]", ("salvaged", ""), ("array", "")),  # the finding is the first object of the text, and no review
    ('{"findings": [', ', {"file": "cut', ("salvaged", ""), ("malformed", "")),
    ("nothing here", "", ("malformed", ""), ("malformed", "")),
)
LADDER_SQL, SUMMARY_SQL = (" ".join(f"WHEN turn % 8 = {i} AND conv_id % 2 = {1 - k} THEN '{rule[k][part]}'" for i, (_, _, *rule) in enumerate(LADDER) for k in (0, 1)) for part in (0, 1))


@query(f"""SELECT conv_id, turn, CASE {LADDER_SQL} END AS quality, CASE {SUMMARY_SQL} END AS summary, CASE WHEN turn % 8 < 7 AND conv_id % 2 = 1 THEN 1 ELSE 0 END AS n FROM conversations""")
def parse_ladder(spark, sf_dir):
    """Answers of eight shapes, with a finding and without, through the ladder of parsers."""
    finding = '{"file":"a","start_line":1,"end_line":null,"category":"logic","confidence":0.9,"evidence":"x","explanation":"y","impact":"z","suggestion":null}'
    said = F.lit(None).cast("string")
    for i, (head, tail, *_) in enumerate(LADDER):
        said = F.when(F.col("turn") % 8 == i, F.concat(F.lit(head), F.when((F.col("conv_id") % 2 == 1) & F.lit(i < 7), finding).otherwise(""), F.lit(tail))).otherwise(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", jsonx.parse_responses(said).alias("p")).select("conv_id", "turn", "p.quality", "p.summary", F.size("p.findings").alias("n"))


@query("""SELECT doc_id, CASE WHEN c >= 0.9 THEN 'error' WHEN c >= 0.7 THEN 'warning' ELSE 'note' END AS level, lang AS rule, source AS uri, 'because ' || doc_id AS message, CAST(doc_id % 90 + 1 AS INT) AS start_line, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 90 + 3 AS INT) END AS end_line,
    CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id END AS content_id, CASE WHEN doc_id % 2 = 0 THEN 'l' || doc_id END AS line_id, CASE WHEN doc_id % 4 = 0 THEN 'try ' || lang END AS suggestion, doc_id % 3 = 0 AS has_end, doc_id % 2 = 0 AS has_prints FROM (SELECT *, 0.5 + (doc_id % 6) * 0.1 AS c FROM documents)""")
def sarif_export(spark, sf_dir):
    """Every field of a SARIF result, read again from its JSON; what is null is left out there."""
    key = F.col("doc_id")
    named = lambda p: F.concat(F.lit(p), key.cast("string"))
    start = (key % 90 + 1).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.col("lang").alias("category"), start.alias("start_line"), F.when(key % 3 == 0, start + 2).alias("end_line"), (0.5 + key % 6 * 0.1).alias("confidence"), named("because ").alias("explanation"), F.when(key % 2 == 0, named("c")).alias("fp_id"), F.when(key % 2 == 0, named("l")).alias("line_id"), F.when(key % 4 == 0, F.concat(F.lit("try "), "lang")).alias("suggestion"))
    json = F.to_json(F.col("result"))
    shape = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>, fingerprints struct<contentId:string,lineId:string>, properties struct<suggestion:string>"
    out = report.sarif_results(rows).select("doc_id", json.alias("json"), F.from_json(json, shape).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return out.select("doc_id", "r.level", F.col("r.ruleId").alias("rule"), place["artifactLocation"]["uri"].alias("uri"), F.col("r.message.text").alias("message"), place["region"]["startLine"].alias("start_line"), place["region"]["endLine"].alias("end_line"), F.col("r.fingerprints.contentId").alias("content_id"), F.col("r.fingerprints.lineId").alias("line_id"), F.col("r.properties.suggestion").alias("suggestion"), F.col("json").contains("endLine").alias("has_end"), F.col("json").contains("fingerprints").alias("has_prints"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) SELECT event_type, v[least(CAST(ceil(n * 50 / 100.0) AS BIGINT) + 1, n)] AS p50, v[least(CAST(ceil(n * 95 / 100.0) AS BIGINT) + 1, n)] AS p95, v[least(CAST(ceil(n * 99 / 100.0) AS BIGINT) + 1, n)] AS p99 FROM s""")
def percentiles(spark, sf_dir):
    return evaluate.percentile_index(table(spark, sf_dir, "events"), "value", (50, 95, 99), "event_type")


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderpriority END AS hash FROM orders""")
def upsert_changed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("hash"), "o_orderstatus")
    return store.merge(rows.select("path", "hash"), rows.where("o_orderstatus = 'O'").select("path", F.lit("new").alias("hash")), "path")


@query("SELECT o_orderkey AS path, o_orderpriority AS hash FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW'")
def changed_files(spark, sf_dir):
    """Orders whose stored hash is missing (not F) or another (all F are stored as 5-LOW)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("hash"), "o_orderstatus")
    return store.changed_files(rows.where("o_orderstatus = 'F'").select("path", F.lit("5-LOW").alias("hash")), rows.select("path", "hash")).select("path", "hash")


@query("""SELECT 'parent' AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'child', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 10 = 0)""")
def cascade_delete(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    gone = orders.where("o_custkey % 10 = 0").select("o_custkey").distinct()
    left, children = store.cascade_delete(orders, items, gone, "o_orderkey", "l_orderkey")
    sides = [d.agg(F.count("*").alias("n"), F.sum(k).alias("keys")).select(F.lit(s).alias("side"), "n", "keys") for s, d, k in (("parent", left, "o_orderkey"), ("child", children, "l_orderkey"))]
    return sides[0].unionByName(sides[1])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def last_writer(spark, sf_dir):
    return store.last_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_orderkey", "o_custkey")


@query("""WITH i AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '\\n', '+', 'g'), '[^\\p{L}\\p{N}_]+'), lambda w: strlen(w) > 2 AND regexp_matches(w, '^\\p{L}')))) AS ids FROM documents) SELECT doc_id, CAST(len(ids) AS INT) AS n, sha256(array_to_string(ids, ',')) AS digest FROM i""")
def diff_identifiers(spark, sf_dir):
    """Each document as a diff that adds all its lines."""
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+"), F.regexp_replace("text", "\n", "\n+"))
    return table(spark, sf_dir, "documents").select("doc_id", text.diff_identifiers(diff).alias("ids")).select("doc_id", F.size("ids").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))


@query("SELECT p_partkey, p_name || '.py' AS path FROM part")
def changed_paths(spark, sf_dir):
    diff = F.concat(F.lit("--- a/x\n+++ b/"), F.col("p_name"), F.lit(".py\n@@ -1 +1 @@\n-a\n+b\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-c"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.changed_paths(diff)).alias("path"))


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents) SELECT doc_id, CASE WHEN len(ls) >= 2 AND length(array_to_string(ls, '')) > 0 THEN array_to_string(ls[2:4], chr(10)) END AS body FROM l""")
def symbol_body(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("body"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/yarn.lock' WHEN 1 THEN 'src/' || p_partkey || '.min.js' WHEN 2 THEN 'go.sum' ELSE 'src/' || p_partkey || '.rs' END AS path FROM part) SELECT p_partkey, p_partkey % 4 < 3 AS skipped, CASE WHEN p_partkey % 4 = 3 THEN 'rust' END AS language FROM n""")
def path_predicates(spark, sf_dir):
    key = F.col("p_partkey")
    path = F.when(key % 4 == 0, "a/yarn.lock").when(key % 4 == 1, F.concat(F.lit("src/"), key.cast("string"), F.lit(".min.js"))).when(key % 4 == 2, "go.sum").otherwise(F.concat(F.lit("src/"), key.cast("string"), F.lit(".rs")))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_non_reviewable(path).alias("skipped"), text.language_of(path).alias("language"))


@query("""SELECT p_partkey AS ord, round(CASE WHEN p_size > 45 THEN 0.7 WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.6 END, 6) AS confidence FROM part""")
def verify_findings(spark, sf_dir):
    """Evidence of even sizes quotes the file's brand, of odd ones what no file holds; sizes over 45 name no file."""
    parts = table(spark, sf_dir, "part")
    evidence_ = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("calls `"), F.col("p_brand"), F.lit("` here"))).otherwise("calls `absent_name()` here")
    file = F.when(F.col("p_size") > 45, "missing").otherwise(F.col("p_brand"))
    rows = parts.select(F.col("p_partkey").alias("ord"), file.alias("file"), evidence_.alias("evidence"), F.lit(0.9).alias("confidence"))
    contents = parts.groupBy(F.col("p_brand").alias("path")).agg(F.concat(F.first("p_brand"), F.lit(" and more")).alias("content"))
    return findings.verify(rows, contents).select("ord", F.round("confidence", 6).alias("confidence"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'inconclusive' WHEN role = 'assistant' THEN 'findings' WHEN role = 'system' THEN 'limited_clean' ELSE 'clean' END AS outcome FROM conversations""")
def review_outcome(spark, sf_dir):
    reason = findings.empty_review_reason(F.col("turn") % 5 != 0, F.lit("two issues found"), F.lit("strict"), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", findings.outcome(reason, F.col("role") == "assistant", F.col("role") == "system").alias("outcome"))


@query("""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM t),
    s AS (SELECT doc_id, string_agg(lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || line, chr(10) ORDER BY i) AS shown FROM l GROUP BY 1) SELECT doc_id, sha256(coalesce(shown, '')) AS shown FROM documents LEFT JOIN s USING (doc_id)""")
def numbered_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(report.numbered_lines(F.col("text")), 256).alias("shown"))


#: A code base in which file i is part i, has document i as its text and vector i as that of its summary; every 50th file changed.
FILES_SQL = f"""files AS (SELECT p_partkey AS id, 'src/p' || p_partkey AS path FROM part), changed AS (SELECT id FROM files WHERE id % {EVERY} = 0),
    edges AS (SELECT l_suppkey AS file_id, p_partkey AS target_id FROM lineitem JOIN part ON p_partkey = l_partkey)"""
STRUCTURAL_SQL = """SELECT * FROM (SELECT target_id AS file_id, 'structural' AS method, 'direct_import' AS reason, CAST(1 AS DOUBLE) AS value FROM edges WHERE file_id IN (FROM changed)
    UNION ALL SELECT file_id, 'structural', 'reverse_import', 0.8 FROM (SELECT DISTINCT target_id, file_id FROM edges) WHERE target_id IN (FROM changed)
    UNION ALL SELECT other, 'structural', 'cochange', correlation FROM (SELECT file_a AS file, file_b AS other, correlation FROM pairs UNION ALL SELECT file_b, file_a, correlation FROM pairs) WHERE file IN (FROM changed)) WHERE file_id NOT IN (FROM changed)"""
SEMANTIC_SQL = """SELECT id AS file_id, 'semantic' AS method, CAST(NULL AS VARCHAR) AS reason, greatest(1 - distance / 2, 0) AS value FROM hits JOIN embeddings ON vec_id = id WHERE label <> 9 AND id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)"""
CODE_SQL = """SELECT file_id, 'code_semantic' AS method, CAST(NULL AS VARCHAR) AS reason, 1 - min(distance) / 2 AS value FROM (SELECT query_id, id // 3 AS file_id, distance FROM hits) WHERE file_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) GROUP BY query_id, file_id HAVING min(distance) < 2"""
KEYWORD_SQL = """SELECT doc_id AS file_id, 'keyword' AS method, CASE WHEN doc_id % 3 = 0 THEN 'references' ELSE 'defines' END AS reason, CAST(1 AS DOUBLE) AS value FROM k WHERE doc_id NOT IN (FROM changed)"""


def code_base(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables of retrieval.retrieve()."""
    imports, files = part_imports(spark, sf_dir)
    src = lambda c: F.concat(F.lit("src/p"), F.col(c))
    files = files.withColumn("path", src("path"))
    tokens, names = doc_tokens(spark, sf_dir)
    _, base = vectors(spark, sf_dir)
    half = base.select("id", "label", F.transform("embedding", lambda x: x.cast("double") * 0.5).alias("embedding"))
    asked = half.where(F.col("id") % EVERY == 0).select("id", "embedding")
    return {
        "files": files,
        "changed": files.where(F.col("id") % EVERY == 0),
        "imports": imports.withColumn("source_path", src("source_path")),
        "pairs": part_pairs(spark, sf_dir),
        "symbols": tokens.where("file_id % 3 <> 0"),
        "refs": tokens.where("file_id % 3 = 0").withColumnRenamed("name", "symbol_name"),
        "names": names,
        "most_names": most_names(spark, sf_dir),
        "summaries": half.select("id", F.when(F.col("label") != 9, F.col("id")).alias("file_id"), "embedding"),
        "chunks": half.select("id", F.floor(F.col("id") / 3).alias("file_id"), "embedding"),
        "vectors": asked.withColumn("kind", F.lit("summary")).unionByName(asked.withColumn("kind", F.lit("code"))),
    }


@query(f"WITH {COCHANGE}, {FILES_SQL}, e AS ({STRUCTURAL_SQL}) SELECT file_id, reason, count(*) AS entries, round(sum(value), 6) AS value FROM e GROUP BY 1, 2")
def retrieve_structural(spark, sf_dir):
    t = code_base(spark, sf_dir)
    found = retrieval.structural(t["changed"], t["files"], t["imports"], t["pairs"], 0.1)
    return found.groupBy("file_id", "reason").agg(F.count("*").alias("entries"), F.round(F.sum("value"), 6).alias("value"))


@query(f"WITH {hits_sql(20)}, e AS ({SEMANTIC_SQL}) SELECT file_id, method, round(value, 6) AS value FROM e")
def retrieve_semantic(spark, sf_dir):
    t = code_base(spark, sf_dir)
    return retrieval.semantic(t["vectors"].where("kind = 'summary'"), t["summaries"]).select("file_id", "method", F.round("value", 6).alias("value"))


@query(f"WITH {hits_sql(20)}, e AS ({CODE_SQL}) SELECT file_id, method, round(value, 6) AS value FROM e")
def retrieve_code(spark, sf_dir):
    t = code_base(spark, sf_dir)
    return retrieval.code_semantic(t["vectors"].where("kind = 'code'"), t["chunks"]).select("file_id", "method", F.round("value", 6).alias("value"))


@query(f"WITH {KEYWORDS}, {FILES_SQL}, e AS ({KEYWORD_SQL}) SELECT file_id, reason, count(*) AS entries FROM e GROUP BY 1, 2")
def retrieve_keyword(spark, sf_dir):
    t = code_base(spark, sf_dir)
    return retrieval.keyword(t["changed"], t["symbols"], t["refs"], t["names"], t["most_names"]).groupBy("file_id", "reason").agg(F.count("*").alias("entries"))


@query(f"""WITH {COCHANGE}, {KEYWORDS}, {hits_sql(20)}, {FILES_SQL}, e AS ({STRUCTURAL_SQL} UNION ALL {SEMANTIC_SQL} UNION ALL {CODE_SQL} UNION ALL {KEYWORD_SQL})
    SELECT file_id, path, round(sum(CASE method WHEN 'structural' THEN value WHEN 'semantic' THEN 0.7 * value WHEN 'code_semantic' THEN 0.4 * value ELSE 0.3 * value / 3 END), 6) AS score, count(*) AS entries FROM e JOIN files ON id = file_id GROUP BY 1, 2""")
def retrieve_ranked(spark, sf_dir):
    """All four kinds of evidence, fused and ranked."""
    t = code_base(spark, sf_dir)
    return retrieval.retrieve(**t, min_correlation=0.1).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, 'src/' || source AS path, len(string_split(text, chr(10))) + 1 AS hunks FROM documents UNION ALL SELECT doc_id, 'q', CAST(1 AS BIGINT) FROM documents""")
def hunk_counts(spark, sf_dir):
    """Each document as a diff in which every line is a hunk. The hunk of a deleted file counts for the file before it."""
    added = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("@@ -1 +1 @@\n+"), line)), "\n")
    diff = F.concat(F.lit("@@ before any file @@\n--- a/x\n+++ b/src/"), "source", F.lit("\n"), added, F.lit("\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-y\n+++ q\n@@\n"))
    return budget.hunk_counts(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", diff.alias("diff")), "doc_id")


BODIES = ("", "rate limit docs", "Upstream Request Timeout", "operation timed out", "capacity", "Server overloaded!", "provider capacity")


@query(f"""WITH f AS (SELECT conv_id, turn, ([429, 503, 500, 408, 501])[1 + CAST((conv_id + turn) % 5 AS INT)] AS status, lower(text || ({list_sql(BODIES)})[1 + CAST(conv_id % 7 AS INT)]) AS body FROM conversations)
    SELECT conv_id, turn, CASE WHEN status = 429 THEN 'rate_limited' WHEN status IN (408, 502, 503, 504) OR {contains_sql('body', fixed.PRESSURE_PHRASES)} THEN 'provider_pressure' ELSE 'server_error' END AS kind FROM f""")
def failure_kinds(spark, sf_dir):
    """Turns as the bodies of failed answers; six of seven end with a phrase that may tell pressure."""
    nth = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (n % len(v) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.failure_kind(nth((429, 503, 500, 408, 501), F.col("conv_id") + F.col("turn")), F.concat("text", nth(BODIES, F.col("conv_id")))).alias("kind"))


@query("""WITH b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord, 6 + user_id % 5 AS size, CASE WHEN user_id % 4 = 0 THEN event_id % 2 ELSE event_id * 7 % (4 + user_id % 7) END AS errors FROM events),
    e AS (SELECT user_id, ord, size, least(errors, size) AS errors, ord * (10 + user_id % 60) AS elapsed FROM b),
    t AS (SELECT *, sum(errors) OVER w AS total, coalesce(last_value(CASE WHEN errors * 2 < size OR errors = 0 THEN ord END IGNORE NULLS) OVER w, 0) AS calm FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT *, CASE WHEN total > 0 AND elapsed >= 600 THEN 'time_budget' WHEN errors = 0 THEN NULL WHEN errors = size THEN 'full_batch' WHEN ord - calm >= 2 THEN 'repeated_partial_batches' WHEN total >= 10 THEN 'total_errors' END AS why FROM t),
    f AS (SELECT user_id, min(ord) AS ended FROM r WHERE why IS NOT NULL GROUP BY 1) SELECT r.user_id, ord, CASE WHEN ord = ended THEN why WHEN ord > ended THEN 'over' END AS stop FROM r LEFT JOIN f USING (user_id)""")
def pressure_replay(spark, sf_dir):
    """A user's events as batches of one summarising run."""
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    errors = F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 2).otherwise(F.col("event_id") * 7 % (4 + F.col("user_id") % 7))
    rows = table(spark, sf_dir, "events").select("user_id", ord_.alias("ord"), (6 + F.col("user_id") % 5).alias("size"), errors.alias("errors"))
    rows = rows.withColumn("errors", F.least("errors", "size")).withColumn("elapsed", F.col("ord") * (10 + F.col("user_id") % 60))
    return budget.pressure_replay(rows, "user_id").select("user_id", "ord", "stop")


TIERS = f"CASE WHEN forced THEN {len(fixed.EXCLUDED_TEXT.encode()) // 3} WHEN whole <= room THEN whole WHEN brief IS NOT NULL AND brief <= room THEN brief ELSE {len(fixed.DIFF_ONLY_TEXT.encode()) // 3} END"


@query(f"""WITH RECURSIVE i AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 5 DESC, doc_id) AS n, doc_id % 11 = 0 OR strlen(text) > 50000 AS forced, CASE WHEN doc_id % 2 = 0 THEN strlen(left(text, 90)) // 3 END AS brief,
      strlen(text) // 3 + coalesce(CASE WHEN doc_id % 2 = 0 THEN strlen(left(text, 90)) // 3 END, 0) AS whole FROM documents),
    f AS (SELECT i.*, CAST(6000 AS BIGINT) AS room FROM i WHERE n = 1 UNION ALL SELECT i.*, greatest(f.room - {TIERS.replace('forced', 'f.forced').replace('whole', 'f.whole').replace('brief', 'f.brief').replace('room', 'f.room')}, 0) FROM f JOIN i ON i.source = f.source AND i.n = f.n + 1)
    SELECT source, doc_id, CASE WHEN forced THEN 'diff_only' WHEN whole <= room THEN 'full' WHEN brief IS NOT NULL AND brief <= room THEN 'summary_only' ELSE 'diff_only' END AS tier, CAST({TIERS} AS BIGINT) AS cost,
      CASE WHEN forced OR whole <= room THEN NULL WHEN brief IS NOT NULL AND brief <= room THEN 'content_degraded_to_summary' ELSE 'content_degraded_to_diff_only' END AS omission FROM f""")
def context_tiers(spark, sf_dir):
    """A source is a change of which its documents are the changed files, the even ones with a summary."""
    key = F.col("doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(key % 5), "doc_id"))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(key % 11 == 0, "go.sum").otherwise("a.rs").alias("path"), F.col("text").alias("content"), F.when(key % 2 == 0, F.substring("text", 1, 90)).alias("summary"), rank.alias("rank"))
    return budget.context_tiers(rows, 6000, "source").select("source", "doc_id", "tier", "cost", "omission")


@query("""SELECT doc_id, CASE WHEN strlen(text) > 50 THEN left(text, CAST((SELECT min(n) FROM range(1, 52) r(n) WHERE strlen(left(text, CAST(n AS INT))) > 50) AS INT)) ELSE text END AS cut FROM documents""")
def cut_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_bytes(F.col("text"), 50).alias("cut"))


def order_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as files and their lines as symbols."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("path"), "o_custkey")
    symbols = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("start_line"), F.col("l_partkey").cast("string").alias("name"))
    return files, symbols


@query("""SELECT l_orderkey AS file_id, 'o' || l_orderkey AS path, l_returnflag AS kind, l_linenumber AS start_line, CAST(l_partkey AS VARCHAR) AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 20 = 0""")
def symbols_in_files(spark, sf_dir):
    files, symbols = order_graph(spark, sf_dir)
    return store.symbols_in_files(symbols, files, files.where("o_custkey % 20 = 0")).select("file_id", "path", "kind", "start_line", "name")


@query("""WITH s AS (SELECT DISTINCT l_partkey * 100000 + l_suppkey AS id, l_orderkey AS file_id, CAST(l_partkey AS VARCHAR) AS name, l_linenumber AS line FROM lineitem WHERE l_orderkey % 30 = 0)
    SELECT ps.id, file_id, name, 'symbol' AS level, p_name AS summary FROM s JOIN (SELECT p_partkey * 100000 + s_suppkey AS id, p_name FROM part, supplier WHERE s_suppkey % 10 = 0) ps ON ps.id = s.id""")
def symbol_summaries(spark, sf_dir):
    files, symbols = order_graph(spark, sf_dir)
    held = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 = 0").select("l_partkey", "l_suppkey").distinct().join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    summaries_ = held.select((F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("symbol_id"), F.lit("symbol").alias("level"), F.col("p_name").alias("summary"))
    return store.symbol_summaries(summaries_, symbols.distinct(), files.where("id % 30 = 0").select(F.col("id").alias("file_id")))


@query("SELECT 'o' || o_orderkey AS path, o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def file_ids(spark, sf_dir):
    files, _ = order_graph(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("path"))
    return store.file_ids(files, wanted)


@query(f"WITH {chunks_sql(5, 3)}, h AS (SELECT doc_id, start_line, sha256(content) AS content_hash FROM c) SELECT content_hash, doc_id * 1000 + start_line AS id FROM h WHERE content_hash IN (SELECT content_hash FROM h WHERE doc_id % 10 = 0)")
def chunks_by_hash(spark, sf_dir):
    held = chunks.line_chunks(doc_files(spark, sf_dir), 5, 2).select("doc_id", "content_hash", (F.col("doc_id") * 1000 + F.col("start_line")).alias("id"))
    return store.chunks_by_hash(held, held.where("doc_id % 10 = 0"))


@query("""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, doc_id % 3 AS k FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' ELSE 'java' END AS language, CASE k WHEN 0 THEN 2 ELSE 1 END AS imports, n + CASE k WHEN 2 THEN 1 ELSE 0 END AS symbols, n AS calls, 0 AS errors, CAST(n + CASE k WHEN 0 THEN 1 ELSE 2 END AS INT) AS last_line FROM l""")
def code_extraction(spark, sf_dir):
    """Each document as a source file of one of three languages: a line is a comment, then a text, of a function of its own, and has a brace."""
    k, lines = F.col("doc_id") % 3, F.split(F.regexp_replace("text", "[\\\\\"*/`$'\\r]", " "), "\n")
    each = lambda head, mid, tail: F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit(head), x, F.lit(mid), i.cast("string"), F.lit(tail), x, F.lit(' {"); }'))), "\n")
    rust = F.concat(F.lit("use a::{b::{C, D}, e};\n"), each("/* /* ", " { */ */ pub fn f", '(a: &str) { helper("'))
    typescript = F.concat(F.lit("import { C } from './c';\nconst t = `{ ${'}'}`;\n"), each("/* ", " { */ export function f", '(a: { b: string }): { c: string } { helper("'))
    java = F.concat(F.lit("import a.b.C;\nclass D {\n"), each("/* ", " { */ int f", '(int a) { helper("'), F.lit("}"))
    language = F.when(k == 0, "rust").when(k == 1, "typescript").otherwise("java")
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), language.alias("language"), F.when(k == 0, rust).when(k == 1, typescript).otherwise(java).cast("binary").alias("content"))
    rows = extract.extract(files).groupBy(F.col("path").cast("long").alias("doc_id"), "language")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.agg(count("import").cast("int").alias("imports"), count("symbol").alias("symbols"), count("reference").alias("calls"), count("error").cast("int").alias("errors"), F.max("end_line").alias("last_line"))


@query("SELECT md5(CAST(l_orderkey AS VARCHAR)) || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS commit, l_orderkey * 100 + l_linenumber AS pos, 'part/' || l_partkey || '.rs' AS file FROM lineitem")
def commit_log(spark, sf_dir):
    """A log in which each order is a commit of its parts; every tenth line is blank."""
    items = table(spark, sf_dir, "lineitem")
    key = F.md5(F.col("l_orderkey").cast("string").cast("binary"))
    heads = items.select((F.col("l_orderkey") * 100).alias("line_no"), F.concat(key, F.substring(key, 1, 8)).alias("line")).distinct()
    lines = items.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".rs")).alias("line"))
    blanks = heads.select(F.col("line_no") + 9, F.lit("  "))
    return files.commit_files(heads.union(lines).union(blanks))


@query(f"""WITH old AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '' ELSE '!' END AS text FROM documents), new AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 5), {chunks_sql(50, 40, "new")}, {chunks_sql(50, 40, "old", "o")},
    b AS (SELECT doc_id, count(*) AS n, list_sort(list(sha256(content))) AS h FROM c GROUP BY 1), bo AS (SELECT doc_id, list_sort(list(sha256(content))) AS h FROM co GROUP BY 1), j AS (SELECT b.doc_id, b.n, coalesce(b.h = bo.h, false) AS same FROM b LEFT JOIN bo USING (doc_id))
    SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS no_language, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 = 5) AS outside_root, (SELECT count(*) FROM new WHERE text IS NULL) AS no_text, CAST(0 AS BIGINT) AS too_large, (SELECT count(*) FROM new WHERE text = '') AS empty,
    count(*) FILTER (same) AS unchanged, count(*) FILTER (NOT same) AS chunked, CAST(coalesce(sum(n) FILTER (NOT same), 0) AS BIGINT) AS chunks FROM j""")
def chunk_scan(spark, sf_dir):
    """Documents as files, some without a language or text; two of three had other text when their chunks were stored."""
    docs = table(spark, sf_dir, "documents")
    stored = chunks.line_chunks(docs.select(F.col("doc_id").alias("file_id"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise("!")).alias("content")))
    now = docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("language"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).alias("content"), F.concat(F.when(F.col("doc_id") % 13 == 5, "a/../../").otherwise("a/./b/../"), F.col("doc_id").cast("string")).alias("path"))
    return chunks.scan(now, stored)[1]


@query("""WITH c AS (SELECT (length(text) / 4 * 3.0 + length(role) / 4 * 15.0) / 1e6 AS cost FROM conversations), m AS (SELECT count(*) AS calls, avg(cost) AS per_unit FROM c)
    SELECT units, calls, round(units * per_unit, 6) AS cost FROM m, (SELECT unnest([1000, 5000, 10000])::BIGINT AS units)""")
def cost_extrapolation(spark, sf_dir):
    """Turns as prompts and their roles as answers, priced and carried on to more calls."""
    calls = table(spark, sf_dir, "conversations").select(F.col("text").alias("prompt"), F.col("role").alias("response"))
    return summaries.extrapolate(summaries.cost(calls, 3.0, 15.0), (1000, 5000, 10_000)).select("units", "calls", F.round("cost", 6).alias("cost"))


def claims_sql(column: str) -> str:
    return f"(NOT {contains_sql(column, fixed.NO_CLAIM_PHRASES)} AND {contains_sql(column, fixed.CLAIM_PHRASES)})"


@query(f"""WITH p AS (SELECT conv_id, turn, lower(text) AS t, ' ' || ({list_sql(fixed.CLAIM_PHRASES)})[1 + CAST((conv_id + turn) % {len(fixed.CLAIM_PHRASES)} AS INT)] AS c FROM conversations),
    s AS (SELECT conv_id, turn, trim(regexp_replace(t || CASE WHEN conv_id % 4 = 0 THEN c ELSE '' END, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(t || CASE WHEN turn % 3 = 1 THEN c ELSE '' END, '\\s+', ' ', 'g')) AS b FROM p)
    SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN NULL WHEN {claims_sql("a")} THEN 'summary_claims_findings' WHEN conv_id % 5 IN (1, 2) THEN 'repair_did_not_produce_structured_review'
      WHEN turn % 2 = 1 AND {claims_sql("b")} THEN 'malformed_response_contains_finding_language' END AS reason FROM s""")
def review_reason(spark, sf_dir):
    """Turns as summaries and answers of reviews, some with a phrase that claims findings, through all rules of an empty review."""
    key, turn = F.col("conv_id"), F.col("turn")
    phrase = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, fixed.CLAIM_PHRASES)), ((key + turn) % len(fixed.CLAIM_PHRASES) + 1).cast("int")))
    said = lambda when: F.concat("text", F.when(when, phrase).otherwise(""))
    repaired = F.when(key % 5 == 1, "malformed").when(key % 5 == 2, "salvaged").when(key % 5 == 3, "strict").when(key % 5 == 4, "flexible")
    reason = findings.empty_review_reason(turn % 7 == 6, said(key % 4 == 0), F.when(turn % 2 == 1, "malformed").otherwise("strict"), said(turn % 3 == 1), F.lit(None).cast("string"), repaired, F.lit(None).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))
