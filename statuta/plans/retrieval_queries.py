"""Queries of hybrid retrieval: BM25, vectors, fusion, re-ranking, search over all categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.common import small, stash
from statuta.functions import text
from statuta.operators import retrieval
from statuta.plans import views as V
from statuta.registry import query

SEES = "c.category = q.category AND (c.entity_type = 'both' OR c.entity_type = q.entity_type) AND (c.province_scope = 'national' OR coalesce(c.province_scope = q.province, FALSE))"
TOKENS = "list_concat(w, list_filter(list_transform(w, lambda t: strip_accents(t)), lambda t: t <> '' AND NOT list_contains(w, t)))"


def tokens_sql(name: str, rel: str, key: str, column: str) -> str:
    return f"{name}_w AS (SELECT {key}, list_filter(string_split_regex(lower({column}), '\\s+'), lambda t: t <> '') AS w FROM {rel}), {name} AS MATERIALIZED (SELECT {key}, {TOKENS} AS tokens FROM {name}_w)"


# q: query_id, category, query_text, entity_type, province.
BM25_SQL = f"""
    {tokens_sql("ct", "chunks", "chunk_id", "text")}, {tokens_sql("qt", "q", "query_id", "query_text")},
    seen_pairs AS MATERIALIZED (SELECT q.query_id, c.chunk_id FROM q JOIN chunks c ON {SEES}),
    key AS (SELECT query_id, row_number() OVER (PARTITION BY category, entity_type, province ORDER BY query_id) = 1 AS first, min(query_id) OVER (PARTITION BY category, entity_type, province) AS k FROM q),
    kc AS MATERIALIZED (SELECT k, chunk_id FROM seen_pairs JOIN key USING (query_id) WHERE first),
    seen AS MATERIALIZED (SELECT k, count(*) AS n, sum(len(tokens)) / count(*) AS avgdl FROM kc JOIN ct USING (chunk_id) GROUP BY k),
    tf AS MATERIALIZED (SELECT chunk_id, token, dl, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM ct) GROUP BY 1, 2, 3),
    df AS MATERIALIZED (SELECT k, token, count(*) AS df FROM kc JOIN tf USING (chunk_id) GROUP BY 1, 2),
    raw AS MATERIALIZED (SELECT k, token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN seen USING (k)),
    fl AS (SELECT k, 0.25 * avg(raw) AS floor FROM raw GROUP BY k),
    idf AS MATERIALIZED (SELECT k, token, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM raw JOIN fl USING (k)),
    qw AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(tokens) AS token FROM qt) GROUP BY 1, 2),
    sc AS MATERIALIZED (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
        FROM qw JOIN key USING (query_id) JOIN idf USING (k, token) JOIN seen USING (k) JOIN tf USING (token) JOIN seen_pairs USING (query_id, chunk_id) GROUP BY 1, 2),
    bm AS MATERIALIZED (SELECT query_id, chunk_id, round(coalesce(s, 0), 9) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, chunk_id) AS rank FROM seen_pairs LEFT JOIN sc USING (query_id, chunk_id))"""


def vector_sql(rel: str, key: str, column: str, name: str) -> str:
    return f"""{name}_b AS (SELECT {key}, CAST('0x' || right(md5(t), 2) AS INT) AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({column}), '[\\pL\\pN_]+')) AS t FROM {rel}) GROUP BY 1, 2),
    {name} AS MATERIALIZED (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}_b)"""


VECTOR_SQL = f"""
    {vector_sql("chunks", "chunk_id", "text", "cv")}, {vector_sql("q", "query_id", "query_text", "qv")},
    dot AS MATERIALIZED (SELECT query_id, chunk_id, sum(a.w * b.w) AS s FROM (SELECT cv.*, category FROM cv JOIN chunks USING (chunk_id)) a JOIN (SELECT qv.*, category FROM qv JOIN q USING (query_id)) b USING (bucket, category) GROUP BY 1, 2),
    near AS MATERIALIZED (SELECT q.query_id, c.chunk_id, {SEES.replace("c.category = q.category AND ", "")} AS sees, round(coalesce(s, 0), 9) AS similarity,
        row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(s, 0), 9) DESC, c.chunk_id) AS rank FROM q JOIN chunks c USING (category) LEFT JOIN dot ON dot.query_id = q.query_id AND dot.chunk_id = c.chunk_id)"""

FUSED_SQL = """
    fused AS (SELECT query_id, chunk_id, b.rank AS br, v.rank AS vr, coalesce(b.bm25, 0) AS bm25, round(coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + v.rank), 0), 12) AS fused
        FROM (SELECT * FROM bm WHERE rank <= 5) b FULL JOIN v USING (query_id, chunk_id))"""
Q_SQL = "q AS (SELECT * FROM questions)"


@query("a1_bm25", f"WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {Q_SQL}, {BM25_SQL} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank FROM bm WHERE rank <= 5")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each question among what it may see."""
    return retrieval.bm25_top(V.questions(spark, sf_dir), V.chunks(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))


@query("w3_vector_pool", f"WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {Q_SQL}, {VECTOR_SQL} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM near WHERE rank <= 100")
def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred nearest chunks of each question's category."""
    return retrieval.vector_top(V.questions(spark, sf_dir), V.chunks(spark, sf_dir), 100).withColumn("similarity", F.round("similarity", 6))


@query(
    "z2_hybrid_retrieval",
    f"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {Q_SQL}, {BM25_SQL}, {VECTOR_SQL},
    v AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM near WHERE rank <= 5 AND sees), {FUSED_SQL}
    SELECT query_id, chunk_id, round(fused, 9) AS fused, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, br NULLS LAST, vr NULLS LAST) AS INT) AS rank FROM fused""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors fused by rank; the flagship."""
    out = retrieval.retrieve_full(V.questions(spark, sf_dir), V.chunks(spark, sf_dir))
    return out.withColumn("fused", F.round("fused", 9)).withColumn("bm25", F.round("bm25", 6))


# In the pruned form each question's pool is the corpus.
POOL_BM25_SQL = f"""
    {tokens_sql("ct", "chunks", "chunk_id", "text")}, {tokens_sql("qt", "q", "query_id", "query_text")},
    v AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM near WHERE rank <= 100 AND sees),
    seen AS MATERIALIZED (SELECT query_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM v JOIN ct USING (chunk_id) GROUP BY 1),
    once AS (SELECT DISTINCT chunk_id FROM v), ctf AS MATERIALIZED (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS token FROM once JOIN ct USING (chunk_id)) GROUP BY 1, 2),
    size AS MATERIALIZED (SELECT chunk_id, len(tokens) AS dl FROM once JOIN ct USING (chunk_id)),
    raw AS MATERIALIZED (SELECT query_id, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM v JOIN ctf USING (chunk_id) JOIN seen USING (query_id) GROUP BY 1, 2),
    fl AS (SELECT query_id, 0.25 * avg(raw) AS floor FROM raw GROUP BY 1),
    qw AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(tokens) AS token FROM qt) GROUP BY 1, 2),
    sc AS MATERIALIZED (SELECT query_id, chunk_id, sum(times * CASE WHEN raw < 0 THEN floor ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
        FROM qw JOIN raw USING (query_id, token) JOIN fl USING (query_id) JOIN seen USING (query_id) JOIN v USING (query_id) JOIN ctf USING (chunk_id, token) JOIN size USING (chunk_id) GROUP BY 1, 2),
    bm AS MATERIALIZED (SELECT query_id, chunk_id, round(coalesce(s, 0), 9) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, v.rank) AS rank FROM v LEFT JOIN sc USING (query_id, chunk_id))"""


@query(
    "z3_hybrid_pruned",
    f"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {Q_SQL}, {VECTOR_SQL}, {POOL_BM25_SQL}, {FUSED_SQL}
    SELECT query_id, chunk_id, round(fused, 9) AS fused, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, br NULLS LAST, vr NULLS LAST) AS INT) AS rank FROM fused""",
)
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of a hundred by vector, re-ranked by words; all of it is fused."""
    out = retrieval.retrieve_pruned(V.questions(spark, sf_dir), V.chunks(spark, sf_dir))
    return out.withColumn("fused", F.round("fused", 9)).withColumn("bm25", F.round("bm25", 6))


SEARCH_SQL = f"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, q AS (SELECT query_id * 10 + k AS query_id, query_id AS asked, ['tax', 'contracts_signing', 'labor_insurance'][k] AS category, query_text, entity_type, province
        FROM questions, (SELECT unnest([1, 2, 3]) AS k)), {BM25_SQL}, {VECTOR_SQL},
    v AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM near WHERE rank <= 5 AND sees), {FUSED_SQL},
    two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, br NULLS LAST, vr NULLS LAST) AS rank FROM fused),
    best AS (SELECT q.asked, q.category, chunk_id, fused, bm25, row_number() OVER (PARTITION BY asked ORDER BY fused DESC, bm25 DESC, two.query_id, rank) AS best FROM two JOIN q USING (query_id) WHERE rank <= 2)
    SELECT asked AS query_id, category, chunk_id, round(fused, 9) AS fused, round(bm25, 6) AS bm25, CAST(best AS INT) AS rank FROM best WHERE best <= 5"""


@query("z4_search_all_categories", SEARCH_SQL)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question over every category, the best two of each, of those the best five."""
    asked = V.questions(spark, sf_dir).drop("category")
    return retrieval.search_all_categories(asked, V.chunks(spark, sf_dir)).withColumn("fused", F.round("fused", 9)).withColumn("bm25", F.round("bm25", 6))


@query(
    "x9_dense_similarity",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
    s AS (SELECT a.vec_id AS query_id, 'v' || lpad(CAST(b.vec_id AS VARCHAR), 12, '0') AS neighbour, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, neighbour, round(least(1, greatest(0, s)), 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour) AS rank FROM s) WHERE rank <= 10""",
)
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stored vectors, the ten nearest rows of every fiftieth, among all rows."""
    norm = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    own = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    own = stash(own.select("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("chunk_id"), F.lit(None).cast("string").alias("category"), norm(F.col("e")).alias("vector")), "unit-vectors")
    asked = own.where(F.col("vec_id") % 50 == 0).withColumn("query_id", F.col("vec_id"))
    near = retrieval.nearest_vectors(asked, own, 11).join(small(asked.select("query_id", F.col("chunk_id").alias("self"))), "query_id").where("chunk_id <> self")
    order = Window.partitionBy("query_id").orderBy("rank")
    near = near.select("query_id", F.col("chunk_id").alias("neighbour"), F.round(text.clip01(F.col("similarity")), 6).alias("similarity"), F.row_number().over(order).alias("rank"))
    return near.where("rank <= 10")


@query(
    "o4_rerank",
    f"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {Q_SQL}, {BM25_SQL}, {VECTOR_SQL},
    v AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM near WHERE rank <= 5 AND sees), {FUSED_SQL},
    hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, br NULLS LAST, vr NULLS LAST) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM fused),
    o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 0 THEN n - rank END NULLS LAST, rank) AS r FROM hits)
    SELECT query_id, chunk_id, CAST(r AS INT) AS rank FROM o WHERE r <= 5""",
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every question, re-ranked by an order that names every other one from behind, one twice and an unknown one; the rest stay behind."""
    hits = stash(retrieval.retrieve_full(V.questions(spark, sf_dir), V.chunks(spark, sf_dir)), "hits")
    listed = hits.where(F.col("rank") % 2 == 0).groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))).alias("r"))
    ids = F.transform("r", lambda x: x["chunk_id"])
    ranked = listed.select("query_id", F.concat(F.array(F.lit("unknown")), ids, F.slice(ids, 1, 1)).alias("ranked_chunk_ids"))
    return retrieval.rerank(hits.select("query_id", "chunk_id", "rank"), ranked).select("query_id", "chunk_id", "rank")


@query(
    "x11_scalar_functions",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 1 THEN 'Law ' || (doc_id % 10) || ', Điều ' || (doc_id % 40) || ' (part ' || (doc_id % 3) || '/' || (doc_id % 3) || ')' ELSE 'Law ' || (doc_id % 10) || ', Điều ' || (doc_id % 40) END AS citation,
        md5(regexp_replace(substring(text, 6, 600), '^\\s+|\\s+$', '', 'g')) AS excerpt,
        len(list_filter(string_split_regex(text, '[\\s,.;:!?()\\[\\]"'']+'), lambda t: length(t) >= 3)) AS keywords,
        round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zzz') THEN 1 ELSE 0 END) / 2.0, 6) AS overlap,
        len(string_split(lower(text), 'the')) - 1 AS times, md5('query: ' || text) AS prompt, md5(nfc_normalize(text)) AS form_c FROM documents WHERE text IS NOT NULL""",
)
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar text functions."""
    i, t = F.col("doc_id"), F.col("text")
    d = V.table(spark, sf_dir, "documents").where("text is not null")
    return d.select(
        "doc_id", text.citation(F.concat(F.lit("Law "), i % 10), (i % 40).cast("string"), (i % 3 - 1).cast("int"), (i % 3).cast("int")).alias("citation"), F.md5(text.excerpt(t, F.lit(5), F.lit(5000))).alias("excerpt"),
        F.size(text.default_keywords(t)).cast("long").alias("keywords"), F.round(text.lexical_overlap(F.lit("THE zzz"), t), 6).alias("overlap"),
        text.keyword_vector(t, ["the"])[0].cast("long").alias("times"), F.md5(text.task_prompt("multilingual-e5-small", t, "query")).alias("prompt"), F.md5(text.nfc(t)).alias("form_c"),
    )
