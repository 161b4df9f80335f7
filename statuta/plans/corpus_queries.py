"""Queries over the corpus: ingest, classification, segmentation, text functions, consolidation, obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.common import stash
from statuta.functions import citations, classify, segment, text
from statuta.operators import consolidation, facets, obligations
from statuta.plans import retrieval_queries as R_Q
from statuta.plans import views as V
from statuta.registry import query
from statuta.sources import corpus as S
from statuta.sources import store

CATEGORY_SQL = "CASE " + " ".join(f"WHEN contains(lower(x), '{k}') THEN '{c}'" for k, c in R.CATEGORY_KEYWORDS) + f" ELSE '{R.DEFAULT_CATEGORY}' END"
TAGGED = "(legal_area IS NOT NULL AND legal_area <> 'Chưa phân loại')"
RANK_SQL = "CASE WHEN doc_type = 'nghi_quyet' AND scope = 'trung_uong' THEN 1 " + " ".join(f"WHEN doc_type = '{k}' THEN {v}" for k, v in R.INSTRUMENT_RANK.items()) + " ELSE 99 END"
USABLE = "has_body AND len(l) > 0 AND doc_type NOT IN (" + ", ".join(f"'{t}'" for t in R.EXCLUDED_DOC_TYPES) + ")"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

# The expected articles follow from how the view makes the text, with no parsing at all.
ARTICLES_SQL = f"""
    a AS (SELECT *, unnest(range(1, (len(l) + 2) // 3 + 1)) AS n FROM corpus WHERE {USABLE}),
    arts AS (SELECT doc_id, doc_name, title, scope, n_name, legal_type, numbers, legal_area, n,
        ((n - 1) // 3 + 1) AS chapter, {STRIP("l[3 * n - 2]")} AS h, {STRIP("'1. ' || l[3 * n - 1]")} AS c1, {STRIP("'2. ' || l[3 * n]")} AS c2, 3 * n - 1 <= len(l) AS has1, 3 * n <= len(l) AS has2,
        {STRIP("l[3 * n - 2] || CASE WHEN 3 * n - 1 <= len(l) THEN ' 1. ' || l[3 * n - 1] ELSE '' END || CASE WHEN 3 * n <= len(l) THEN ' 2. ' || l[3 * n] ELSE '' END")} AS run FROM a),
    arts2 AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN run ELSE h END AS article_title, CASE WHEN doc_id % 2 = 0 AND has1 THEN {STRIP("'1. ' || l1")} END AS unused FROM (SELECT *, c1 AS l1 FROM arts)),
    packed AS (SELECT *, {STRIP("'Điều ' || n || '. ' || article_title")} AS heading, CASE WHEN doc_id % 2 = 0 AND has1 THEN c1 END AS p1, CASE WHEN doc_id % 2 = 0 AND has2 THEN c2 END AS p2 FROM arts2),
    whole AS (SELECT *, {STRIP("concat_ws(chr(10), heading, coalesce(p1 || chr(10) || p2, p1, ''))")} AS full_text FROM packed),
    parts AS (SELECT *, CASE WHEN length(full_text) <= 1500 THEN [full_text]
            WHEN p1 IS NULL THEN [heading]
            WHEN p2 IS NOT NULL AND length(heading) + length(p1) + 1 + length(p2) > 1500 THEN [heading || chr(10) || p1, heading || chr(10) || p2]
            ELSE [full_text] END AS texts, length(full_text) > 1500 AS split FROM whole),
    expected AS (SELECT *, unnest(range(len(texts))) AS part_index FROM parts)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents_of_corpus(V.corpus(spark, sf_dir))


@query(
    "z1_ingest",
    f"""WITH {V.CORPUS_SQL}, {ARTICLES_SQL}
    SELECT 'vbpl-hf-' || doc_name || ':dieu' || n || CASE WHEN split THEN ':part' || part_index ELSE '' END AS chunk_id, 'vbpl-hf-' || doc_name AS document_id,
        CASE WHEN numbers IS NOT NULL THEN trim(coalesce(legal_type, '') || ' ' || numbers || ' - ' || title, ' -') ELSE {STRIP("coalesce(legal_type, '') || ' ' || title")} END AS law_name,
        {CATEGORY_SQL.replace("x)", f"CASE WHEN {TAGGED} THEN legal_area || ' ' || title ELSE title END)")} AS category,
        CASE WHEN scope = 'dia_phuong' THEN n_name ELSE 'national' END AS province_scope, CAST(chapter AS VARCHAR) AS chapter_number, CAST(n AS VARCHAR) AS article_number, article_title,
        CAST(part_index AS INT) AS part_index, CAST(len(texts) AS INT) AS part_count, sha256(texts[part_index + 1]) AS content_hash FROM expected""",
)
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of the whole corpus."""
    good, _ = S.validated(documents(spark, sf_dir))
    return S.chunks_of(good).select("chunk_id", "document_id", "law_name", "category", "province_scope", "chapter_number", "article_number", "article_title", "part_index", "part_count", "content_hash")


@query(
    "s16_ingest_summary",
    f"""WITH {V.CORPUS_SQL}, {ARTICLES_SQL}
    SELECT {CATEGORY_SQL.replace("x)", f"CASE WHEN {TAGGED} THEN legal_area || ' ' || title ELSE title END)")} AS category, count(DISTINCT doc_id) AS documents,
        count(DISTINCT (doc_id, n)) AS articles, count(*) AS chunks, CAST(sum(length(texts[part_index + 1])) AS BIGINT) AS chars FROM expected GROUP BY 1""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, articles and chunks by category."""
    chunks = S.chunks_of(documents(spark, sf_dir))
    by_doc = chunks.groupBy("category", "document_id").agg(F.count_if(F.col("part_index") == 0).alias("articles"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return by_doc.groupBy("category").agg(F.count("*").alias("documents"), F.sum("articles").alias("articles"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))


@query(
    "s9_upsert_diff",
    f"""WITH {V.CORPUS_SQL}, {ARTICLES_SQL}
    SELECT 'vbpl-hf-' || doc_name || ':dieu' || n || CASE WHEN split THEN ':part' || part_index ELSE '' END AS chunk_id, sha256(texts[part_index + 1]) AS content_hash,
        CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN n % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM expected""",
)
def upsert_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus against a store that lacks some documents and has other texts of some articles."""
    chunks = S.chunks_of(documents(spark, sf_dir))
    number = F.regexp_extract("document_id", r"(\d+)$", 1).cast("long")
    old = chunks.where(number % 4 != 0).withColumn("content_hash", F.when(F.col("article_number").cast("int") % 5 == 0, F.md5("text")).otherwise(F.col("content_hash")))
    return store.diff(chunks, old).select("chunk_id", "content_hash", "change")


@query(
    "d1_classify",
    f"""WITH {V.CORPUS_SQL}
    SELECT doc_name, {CATEGORY_SQL.replace("x)", "title)")} AS by_title, {CATEGORY_SQL.replace("x)", f"CASE WHEN {TAGGED} THEN legal_area || ' ' || title ELSE title END)")} AS category,
        CASE WHEN scope = 'dia_phuong' THEN n_name END AS province, CAST({RANK_SQL} AS INT) AS rank, doc_type IN ({", ".join(f"'{k}'" for k in R.INSTRUMENT_RANK)}) AS ranked,
        CASE WHEN {TAGGED} AND contains(lower(legal_area), 'thuế') THEN 1.0 ELSE 0.0 END AS boost,
        scope = 'trung_uong' OR (scope = 'dia_phuong' AND contains(lower(issuing_authority), 'china')) AS inside FROM corpus""",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's metadata say of it."""
    c = V.corpus(spark, sf_dir)
    return c.select(
        "doc_name", classify.category_of_title(F.col("title")).alias("by_title"), classify.category(F.col("title"), F.col("legal_area")).alias("category"),
        classify.province_scope(F.col("scope"), F.col("issuing_authority")).alias("province"), classify.rank_of(F.col("doc_type"), F.col("scope")).alias("rank"), classify.is_ranked(F.col("doc_type")).alias("ranked"),
        classify.legal_area_boost(F.col("legal_area"), F.array(F.lit("Thuế"), F.lit(""))).alias("boost"),
        classify.in_jurisdiction(F.col("scope"), F.col("issuing_authority"), F.lit("tỉnh CHINA")).alias("inside"),
    )


@query(
    "x2_tokens",
    """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '') AS w FROM documents),
    t AS (SELECT doc_id, w, list_filter(list_transform(w, lambda t: strip_accents(t)), lambda t: t <> '' AND NOT list_contains(w, t)) AS bare FROM d)
    SELECT doc_id, CAST(len(w) AS INT) AS words, CAST(len(bare) AS INT) AS bare_words, md5(array_to_string(list_concat(w, bare), ' ')) AS tokens FROM t""",
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their forms without marks."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("t"), F.size(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda x: x != "")).alias("words"))
    return d.select("doc_id", "words", (F.size("t") - F.col("words")).alias("bare_words"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(
    "x6_hashing_embedding",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+')) AS t FROM documents),
    b AS (SELECT doc_id, CAST('0x' || right(md5(t), 2) AS INT) AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
)
def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing embedding of every document, as its buckets."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.hashing_embedding(F.coalesce("text", F.lit("")))).alias("bucket", "w"))
    return d.where("w > 0").select("doc_id", "bucket", F.round("w", 6).alias("weight"))


@query(
    "t1_html_lines",
    """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<!doctype[^>]*>', '', 'gis'), '<[A-Za-z/][^>]*>', chr(10), 'gs') AS x FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM a),
    c AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '') AS l FROM b)
    SELECT page_id, CAST(len(l) AS INT) AS lines, md5(array_to_string(l, chr(10))) AS text, left(regexp_replace(l[1], '\\s+', ' ', 'g'), 200) AS title FROM c""",
)
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines, and the title they suggest."""
    p = V.table(spark, sf_dir, "pages").select("page_id", segment.html_to_lines(F.coalesce("html", F.lit(""))).alias("t"))
    return p.select("page_id", F.size(F.split("t", "\n")).alias("lines"), F.md5("t").alias("text"), segment.guess_title(F.col("t")).alias("title"))


WALK_SQL = """
    first AS (SELECT src, max(relation IN ('amend', 'replace', 'sua_doi', 'thay_the')) AS sup, arg_min({'t': target, 'c': confidence}, pos) FILTER (relation IN ('amend', 'replace', 'sua_doi', 'thay_the')) AS f
        FROM refs WHERE relation IN ('amend', 'replace', 'sua_doi', 'thay_the', 'repeal', 'bai_bo', 'huy_bo') GROUP BY src),
    walk AS (SELECT doc_name, doc_name AS at, [doc_name] AS chain, 1.0::DOUBLE AS confidence, 0 AS hops FROM corpus WHERE pointer IS NULL
        UNION ALL SELECT w.doc_name, f.f.t, list_append(w.chain, f.f.t), w.confidence * coalesce(f.f.c, 0.75), w.hops + 1
        FROM walk w JOIN first f ON f.src = w.at AND f.sup JOIN corpus c ON c.doc_name = f.f.t WHERE w.hops < 5 AND NOT list_contains(w.chain, f.f.t)),
    last AS (SELECT doc_name, max(hops) AS hops FROM walk GROUP BY 1),
    walked AS (SELECT w.doc_name, w.at AS effective, array_to_string(w.chain, ' -> ') AS chain, w.confidence, FALSE AS used_pointer, w.hops = 5 OR f.src IS NOT NULL AS unresolved
        FROM walk w JOIN last USING (doc_name, hops) LEFT JOIN first f ON f.src = w.at),
    consolidated AS (SELECT * FROM walked UNION ALL SELECT c.doc_name, coalesce(p.doc_name, c.doc_name), CASE WHEN p.doc_name IS NULL THEN c.doc_name ELSE c.doc_name || ' -> ' || p.doc_name END,
        CASE WHEN p.doc_name IS NULL THEN 0.0 ELSE 0.95 END, p.doc_name IS NOT NULL, p.doc_name IS NULL FROM corpus c LEFT JOIN corpus p ON p.doc_name = c.pointer WHERE c.pointer IS NOT NULL)"""


@query(
    "j7_consolidation",
    f"""WITH RECURSIVE {V.CORPUS_SQL}, {V.REFS_SQL}, {WALK_SQL}
    SELECT doc_name, effective, chain, round(confidence, 9) AS confidence, used_pointer, unresolved FROM consolidated""",
)
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document in force for every document."""
    out = consolidation.consolidate(V.corpus(spark, sf_dir).select("doc_name", "pointer"), V.refs(spark, sf_dir))
    return out.withColumn("chain", F.array_join("chain", " -> ")).withColumn("confidence", F.round("confidence", 9))


@query(
    "n5_citations",
    f"""WITH {V.CORPUS_SQL}
    SELECT doc_name, CASE WHEN doc_id % 4 <> 3 AND doc_id % 8 <> 5 THEN 1 END AS first_number, CASE WHEN doc_id % 4 <> 3 AND doc_id % 8 <> 5 THEN 2 END AS second_number,
        CASE WHEN doc_id % 4 <> 3 AND doc_id % 8 <> 5 THEN CAST(41 AS INT) ELSE 0 END AS second_start,
        CASE WHEN doc_id % 4 <> 3 AND doc_id % 8 <> 5 THEN CASE WHEN 45 <= 40 + doc_id % 50 AND 40 + doc_id % 50 <= 49 THEN 1 ELSE 2 END END AS around FROM corpus""",
)
def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article, the one of number 2, and the smallest around a place."""
    s, m = F.col("structure_json"), F.col("markdown")
    c = V.corpus(spark, sf_dir).select("doc_name", citations.locate_article(s, m).alias("a"), citations.locate_article(s, m, number=F.lit(2)).alias("b"), citations.locate_article(s, m, offset=F.lit(45)).alias("c"))
    return c.select("doc_name", F.col("a.dieu_number").alias("first_number"), F.col("b.dieu_number").alias("second_number"), F.col("b.span_start").alias("second_start"), F.col("c.dieu_number").alias("around"))


# Questions to documents: a provision of the benchmark, the province of its user and a keyword; the best twenty documents by words and by vectors.
BEST = 20
ASKED_SQL = f"""
    kw AS (SELECT item_id AS query_id, n_name AS province, ['thuế', 'lao động'][item_id % 2 + 1] AS keyword FROM benchmark JOIN nation ON item_id % 25 = n_nationkey),
    places AS (SELECT DISTINCT lower(province) AS place FROM kw), bodies AS (SELECT doc_id, scope, lower(issuing_authority) AS authority, text FROM documents JOIN corpus USING (doc_id) WHERE has_body AND text IS NOT NULL),
    chunks AS (SELECT 'd' || doc_id || chr(31) || '*' AS chunk_id, 'all' AS category, 'both' AS entity_type, 'national' AS province_scope, text FROM bodies WHERE scope = 'trung_uong'
        UNION ALL SELECT 'd' || doc_id || chr(31) || place, 'all', 'both', place, text FROM bodies JOIN places ON contains(authority, place) WHERE scope = 'dia_phuong'),
    q AS (SELECT item_id AS query_id, 'all' AS category, text AS query_text, 'individual' AS entity_type, lower(province) AS province FROM benchmark JOIN kw ON query_id = item_id), {R_Q.BM25_SQL}, {R_Q.VECTOR_SQL},
    terms AS (SELECT query_id, list_filter(string_split_regex(lower(query_text), '\\s+'), lambda t: t <> '') AS w FROM q),
    lex AS (SELECT query_id, split_part(chunk_id, chr(31), 1) AS doc_name, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda t: contains(lower(c.text), t))) / len(w) ELSE 0.0 END AS score FROM bm JOIN terms USING (query_id) JOIN chunks c USING (chunk_id) WHERE rank <= {BEST}),
    vec AS (SELECT query_id, split_part(chunk_id, chr(31), 1) AS doc_name, similarity AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS place FROM near WHERE sees) WHERE place <= {BEST}),
    cand AS (SELECT query_id, doc_name, greatest(coalesce(l.score, 0), 0) AS lexical, CASE WHEN v.score IS NOT NULL THEN greatest(0, least(1, v.score)) END AS embedding FROM lex l FULL JOIN vec v USING (query_id, doc_name))"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions: query_id, query_text, province, keywords."""
    n = F.broadcast(V.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("province")))  # 25 rows
    return V.table(spark, sf_dir, "benchmark").join(n, F.col("item_id") % 25 == F.col("n_nationkey")).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "province", F.array(V.pick(["thuế", "lao động"], F.col("item_id") % 2)).alias("keywords")
    )


def document_store(spark: SparkSession, sf_dir: str, questions: DataFrame) -> facets.DocumentStore:
    text = F.when(F.col("doc_id") % 14 != 0, F.col("text")).alias("text")
    return facets.DocumentStore(V.corpus(spark, sf_dir).select("doc_name", "scope", "issuing_authority", text), questions)


def found(spark: SparkSession, sf_dir: str, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and gaps of the questions: candidates are the best documents of their jurisdiction by words, scored by the share of the question's words that they hold, and by vectors."""
    corpus, documents = V.corpus(spark, sf_dir), document_store(spark, sf_dir, questions)
    known = consolidation.consolidate(corpus.select("doc_name", "pointer"), V.refs(spark, sf_dir))
    lex, vec = documents.search_fulltext(BEST), documents.search_embeddings(BEST)
    return obligations.retrieve_obligations(questions, corpus, stash(lex, "lexical"), stash(vec, "embedding"), stash(known, "consolidated"))


@query(
    "s15_document_store",
    f"""WITH {V.CORPUS_SQL}, {ASKED_SQL},
    inside AS (SELECT query_id, count(*) AS n, md5(string_agg(doc_name, ',' ORDER BY doc_name)) AS names FROM corpus, kw WHERE scope = 'trung_uong' OR (scope = 'dia_phuong' AND contains(lower(issuing_authority), lower(province))) GROUP BY 1)
    SELECT query_id, 'inside' AS source, names AS doc_name, CAST(n AS DOUBLE) AS score FROM inside UNION ALL SELECT query_id, 'words', doc_name, round(score, 9) FROM lex UNION ALL SELECT query_id, 'vectors', doc_name, score FROM vec""",
)
def document_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question, how many documents its jurisdiction has and which, and the best of these by words and by vectors."""
    documents = document_store(spark, sf_dir, asked(spark, sf_dir))
    listed = documents.by_jurisdiction().groupBy("query_id").agg(F.count("*").cast("double").alias("score"), F.md5(F.array_join(F.array_sort(F.collect_list("doc_name")), ",")).alias("doc_name"))
    parts = {"inside": listed, "words": documents.search_fulltext(BEST).withColumn("score", F.round("score", 9)), "vectors": documents.search_embeddings(BEST)}
    rows = [df.select("query_id", F.lit(name).alias("source"), "doc_name", "score") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


ROWS_SQL = f"""
    rows AS (SELECT c.query_id, c.doc_name AS candidate, e.doc_name, e.title, k.chain, k.unresolved, CAST({RANK_SQL.replace("doc_type", "e.doc_type").replace("scope", "e.scope")} AS INT) AS hierarchy_rank,
        round(0.30 * CASE WHEN e.scope = 'trung_uong' OR (e.scope = 'dia_phuong' AND contains(lower(e.issuing_authority), lower(w.province))) THEN 1.0 ELSE 0.0 END + 0.20 * c.lexical + 0.20 * coalesce(c.embedding, 0)
            + 0.05 * CASE WHEN e.legal_area IS NOT NULL AND e.legal_area <> 'Chưa phân loại' AND contains(lower(e.legal_area), w.keyword) THEN 1.0 ELSE 0.0 END
            + 0.10 * CASE WHEN e.doc_type IN ({", ".join(f"'{k}'" for k in R.INSTRUMENT_RANK)}) THEN 1.0 ELSE 0.5 END + 0.15 * k.confidence, 9) AS coverage_total
        FROM cand c JOIN kw w USING (query_id) JOIN corpus o ON o.doc_name = c.doc_name JOIN consolidated k ON k.doc_name = c.doc_name JOIN corpus e ON e.doc_name = k.effective
        WHERE o.scope = 'trung_uong' OR (o.scope = 'dia_phuong' AND contains(lower(o.issuing_authority), lower(w.province))))"""


@query(
    "z6_obligations",
    f"""WITH RECURSIVE {V.CORPUS_SQL}, {V.REFS_SQL}, {WALK_SQL}, {ASKED_SQL}, {ROWS_SQL}
    SELECT query_id, CAST(rank AS INT) AS rank, candidate, doc_name, hierarchy_rank, chain, unresolved, coverage_total FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hierarchy_rank, coverage_total DESC, candidate) AS rank FROM rows) WHERE rank <= 10""",
)
def obligation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each question, by authority and then by coverage."""
    hits, _ = found(spark, sf_dir, asked(spark, sf_dir))
    return hits.select("query_id", "rank", "candidate", "doc_name", "hierarchy_rank", "chain", "unresolved", "coverage_total")


# What a reviewer has to look at.
GAPS_SQL = f"WITH RECURSIVE {V.CORPUS_SQL}, {V.REFS_SQL}, {WALK_SQL}, {ASKED_SQL}, {ROWS_SQL}"
GAPS_SELECT = """SELECT DISTINCT query_id, kind, doc_name, title FROM (
        SELECT query_id, 'low_coverage' AS kind, doc_name, title FROM rows WHERE coverage_total < 0.6 UNION ALL SELECT query_id, 'unresolved_consolidation', doc_name, title FROM rows WHERE unresolved
        UNION ALL SELECT query_id, 'null_markdown_match', doc_name, title FROM corpus, kw WHERE (NOT has_body OR len(l) = 0) AND (scope = 'trung_uong' OR (scope = 'dia_phuong' AND contains(lower(issuing_authority), lower(province))))
            AND (legal_area IS NULL OR legal_area = 'Chưa phân loại' OR contains(lower(legal_area), keyword)))"""


@query("g1_gaps", f"{GAPS_SQL} {GAPS_SELECT}")
def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer has to look at."""
    _, gaps = found(spark, sf_dir, asked(spark, sf_dir))
    return gaps.select("query_id", "kind", "doc_name", "title")
