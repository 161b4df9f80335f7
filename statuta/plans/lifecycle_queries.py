"""Queries over what is stored and changes: the chunk store, page sources, overrides, profiles that come and go, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.common import fresh_path, stash
from statuta.functions import citations, classify
from statuta.operators import checklist, obligations, profiles, retrieval
from statuta.plans import corpus_queries as C
from statuta.plans import retrieval_queries as Q
from statuta.plans import user_queries as U
from statuta.plans import views as V
from statuta.registry import query
from statuta.sources import corpus as S
from statuta.sources import store

# What is in the store after three writes and a delete: documents of other numbers first, all of them with changed articles last.
STORED_SQL = f"""WITH {V.CORPUS_SQL}, {C.ARTICLES_SQL},
    c AS (SELECT 'vbpl-hf-' || doc_name || ':dieu' || n || CASE WHEN split THEN ':part' || part_index ELSE '' END AS chunk_id, doc_id, 'vbpl-hf-' || doc_name AS document_id, n,
        {C.CATEGORY_SQL.replace("x)", f"CASE WHEN {C.TAGGED} THEN legal_area || ' ' || title ELSE title END)")} AS category, texts[part_index + 1] AS text FROM expected)"""


def _written(spark: SparkSession, sf_dir: str) -> tuple[store.ChunkStore, list[dict]]:
    chunks = stash(S.chunks_of(C.documents(spark, sf_dir)), "chunks")
    number = F.regexp_extract("document_id", r"(\d+)$", 1).cast("long")
    changed = F.when(F.col("article_number").cast("int") % 5 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    every = chunks.withColumn("text", changed).withColumn("content_hash", F.sha2("text", 256))
    kept = store.ChunkStore(spark, fresh_path(spark, "chunk-store"))
    told = [kept.upsert(chunks.where(number % 4 != 0)), kept.upsert(chunks.where(number % 4 != 0)), kept.upsert(every)]
    kept.delete_documents(chunks.where(number % 3 == 0).select("document_id").distinct())
    return kept, told


@query(
    "s8_chunk_store",
    f"""{STORED_SQL} SELECT chunk_id, document_id, category, sha256(text || CASE WHEN n % 5 = 0 THEN ' (revised)' ELSE '' END) AS content_hash, category = 'tax' AS by_category, doc_id % 10 = 1 AS got FROM c WHERE doc_id % 3 <> 0""",
)
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after a write, the same write again, one with changes, and the removal of documents; read whole, by category and by id."""
    kept, _ = _written(spark, sf_dir)
    rows = kept.chunks()
    wanted = rows.where(F.regexp_extract("document_id", r"(\d)$", 1) == "1").select("chunk_id")
    got = kept.get(wanted).select("chunk_id", F.lit(True).alias("got"))
    tax = kept.by_category("tax").select("chunk_id", F.lit(True).alias("by_category"))
    out = rows.join(got, "chunk_id", "left").join(tax, "chunk_id", "left")
    return out.select("chunk_id", "document_id", "category", "content_hash", F.coalesce("by_category", F.lit(False)).alias("by_category"), F.coalesce("got", F.lit(False)).alias("got"))


@query(
    "a7_store_counters",
    f"""{STORED_SQL}, k AS (SELECT count(*) FILTER (doc_id % 4 <> 0) AS first, count(*) FILTER (doc_id % 4 = 0 OR n % 5 = 0) AS changed, count(*) AS every, count(*) FILTER (doc_id % 3 <> 0) AS kept FROM c)
    SELECT 1 AS step, first AS written, 0 AS skipped, first AS total FROM k UNION ALL SELECT 2, 0, first, first FROM k UNION ALL SELECT 3, changed, every - changed, every FROM k UNION ALL SELECT 4, 0, kept, kept FROM k""",
)
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each write of s8_chunk_store wrote and skipped; the last row is what the store holds."""
    kept, told = _written(spark, sf_dir)
    n = kept.count()
    rows = [(k, t["written"], t["skipped"], t["total"]) for k, t in enumerate(told, 1)]
    return spark.createDataFrame([*rows, (4, 0, n, n)], "step int, written long, skipped long, total long")


@query(
    "s6_page_documents",
    f"""WITH regions AS (SELECT *, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*?)</body>', 1) ELSE regexp_extract(html, '(?is)<div(?:\\s[^>]*)?>(.*?)</div>', 1) END AS part FROM pages WHERE page_id % 11 <> 0), {V.LINES_SQL},
    t AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'Luật thuế ' || page_id ELSE left(regexp_replace(l[1], '\\s+', ' ', 'g'), 200) END AS title FROM c WHERE len(l) > 0)
    SELECT 'page-' || page_id AS doc_id, title, md5(array_to_string(l, chr(10))) AS text, CASE WHEN page_id % 4 = 0 THEN 'Law ' || page_id ELSE title END AS law_name,
        CASE page_id % 7 WHEN 0 THEN 'tax' WHEN 1 THEN '{R.DEFAULT_CATEGORY}' ELSE {C.CATEGORY_SQL.replace("x)", "title)")} END AS category, CASE WHEN page_id % 2 = 0 THEN 'business' ELSE 'both' END AS entity_type FROM t""",
)
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the listed pages, from a region of the page, with what the list overrides; an unknown category gives the default."""
    n, none = F.col("page_id"), F.lit(None).cast("string")
    pages = V.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page:"), n.cast("string")).alias("url"), "html")
    specs = pages.where(n % 11 != 0).select(
        "url", F.concat(F.lit("page-"), n.cast("string")).alias("doc_id"), F.when(n % 3 == 1, "body").when(n % 3 == 2, "div").alias("region"), F.when(n % 5 == 0, F.concat(F.lit("Luật thuế "), n.cast("string"))).alias("title"),
        F.when(n % 7 == 0, "tax").when(n % 7 == 1, "no category").alias("category"), F.when(n % 4 == 0, F.concat(F.lit("Law "), n.cast("string"))).alias("law_name"), F.when(n % 2 == 0, "business").alias("entity_type"),
        none.alias("province_scope"), none.alias("effective_from"), none.alias("effective_to"),
    )
    docs = S.documents_of_pages(pages.select("url", "html"), specs)
    return docs.select("doc_id", "title", F.md5("raw_text").alias("text"), "law_name", "category", "entity_type")


@query("s5_listing_ids", "SELECT 'd' || page_id AS doc_id FROM pages WHERE page_id % 7 <> 0")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of listing pages, under either key and either name; blank ones go."""
    n = F.col("page_id")
    name = F.concat(F.lit("d"), n.cast("string"))
    entry = F.struct(F.when(n % 7 == 0, "").when(n % 2 == 0, name).alias("id"), F.when(n % 7 != 0, name).alias("docId"))
    rows = V.table(spark, sf_dir, "pages").groupBy((n % 3).alias("kind"), F.floor(n / 20).alias("page")).agg(F.collect_list(entry).alias("e"))
    return S.listing_ids(rows.select(F.when(F.col("kind") == 0, F.col("e")).alias("items"), F.when(F.col("kind") != 0, F.col("e")).alias("data")))


@query(
    "f16_taxonomy_and_overrides",
    f"""WITH {V.CORPUS_SQL} SELECT 'vbpl-hf-' || doc_name AS doc_id, doc_id % 9 <> 0 AS known, CASE WHEN doc_id % 6 = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'tax' ELSE '{R.DEFAULT_CATEGORY}' END
        ELSE {C.CATEGORY_SQL.replace("x)", f"CASE WHEN {C.TAGGED} THEN legal_area || ' ' || title ELSE title END)")} END AS category FROM corpus WHERE {C.USABLE}""",
)
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides per document decide, unknown ones give the default; rows of an unknown entity type are told apart."""
    corpus = V.corpus(spark, sf_dir)
    overrides = corpus.where("doc_id % 6 = 0").select("doc_name", F.when(F.col("doc_id") % 4 == 0, "tax").otherwise("no category").alias("category"))
    docs = S.documents_of_corpus(corpus, overrides)
    number = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    good, bad = S.validated(docs.withColumn("entity_type", F.when(number % 9 == 0, "alien").otherwise(F.col("entity_type"))))
    return good.select("doc_id", F.lit(True).alias("known"), "category").unionByName(bad.select("doc_id", F.lit(False).alias("known"), "category"))


@query("o5_max_documents", f"WITH {V.CORPUS_SQL} SELECT 'vbpl-hf-' || doc_name AS doc_id, title FROM (SELECT * FROM corpus WHERE {C.USABLE} ORDER BY doc_name LIMIT 150)")
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that pass the filters, the first 150 by name."""
    return S.documents_of_corpus(V.corpus(spark, sf_dir), max_documents=150).select("doc_id", "title")


@query(
    "n6_statute_refs",
    f"WITH {V.REFS_SQL} SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY pos) - 1 AS INT) AS pos, relation, target, confidence FROM refs WHERE CAST(src[2:] AS BIGINT) % 13 <> 0",
)
def statute_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References read from the JSON that comes with a document; malformed text and empty entries give none."""
    refs = V.refs(spark, sf_dir).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "relation", "target", "confidence"))).alias("r"))
    entry = F.transform("r", lambda x: F.struct(x["target"].alias("target_doc_name"), x["relation"].alias("relation"), x["confidence"].alias("confidence")))
    number = F.col("src").substr(2, 20).cast("long")
    whole = F.regexp_replace(F.to_json(F.struct(entry.alias("statute_refs"))), r"\]\}$", ", null]}")
    text = F.when(number % 13 == 0, '{"statute_refs": [').otherwise(whole)
    each = refs.select("src", F.posexplode(citations.statute_refs(text)).alias("pos", "r"))
    return each.select("src", "pos", "r.relation", F.col("r.target_doc_name").alias("target"), "r.confidence")


_NAMED = "CASE WHEN user_id % 4 = 0 THEN 'user' || (user_id % 40) ELSE username END"
_FIELDS = ", ".join(f"{f} := {f}" for f in profiles.FIELDS)


@query(
    "h1_create_profiles",
    f"""WITH {V.PROFILES_SQL}, n AS (SELECT * REPLACE ({_NAMED} AS username) FROM profiles), o AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY user_id) AS k FROM n),
    known AS (SELECT DISTINCT username FROM n WHERE user_id % 10 = 1)
    SELECT user_id, CASE WHEN k = 1 AND username NOT IN (SELECT username FROM known) THEN 1 ELSE 0 END AS version, md5(CAST(to_json(struct_pack({_FIELDS})) AS VARCHAR)) AS snapshot FROM o""",
)
def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New profiles at version 1 with their snapshot; names that exist or come twice are refused (version 0)."""
    p = V.profiles(spark, sf_dir)
    p = p.withColumn("username", F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("user"), F.col("user_id") % 40)).otherwise(F.col("username")))
    fresh, refused = profiles.create_profiles(p, p.where("user_id % 10 = 1").select("username").distinct())
    both = fresh.unionByName(refused.withColumn("version", F.lit(0)))
    return both.select("user_id", "version", F.md5(profiles.snapshot_json()).alias("snapshot"))


@query(
    "f21_checked_profiles",
    f"""WITH {V.PROFILES_SQL} SELECT user_id, user_id % 6 <> 1 AND user_id % 8 <> 3 AS good, CASE WHEN user_id % 4 = 0 AND user_id % 6 <> 1 AND user_id % 8 <> 3 THEN 0 WHEN user_id % 4 = 0 THEN NULL ELSE dependents END AS dependents FROM profiles""",
)
def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profiles out of range are told apart; missing numbers get their defaults."""
    n = F.col("user_id")
    p = V.profiles(spark, sf_dir).withColumn("age", F.when(n % 6 == 1, 150).otherwise(F.col("age"))).withColumn("username", F.when(n % 8 == 3, "").otherwise(F.col("username")))
    good, bad = profiles.checked_profiles(p.withColumn("dependents", F.when(n % 4 != 0, F.col("dependents"))))
    return good.select("user_id", F.lit(True).alias("good"), "dependents").unionByName(bad.select("user_id", F.lit(False).alias("good"), "dependents"))


@query(
    "h4_recomputed_traits",
    f"""WITH {V.PROFILES_SQL.replace("profiles AS (", "before AS (")}, profiles AS (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 'driver' ELSE occupation_type END AS occupation_type, CASE WHEN user_id % 3 = 0 THEN 0 ELSE dependents END AS dependents) FROM before WHERE user_id % 7 <> 0), {U.TRAITS_SQL}
    SELECT user_id, tag, source_rule FROM traits""",
)
def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 H9: traits of changed profiles made anew, those of removed users gone."""
    p = V.profiles(spark, sf_dir)
    changed = p.where("user_id % 3 = 0").withColumn("occupation_type", F.lit("driver")).withColumn("dependents", F.lit(0))
    rows = profiles.recompute_traits(profiles.trait_rows(p), changed)
    return profiles.remove_users(p.where("user_id % 7 = 0"), rows)[0]


@query(
    "d11_authority",
    f"""WITH {V.CORPUS_SQL}, r AS (SELECT doc_id, doc_name, CAST({C.RANK_SQL} AS INT) AS rank FROM corpus)
    SELECT a.doc_name AS doc_name, b.doc_name AS other, a.rank < b.rank AS above, b.rank < a.rank AS below FROM r a JOIN r b ON b.doc_id = a.doc_id + 1""",
)
def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next; of equal ones neither is above."""
    c = V.corpus(spark, sf_dir).select("doc_id", "doc_name", "doc_type", "scope")
    a, b = c.alias("a"), c.withColumn("doc_id", F.col("doc_id") - 1).alias("b")
    one = [F.col(f"{s}.{x}") for s in "ab" for x in ("doc_type", "scope")]
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select(
        "a.doc_name", F.col("b.doc_name").alias("other"), classify.more_authoritative(*one).alias("above"), classify.more_authoritative(*one[2:], *one[:2]).alias("below")
    )


@query("g4_unreviewed", f"{C.GAPS_SQL}, g AS ({C.GAPS_SELECT}) SELECT query_id, coalesce(n, 0) > 0 AS has_unreviewed_gaps FROM kw LEFT JOIN (SELECT query_id, count(*) AS n FROM g WHERE query_id % 3 <> 0 GROUP BY 1) USING (query_id)")
def unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question has a gap that nobody has looked at; those of every third have been."""
    asked = C.asked(spark, sf_dir)
    _, gaps = C.found(spark, sf_dir, asked)
    return obligations.unreviewed(asked, gaps.where("query_id % 3 <> 0"))


@query(
    "x14_answer_text",
    f"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {Q.Q_SQL}, {Q.BM25_SQL}, {Q.VECTOR_SQL},
    v AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM near WHERE rank <= 5 AND sees), {Q.FUSED_SQL},
    h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, br NULLS LAST, vr NULLS LAST) AS rank FROM fused),
    t AS (SELECT query_id, string_agg('Source: Law ' || (CAST(chunk_id[2:] AS BIGINT) % 100) || ', Điều ' || (CAST(chunk_id[2:] AS BIGINT) % 40) || chr(10) || c.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS a FROM h JOIN chunks c USING (chunk_id) WHERE query_id % 10 <> 0 GROUP BY 1)
    SELECT item_id AS query_id, md5(coalesce(a, 'No relevant legal information found in the knowledge base.')) AS answer FROM benchmark LEFT JOIN t ON query_id = item_id""",
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found for every question, as text; a message for those without hits (here every tenth)."""
    asked, chunks = V.questions(spark, sf_dir), V.chunks(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    hits = retrieval.retrieve_full(asked, chunks).where("query_id % 10 <> 0")
    return retrieval.answer_text(hits.select("query_id", "chunk_id", "rank"), chunks, asked).select("query_id", F.md5("answer").alias("answer"))


@query(
    "s14_stored_items",
    f"""WITH {U.ITEMS_SQL}, asked AS (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT c_custkey + 10000000 FROM customer)
    SELECT a.user_id, a.user_id < 10000000 AS found, id, title, strftime(due_date, '%Y-%m-%d') AS due_date FROM asked a LEFT JOIN items i ON i.user_id = a.user_id""",
)
def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored checklists of users; an unknown user is told from one without items."""
    users = V.profiles(spark, sf_dir).select("user_id")
    asked = users.unionByName(users.select((F.col("user_id") + 10_000_000).alias("user_id")))
    return checklist.stored_items(users, asked, U.items(spark, sf_dir)).select("user_id", "found", "id", "title", "due_date")
