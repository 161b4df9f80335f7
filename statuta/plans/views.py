"""The engine's tables as views of the test tables, each with the SQL that gives the same rows.

The mappings are plain arithmetic on keys, so both engines see one input. A document's lines become articles: every
third line a heading, the others clauses, a chapter heading before every ninth; odd documents run on in one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_TYPES = [
    "luat", "nghi_dinh", "thong_tu", "quyet_dinh", "nghi_quyet", "hien_phap", "phap_lenh", "van_ban_hop_nhat", "bo_luat", "chi_thi", "cong_van", "sac_lenh",
    "thong_tu_lien_tich", "lenh", "thong_bao", "nghi_quyet_lien_tich",
]
TITLES = ["Luật thuế", "Bộ luật lao động", "Nghị định hợp đồng", "Luật cư trú", "Luật doanh nghiệp", "Luật đất đai", "Luật hôn nhân", "Văn bản"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, n) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def line(x, k):
        chapter = F.when(k % 9 == 0, F.concat(F.lit("Chương "), F.floor(k / 9) + 1, F.lit(". C\n"))).otherwise("")
        own = F.when(k % 3 == 0, F.concat(F.lit("Điều "), F.floor(k / 3) + 1, F.lit(". "), x)).otherwise(F.concat(k % 3, F.lit(". "), x))
        return F.concat(chapter, own)

    text = F.array_join(F.transform(lines, line), "\n")
    text = F.when(i % 2 == 1, F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(text)
    scope = F.when(i % 3 == 1, "dia_phuong").when(i % 7 == 0, "khac").otherwise("trung_uong")
    authority = F.when(i % 3 == 1, F.concat(F.when(i % 2 == 0, "UBND tỉnh ").otherwise("HĐND Thành phố "), "n_name")).otherwise("Quốc hội")
    area = F.when(i % 10 < 7, "Chưa phân loại").when(i % 10 == 7, "Quản lý thuế, phí và lệ phí").when(i % 10 == 8, "Lao động")
    sections = F.when(i % 4 != 3, F.concat(F.lit('{"sections":[{"kind":"dieu","label":"Điều 1. a","start":0,"end":'), F.lit(40) + i % 50, F.lit('},{"kind":"khoan","label":"1"},{"label":"Điều 2. b","char_start":41,"char_end":90}]}')))
    sections = F.when(i % 8 == 5, "no json").otherwise(sections)
    return d.join(nation, F.pmod(i, F.lit(25)) == F.col("n_nationkey")).select(
        "doc_id", F.concat(F.lit("d"), i).alias("doc_name"), F.concat(pick(TITLES, i % len(TITLES)), F.lit(" "), i).alias("title"), pick(DOC_TYPES, i % len(DOC_TYPES)).alias("doc_type"),
        F.when(i % 5 != 0, "Luật").alias("legal_type"), scope.alias("scope"), authority.alias("issuing_authority"),
        F.when(i % 4 == 0, F.array()).when(i % 4 == 1, F.array(F.concat(i, F.lit("/QH")))).when(i % 4 == 2, F.array(F.concat(i, F.lit("/A")), F.concat(i, F.lit("/B")))).cast("array<string>").alias("doc_number"),
        area.alias("legal_area"), F.when(i % 6 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (i % 9000).cast("int")).cast("string")).alias("issue_date"),
        F.when(i % 14 != 0, text).alias("markdown"), sections.alias("structure_json"), F.concat(F.lit("http://law/"), i).alias("source_url"), "n_name", "text",
        F.when(i % 23 == 0, F.concat(F.lit("d"), i + 3)).alias("pointer"),
    )


CORPUS_SQL = f"""
    corpus AS (SELECT doc_id, 'd' || doc_id AS doc_name, {_list(TITLES)}[doc_id % {len(TITLES)} + 1] || ' ' || doc_id AS title, {_list(DOC_TYPES)}[doc_id % {len(DOC_TYPES)} + 1] AS doc_type,
        CASE WHEN doc_id % 5 <> 0 THEN 'Luật' END AS legal_type,
        CASE WHEN doc_id % 3 = 1 THEN 'dia_phuong' WHEN doc_id % 7 = 0 THEN 'khac' ELSE 'trung_uong' END AS scope,
        CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'UBND tỉnh ' ELSE 'HĐND Thành phố ' END || n_name ELSE 'Quốc hội' END AS issuing_authority, n_name,
        CASE doc_id % 4 WHEN 1 THEN doc_id || '/QH' WHEN 2 THEN doc_id || '/A; ' || doc_id || '/B' END AS numbers,
        CASE WHEN doc_id % 10 < 7 THEN 'Chưa phân loại' WHEN doc_id % 10 = 7 THEN 'Quản lý thuế, phí và lệ phí' WHEN doc_id % 10 = 8 THEN 'Lao động' END AS legal_area,
        list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, doc_id % 14 <> 0 AS has_body,
        CASE WHEN doc_id % 23 = 0 THEN 'd' || (doc_id + 3) END AS pointer
        FROM documents JOIN nation ON doc_id % 25 = n_nationkey)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between documents: replaced by the one seven on, amended with no confidence, repealed, circles and dead links."""
    i = F.col("doc_id")
    ref = lambda when, pos, relation, target, confidence: F.when(when, F.struct(F.lit(pos).alias("pos"), F.lit(relation).alias("relation"), target.alias("target"), F.lit(confidence).cast("double").alias("confidence")))
    d = lambda n: F.concat(F.lit("d"), n)
    each = F.array_compact(F.array(
        ref(i % 17 == 0, 0, "repeal", F.lit(None).cast("string"), 0.8), ref(i % 5 == 0, 1, "replace", d(i + 7), 0.9), ref(i % 12 == 7, 2, "amend", d(i + 5), None),
        ref(i % 29 == 0, 3, "thay_the", d(i + 1), 0.7), ref(i % 29 == 1, 4, "sua_doi", d(i - 1), 0.6), ref(i % 31 == 0, 5, "replace", F.lit(None).cast("string"), 0.5), ref(i % 3 == 0, 6, "cites", d(i + 2), 0.9),
    ))
    return table(spark, sf_dir, "documents").select(d(i).alias("src"), F.explode(each).alias("r")).select("src", "r.*")


REFS_SQL = """
    refs AS (SELECT 'd' || doc_id AS src, pos, relation, target, confidence FROM documents, (VALUES (0), (1), (2), (3), (4), (5), (6)) p(pos), LATERAL (SELECT
        CASE pos WHEN 0 THEN doc_id % 17 = 0 WHEN 1 THEN doc_id % 5 = 0 WHEN 2 THEN doc_id % 12 = 7 WHEN 3 THEN doc_id % 29 = 0 WHEN 4 THEN doc_id % 29 = 1 WHEN 5 THEN doc_id % 31 = 0 ELSE doc_id % 3 = 0 END AS here,
        ['repeal', 'replace', 'amend', 'thay_the', 'sua_doi', 'replace', 'cites'][pos + 1] AS relation,
        CASE pos WHEN 1 THEN 'd' || (doc_id + 7) WHEN 2 THEN 'd' || (doc_id + 5) WHEN 3 THEN 'd' || (doc_id + 1) WHEN 4 THEN 'd' || (doc_id - 1) WHEN 6 THEN 'd' || (doc_id + 2) END AS target,
        [0.8, 0.9, NULL, 0.7, 0.6, 0.5, 0.9][pos + 1] AS confidence) WHERE here)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks for retrieval, in three categories, with entity types and provinces."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), i).alias("chunk_id"), pick(["tax", "labor_insurance", "contracts_signing"], i % 3).alias("category"), pick(["both", "both", "individual", "business"], i % 4).alias("entity_type"),
        F.when(i % 5 == 0, F.concat(F.lit("P"), i % 4)).otherwise("national").alias("province_scope"), F.concat(F.lit("Law "), i % 100).alias("law_name"), (i % 40).cast("string").alias("article_number"),
        (i % 3).cast("int").alias("part_index"), F.lit(3).alias("part_count"), "text",
    )


CHUNKS_SQL = """
    chunks AS (SELECT 'c' || doc_id AS chunk_id, ['tax', 'labor_insurance', 'contracts_signing'][doc_id % 3 + 1] AS category, ['both', 'both', 'individual', 'business'][doc_id % 4 + 1] AS entity_type,
        CASE WHEN doc_id % 5 = 0 THEN 'P' || (doc_id % 4) ELSE 'national' END AS province_scope, coalesce(text, '') AS text FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), pick(["tax", "labor_insurance", "contracts_signing"], i % 3).alias("category"), F.col("text").alias("query_text"),
        F.when(i % 2 == 0, "individual").otherwise("business").alias("entity_type"), F.when(i % 3 != 0, F.concat(F.lit("P"), i % 4)).alias("province"),
    )


QUESTIONS_SQL = """
    questions AS (SELECT item_id AS query_id, ['tax', 'labor_insurance', 'contracts_signing'][item_id % 3 + 1] AS category, text AS query_text,
        CASE WHEN item_id % 2 = 0 THEN 'individual' ELSE 'business' END AS entity_type, CASE WHEN item_id % 3 <> 0 THEN 'P' || (item_id % 4) END AS province FROM benchmark)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    i = F.col("c_custkey")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        i.alias("user_id"), F.col("c_name").alias("username"), (18 + i % 70).cast("int").alias("age"), F.when(i % 2 == 0, "f").otherwise("m").alias("gender"),
        F.when(i % 3 == 0, "married").when(i % 3 == 1, "single").alias("marital_status"), F.when(i % 5 != 0, F.col("n_name")).alias("province"), (i % 4).cast("int").alias("dependents"),
        F.when(i % 7 != 0, F.concat(F.lit("occ"), i % 6)).alias("occupation_type"), (F.col("c_acctbal") > 5000).alias("has_business"), F.lower("c_mktsegment").alias("business_sector"),
        (i % 2 == 0).alias("owns_property"), (i % 11 == 0).alias("owns_vehicle"),
    )


PROFILES_SQL = """
    profiles AS (SELECT c_custkey AS user_id, c_name AS username, CAST(18 + c_custkey % 70 AS INT) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
        CASE c_custkey % 3 WHEN 0 THEN 'married' WHEN 1 THEN 'single' END AS marital_status, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS province, CAST(c_custkey % 4 AS INT) AS dependents,
        CASE WHEN c_custkey % 7 <> 0 THEN 'occ' || (c_custkey % 6) END AS occupation_type, c_acctbal > 5000 AS has_business, lower(c_mktsegment) AS business_sector,
        c_custkey % 2 = 0 AS owns_property, c_custkey % 11 = 0 AS owns_vehicle FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as profile changes: the type of the event picks the field; fields: age, dependents or occupation."""
    k = F.col("event_id")
    sent = F.when(k % 3 == 0, F.create_map(F.lit("age"), (20 + k % 5).cast("string"))).when(k % 3 == 1, F.create_map(F.lit("dependents"), (k % 2).cast("string")))
    sent = sent.otherwise(F.create_map(F.lit("occupation_type"), F.col("event_type"), F.lit("dependents"), (k % 3).cast("string")))
    return table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("user_id"), "ts", sent.alias("changes"), "event_id")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deadline rules."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("rule_id"), pick(["fixed", "recurring", "event_triggered", "other"], k % 4).alias("kind"), F.when(k % 10 != 3, 1 + k % 12).cast("int").alias("month"),
        F.when(k % 11 != 5, 1 + k % 31).cast("int").alias("day"), F.when(k % 13 != 4, k % 7).cast("int").alias("period"), F.when(k % 6 != 1, k % 90).cast("int").alias("days"),
        F.when(k % 9 != 2, F.col("o_orderdate").cast("date")).alias("event"),
    )


RULES_SQL = """
    rules AS (SELECT o_orderkey AS rule_id, ['fixed', 'recurring', 'event_triggered', 'other'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 10 <> 3 THEN 1 + o_orderkey % 12 END AS m,
        CASE WHEN o_orderkey % 11 <> 5 THEN 1 + o_orderkey % 31 END AS d, CASE WHEN o_orderkey % 13 <> 4 THEN o_orderkey % 7 END AS p, CASE WHEN o_orderkey % 6 <> 1 THEN o_orderkey % 90 END AS n,
        CASE WHEN o_orderkey % 9 <> 2 THEN CAST(o_orderdate AS DATE) END AS e FROM orders)"""


# Pages as lines, from rows of `regions` with the HTML in `part`: in `l` of `c`.
LINES_SQL = """
    a AS (SELECT *, regexp_replace(regexp_replace(coalesce(part, ''), '<!--.*?-->|<!doctype[^>]*>', '', 'gis'), '<[A-Za-z/][^>]*>', chr(10), 'gs') AS x FROM regions),
    b AS (SELECT * EXCLUDE (x), replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM a),
    c AS (SELECT * EXCLUDE (x), list_filter(list_transform(string_split(x, chr(10)), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '') AS l FROM b)"""
