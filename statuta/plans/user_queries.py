"""Queries about users: traits, category queries, history, deadlines, checklists."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.common import stash
from statuta.functions import deadlines
from statuta.operators import checklist, profiles
from statuta.plans import views as V
from statuta.plans.retrieval_queries import BM25_SQL, FUSED_SQL, VECTOR_SQL
from statuta.plans.views import LINES_SQL
from statuta.registry import query
from statuta.sources import corpus as S

TODAY = "2024-05-15"
TRAITS_SQL = """
    traits AS (SELECT user_id, occupation_type AS tag, 'occupation' AS source_rule FROM profiles WHERE occupation_type IS NOT NULL UNION ALL SELECT user_id, 'small_business_owner', 'business_owner' FROM profiles WHERE has_business
        UNION ALL SELECT user_id, 'business_sector_' || business_sector, 'business_owner' FROM profiles WHERE has_business UNION ALL SELECT user_id, 'has_dependents', 'dependents' FROM profiles WHERE dependents > 0
        UNION ALL SELECT user_id, 'marital_' || marital_status, 'marital_status' FROM profiles WHERE marital_status IS NOT NULL UNION ALL SELECT user_id, 'property_owner', 'owns_property' FROM profiles WHERE owns_property
        UNION ALL SELECT user_id, 'vehicle_owner', 'owns_vehicle' FROM profiles WHERE owns_vehicle UNION ALL SELECT user_id, 'resident_of_' || province, 'province' FROM profiles WHERE province IS NOT NULL)"""


@query("d4_traits", f"WITH {V.PROFILES_SQL}, {TRAITS_SQL} SELECT user_id, tag, source_rule FROM traits")
def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traits of every user."""
    return profiles.trait_rows(V.profiles(spark, sf_dir))


@query("z7_profile_traits", f"WITH {V.PROFILES_SQL}, {TRAITS_SQL} SELECT user_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, CASE WHEN list_contains(list(tag), 'small_business_owner') THEN 'business' ELSE 'individual' END AS entity_type FROM traits GROUP BY 1")
def sorted_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted traits and the kind of user."""
    from statuta.functions.classify import entity_type

    rows = profiles.sorted_traits(profiles.trait_rows(V.profiles(spark, sf_dir)))
    return rows.select("user_id", F.array_join("tags", ",").alias("tags"), entity_type(F.col("tags")).alias("entity_type"))


_TRIGGERS = ", ".join(f"('{c}', {'NULL' if t is None else V._list(t)}, '{R.QUERY_TEMPLATES[c]}')" for c, t in R.TRIGGERS.items())


QUERIES_SQL = f"""
    t AS (SELECT user_id, list(DISTINCT tag) AS tags FROM traits GROUP BY 1), g(category, triggers, template) AS (VALUES {_TRIGGERS}),
    m AS (SELECT user_id, category, template, tags, list_sort(list_filter(tags, lambda x: list_contains(coalesce(triggers, []), x))) AS matched, list_sort(list_filter(tags, lambda x: starts_with(x, 'business_sector_'))) AS sectors
        FROM t, g WHERE triggers IS NULL OR list_has_any(tags, triggers))"""
ASKED_TEXT = "template || CASE WHEN len(matched) + len(sectors) > 0 THEN ' đối với ' || array_to_string(list_concat(matched, sectors), ', ') ELSE '' END"


@query(
    "d8_category_queries",
    f"""WITH {V.PROFILES_SQL}, {TRAITS_SQL}, {QUERIES_SQL}
    SELECT user_id || '|' || category AS query_id, user_id, category, {ASKED_TEXT} AS query_text,
        array_to_string(matched, ',') AS matched_traits, CASE WHEN list_contains(tags, 'small_business_owner') THEN 'business' ELSE 'individual' END AS entity_type FROM m""",
)
def category_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for every user."""
    p = V.profiles(spark, sf_dir)
    users = profiles.sorted_traits(profiles.trait_rows(p)).join(p.select("user_id", "province"), "user_id")
    return profiles.category_queries(users).withColumn("matched_traits", F.array_join("matched_traits", ",")).drop("province")


_DAY = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"


@query(
    "k4_due_dates",
    f"""WITH {V.RULES_SQL}, f AS (SELECT *, {_DAY(2024, "CAST(m AS INT)", "CAST(d AS INT)")} AS f1, {_DAY(2025, "CAST(m AS INT)", "CAST(d AS INT)")} AS f2 FROM rules),
    r AS (SELECT rule_id, i, {_DAY("CAST(2024 + (coalesce(m, 1) - 1 + i * p) // 12 AS INT)", "CAST((coalesce(m, 1) - 1 + i * p) % 12 + 1 AS INT)", "CAST(d AS INT)")} AS c FROM rules, (SELECT unnest(range(0, 121)) AS i)
        WHERE kind = 'recurring' AND p > 0 AND d IS NOT NULL AND i * p <= 120),
    rr AS (SELECT rule_id, arg_min({{'c': c}}, i).c AS c FROM r WHERE c IS NULL OR c >= DATE '{TODAY}' GROUP BY 1)
    SELECT rule_id, strftime(d2, '%Y-%m-%d') AS due_date FROM (SELECT rule_id, CASE kind WHEN 'fixed' THEN CASE WHEN m IS NULL OR d IS NULL THEN NULL WHEN f1 < DATE '{TODAY}' THEN f2 ELSE f1 END WHEN 'recurring' THEN rr.c
        WHEN 'event_triggered' THEN CAST(e + CAST(n AS INT) AS DATE) END AS d2 FROM f LEFT JOIN rr USING (rule_id))""",
)
def due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K4: the next due date of every rule."""
    r = V.rules(spark, sf_dir)
    return r.select("rule_id", deadlines.due_date(*(F.col(c) for c in ("kind", "month", "day", "period", "days", "event")), F.lit(TODAY).cast("date")).cast("string").alias("due_date"))


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the JSON that an extractor gave, an order a chunk; some lack a required field, some are no JSON."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    item = F.struct(
        F.when(n != 7, F.concat(F.lit("pay "), n)).alias("title"), F.col("l_returnflag").alias("description"), F.when(n % 2 == 0, "fixed").otherwise("recurring").alias("deadline_type"),
        (1 + k % 12).cast("int").alias("deadline_month"), (1 + n * 3).cast("int").alias("deadline_day"), F.lit(3).alias("period_months"), F.col("l_returnflag").alias("penalty_summary"),
    )
    by = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(item).alias("obligations"))).alias("extraction"))
    i = F.col("l_orderkey")
    return by.select(
        (i % 500).alias("user_id"), V.pick(["tax", "labor_insurance"], i % 2).alias("category"), F.concat(F.lit("c"), i).alias("chunk_id"), F.concat(F.lit("Law "), i % 9).alias("law_name"), (i % 40).cast("string").alias("article_number"),
        F.lit(0).alias("part_index"), F.lit(1).alias("part_count"), F.when(i % 50 == 0, "none").otherwise(F.col("extraction")).alias("extraction"),
    )


ITEMS_SQL = f"""
    l AS (SELECT l_orderkey AS k, l_linenumber AS n, * FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_linenumber <> 7),
    dates AS (SELECT *, CAST(1 + k % 12 AS INT) AS mo, CAST(1 + n * 3 AS INT) AS da FROM l),
    r AS (SELECT k, n, min(c) AS c FROM (SELECT k, n, {_DAY("CAST(2024 + (mo - 1 + i * 3) // 12 AS INT)", "CAST((mo - 1 + i * 3) % 12 + 1 AS INT)", "da")} AS c FROM dates, (SELECT unnest(range(0, 41)) AS i) WHERE n % 2 = 1) WHERE c >= DATE '{TODAY}' GROUP BY 1, 2),
    items AS (SELECT k % 500 AS user_id, 'pay ' || n AS title, ['tax', 'labor_insurance'][k % 2 + 1] AS category, CASE WHEN n % 2 = 0 THEN 'fixed' ELSE 'recurring' END AS deadline_type,
        CASE WHEN n % 2 = 1 THEN c WHEN {_DAY(2024, "mo", "da")} < DATE '{TODAY}' THEN {_DAY(2025, "mo", "da")} ELSE {_DAY(2024, "mo", "da")} END AS due_date, l_returnflag AS penalty_summary,
        'Law ' || (k % 9) || ', Điều ' || (k % 40) AS source_citation, 'c' || k AS source_chunk_id, 'pending' AS status, md5((k % 500) || '|' || ['tax', 'labor_insurance'][k % 2 + 1] || '|c' || k || '|pay ' || n) AS id FROM dates LEFT JOIN r USING (k, n))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = checklist.obligations(extraction(spark, sf_dir))
    return checklist.items(found, F.lit(TODAY).cast("date"))


@query("n7_checklist_items", f"WITH {ITEMS_SQL} SELECT id, user_id, title, category, deadline_type, strftime(due_date, '%Y-%m-%d') AS due_date, penalty_summary, source_citation, source_chunk_id, status FROM items")
def checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations parsed from an extractor's output, dated and cited."""
    return items(spark, sf_dir).select("id", "user_id", "title", "category", "deadline_type", F.col("due_date").cast("string").alias("due_date"), "penalty_summary", "source_citation", "source_chunk_id", "status")


@query("n7_quarantine", "SELECT 'c' || l_orderkey AS chunk_id, count(*) AS n FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_linenumber = 7 GROUP BY 1")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations without a required field."""
    _, bad = checklist.obligations(extraction(spark, sf_dir))
    return bad.groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("f11_pending_items", f"WITH {ITEMS_SQL} SELECT user_id, count(*) AS n, strftime(min(due_date), '%Y-%m-%d') AS next_due FROM items WHERE due_date <= DATE '{TODAY}' + 30 GROUP BY 1")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items due within thirty days, by user."""
    return checklist.pending(items(spark, sf_dir), F.lit(TODAY).cast("date"), 30).groupBy("user_id").agg(F.count("*").alias("n"), F.min("due_date").cast("string").alias("next_due"))


@query(
    "x14_status_text",
    f"""WITH {ITEMS_SQL}, t AS (SELECT user_id, string_agg('- [' || category || '] ' || title || ' — due ' || strftime(due_date, '%Y-%m-%d') || ' — ' || source_citation, chr(10) ORDER BY id) AS m FROM items WHERE due_date <= DATE '{TODAY}' + 10 GROUP BY 1)
    SELECT user_id, coalesce(m, 'No pending checklist items due within 10 days.') AS message FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) LEFT JOIN t USING (user_id)""",
)
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's pending items as text."""
    users = V.profiles(spark, sf_dir).select("user_id")
    return checklist.status_text(users, items(spark, sf_dir), F.lit(TODAY).cast("date"), 10)


@query(
    "h7_mark_done",
    f"""WITH {ITEMS_SQL}, req AS (SELECT c_custkey AS request_id, c_custkey AS user_id, 'PAY ' || (c_custkey % 7 + 1) AS t FROM customer),
    h AS (SELECT request_id, t, count(id) AS n, string_agg(title, '; ' ORDER BY i.id) AS titles FROM req AS r LEFT JOIN items i ON i.user_id = r.user_id AND contains(lower(i.title), lower(t)) GROUP BY 1, 2)
    SELECT request_id, n, CASE WHEN n = 0 THEN 'No checklist item found matching ''' || t || '''.' WHEN n > 1 THEN 'Multiple items match ''' || t || ''': ' || titles || '. Please be more specific.' ELSE 'Marked ''' || titles || ''' as done.' END AS message FROM h""",
)
def mark_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name an item by part of its title."""
    requests = V.profiles(spark, sf_dir).select(F.col("user_id").alias("request_id"), "user_id", F.concat(F.lit("PAY "), F.col("user_id") % 7 + 1).alias("title_contains"))
    return checklist.mark_done(items(spark, sf_dir), requests)[1]


@query(
    "h5_replace_checklist",
    f"""WITH {ITEMS_SQL} SELECT user_id, id, title, user_id % 3 = 0 AS renewed, CASE WHEN user_id % 3 <> 0 AND title = 'pay 2' THEN 'done' ELSE 'pending' END AS status FROM items""",
)
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of some users made anew, those of others updated; updates of unknown status are refused."""
    new = stash(items(spark, sf_dir), "items")  # read four times below
    updates = new.where("title = 'pay 2'").select("user_id", "id", F.lit("done").alias("status")).unionByName(new.where("title = 'pay 1'").select("user_id", "id", F.lit("lost").alias("status")))
    stored, _ = checklist.update_status(new.withColumn("description", F.lit("old")), updates)
    some = new.where(F.col("user_id") % 3 == 0)
    out = checklist.replace_items(stored, some.select("user_id"), some)
    return out.select("user_id", "id", "title", (F.col("description") != "old").alias("renewed"), "status")


# Each field's value at an event is the last that was sent up to it.
HISTORY_SQL = f"""
    e AS (SELECT user_id + 1 AS user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN CAST(20 + event_id % 5 AS INT) END AS age, CASE WHEN event_id % 3 = 1 THEN CAST(event_id % 2 AS INT) WHEN event_id % 3 = 2 THEN CAST(event_id % 3 AS INT) END AS dependents,
        CASE WHEN event_id % 3 = 2 THEN event_type END AS occupation_type FROM events WHERE user_id + 1 IN (SELECT user_id FROM profiles)),
    a AS (SELECT user_id, NULL::TIMESTAMP AS ts, age, dependents, occupation_type, TRUE AS start FROM profiles UNION ALL SELECT user_id, ts, age, dependents, occupation_type, FALSE FROM e),
    f AS (SELECT user_id, ts, start, last_value(age IGNORE NULLS) OVER w AS age, last_value(dependents IGNORE NULLS) OVER w AS dependents, last_value(occupation_type IGNORE NULLS) OVER w AS occupation_type FROM a
        WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, lag(age) OVER w IS DISTINCT FROM age AS d1, lag(dependents) OVER w IS DISTINCT FROM dependents AS d2, lag(occupation_type) OVER w IS DISTINCT FROM occupation_type AS d3 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST)),
    history AS (SELECT user_id, ts, age, dependents, occupation_type, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST) AS version,
        CASE WHEN start THEN 'age,dependents,occupation_type' ELSE array_to_string(list_filter([CASE WHEN d1 THEN 'age' END, CASE WHEN d2 THEN 'dependents' END, CASE WHEN d3 THEN 'occupation_type' END], lambda x: x IS NOT NULL), ',') END AS changed_fields
        FROM g WHERE start OR d1 OR d2 OR d3)"""
CHANGING = ["age", "dependents", "occupation_type"]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.apply_changes(V.profiles(spark, sf_dir), V.changes(spark, sf_dir), CHANGING)


@query("h2_profile_history", f"WITH {V.PROFILES_SQL}, {HISTORY_SQL} SELECT user_id, CAST(version AS INT) AS version, changed_fields, age, dependents, occupation_type FROM history")
def profile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every profile."""
    return history(spark, sf_dir).withColumn("changed_fields", F.array_join("changed_fields", ",")).drop("ts")


@query(
    "h9_removed_users",
    f"""WITH {V.PROFILES_SQL}, {HISTORY_SQL}, {TRAITS_SQL}, {ITEMS_SQL}, known AS (SELECT user_id FROM profiles)
    SELECT 'users' AS table_name, user_id, count(*) AS n FROM profiles WHERE user_id % 7 <> 0 GROUP BY 2 UNION ALL SELECT 'profiles', user_id, count(*) FROM profiles WHERE user_id % 7 <> 0 GROUP BY 2
    UNION ALL SELECT 'history', user_id, count(*) FROM history WHERE user_id % 7 <> 0 GROUP BY 2 UNION ALL SELECT 'traits', user_id, count(*) FROM traits WHERE user_id % 7 <> 0 GROUP BY 2
    UNION ALL SELECT 'items', user_id, count(*) FROM items JOIN known USING (user_id) WHERE user_id % 7 <> 0 GROUP BY 2 UNION ALL SELECT 'left behind', NULL, 0""",
)
def removed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: users removed with all that hangs on them; the rows left by table and user, and how many of any table hang on nothing."""
    p = V.profiles(spark, sf_dir)
    own = items(spark, sf_dir).join(p.select("user_id").hint("shuffle_hash"), "user_id", "left_semi")
    tables = {"users": p.select("user_id", "username"), "profiles": p, "history": history(spark, sf_dir), "traits": profiles.trait_rows(p), "items": own}
    left = profiles.removed_with(tables, p.where("user_id % 7 = 0").select("user_id"))
    counts = [rows.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "user_id", "n") for name, rows in left.items()]
    kept = stash(reduce(DataFrame.unionByName, counts), "kept")  # read twice below
    lone = profiles.left_behind({name: kept.where(F.col("table_name") == name) for name in left}, rows="n")
    return kept.unionByName(lone.agg(F.lit("left behind").alias("table_name"), F.lit(None).cast("long").alias("user_id"), F.sum("n").alias("n")))


@query("h3_current_profiles", f"WITH {V.PROFILES_SQL}, {HISTORY_SQL} SELECT user_id, CAST(max(version) AS INT) AS version, arg_max({{'v': age}}, version).v AS age, arg_max({{'v': occupation_type}}, version).v AS occupation_type FROM history GROUP BY 1")
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: each profile as it is."""
    return profiles.current(history(spark, sf_dir)).select("user_id", "version", "age", "occupation_type")


@query(
    "h8_invariants",
    """SELECT 'username' AS key, count(*) AS repeated FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'nation', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)""",
)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come more than once."""
    c = V.table(spark, sf_dir, "customer")
    each = [profiles.repeated_keys(c, k).agg(F.lit(n).alias("key"), F.count("*").alias("repeated")) for k, n in (("c_name", "username"), ("c_nationkey", "nation"))]
    return each[0].unionByName(each[1])


@query(
    "s4_detail_documents",
    f"""WITH regions AS (SELECT page_id, html AS part, CASE WHEN page_id % 4 = 0 THEN 'Hết hiệu lực toàn bộ' WHEN page_id % 4 = 1 THEN 'Còn hiệu lực' WHEN page_id % 4 = 2 THEN '' ELSE 'other' END AS st, page_id % 5 = 0 AS empty FROM pages),
    {LINES_SQL}, d AS (SELECT *, CASE WHEN st <> '' AND st <> 'Còn hiệu lực' THEN 'status' WHEN empty OR part IS NULL OR part = '' THEN 'no content' WHEN len(l) = 0 THEN 'no text' END AS reason FROM c)
    SELECT coalesce(reason, 'document') AS outcome, CASE WHEN reason IS NULL THEN 'vbpl-' ELSE '' END || page_id AS doc_id, 'Luật thuế ' || page_id AS title, CASE WHEN reason IS NULL THEN 'Luật thuế ' || page_id || ' (' || page_id || '/ND)' END AS law_name,
        CASE WHEN reason IS NULL THEN 'tax' END AS category, CASE WHEN reason IS NULL THEN '2024-01-01' END AS effective_from, CASE WHEN reason IS NULL THEN md5(array_to_string(l, chr(10))) END AS text FROM d""",
)
def detail_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail records of several spellings; those out of force or without content are told apart."""
    i = F.col("page_id").cast("string")
    n = F.col("page_id")
    status = F.when(n % 4 == 0, "Hết hiệu lực toàn bộ").when(n % 4 == 1, "Còn hiệu lực").when(n % 4 == 2, "").otherwise("other")
    body = F.when(n % 5 != 0, F.col("html"))
    none = F.lit(None).cast("string")
    rows = V.table(spark, sf_dir, "pages").select(
        F.when(n % 2 == 0, i).alias("id"), i.alias("docId"), none.alias("docNum"), F.concat(i, F.lit("/ND")).alias("docNumber"), F.lit("").alias("title"), F.concat(F.lit("Luật thuế "), i).alias("docName"), none.alias("name"),
        F.when(n % 3 == 0, status).alias("effStatus"), status.alias("effectStatus"), none.alias("effFrom"), F.lit("2024-01-01").alias("effectiveFrom"), none.alias("effTo"), none.alias("effectiveTo"),
        F.struct(F.when(n % 3 == 1, body).alias("content")).alias("documentContent"), body.alias("content"),
    )
    docs, rest = S.documents_of_details(S.detail_fields(rows))
    good = docs.select(F.lit("document").alias("outcome"), "doc_id", "title", "law_name", "category", "effective_from", F.md5("raw_text").alias("text"))
    return good.unionByName(rest.select(F.col("reason").alias("outcome"), F.col("id").alias("doc_id"), "title"), allowMissingColumns=True)


@query(
    "z5_generate_checklist",
    f"""WITH {V.PROFILES_SQL}, {TRAITS_SQL}, {V.CHUNKS_SQL}, {QUERIES_SQL}, asks AS (SELECT m.*, {ASKED_TEXT} AS query_text, CASE WHEN list_contains(tags, 'small_business_owner') THEN 'business' ELSE 'individual' END AS entity_type, p.province FROM m JOIN profiles p USING (user_id)),
    q AS (SELECT DISTINCT category || '|' || query_text || '|' || entity_type || '|' || coalesce(province, '') AS query_id, category, query_text, entity_type, province FROM asks WHERE category IN (SELECT category FROM chunks)), {BM25_SQL}, {VECTOR_SQL},
    v AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM near WHERE rank <= 5 AND sees), {FUSED_SQL},
    h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, br NULLS LAST, vr NULLS LAST) AS rank FROM fused)
    SELECT user_id, a.category, chunk_id AS source_chunk_id, 'Law ' || (CAST(chunk_id[2:] AS BIGINT) % 100) AS law, '2024-07-20' AS due_date FROM asks a
        JOIN h ON h.query_id = a.category || '|' || a.query_text || '|' || a.entity_type || '|' || coalesce(a.province, '') JOIN chunks c USING (chunk_id) WHERE rank <= 3 AND regexp_matches(c.text, 'ar')""",
)
def generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklists of all users from their profiles, by the extractor that needs no model: a sentence with the letters `ar` is a duty."""
    p = V.profiles(spark, sf_dir)
    users = profiles.sorted_traits(profiles.trait_rows(p)).join(p.select("user_id", "province"), "user_id")
    new = checklist.generate_for_users(profiles.category_queries(users), V.chunks(spark, sf_dir), F.lit(TODAY).cast("date"), extractor=partial(checklist.rule_extractor, duty="ar"))
    return new.select("user_id", "category", "source_chunk_id", F.regexp_extract("source_citation", r"^(.*?),", 1).alias("law"), F.col("due_date").cast("string").alias("due_date"))
