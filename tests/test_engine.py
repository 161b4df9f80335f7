"""Retrieval, consolidation, profiles, checklists, store and streams on small tables."""

import datetime as dt
import json
import math
import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import checklist, consolidation, profiles, retrieval
from statuta.sources import corpus, models
from statuta.sources.store import ChunkStore
from statuta.streaming import ingest

CHUNKS = "chunk_id string, category string, entity_type string, province_scope string, text string, law_name string, article_number string"
ASKED = "query_id int, category string, query_text string, entity_type string, province string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("a", "tax", "both", "national", "thuế thu nhập cá nhân", "L1", "1"), ("b", "tax", "both", "national", "đăng ký kinh doanh", "L2", "2"), ("c", "tax", "both", "national", "giao thông đường bộ", "L3", "3"),
        ("d", "tax", "business", "national", "thuế doanh nghiệp", "L4", "4"), ("e", "tax", "both", "Phú Thọ", "thuế địa phương", "L5", "5"), ("f", "labor_insurance", "both", "national", "thuế thuế thuế", "L6", "6"),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def brute_bm25(docs, query):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return {c: sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query) for c, t in docs.items()}


def test_bm25_sees_only_what_the_user_may(spark, chunks):
    asked = spark.createDataFrame([(1, "tax", "thue thuế", "individual", None), (2, "tax", "thuế", "business", "Phú Thọ"), (3, "family_civil", "thuế", "individual", None), (4, "tax", "thuế", "individual", "Hà Nam")], ASKED)
    got = retrieval.bm25_top(asked, chunks).collect()
    seen = {q: sorted(r.chunk_id for r in got if r.query_id == q) for q in (1, 2, 3, 4)}
    assert seen == {1: ["a", "b", "c"], 2: ["a", "b", "c", "d", "e"], 3: [], 4: ["a", "b", "c"]}
    from statuta.functions.text import tokenize

    tok = {r.chunk_id: r.t for r in chunks.select("chunk_id", tokenize(F.col("text")).alias("t")).collect()}
    want = brute_bm25({c: tok[c] for c in "abc"}, ["thue", "thuế"])
    assert all(abs(r.bm25 - want[r.chunk_id]) < 1e-6 for r in got if r.query_id == 1)
    assert [r.chunk_id for r in sorted((r for r in got if r.query_id == 1), key=lambda r: r["rank"])] == ["a", "b", "c"]


def test_retrieval_paths(spark, chunks):
    asked = spark.createDataFrame([(1, "tax", "thuế thu nhập", "individual", None), (2, "family_civil", "x", "individual", None)], ASKED)
    for semantic in (False, True):
        got = retrieval.retrieve(asked, chunks, semantic).orderBy("rank").collect()
        assert got[0].chunk_id == "a" and {r.chunk_id for r in got} <= set("abc") and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    near = retrieval.vector_top(asked, chunks, 2).collect()
    assert len(near) == 2 and all(r.query_id == 1 for r in near)
    every = retrieval.search_all_categories(asked.drop("category").where("query_id = 1"), chunks)
    assert {r.category for r in every.collect()} == {"tax", "labor_insurance"}
    told = {r.query_id: r.answer for r in retrieval.answer_text(every, chunks.drop("category"), asked).collect()}
    assert told[1].startswith("Source: L") and "\n\n---\n\n" in told[1] and told[2].startswith("No relevant")


def plain_bm25(query, texts):
    """Scores of the texts (id to text) for a query, by the formula."""
    import math

    docs = {i: (t or "").lower().split() for i, t in texts.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(idf.values()) / max(1, len(idf))
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        out[i] = round(sum((floor if idf[w] < 0 else idf[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in query.lower().split() if tf[w]), 9)
    return out


CHUNK = "chunk_id string, category string, entity_type string, province_scope string, text string"
ASK = "query_id int, category string, query_text string, entity_type string, province string"


def test_a_chunk_without_a_query_word_stands_before_negative_scores(spark):
    chunks = spark.createDataFrame([(f"c{i}", "tax", "both", None, "x") for i in range(3)] + [("d", "tax", None, "national", "")], CHUNK)
    queries = spark.createDataFrame([(1, "tax", "x", "individual", None)], ASK)
    assert [(r.chunk_id, r.bm25) for r in retrieval.bm25_top(queries, chunks, 1).collect()] == [("d", 0.0)]


def test_bm25_against_the_formula(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS_AT_ONCE", 7)
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    rng = random.Random(17)
    word = lambda: rng.choice("abcdefg")
    rows = [(f"c{i:02d}", rng.choice(["tax", "labor_insurance"]), rng.choice(["both", "individual", "business", None]), rng.choice(["national", None, "P1", "P2"]), " ".join(word() for _ in range(rng.choice((0, 1, 2, 9))))) for i in range(60)]
    asks = [(i, rng.choice(["tax", "labor_insurance"]), " ".join([word(), word(), "zz"][: rng.randint(0, 3)]), rng.choice(["individual", "business"]), rng.choice(["P1", "P2", None])) for i in range(24)]
    chunks, queries = spark.createDataFrame(rows, CHUNK).repartition(3), spark.createDataFrame(asks, ASK)
    got = {}
    for r in retrieval.bm25_top(queries, chunks, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.bm25))
    for i, category, text_, entity, province in asks:
        seen = {c: t for c, cat, e, p, t in rows if cat == category and e in ("both", None, entity) and (p in ("national", None) or p == province)}
        want = sorted(plain_bm25(text_, seen).items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [(k, c, pytest.approx(s)) for k, (c, s) in enumerate(want, 1)] == sorted(got.get(i, []))
    pool = queries.select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.struct(F.concat(F.lit("c"), F.lpad(((k * 7 + F.col("query_id")) % 60).cast("string"), 2, "0")).alias("chunk_id"), (k + 1).cast("int").alias("rank")))).alias("p")).select("query_id", "p.*")
    texts, pooled = {r[0]: r[4] for r in rows}, {}
    for r in retrieval.bm25_in_pool(queries, pool, chunks, 4).collect():
        pooled.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.bm25))
    for i, _, text_, _, _ in asks:
        own = [f"c{(k * 7 + i) % 60:02d}" for k in range(30)]
        scores = plain_bm25(text_, {c: texts[c] for c in own})
        want = sorted(own, key=lambda c: (-scores[c], own.index(c)))[:4]
        assert [(k, c, pytest.approx(scores[c])) for k, c in enumerate(want, 1)] == sorted(pooled[i])


def test_nearest_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS_AT_ONCE", 11)
    monkeypatch.setattr(retrieval, "AT_ONCE", 4)
    v = np.random.default_rng(5).normal(size=(90, 6))
    v[40:50] = v[3]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"v{i:02d}", None, v[i].tolist()) for i in range(90)], "chunk_id string, category string, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(i, None, v[i].tolist()) for i in range(0, 90, 9)], "query_id int, category string, vector array<double>")
    got = {}
    for r in retrieval.nearest_vectors(asked, rows, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    for i in range(0, 90, 9):
        near = np.round(v @ v[i], 9)
        assert [c for _, c in sorted(got[i])] == [f"v{j:02d}" for j in sorted(range(90), key=lambda j: (-near[j], j))[:5]]


def test_fusion_and_reranking(spark):
    lists = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "y")], "list_id int, rank int, chunk_id string")
    got = dict(retrieval.rrf(lists, "chunk_id").collect())
    assert got == {"x": round(1 / 61, 12), "y": round(1 / 62 + 1 / 61, 12)}
    hits = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcd")], "query_id int, chunk_id string, rank int")
    order = lambda ids, k=5: [r.chunk_id for r in retrieval.rerank(hits, spark.createDataFrame([(1, ids)], "query_id int, ranked_chunk_ids array<string>"), k).orderBy("rank").collect()]
    assert order(["c", "zz", "c", "a"]) == ["c", "a", "b", "d"] and order([], 2) == ["a", "b"]


def walk(name, pointer, edges, names):
    if pointer:
        return (pointer, [name, pointer], 0.95, False) if pointer in names else (name, [name], 0.0, True)
    chain, sure, at = [name], 1.0, name
    for _ in range(5):
        own = [e for e in edges if e[0] == at]
        up, gone = [e for e in own if e[2] in ("amend", "replace")], [e for e in own if e[2] == "repeal"]
        if not up:
            return at, chain, sure, bool(gone)
        _, _, _, target, c = min(up, key=lambda e: e[1])
        if not target or target in chain or target not in names:
            return at, chain, sure, True
        sure *= 0.75 if c is None else c
        chain.append(target)
        at = target
    return at, chain, sure, True


def test_consolidation(spark):
    rng = random.Random(5)
    names = [f"d{i}" for i in range(120)]
    pointers = {n: rng.choice(names + ["gone"]) if rng.random() < 0.1 else None for n in names}
    edges = [(n, k, rng.choice(["amend", "replace", "repeal", "cites"]), rng.choice([*names, None, "dead"]), rng.choice([None, 0.5, 0.9])) for n in names for k in range(rng.randint(0, 3))]
    docs = spark.createDataFrame(list(pointers.items()), "doc_name string, pointer string")
    refs = spark.createDataFrame(edges, "src string, pos int, relation string, target string, confidence double")
    for r in consolidation.consolidate(docs, refs).collect():
        at, chain, sure, unresolved = walk(r.doc_name, pointers[r.doc_name], edges, set(names))
        assert (r.effective, r.chain, r.unresolved) == (at, chain, unresolved) and abs(r.confidence - sure) < 1e-9


PROFILE = "user_id string, username string, age int, gender string, marital_status string, province string, dependents int, occupation_type string, has_business boolean, business_sector string, owns_property boolean, owns_vehicle boolean"


def test_profiles(spark):
    rows = [("u1", "ann", 30, "f", "married", "Phú Thọ", 2, "trader", True, "food", True, False), ("u2", "bob", *[None] * 10)]
    p = spark.createDataFrame(rows, PROFILE)
    tags = {r.user_id: r.tags for r in profiles.sorted_traits(profiles.trait_rows(p)).collect()}
    assert tags == {"u1": sorted(["trader", "small_business_owner", "business_sector_food", "has_dependents", "marital_married", "property_owner", "resident_of_Phú Thọ"])}
    users = p.select("user_id", "province").join(profiles.sorted_traits(profiles.trait_rows(p)), "user_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    got = profiles.category_queries(users).collect()
    assert sum(r.user_id == "u2" for r in got) == 4 and sum(r.user_id == "u1" for r in got) == 7
    text = {r.category: r.query_text for r in got if r.user_id == "u1"}
    assert text["family_civil"].endswith("đối với has_dependents, marital_married, business_sector_food") and all(r.entity_type == "business" for r in got if r.user_id == "u1")
    fresh, refused = profiles.create_profiles(p.unionByName(p.where("user_id = 'u1'").withColumn("user_id", F.lit("u9"))), spark.createDataFrame([("bob",)], "username string"))
    assert [r.user_id for r in fresh.collect()] == ["u1"] and sorted(r.user_id for r in refused.collect()) == ["u2", "u9"]
    t = lambda k: dt.datetime(2024, 1, k)
    feed = spark.createDataFrame([("u1", t(2), {"age": "31"}), ("u1", t(3), {"age": "31", "gender": "f"}), ("u1", t(4), {"province": "Hà Nội", "age": "31"}), ("zz", t(1), {"age": "1"})], "user_id string, ts timestamp, changes map<string,string>")
    h = profiles.apply_changes(p, feed)
    assert [(r.version, r.changed_fields) for r in h.where("user_id = 'u1'").orderBy("version").collect()][1:] == [(2, ["age"]), (3, ["province"])]
    now = {r.user_id: (r.version, r.age, r.province) for r in profiles.current(h).collect()}
    assert now == {"u1": (3, 31, "Hà Nội"), "u2": (1, None, None)}
    bad = spark.createDataFrame([("u", "n", 130), ("v", "", 3), ("w", "ok", None)], "user_id string, username string, age int")
    good, wrong = profiles.checked_profiles(bad)
    assert [r.user_id for r in good.collect()] == ["w"] and wrong.count() == 2


def test_checklist(spark):
    reply = {"obligations": [{"title": "Nộp thuế", "description": "d", "deadline_type": "fixed", "deadline_month": 6, "deadline_day": 15, "penalty_summary": "p"}, {"title": "no type", "description": "d", "penalty_summary": "p"}]}
    rows = [("c1", "thuế", "L", "5", 1, 3), ("c2", "không", "L", "6", 0, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, law_name string, article_number string, part_index int, part_count int")
    hits = spark.createDataFrame([("q1", "c1", 1), ("q1", "c2", 2), ("q2", "c1", 4)], "query_id string, chunk_id string, rank int")
    queries = spark.createDataFrame([("q1", "u1", "tax"), ("q2", "u2", "tax")], "query_id string, user_id string, category string")
    today = F.lit("2026-01-01").cast("date")
    new = checklist.generate(hits, queries, chunks, lambda t, c: json.dumps(reply) if t == "thuế" else "nonsense", today)
    [item] = new.collect()
    assert (item.user_id, item.due_date, item.source_citation, item.status) == ("u1", dt.date(2026, 6, 15), "L, Điều 5 (part 2/3)", "pending")
    stored, refused = checklist.update_status(new, spark.createDataFrame([("u1", item.id, "done"), ("u2", item.id, "done"), ("u1", item.id, "lost")], "user_id string, id string, status string"))
    assert stored.first().status == "done" and refused.count() == 2
    assert checklist.replace_items(stored, queries.select("user_id"), new).first().status == "pending"
    assert checklist.replace_items(stored, queries.select("user_id"), new, preserve_status=True).first().status == "done"
    ask = spark.createDataFrame([(1, "u1", "THUẾ"), (2, "u2", "thuế")], "request_id int, user_id string, title_contains string")
    out, told = checklist.mark_done(new, ask)
    assert out.first().status == "done" and {r.request_id: r.n for r in told.collect()} == {1: 1, 2: 0}
    assert checklist.pending(new, today, 10).count() == 0 and checklist.pending(new, today, 200).count() == 1
    lines = {r.user_id: r.message for r in checklist.status_text(queries, new, today).collect()}
    assert lines["u1"].startswith("- [tax] Nộp thuế — due 2026-06-15") and lines["u2"] == "No pending checklist items."
    found = {r.user_id: r.found for r in checklist.stored_items(queries.select("user_id"), spark.createDataFrame([("u1",), ("u7",)], "user_id string"), new).collect()}
    assert found == {"u1": True, "u7": False}


def docs(spark, *rows):
    return spark.createDataFrame([(i, i, t, "L", "tax", "both", None, None, None, None) for i, t in rows], "doc_id string, title string, raw_text string, law_name string, category string, entity_type string, province_scope string, effective_from string, effective_to string, source_url string")


def test_ingest_is_idempotent(spark):
    seen = []
    store = ChunkStore(spark, tempfile.mkdtemp(dir="/tmp", prefix="spark-"), embed=lambda rows: seen.append(rows.count()) or models.hashing(rows), sync_deletes=True)
    first = docs(spark, ("d", "Điều 1. a\nx\nĐiều 2. b\ny"))
    assert ingest.ingest(first, store)[0] == {"written": 2, "skipped": 0, "total": 2} and store.count() == 2
    assert ingest.ingest(first, store)[0] == {"written": 0, "skipped": 2, "total": 2}
    assert ingest.ingest(docs(spark, ("d", "Điều 1. a\nx\nĐiều 2. b\nz"), ("e", "Điều 1. q\nr")), store)[0] == {"written": 2, "skipped": 1, "total": 3}
    assert store.count() == 3 and seen == [2, 2] and len(store.chunks().first().embedding) == 256
    ingest.ingest(docs(spark, ("d", "Điều 1. a\nx")), store)
    assert {r.chunk_id for r in store.chunks().collect()} == {"d:dieu1", "e:dieu1"}
    store.delete_documents(spark.createDataFrame([("d",)], "document_id string"))
    assert [r.chunk_id for r in store.by_category("tax").collect()] == ["e:dieu1"]
    good, bad = corpus.validated(docs(spark, ("x", "")).withColumn("category", F.lit("nope")))
    assert good.count() == 0 and bad.count() == 1


def test_streams_resume(spark):
    root = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    row = lambda n, t: (n, "Luật thuế " + n, "luat", "Luật", "trung_uong", "Quốc hội", [n], None, "2020-01-01", t, None, None, None, None, None)
    put = lambda *rows: spark.createDataFrame(list(rows), corpus.CORPUS).write.mode("append").parquet(root + "/in")
    store = ChunkStore(spark, root + "/store")
    run = lambda: ingest.ingest_stream(spark, root + "/in", root + "/ck", store, root + "/bad").awaitTermination()
    put(row("a", "Chương I X Điều 1. m Điều 2. n"), row("b", None))
    run()
    assert store.count() == 2 and spark.read.parquet(root + "/bad").count() == 1
    put(row("c", "Điều 1. z"))
    run()
    run()
    assert store.count() == 3
    assert [(r.reason, r.attempt) for r in ingest.open_letters(spark, root + "/bad").collect()] == [("body", 1)]
    mended = spark.createDataFrame([row("b", "Điều 1. now"), row("zz", "Điều 1. not asked for")], corpus.CORPUS)
    assert ingest.retry(spark, root + "/bad", store, mended, "first").count() == 0 and store.count() == 4
    assert ingest.retry(spark, root + "/bad", store, mended, "first").count() == 0 and ingest.retry(spark, root + "/bad", store, mended, "second").count() == 0
    assert store.count() == 4 and spark.read.parquet(root + "/bad").where("run = 'second'").count() == 0


def test_sources(spark):
    root = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    with open(root + "/law.txt", "w", encoding="utf-8") as f:
        f.write("Luật A\nĐiều 1. b")
    assert [tuple(r) for r in corpus.read_texts(spark, root + "/law.txt").collect()] == [("law", "Luật A", "Luật A\nĐiều 1. b")]
    with open(root + "/details.json", "w", encoding="utf-8") as f:
        f.write(json.dumps({"docId": "7", "docName": "Luật thuế", "effectStatus": "Còn hiệu lực", "documentContent": {"content": "<p>a</p>"}}) + "\n" + json.dumps({"id": "8", "title": "T", "content": "<p>b</p>", "effStatus": "other"}) + "\n")
    docs_, rest = corpus.documents_of_details(corpus.detail_fields(corpus.read_details(spark, root + "/details.json")))
    assert [(r.doc_id, r.title, r.raw_text, r.category) for r in docs_.collect()] == [("vbpl-7", "Luật thuế", "a", "tax")] and [(r.id, r.reason) for r in rest.collect()] == [("8", "status")]
    pages = spark.createDataFrame([(None, [(1, None), (None, "x"), (None, None)]), ([("7", "8")], None)], "items array<struct<id:string,docId:string>>, data array<struct<id:string,docId:string>>")
    assert sorted(r[0] for r in corpus.listing_ids(pages).collect()) == ["1", "7", "x"]
    specs = spark.createDataFrame([("u1", "d1", "article", None), ("u2", "d2", "article", None), ("u3", "d3", None, "tax")], "url string, doc_id string, region string, category string").select("*", *(F.lit(None).cast("string").alias(c) for c in ("title", "law_name", "entity_type", "province_scope", "effective_from", "effective_to")))
    html = spark.createDataFrame([("u1", "<nav>n</nav><article><p>Luật lao động</p></article>"), ("u2", "<p>none</p>"), ("u3", "<p>x</p>")], "url string, html string")
    got = {r.doc_id: (r.raw_text, r.category) for r in corpus.documents_of_pages(html, specs).collect()}
    assert got == {"d1": ("Luật lao động", "labor_insurance"), "d3": ("x", "tax")}


def test_registered_queries_have_sql():
    import __spark_entry__ as e
    from statuta import registry

    assert set(registry.queries()) == set(registry.oracle_sql()) <= set(e.queries())


def test_views_of_the_same_cells_share_their_frequencies(spark, chunks):
    """Provinces without law of their own see what all see: of two hundred of them, one lens adds up the vocabulary."""
    asked = spark.createDataFrame([(i, "tax", "thuế", "individual", f"P{i}") for i in range(200)] + [(200, "tax", "thuế", "individual", "Phú Thọ")], ASKED)
    own, views = retrieval.tokenized(chunks), retrieval.views(asked)
    sent = []
    plain = spark.sparkContext.broadcast
    spark.sparkContext.broadcast = lambda x: sent.append(x) or plain(x)
    try:
        seen, _ = retrieval.corpus_statistics(own, views, asked.selectExpr("'thuế' as token").distinct())
    finally:
        del spark.sparkContext.broadcast
    assert [len(x) for x in sent if isinstance(x, dict)] == [2] and seen.count() == 201
    tokens = {r.chunk_id: r.tokens for r in own.where("category = 'tax'").collect()}
    for shown, n in (("abc", 200), ("abce", 1)):
        df = Counter(t for c in shown for t in set(tokens[c]))
        floor = 0.25 * sum(math.log(len(shown) - k + 0.5) - math.log(k + 0.5) for k in df.values()) / len(df)
        assert seen.where(F.abs(F.col("floor") - floor) < 1e-9).where(F.col("n") == len(shown)).count() == n


def test_histograms_add_up_words_that_batches_cut(spark):
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((w, c, rng.randint(1, 9)) for w in range(60) for c in (7, 8, 9) if rng.random() < 0.7)
    lenses = {1: [7], 2: [7, 8, 9], 3: [8, 11], 4: [12]}
    want = {lens: Counter(v for v in (sum(d for w, c, d in rows if w == word and c in cells) for word in range(60)) if v) for lens, cells in lenses.items()}
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size])], ["word", "cell", "df"]) for i in range(0, len(rows), size)]
        got = {lens: Counter() for lens in lenses}
        for out in retrieval._histograms(iter(batches), lenses):
            for r in out.to_pylist():
                got[r["lens"]][r["df"]] += r["times"]
        assert got == want


def test_users_come_to_what_their_question_found(spark, chunks):
    """Users who ask the same are joined to the items of their question at the end; no query text and no hit is dealt out for each user."""
    asked = spark.range(500).selectExpr("concat(id, '|tax') as query_id", "id as user_id", "'tax' as category", "'thuế' as query_text", "'individual' as entity_type", "cast(null as string) as province")
    given = chunks.selectExpr("*", "0 as part_index", "1 as part_count")
    got = checklist.generate_for_users(asked, given, F.lit("2024-05-15").cast("date"), extractor=lambda t, c: checklist.rule_extractor(t, c, duty="thuế"))
    assert got.count() == 500 and {r.source_chunk_id for r in got.select("source_chunk_id").distinct().collect()} == {"a"}
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_before_anything_is_shuffled(spark, chunks, monkeypatch):
    """Tokens are nowhere written, and a task gives one count for a word and a cell, however many chunks hold the word."""
    written = []
    plain = retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    asked = spark.createDataFrame([(1, "tax", "thuế", "individual", None)], ASKED)
    many = spark.range(100, numPartitions=1).selectExpr("concat('c', id) as chunk_id", "'tax' as category", "'both' as entity_type", "cast(null as string) as province_scope", "concat('thuế ', id % 3) as text")
    assert retrieval.bm25_top(asked, many.coalesce(1)).count() == 5
    assert "chunk-tokens" not in dict(written)
    told = dict(written)["word-frequencies"].where("word is not null")
    rows = told.groupBy("word").agg(F.sum("df").alias("df"), F.count("*").alias("rows")).collect()
    assert sorted(r.df for r in rows) == [33, 33, 34, 100, 100] and max(r.rows for r in rows) <= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("pairs, size", [(4_000_000, 1000), (9, 2), (3, 1)])
def test_counts_given_away_in_parts_add_up(monkeypatch, pairs, size):
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "PAIRS_HELD", pairs)
    rng = random.Random(1)
    rows = [("tax", "both", rng.choice(["national", "P1"]), " ".join(rng.choice("abcdefé") for _ in range(rng.randint(0, 9)))) for _ in range(40)] + [("tax", "both", "P1", None)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in list(zip(*some))[:3]] + [pa.array([len(r[2]) for r in some], pa.int64()), pa.array([r[3] for r in some], pa.string())], ["category", "entity_type", "province_scope", "cell", "text"])
               for some in (rows[i : i + size] for i in range(0, len(rows), size))]
    got, totals = Counter(), {}
    for out in retrieval._counts(iter(batches)):
        for r in out.to_pylist():
            if r["word"] is None:
                totals[r["cell"]] = (r["df"], r["dl"], r["province_scope"])
            else:
                got[r["cell"], r["word"]] += r["df"]
    tokens = lambda t: (t or "").split() + ["e"] * ((t or "").count("é") if "e" not in (t or "") else 0)
    hashed = dict(zip("abcdefé", retrieval._hashes(list("abcdefé")).tolist()))
    assert got == Counter((len(r[2]), hashed[w]) for r in rows for w in set(tokens(r[3])))
    assert totals == {len(p): (sum(r[2] == p for r in rows), sum(len(tokens(r[3])) for r in rows if r[2] == p), p) for p in ("national", "P1")}
