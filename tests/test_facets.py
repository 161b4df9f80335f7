"""Places, areas and the document store: against plain loops."""

import random

from pyspark.sql import functions as F

from statuta.operators import facets, obligations

DOCS = "doc_name string, scope string, issuing_authority string, legal_area string, title string, text string, markdown string, structure_json string"


def test_contained_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None, ""]
    terms = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 3))) for _ in range(30)] + [None, ""]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "x string")
    want = {(x, t) for x in texts for t in terms if x is not None and t is not None and t in x}
    for n in (50_000, 4):
        monkeypatch.setattr(facets, "AT_ONCE", n)
        got = [tuple(r) for r in facets.contained(frame(texts), frame(terms)).collect()]
        assert set(got) == want and len(got) == len(want)
    assert facets.contained(frame(texts), frame([])).count() == 0 == facets.contained(frame([]), frame(terms)).count()


def corpus(spark):
    rng, places = random.Random(2), ["Hà Nội", "Hà", "Huế", "An Giang"]
    rows = []
    for i in range(120):
        scope = rng.choice(["trung_uong", "dia_phuong", "dia_phuong", "khac", None])
        text = None if rng.random() < 0.3 else " ".join(rng.choice(["thuế", "đất", "nhà", "xe", "phép"]) for _ in range(rng.randint(0, 9)))
        authority = None if rng.random() < 0.1 else f"UBND tỉnh {rng.choice(places)}"
        rows.append((f"d{i}", scope, authority, rng.choice([None, "", "Chưa phân loại", "Thuế và phí", "Đất đai"]), f"t{i}", text, text, None))
    return rows, spark.createDataFrame(rows, DOCS)


QUESTIONS = [(1, "thuế đất", "tỉnh Hà Nội", ["Thuế", ""]), (2, "nhà xe", None, ["đất"]), (3, "xe", "Thành phố Huế ", ["thuế", "ĐẤT"]), (4, "thuế đất", "HÀ NỘI", ["Thuế", ""]), (5, "none", "Mỹ", [])]


def inside(doc, province):
    name = (province or "").strip().lower().removeprefix("tỉnh ").removeprefix("thành phố ").strip()
    return doc[1] == "trung_uong" or doc[1] == "dia_phuong" and province is not None and doc[2] is not None and name in doc[2].lower()


def test_searches_stay_within_the_jurisdiction(spark):
    rows, docs = corpus(spark)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query_text string, province string, keywords array<string>")
    store = facets.DocumentStore(docs.select("doc_name", "scope", "issuing_authority", "text"), asked)
    want = {(q, d[0]) for q, _, p, _ in QUESTIONS for d in rows if inside(d, p)}
    assert sorted(map(tuple, store.by_jurisdiction().collect())) == sorted(want)
    words, near = ([tuple(r) for r in found.collect()] for found in (store.search_fulltext(200), store.search_embeddings(200)))
    bodies = {d[0] for d in rows if d[5] is not None}
    assert sorted((q, d) for q, d, _ in words) == sorted((q, d) for q, d in want if d in bodies) == sorted((q, d) for q, d, _ in near)
    few = store.search_embeddings(4)
    best = {q: sorted(((-s, d) for x, d, s in near if x == q))[:4] for q, *_ in QUESTIONS}
    assert sorted((r.query_id, -r.score, r.doc_name) for r in few.collect()) == sorted((q, s, d) for q, rows_ in best.items() for s, d in rows_)
    assert {r.doc_name for r in store.get(spark.createDataFrame([("d1",), ("d1",), ("no",)], "doc_name string")).collect()} == {"d1"}


def test_documents_without_a_body_by_key(spark):
    rows, docs = corpus(spark)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query_text string, province string, keywords array<string>")
    none = spark.createDataFrame([], "query_id long, doc_name string, title string, coverage_total double, unresolved boolean, chain array<string>, candidate string")
    gaps = obligations.gaps(asked.select("query_id", "province", "keywords"), docs.drop("text"), none)
    assert "NestedLoop" not in gaps._jdf.queryExecution().executedPlan().toString()

    def may(d, keywords):
        tagged = bool(d[3]) and d[3] != "Chưa phân loại"
        return not tagged or any(k and k.lower() in d[3].lower() for k in keywords)

    want = {(q, d[0]) for q, _, p, k in QUESTIONS for d in rows if inside(d, p) and (d[6] is None or not d[6].strip()) and may(d, k)}
    got = [(r.query_id, r.doc_name) for r in gaps.where(F.col("kind") == "null_markdown_match").collect()]
    assert set(got) == want and len(got) == len(want)
