"""Text, segmentation, classification, deadlines and citations on the cases that must hold."""

import datetime as dt
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from statuta.functions import citations, classify, deadlines, segment, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def parse(spark, raw, normalise=True):
    raw = one(spark, segment.normalize_markdown(F.lit(raw))) if normalise else raw
    d = spark.createDataFrame([("d", "t", raw)], "doc_id string, title string, raw_text string")
    return segment.articles(d).orderBy("article_seq").collect()


TWO = "Căn cứ\nChương I Quy định chung\nĐiều 1. Phạm vi\nNội dung\nĐiều 2. Đối tượng\nx\nChương II. Thuế\nbỏ\nĐiều 3. Mức\n1. a\n2. b\n"


def test_chapters_and_articles(spark):
    rows = parse(spark, TWO)
    assert [(r.chapter_number, r.article_number, r.article_title, r.body) for r in rows] == [("I", "1", "Phạm vi", "Nội dung"), ("I", "2", "Đối tượng", "x"), ("II", "3", "Mức", "1. a\n2. b")]
    assert [r.chapter_number for r in parse(spark, "Điều 1. a\nĐiều 2. b")] == [None, None]
    assert parse(spark, "") == [] and parse(spark, "Chương 4\nĐiều 9. z")[0].chapter_number == "4"


@pytest.mark.parametrize(
    ("raw", "numbers"),
    [
        ("Chương I Chung Điều 1. Một hai Điều 2. Ba Điều 3. Bốn", ["1", "2", "3"]),
        ("Điều 1. Theo quy định tại Điều 15 của Luật. Điều 2. b", ["1", "2"]),
        ("Điều 6. a Điều 7. quy định tại Điều 8 Luật ngân sách. Điều 8. c", ["6", "7", "8"]),
        ("Điều 1. a Điều 2. Sửa đổi, bổ sung Điều 3 Nghị định", ["1", "2"]),
        ("Điều 1. a\nĐiều 2. b\n", ["1", "2"]),
    ],
)
def test_headings_within_lines(spark, raw, numbers):
    assert [r.article_number for r in parse(spark, raw)] == numbers


def test_without_normalising_there_are_no_headings(spark):
    assert parse(spark, "Lời nói Điều 1. Một Điều 2. Ba", normalise=False) == []


def test_articles_against_a_plain_loop(spark):
    rng = random.Random(0)
    lines = ["Chương I A", "Điều 1. b", "  điều 2 c", "text", "", "1. x", "chương 3", "Điều 1. b"]
    rows = [(str(i), "t", "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    want = {}
    for i, _, raw in rows:
        chapter, found = (None, None), []
        for line in raw.split("\n"):
            if m := re.match(r"(?i)\s*chương\s+([ivx]+|\d+)\.?\s*(.*)$", line):
                chapter = (m[1], m[2].strip())
                found.append(None)
            elif m := re.match(r"(?i)\s*điều\s+(\d+)\.?\s*(.*)$", line):
                found.append([*chapter, m[1], m[2].strip(), []])
            elif found and found[-1]:
                found[-1][4].append(line)
        for k, x in enumerate(x for x in found if x):
            want[i, k] = (*x[:4], "\n".join(x[4]).strip())
    d = spark.createDataFrame(rows, "doc_id string, title string, raw_text string")
    assert {(r.doc_id, r.article_seq): (r.chapter_number, r.chapter_title, r.article_number, r.article_title, r.body) for r in segment.articles(d).collect()} == want and len(want) > 50


def test_scan_over_long_arrays(spark):
    n = 10_000
    total = text.scan(F.sequence(F.lit(1), F.lit(n)), "bigint", "bigint", F.lit(0).cast("bigint"), lambda at, x: (at + x, at + x))
    assert one(spark, total) == [k * (k + 1) // 2 for k in range(1, n + 1)]
    assert one(spark, text.scan(F.array().cast("array<int>"), "bigint", "bigint", F.lit(0), lambda at, x: (at + x, at))) == []
    raw = " ".join(f"Điều {k}. a" for k in range(1, 3000))
    assert one(spark, segment.break_articles(F.lit(raw))) == "\n".join(f"Điều {k}. a " for k in range(1, 3000)).rstrip()


def test_chunks_keep_clauses_whole(spark):
    clauses = [f"{i}. " + "n" * 240 for i in range(1, 8)]
    raw = "Điều 1. T\n" + "\n".join(clauses) + "\nĐiều 2. " + "d" * 400 + "\nĐiều 2. again\nx"
    d = spark.createDataFrame([("d", "t", raw)], "doc_id string, title string, raw_text string")
    rows = segment.chunk_articles(segment.articles(d), 350).collect()
    first = sorted((r for r in rows if r.chunk_id.startswith("d:dieu1:")), key=lambda r: r.part_index)
    assert [r.part_index for r in first] == list(range(first[0].part_count)) and first[0].part_count > 1
    assert all(r.text.startswith("Điều 1. T\n") and re.match(r"\d+\. n+", r.text.split("\n")[1]) for r in first)
    assert [c for r in first for c in r.text.split("\n")[1:]] == clauses
    assert len({r.chunk_id for r in rows}) == len(rows) and sum(r.chunk_id == "d:dieu2:part0" for r in rows) == 1
    assert any(r.chunk_id == "d:dieu2:dup1" for r in rows)


def test_marks_and_tokens(spark):
    low = "ăằắẳẵặâầấậêểệôồộơờợưừựýỹỵđíìĩçñü"
    want = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
    assert one(spark, text.strip_diacritics(F.lit(low.upper()))) == want and "đ" in want
    assert one(spark, text.tokenize(F.lit(" Thuế thuế đất THUE \n"))) == ["thuế", "thuế", "đất", "thue", "đat"]
    assert one(spark, text.tokenize(F.lit(""))) == []
    assert one(spark, text.nfc(F.lit("é"))) == "é"
    assert one(spark, text.normalize_province(F.lit(" Thành  phố Hồ Chí Minh"))) == "hồ chí minh"


def test_vectors(spark):
    v = spark.createDataFrame([("a b",), ("",), ("a b",), (None,)], "t string").select(text.hashing_embedding("t")).collect()
    assert len(v[0][0]) == 256 and v[0][0] == v[2][0] and abs(sum(x * x for x in v[0][0]) - 1) < 1e-12 and not any(v[1][0]) and not any(v[3][0])
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, text.clip01(F.lit(-0.5))) == 0.0 and one(spark, text.task_prompt("e5-small", F.lit("x"), "query")) == "query: x"


CASES = [
    ("fixed", 6, 15, None, None, None, "2026-01-01", "2026-06-15"), ("fixed", 3, 31, None, None, None, "2026-06-01", "2027-03-31"), ("fixed", 3, 31, None, None, None, "2026-03-31", "2026-03-31"),
    ("fixed", None, 15, None, None, None, "2026-01-01", None), ("recurring", 1, 20, 3, None, None, "2026-02-01", "2026-04-20"), ("recurring", 1, 20, 3, None, None, "2026-04-20", "2026-04-20"),
    ("recurring", 1, 20, 3, None, None, "2026-11-01", "2027-01-20"), ("recurring", None, 15, 6, None, None, "2026-01-01", "2026-01-15"), ("recurring", 1, 15, None, None, None, "2026-01-01", None),
    ("event_triggered", None, None, None, 10, "2026-05-01", "2026-01-01", "2026-05-11"), ("event_triggered", None, None, None, 10, None, "2026-01-01", None),
    ("event_triggered", None, None, None, None, "2026-05-01", "2026-01-01", None), ("fixed", 2, 30, None, None, None, "2026-01-01", None), ("fixed", 2, 29, None, None, None, "2026-01-01", None),
    ("recurring", 1, 1, -3, None, None, "2026-02-01", None), ("recurring", 1, 1, 0, None, None, "2026-02-01", None), ("recurring", 12, 5, 1, None, None, "2026-02-01", "2026-12-05"), ("other", 1, 1, 1, 1, None, "2026-02-01", None),
]


def test_deadlines(spark):
    d = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(CASES)], "i int, k string, m int, d int, p int, n int, e string, t string")
    got = {r.i: r.due for r in d.select("i", deadlines.due_date(F.col("k"), F.col("m"), F.col("d"), F.col("p"), F.col("n"), F.to_date("e"), F.to_date("t")).alias("due")).collect()}
    assert [got[i] for i in range(len(CASES))] == [dt.date.fromisoformat(c[7]) if c[7] else None for c in CASES]


def test_classification(spark):
    rows = [("Luật Thuế", None), ("Bộ luật", "Lao động"), ("Bộ luật", "Chưa phân loại"), ("Luật phí giao thông", ""), ("xe", "Quản lý thuế, phí và lệ phí")]
    d = spark.createDataFrame(rows, "t string, a string")
    assert [r[0] for r in d.select(classify.category(F.col("t"), F.col("a"))).collect()] == ["tax", "labor_insurance", "residence_civil", "tax", "tax"]
    a = spark.createDataFrame([("UBND Tỉnh Phú Thọ",), ("UBND thành phố Hồ Chí Minh",), ("Bộ Tài chính",), (None,)], "a string")
    assert [r[0] for r in a.select(classify.province(F.col("a"))).collect()] == ["Phú Thọ", "Hồ Chí Minh", None, None]
    ranks = spark.createDataFrame([("nghi_quyet", "trung_uong"), ("nghi_quyet", "dia_phuong"), ("luat", None), ("invented", None), (None, None)], "t string, s string")
    assert [r[0] for r in ranks.select(classify.rank_of(F.col("t"), F.col("s"))).collect()] == [1, 5, 1, 99, 99]
    inside = lambda s, who, p: one(spark, classify.in_jurisdiction(F.lit(s), F.lit(who), F.lit(p).cast("string")))
    assert inside("trung_uong", "Quốc hội", None) and not inside("dia_phuong", "UBND tỉnh Hà Nam", None) and not inside("khac", "Hà Nam", "Hà Nam")
    assert inside("dia_phuong", "UBND tỉnh Hà Nam Ninh", "tỉnh Hà Nam")


def test_html(spark):
    html = "<html><!-- x --><body><p>Điều <b>5</b></p><br/>a &amp; b\n\n <i></i></body></html>"
    assert one(spark, segment.html_to_lines(F.lit(html))) == "Điều\n5\na & b"
    assert one(spark, segment.html_to_lines(F.lit(html), True)).startswith("Điều 5\n")
    assert one(spark, segment.content_region(F.lit("<div>n</div><article class='x'>y</article>"), "article")) == "y"
    assert one(spark, segment.content_region(F.lit("<div>n</div>"), "article")) is None
    assert one(spark, segment.guess_title(F.lit("\n \n A   b\nc"))) == "A b"


def test_citations(spark):
    two = json.dumps({"sections": [{"kind": "dieu", "label": "Điều 1. A", "start": 0, "end": 9}, {"kind": "khoan", "label": "1"}, {"label": "Điều 2. B", "char_start": 10, "char_end": 20}, {"dieu_number": "3", "start": 5, "end": 30}]})
    md = "Điều 1. A Điều 2. B và hết phần này"
    at = lambda s=two, m=md, **k: one(spark, citations.locate_article(F.lit(s), F.lit(m), **k)).asDict()
    assert at() == {"dieu_number": 1, "span_start": 0, "span_end": 9, "excerpt": "Điều 1. A"}
    assert at(number=F.lit(2))["span_start"] == 10 and at(offset=F.lit(12))["dieu_number"] == 2 and at(offset=F.lit(25))["dieu_number"] == 3
    assert at(legacy_span=True)["span_end"] == min(600, len(md))
    assert at(s="broken")["dieu_number"] is None and at(s="broken")["excerpt"] == md
    assert one(spark, text.citation(F.lit("L"), F.lit("5"), F.lit(1), F.lit(3))) == "L, Điều 5 (part 2/3)"


def test_segmentation_moves_no_text(spark):
    """No exchange from documents to chunks, whatever the length of a text."""
    from statuta.sources import corpus

    long = "\n".join(f"Chương {k // 50 + 1}. c\nĐiều {k}. heading {k}\n1. " + "x" * 800 + "\n2. " + "y" * 900 for k in range(1, 3000))
    rows = [("a", "t", long, "law", "tax", "both", None, None, None, None), ("b", "t", None, "law", "tax", "both", None, None, None, None), ("c", "t", "", "law", "tax", "both", None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id string, title string, raw_text string, law_name string, category string, entity_type string, province_scope string, effective_from string, effective_to string, source_url string")
    chunks = corpus.chunks_of(d)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    got = chunks.orderBy(F.col("article_number").cast("int"), "part_index").collect()
    assert [(r.chunk_id, r.chapter_number) for r in got] == [(f"a:dieu{k}:part{p}", str(k // 50 + 1)) for k in range(1, 3000) for p in (0, 1)]
    assert got[0].text == "Điều 1. heading 1\n1. " + "x" * 800 and got[0].province_scope == "national" and got[0].effective_to == ""


def plain_region(html, tag, attribute=None, value=None):
    """By a stack over all tags of that name."""
    import re

    html = re.sub(r"(?s)<!--.*?-->", "", html)
    depth = 0
    for m in re.finditer(rf"(?is)<(/?){tag}((?:\s[^>]*?)?)(/?)>", html):
        if depth == 0 and not m.group(1) and not m.group(3):
            held = re.search(rf"""(?i)\s{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", m.group(2)) if attribute else None
            if attribute is None or held and value in next(g for g in held.groups() if g is not None).split():
                depth, start = 1, m.end()
        elif depth and not m.group(3):
            depth += -1 if m.group(1) else 1
            if depth == 0:
                return html[start : m.start()]
    return html[start:] if depth else None


def test_regions_with_nested_elements(spark):
    rng = random.Random(12)
    pieces = ["<div>", "</div>", '<div class="a main b">', "<DIV id='main'>", "</div >", "<divx>", "<div/>", "text ", "<p>x</p>", "<!-- <div> -->", "\n", '<div data-class="main">']
    pages = ["<div>one<div>two</div>three</div>four", "none", "", "<div>open", "<p><div class='main'>a<div>b</div>c</div>d</p>"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select(
        "html", segment.content_region(F.col("html"), "div").alias("first"), segment.content_region(F.col("html"), "div", "class", "main").alias("named"), segment.content_region(F.col("html"), "div", "id", "main").alias("id"),
    )
    for r in rows.collect():
        assert r["first"] == plain_region(r.html, "div"), r.html
        assert r.named == plain_region(r.html, "div", "class", "main"), r.html
        assert r.id == plain_region(r.html, "div", "id", "main"), r.html


def test_page_documents_by_class_and_id(spark):
    from statuta.sources import corpus

    html = '<html><body><div class="top">menu</div><div class="x main"><p>Law one</p><div>two</div>three</div><div id="foot">end</div></body></html>'
    pages = spark.createDataFrame([(f"u{k}", html) for k in range(6)], "url string, html string")
    regions = [None, "div.main", "div#foot", "div", "a b c", "div.none"]
    kinds = "url string, doc_id string, region string, title string, category string, law_name string, entity_type string, province_scope string, effective_from string, effective_to string"
    specs = spark.createDataFrame([(f"u{k}", f"d{k}", r, *[None] * 7) for k, r in enumerate(regions)], kinds)
    got = {r.doc_id: r.raw_text for r in corpus.documents_of_pages(pages, specs).collect()}
    assert got == {"d0": "menu\nLaw one\ntwo\nthree\nend", "d1": "Law one\ntwo\nthree", "d2": "end", "d3": "menu"}


def test_tokens_in_a_task_are_those_of_the_column_function(spark):
    import random

    rng = random.Random(3)
    texts = ["", "thuế thuế đất thue", "A\x1cb \x85c\xa0d e　f​g", "ÉÉ É́x ́ é ΣΑΣ İI ß", "中文 字", "x\ny\t\x0bz"]
    texts += ["".join(rng.choice("aáàÁbđĐêẽ \n\t\xa0\x1f́中Ω") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("x", F.lower("x").alias("low"), text.tokenize(F.col("x")).alias("t")).collect()
    assert len(rows) == len(texts) and all(text.tokens_of(r.low) == r.t for r in rows)


def test_hashing_vectors_count_words_between_any_space():
    import hashlib

    import numpy as np

    want = np.zeros(256)
    for w in ("thuế", "đất", "a_b", "c", "d", "1"):
        want[hashlib.md5(w.encode()).digest()[-1]] += 1
    assert np.allclose(text.hashing_vectors(["Thuế,đất\x1fA_b (c-d)　1", None])[0], want / np.linalg.norm(want))
