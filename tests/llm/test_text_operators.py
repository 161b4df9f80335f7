"""Periodic runs, spelling variants and chat formatting: against plain loops, and with nulls, empty and long texts, ties, repeats, no rows, columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import chat, periodic, queries, simhash, spelling, urlfilter

DOCS = "doc_id long, text string, runs string, word string, n long, p int"


def plain_runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if (length := i - start + q) >= max(least, 2 * q):
                out.setdefault((start, length), q)
            i = max(i, start + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences(rng):
    yield []
    for _ in range(120):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        yield [rng.randrange(k) for _ in range(n)]
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        yield [rng.randrange(9) for _ in range(rng.randint(0, 9))] + [unit[i % len(unit)] for i in range(n)] + [rng.randrange(4) for _ in range(9)]
        yield [0, 1] * rng.randint(1, 20) + [0, 0] + [1, 0] * rng.randint(1, 20)  # two progressions, and a run for each odd distance between them
        yield ([0] * rng.randint(1, 9) + [1]) * rng.randint(1, 9) + [0] * rng.randint(0, 20)
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
        yield b  # Fibonacci words have many runs


def test_runs_are_those_of_a_plain_search():
    rng = random.Random(1)
    for w in sequences(rng):
        for least in (2, 12):
            assert [tuple(r) for r in periodic.runs(np.array(w, np.int64), len(w), least).tolist()] == plain_runs(w, least)


def test_a_long_text_of_one_word_costs_by_its_length():
    for n, words in ((300_000, ["a"]), (300_000, ["a", "b"])):
        (run,) = periodic.runs(np.arange(n) % len(words), n).tolist()
        assert run == [0, n, len(words)]


def test_periodic_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(map(str, w)) for w in sequences(rng) if len(w) % 3 == 0] + [None, "", " \t\n", "one", "x y " * 150_000, "a\xa0b c " * 9]
    rows = [(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None, None)] * 2 + [(None, texts[-1], None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    told = docs.select("doc_id", "runs", periodic.periodic(F.col("text")).alias("q")).select("doc_id", F.col("q.runs").alias("found"), "q.collapsed", periodic.longest(F.col("q.runs")).alias("top"))
    got = told.collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[-1] if r.doc_id is None else texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = [(0, 300_000, 2)] if len(w) > 1000 else plain_runs(w, 12)
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.found] == want
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in dropped)
        assert (tuple(r.top) if r.top else None) == (min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None)
    assert docs.limit(0).select(periodic.periodic(F.col("text"))).count() == 0


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 7)
    text = "  alpha be gamma delta-epsilon z " * 5
    ids, names = periodic.numbered(text)
    assert [names[i] for i in ids] == text.split()
    monkeypatch.setattr(spelling, "PIECE", 4)
    assert [w for some in spelling.words_of("Alphabet ÄÖÜäöü, x1y ×÷ end") for w in some] == ["alphabet", "ÄÖÜäöü", "x", "y", "×÷", "end"]


def test_op11_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200)))) for i in range(120)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = plain_runs(w, 12)
        top = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
        dropped = {i for s, m, q in want for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in want)
        kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(n):
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if distance_one(a, b)]
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in best.items() if n[f] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def vocabulary(rng):
    out = {}
    for _ in range(40):
        w = "".join(rng.choice("abñ") for _ in range(rng.randint(6, 9)))
        out[w] = rng.choice([5, 25, 125, 625, 3000])
        for _ in range(8):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abñz") + w[i:], w[:i] + rng.choice("abñz") + w[i + 1 :]])
            out.setdefault(v, rng.choice([5, 7, 25, 26, 130]))
            w = v
    return {w: k for w, k in out.items() if len(w) >= 6}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_all_pairs(spark, seed):
    n = vocabulary(random.Random(seed)) | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "bananan": 9, "bananana": 45}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == plain_variants(n) and len(got) == len(n)


def test_pivots_are_the_rarest_that_do_not_overlap():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randint(3, 7)))
        grams = [(i, rng.randint(1, 9), "xx") for i in places]
        (a, fa, _), (b, fb, _) = spelling.pivots(grams)
        assert b - a >= 2 and fa + fb == min(x[1] + y[1] for x in grams for y in grams if y[0] - x[0] >= 2)


def test_op12_rows(spark, tmp_path):
    rng = random.Random(5)
    words = [w for w, k in vocabulary(rng).items() for _ in range(k % 40)] + ["Short", "PLANETS", "planets", "planéts", "çaçaça"] * 30
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50]) + rng.choice([".", "", "-x", "7"])) for i in range(50)] * 2 + [(None, "planets"), (90, None), (91, "")]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    seen = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            seen[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    got = queries.op12_spelling_variants(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == plain_variants({w: k for w, k in seen.items() if len(w) >= 6 and k >= 5})


def test_variants_of_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
    with pytest.raises(ValueError):
        spelling.vocabulary(none, least_chars=3)


TURNS = "conv_id long, turn int, role string, parts array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>, text string, segment string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_escapes_come_back():
    rng, template = random.Random(2), chat.Template()
    pieces = ["<", "s>", "/", "[", "INST]", "\\", "[/", "</s>", "<s>", "<image>", "image>", "a", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        told = template.escape(text)
        assert template.unescape(told) == text
        assert not any(mark in told for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>"))
    with pytest.raises(ValueError):
        chat.Template(turn="<<s>").escape("x")


def test_parts_become_placeholders_and_attachments(spark):
    said = [
        (1, 1, "assistant", [part("text", "see <ima"), part(None, "ge> \\"), part("image", ref="a.png", width=56, height=29), part("text", "and"), part("audio", ref="b", seconds=1.0)], "x", "y"),
        (1, 0, "user", [part("document", ref="d.pdf", pages=3), part("image", ref="e")], "x", "y"),
        (1, 2, "tool[INST]", None, "x", "y"), (None, 0, None, [part("text")], "x", "y"),
    ]
    segments = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(said, TURNS)).collect()}
    one = segments[1]
    assert list(chat.parse(one.formatted)) == [
        ("user", [("document", ""), ("image", "")]), ("assistant", [("text", "see <image> \\"), ("image", ""), ("text", "and"), ("audio", "")]), ("tool[INST]", []),
    ]
    assert [(a.kind, a.ref, a.n_tokens) for a in one.attachments] == [("document", "d.pdf", 3072), ("image", "e", 1), ("image", "a.png", 6), ("audio", "b", 13)]
    assert all(one.formatted.startswith(f"<{a.kind}>", a.at) for a in one.attachments) and one.n_tokens == 3092
    assert [chat.Template().unescape(one.formatted[s.start : s.end]) for s in one.loss] == ["see <image> \\", "and"]
    assert list(chat.parse(segments[None].formatted)) == [("", [])]
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [part("video")], "", "")], TURNS)).collect()
    with pytest.raises(ValueError):
        list(chat.parse(one.formatted + "x"))


def test_digests_of_conversations(spark, monkeypatch):
    rng = random.Random(6)
    marks = ["</s>", "[INST] ok [/INST]", "plain", "\\", "é\n", "", "<image>", "x" * 50]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), None if rng.random() < 0.1 else " ".join(rng.choice(marks) for _ in range(rng.randint(0, 6)))) for c in [1, 2, 3, None] for t in range(6)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(2500)] + [(3, 99, "user", "x" * 3_000_000), (1, 3, "user", "again"), (1, 3, "user", "again")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    segments = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, chat.Visitor(chat.Template(), chat.Expansion()).turn(r, [dict(zip(("kind", "text"), ("text", x)))]), r, x or ""))
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        text, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in said), "".join(x for _, _, r, x in said if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars, g.formatted_chars) == (len(said), len(loss), sum(len(p) for _, p, _, _ in said))
        assert (g.turns_sha256, g.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (text, loss))
    sizes = [(r.segment, r.n_turns) for r in segments.where("conv_id = 9").orderBy("segment").collect()]
    assert sizes == [(0, 1024), (1, 1024), (2, 452)]
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.digests(chat.format_conversations(none.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).count() == 0


def test_urls_and_fingerprints_beside_other_columns_and_long_texts(spark):
    names = "host string, path string, rule string, verdict string, score double, n long, gram string, fp long, least long, node long"
    rest = ("x", "y", "z", "w", 1.0, 2, "g", 3, 4, 5)
    long = "http://www.example.net/" + "seg/" * 30_000
    urls = ["http://a.com/x", "http://example.com/en/1", long, None, "no url", "http://b.net/es/1", "http://a.com/x"]
    rules = [urlfilter.UrlRule("allow", "com/"), urlfilter.UrlRule("block", "example.com/en/"), urlfilter.UrlRule("block", "net/es/")]
    plain = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    wide = spark.createDataFrame([(i, u, *rest) for i, u in enumerate(urls)], f"page_id long, url string, {names}")
    one, two = (sorted(map(tuple, urlfilter.judge(x, rules).collect()), key=repr) for x in (plain, wide))
    assert one == two and len(one) == len(urls) and {r[2] for r in one if r[0] == 2} == {long.removeprefix("http://www.example.net")}
    texts = ["a b c d e f", "word " * 200_000, None, "", "a b c d e f"]
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wide = spark.createDataFrame([(i, t, *rest) for i, t in enumerate(texts)], f"doc_id long, text string, {names}")
    one, two = (sorted(map(tuple, simhash.simhash_components(x).collect())) for x in (plain, wide))
    assert one == two and len(one) == len(texts) and one[0][1:] == one[4][1:]
