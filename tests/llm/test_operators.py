"""The ten operators on small tables: against brute force, and with nulls, empty and long texts, ties, repeats, no rows, and columns of clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statuta.llm import components, decontaminate, langid, neardup, packing, pii, quality, sharding, simhash, tokencounts, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, slot int, key string"


def prose(rng, n, words=("an", "of", "water", "stone", "bridge", "river", "light", "under", "green", "seven", "paper", "walks", "slow", "night", "morning", "table")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 3, 4, 5, 30, 60, 200, 900)] + [None, "", " \n\t ", "###", "word " * 3000]
    texts += [texts[6]] * 3 + [texts[6] + " more", texts[7].replace("stone", "stones", 1)]
    rows = [(i, t, "en", f"s{i % 2}", 0, "x", 1, "k") for i, t in enumerate(texts)] + [(4, texts[4], None, None, None, None, None, None), (None, texts[5], "en", "s", 1, "x", 1, "k")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = packing.pack_documents(docs, path, packing.Limits(tokens=128, segments=5, block=8)).collect()
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids) > 0
        by[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc, n), pieces in by.items():
        same = [w for w in want if w[0] == doc and len(w[1]) == n]
        total = sum(want[w] * n for w in same)
        assert sum(len(i) for _, i in pieces) == total
        for w in same:
            for start, ids in pieces:
                if len(same) == 1:
                    assert list(w[1][start : start + len(ids)]) == ids
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128 and len(parts) <= 5
    lengths = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(128 - n for n in lengths if n & (n - 1)) <= 0.05 * sum(lengths)
    assert packing.pack_documents(none, path).count() == 0


def test_packing_keeps_to_every_limit():
    rng = random.Random(5)
    examples = []
    for k in range(300):
        n = rng.randint(1, 150)
        mask = np.array([rng.random() < 0.6 for _ in range(n)], np.uint8)
        examples.append((k, np.arange(n, dtype="<u4"), mask))
    for cut in (True, False):
        out = list(packing.pack_encoded(iter(examples), packing.Limits(100, 4, 40, 32), cut))
        load = defaultdict(lambda: [0, 0, 0])
        seen = defaultdict(list)
        for key, start, ids, loss, n, seq, at in out:
            assert load[seq][0] == at
            load[seq] = [load[seq][0] + len(ids), load[seq][1] + 1, load[seq][2] + loss]
            seen[key] += range(start, start + len(ids))
        assert all(a <= 100 and b <= 4 and c <= 40 for a, b, c in load.values())
        assert all(sorted(seen[k]) == list(range(len(m))) for k, _, m in examples)


def test_packing_chooses_by_dot_product():
    """Places of examples that aren't cut, against a plain loop."""
    rng = random.Random(8)
    limits = packing.Limits(tokens=100, segments=6, loss=40, block=10_000)
    sizes = [(rng.randint(1, 60), rng.random()) for _ in range(200)]
    masks = [np.array([rng.random() < p / 2 for _ in range(n)], np.uint8) for n, p in sizes]
    masks = [m if m.sum() <= 40 else np.zeros(len(m), np.uint8) for m in masks]
    got = defaultdict(list)
    for key, start, ids, loss, n, sequence, at in packing.pack_encoded(((k, np.arange(len(m), dtype="<u4"), m) for k, m in enumerate(masks)), limits, False):
        assert start == 0 and len(ids) == n and loss == masks[key].sum()
        got[sequence].append(key)
    cap = (100, 6, 40)
    need = {k: (len(m), 1, int(m.sum())) for k, m in enumerate(masks)}
    weight = [np.mean([v[j] / cap[j] for v in need.values()]) / cap[j] ** 2 for j in range(3)]
    want = []
    while need:
        left, own = list(cap), []
        while left[0] > 0 and left[1] > 0:
            fits = [k for k, v in need.items() if v[0] <= left[0] and v[2] <= left[2]]
            if not fits:
                break
            k = max(fits, key=lambda k: (sum(need[k][j] * weight[j] * left[j] for j in range(3)), -k))
            left = [left[j] - need[k][j] for j in range(3)]
            own.append(k)
            del need[k]
        want.append(own)
    assert [got[s] for s in sorted(got)] == want


def test_packing_keeps_ids_of_any_type(spark):
    path = packing.public_tokenizer()
    for kind in ("int", "short", "string", "binary", "decimal(20,0)", "date"):
        docs = spark.sql(f"SELECT CAST({'DATE \'2024-01-02\'' if kind == 'date' else 7} AS {kind if kind != 'binary' else 'string'}) AS doc_id, 'a text' AS text, 'x' AS ids, 1 AS start UNION ALL SELECT NULL, NULL, 'x', 1")
        docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        out = packing.pack_documents(docs, path)
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and {str(r.doc_id) for r in out.collect()} == {str(r.doc_id) for r in docs.collect()}


def test_packing_gives_ids_away_in_parts_and_keeps_no_memory(spark, monkeypatch):
    taken = []

    class Rows:  # what a task of mapInArrow sees
        schema = spark.range(1).withColumnRenamed("id", "doc_id").schema

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "give_back", lambda: taken.append("given back"))
    example = np.zeros(700, "<u4"), np.ones(700, np.uint8)
    run = packing.pack_tokens(Rows(), lambda batch: ((k, *example) for k in range(batch)), packing.Limits(), True, "doc_id")
    for out in run(iter([1000, 3000])):
        taken.append(sum(out.column("length").to_pylist()))
    sizes = [x for x in taken if x != "given back"]
    assert sum(sizes) == 4000 * 700 and max(sizes) < (1 << 20) + 1024
    assert taken[-1] == "given back"  # after the last rows, too


def test_conversations_learn_from_one_role(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day"), (2, 0, "user", None), (2, 1, None, "x")], "conv_id long, turn long, role string, text string")
    rows = {r.doc_id: r for r in packing.pack_conversations(turns, packing.public_tokenizer()).collect()}
    assert rows[1].loss_tokens > 0 and rows[1].loss_tokens < rows[1].length and rows[2].loss_tokens == 0


def test_golay_code_is_perfect_and_keys_find_all():
    index = simhash.golay_index()
    assert (np.bincount(index) == 2048).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (i, x), (j, y) = simhash.golay_keys(a), simhash.golay_keys(b)
    assert len({r for r, _ in set(zip(i.tolist(), x.tolist())) & set(zip(j.tolist(), y.tolist()))}) == len(a)


def brute_fingerprint(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    rows = simhash.simhash_components(docs).collect()
    src = docs.collect()
    assert Counter((r.doc_id, r.fp & 2**64 - 1) for r in rows) == Counter((r.doc_id, brute_fingerprint(r.text, 4)) for r in src)
    prints = [brute_fingerprint(r.text, 4) for r in src]
    label = list(range(len(src)))
    for _ in src:
        label = [min(label[j] for j in range(len(src)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(src))]
    least = {g: min((r.doc_id for r, x in zip(src, label) if x == g and r.doc_id is not None), default=None) for g in set(label)}
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter((r.doc_id, least[g]) for r, g in zip(src, label))
    assert simhash.simhash_components(none).count() == 0


def test_simhash_chains_in_one_bucket():
    rng = np.random.default_rng(2)
    prints = [np.uint64(0)]
    for _ in range(60):
        prints.append(prints[-1] ^ np.uint64(1) << np.uint64(rng.integers(0, 64)))
    a, b = simhash.forest(np.array(prints))
    trees = components.Forest()
    for x, y in zip(a.tolist(), b.tolist()):
        assert (int(prints[x]) ^ int(prints[y])).bit_count() <= 4
        trees.join(x, y)
    assert {trees.root(i) for i in range(61)} == {0} and len(a) == 60


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    trees = components.Forest()
    for a, b in links:
        if a != b:
            trees.join(a, b)
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: trees.root(x) for x in trees.up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs, none):
    kept = [r.doc_id for r in neardup.drop_near_duplicates(docs).collect()]
    ids = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(max(1, len(w) - 4))}

    def near(a, b):
        x, y = shingles(ids[a]), shingles(ids[b])
        return ids[a] == ids[b] or (bool(re.search(r"\w", ids[a] or "")) and len(x & y) >= 0.8 * len(x | y))

    trees = components.Forest()
    for a in ids:
        for b in ids:
            if a < b and near(a, b) and {ids[a], ids[b]} != {None, ""}:
                trees.join(a, b)
    assert sorted(kept) == sorted({trees.root(i) for i in ids} - {9})  # null and empty are one text; wordless ones are only ever exact copies
    assert neardup.drop_near_duplicates(docs).columns == docs.columns and neardup.drop_near_duplicates(none).count() == 0


def test_near_copies_inside_a_large_family_of_unlike_texts(spark):
    rng = random.Random(21)
    form, rows = [f"w{i}" for i in range(300)], []
    parts = [form[i : i + 10] for i in range(0, 300, 10)]
    for i in range(600):  # a form whose parts stand in another order each time; of every tenth text a near copy
        text = " ".join(w for part in rng.sample(parts, len(parts)) for w in part).split(" ")
        rows.append((i, " ".join(text)))
        if i % 10 == 0:
            at = rng.sample(range(300), 4)
            rows.append((1000 + i, " ".join(f"x{i}" if j in at else w for j, w in enumerate(text))))
    for i in range(300):  # a common body of 300 of 395 words (similarity 0.61), so that large bands hold texts that aren't copies
        own = [f"o{i}_{j}" for j in range(95)]
        rows.append((2000 + i, " ".join([f"b{j}" for j in range(300)] + own)))
        if i % 10 == 0:
            rows.append((3000 + i, " ".join([f"b{j}" for j in range(300)] + own[:60] + [f"p{i}_{j}" for j in range(35)])))
    kept = {r.doc_id for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split(" ")] for k in range(len(w) - 4)} for i, t in rows}
    trees = components.Forest()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                trees.join(a, b)
    assert kept == {trees.root(i) for i in sets} and not any(1000 <= i < 2000 or i >= 3000 for i in kept) and len(kept) == 900


def test_copies_with_a_fifth_appended_or_cut_off(spark):
    rng, rows = random.Random(22), []
    for i in range(600):  # the longer text holds the shorter one; similarity 0.8 to 0.82
        n = (60, 200, 1000)[i % 3]
        text = [f"v{rng.randrange(5000)}" for _ in range(n)]
        cut = text[: n - int(0.2 * (n - 4))]
        rows += [(2 * i, " ".join(text if i % 2 else cut)), (2 * i + 1, " ".join(cut if i % 2 else text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect()) == list(range(0, 1200, 2))


def jaccard_groups(rows):
    """The smallest id of each group that links of similarity 0.8 and more make, by brute force over shared shingles."""
    sets = {i: {tuple(w[k : k + 5]) for w in [re.findall(r"\w+", t.lower())] for k in range(max(1, len(w) - 4))} for i, t in rows}
    holders, shared, trees = defaultdict(list), Counter(), components.Forest()
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in holders[x])
            holders[x].append(i)
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        trees.join(a, b)
    return links, {trees.root(i) for i in sets}


def edited(rng, words, share, how):
    n = len(words)
    k = max(1, round(share * n))
    if how == "append":
        return words + [f"z{rng.randrange(10**6)}" for _ in range(k)]
    if how == "insert":
        at = rng.randrange(n)
        return words[:at] + [f"z{rng.randrange(10**6)}" for _ in range(k)] + words[at:]
    if how == "cut":
        at = rng.randrange(n - k)
        return words[:at] + words[at + k :]
    at = set(rng.sample(range(n), max(1, k // 5)))  # each edit changes five shingles
    return [f"z{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]


def test_recall_of_near_copies_of_each_kind(spark):
    """Pairs of similarity about 0.8, 0.85 and 0.9, by changes of four kinds, alone and in families of hundreds."""
    rng, rows, kinds = random.Random(41), [], ("append", "insert", "cut", "edit")
    for k in range(480):
        words_ = [f"v{rng.randrange(4000)}" for _ in range(rng.choice((40, 120, 400)))]
        other = edited(rng, words_, rng.choice((0.1, 0.15, 0.2, 0.24)), kinds[k % 4])
        rows += [(2 * k, " ".join(words_)), (2 * k + 1, " ".join(other))]
    base = [f"b{i}" for i in range(200)]
    for k in range(400):  # most are alike to the base, which isn't the first of them; few to one another
        rows.append((5000 + k, " ".join(edited(rng, base, rng.choice((0.1, 0.17)), kinds[k % 4]))))
    rows.append((9000, " ".join(base)))
    for k in range(12):  # small families
        base = [f"c{k}_{i}" for i in range(120)]
        rows += [(10_000 + 100 * k + j, " ".join(edited(rng, base, 0.12, kinds[j % 4]))) for j in range(30)]
    links, want = jaccard_groups(rows)
    kept = {r.doc_id for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(links) > 1000 and len(kept - want) <= 0.001 * len(rows) and not want - kept


def test_blocks_find_what_the_representatives_miss(spark, monkeypatch):
    """Texts that share half their words in one body are apart in large bands; pairs among them are found in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, rows, body = random.Random(43), [], [f"b{j}" for j in range(150)]
    for i in range(120):
        own = [f"o{i}_{j}" for j in range(60)]
        rows.append((i, " ".join(body + own)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(edited(rng, body + own, 0.1, "edit"))))
    _, want = jaccard_groups(rows)
    kept = {r.doc_id for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == want == set(range(120))


def test_components_with_hubs(spark, monkeypatch):
    from statuta.llm import components as c

    monkeypatch.setattr(c, "HUB_SHARE", 10)
    monkeypatch.setattr(c, "FEW", 0)
    rng, trees = random.Random(3), components.Forest()
    links = [(i, 500 + i % 3) for i in range(400)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    for a, b in links:
        trees.join(a, b)
    out = {r.node: r.root for r in c.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert out == {i: trees.root(i) for i in {x for p in links for x in p if p[0] != p[1]}}


def test_language_id(spark, none):
    rng = random.Random(4)
    vocab = {"aa": ["river", "stone", "the", "walks"], "bb": ["fluß", "stein", "das", "geht", "über"], "cc": ["río", "piedra", "la", "camina"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(sorted(vocab) * 60)]
    data = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ?!", "bb"), (902, "x", None)], "doc_id long, text string, lang string")
    fold = langid.fold(F.col("doc_id"))
    assert [r[0] for r in data.where("doc_id < 9").orderBy("doc_id").select(fold).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(9)]
    p = langid.learn(data.where(fold != 0))
    counts = Counter()
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 5 and k == "aa":
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                counts.update(c for c in w)
                counts.update((f"\1{w}\1")[j : j + 2] for j in range(len(w) + 1))
                counts.update((f"\1{w}\1")[j : j + 3] for j in range(len(w)))
    want = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * k for k, c in enumerate(reversed(x[0])))))][:400]
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    assert all(p.ranks[np.searchsorted(p.grams, code(g)), 0] == i for i, g in enumerate(want))
    out = data.select("doc_id", "lang", fold.alias("f"), langid.predict(F.col("text"), p).alias("r")).collect()
    told = {r.doc_id: r.r for r in out}
    assert all(r.r.lang_pred == r.lang for r in out if r.doc_id < 900 and r.f == 0)
    assert told[900] == told[901] == ("und", 0.0) and all(0 <= r.score <= 1 for r in told.values())
    empty = langid.learn(none)
    assert data.select(langid.predict(F.col("text"), empty).alias("r")).where("r.lang_pred <> 'und'").count() == 0


def test_language_distances_against_plain_counts(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(langid, "PIECE", 64)  # so that texts are counted in parts
    vocab = {"aa": ["river", "stone", "the", "walks"], "bb": ["fluß", "stein", "das", "geht"]}
    texts = {k: [" ".join(rng.choice(v) for _ in range(rng.randint(1, 60))) for _ in range(20)] for k, v in vocab.items()}

    def order(ts, size):
        n = Counter()
        for t in ts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                w = f"\1{w}\1"
                n.update(c for c in w[1:-1])
                n.update(w[i : i + 2] for i in range(len(w) - 1))
                n.update(w[i : i + 3] for i in range(len(w) - 2))
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))][:size]

    profiles = {k: {g: i for i, g in enumerate(order(ts, 50))} for k, ts in texts.items()}
    data = spark.createDataFrame([(t, k) for k, ts in texts.items() for t in ts], "text string, lang string")
    p = langid.learn(data, size=50)
    some = [t for ts in texts.values() for t in ts] + ["stone" * 200, "a", "das river"]
    far, kept = langid.distances(some, p)
    for t, d, n in zip(some, far, kept):
        own = order([t], 50)
        assert n == len(own)
        for k, lang in enumerate(p.langs):
            assert d[k] == sum(abs(profiles[lang][g] - i) if g in profiles[lang] else 50 for i, g in enumerate(own))
    out = spark.createDataFrame([(t,) for t in some], "text string").coalesce(1).select(langid.predict(F.col("text"), p).alias("r")).collect()
    for r, d, n in zip(out, far, kept):
        assert r.r.lang_pred == p.langs[int(d.argmin())] and abs(r.r.score - (1 - d.min() / (50 * n))) < 1e-12


def test_language_of_texts_with_very_many_letters(spark):
    many = "".join(chr(i) for i in range(0x4E00, 0x9FFF)) + "".join(chr(i) for i in range(0x20000, 0x2F000) if chr(i).isalpha())
    p = langid.learn(spark.createDataFrame([("the river " * 20000, "aa"), (many, "zz")], "text string, lang string"))
    r = spark.createDataFrame([(many,), ("river",), ("the river " * 9000,)], "text string").coalesce(1).select(langid.predict(F.col("text"), p).alias("r")).collect()
    assert len(set(many)) > 65536 and [x.r.lang_pred for x in r] == ["zz", "aa", "aa"]


def brute_tiles(doc, item, least):
    marked_d, marked_t, tiles = set(), set(), 0
    while True:
        best, found = least - 1, []
        for t in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while t + k < len(item) and d + k < len(doc) and item[t + k] == doc[d + k] and t + k not in marked_t and d + k not in marked_d:
                    k += 1
                if k > best:
                    best, found = k, [(t, d)]
        if not found:
            return tiles, len(marked_t)
        t, d = found[0]
        marked_t.update(range(t, t + best))
        marked_d.update(range(d, d + best))
        tiles += 1


def test_decontamination(spark, docs, none):
    rng = random.Random(8)
    item = prose(rng, 40).split()
    other = prose(rng, 30)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, other), (3, None), (4, "too short"), (1, " ".join(item))], "item_id long, text string")
    mixed = " ".join(item[20:40] + prose(rng, 9).split() + item[:20])
    data = spark.createDataFrame([(100, mixed, None), (101, "x " + other.upper() + " y", "a"), (102, " ".join(item[:15]), "a"), (103, prose(rng, 300), "a")], "doc_id long, text string, coverage string")
    for chars in (1 << 20, 60):
        got = {r.doc_id: r.contamination for r in decontaminate.contamination(data.unionByName(docs.selectExpr("doc_id", "text", "'c' coverage")), bench, block_chars=chars).collect()}
        assert got[100].contaminated and got[100].item_id == 1 and got[101].contaminated and got[101].item_id == 2
        assert not got[102].contaminated and not any(got[i].contaminated for i in range(9)) and not got[103].contaminated
    seeds = decontaminate.Items([(1, "a b c d e f g h i j")], 2)
    for _ in range(60):
        text = " ".join(rng.choice("abcdefghij") for _ in range(25))
        tiles, covered = brute_tiles(text.split(), "a b c d e f g h i j".split(), 2)
        best = seeds.best(text)
        assert (best or (0, 1, 0, 0))[2:] == (tiles, covered)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(data, bench.where("false")).where("contamination.contaminated").count() == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[ -]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_data(spark, docs, none):
    rng = random.Random(6)
    parts = ["a@b.com", "a.b+c@d-e.co.uk_x@y.zz", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890123", "+1 (555) 123-4567", "+12", "+49 30.1234 567 x", "ü", "no", " ", "\n", "-", "."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["a." * 20000, "1" * 5000, "x@" + "a." * 3000 + "b"]
    data = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    import hashlib

    rows = pii.report(data).collect()
    listed = lambda t: ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or ""))
    want = Counter((r.doc_id, hashlib.sha256(listed(r.text).encode()).hexdigest()) for r in data.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert pii.report(none).count() == 0 and pii.sanitise(docs).columns == docs.columns


def test_terms_that_reveal_are_found(spark):
    rng = random.Random(7)
    filler = ["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo"]
    text = lambda: " ".join(rng.choice(filler) for _ in range(12))
    rows = [(i, f"{text()} Zorblatt writes to secret@mail.com {text()}") for i in range(5)] + [(50, f"{text()} Zorblatt alone {text()}")] + [(100 + i, text()) for i in range(60)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    near = pii.Disclosure(near=30)
    got = {r.doc_id: r for r in pii.report(data, near).collect()}
    assert all("term:" in got[i].spans for i in range(5)) and got[50].n_term == 1 and all(got[100 + i].n_term == 0 for i in range(60))
    place = rows[5][1].index("Zorblatt")
    assert got[50].spans == f"term:{place}:{place + 8}"
    shuffled = {r.doc_id: r.spans for r in pii.report(data, pii.Disclosure(near=30, broadcast_rows=0)).collect()}
    assert shuffled == {i: r.spans for i, r in got.items()}
    clean = {r.doc_id: r.text for r in pii.sanitise(data, near).collect()}
    assert "[EMAIL]" in clean[0] and "secret" not in clean[0] and "Zorblatt" not in clean[50] and clean[101] == rows[7][1]
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(9)] + [(100 + i, text()) for i in range(60)], "doc_id long, text string")
    assert pii.report(copies, near).where("n_term > 0").count() == 0


def test_disclosure_against_plain_counts(spark):
    """P(e|t), information and support of all terms of random corpora."""
    import math

    rng = random.Random(31)
    names, mails = [f"name{c}" for c in "abcdefgh"], [f"{c}@mail.org" for c in "pqr"]
    for trial in range(2):
        texts = []
        for _ in range(150):
            parts = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(2, 6))]
            if rng.random() < 0.6:
                k = rng.randrange(3)
                for _ in range(rng.randint(1, 4)):  # one document may name an entity more than once
                    parts += [names[k] if rng.random() < 0.8 else rng.choice(names), f"w{chr(97 + rng.randrange(26)) * 3}", mails[k] if rng.random() < 0.9 else rng.choice(mails)]
            elif rng.random() < 0.4:
                parts.append(rng.choice(names))
            texts.append(" ".join(parts))
        texts += texts[:5]
        rule = pii.Disclosure(near=30, support=2, generalise=0.3, bits=0.5)
        mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        terms = lambda t: {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3}
        joint, contexts, has_term, has_entity = defaultdict(set), defaultdict(set), Counter(), Counter()
        for i, t in enumerate(texts):
            has_term.update(terms(t))
            has_entity.update({m.group().lower() for m in mail.finditer(t)})
            for m in mail.finditer(t):
                first = max(m.start() - 30, 0)
                before, after = t[first : m.start()], t[m.end() : m.end() + 30]
                before = re.sub(r"^[^\W\d_]+", "", before) if first else before
                after = re.sub(r"[^\W\d_]+$", "", after) if len(after) == 30 else after
                context = before + " " + after
                for w in terms(context):
                    joint[m.group().lower(), w].add(i)
                    contexts[m.group().lower(), w].add(context)
        want = {}
        for (e, w), found in joint.items():
            p = len(found) / has_term[w]
            if len(contexts[e, w]) >= 2 and p >= 0.3 and math.log2(p * len(texts) / has_entity[e]) >= 0.5:
                want[w] = max(want.get(w, 0), p)
        data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        base = data.select(F.col("doc_id").alias("doc"), "text", pii.base_spans(F.col("text")).alias("base")).where("size(base) > 0")
        got = {r.term: r.disclosure for r in pii.disclosing_terms(data, base, rule).collect()}
        assert want and got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_a_term_that_is_seldom_near_stays(spark):
    mail = "someone@mail.org "
    rows = [(i, f"{'plumber ' + mail * 5 if i < 2 else 'plumber'} context{chr(97 + i) * 3}") for i in range(8)]
    rows += [(100 + i, f"other text number{chr(97 + i % 26) * 3}") for i in range(60)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "plumber" in out[0] and "plumber" in out[5] and "@" not in out[0]


def test_spans_of_a_text_with_very_many_entities(spark):
    n = 20_000
    text = " ".join(f"é{i} u{i}@mail.org +49 30 {1000000 + i} x" for i in range(n))
    data = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, key string")
    r = pii.report(data).first()
    assert (r.n_email, r.n_phone) == (n, n)
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert r.spans.split(",")[:n] == want
    clean = pii.sanitise(data).first()
    assert clean.text == " ".join(f"é{i} [EMAIL] [PHONE] x" for i in range(n)) and clean.key == "a"


def test_replacement_of_overlapping_spans(spark):
    rng = random.Random(9)
    for _ in range(3):
        text = "".join(rng.choice("abcdé\U0001f600 ") for _ in range(9000))
        spans = sorted({(s, min(len(text), s + rng.randint(1, 60))) for s in (rng.randrange(len(text)) for _ in range(200))})
        want, at = [], 0
        for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
            if s >= at:
                want += [text[at:s], f"<{e - s}>"]
            at = max(at, e)
        data = spark.createDataFrame([(text, [("k", s, e, "") for s, e in spans]), ("", [])], f"t string, s array<{pii.SPAN}>").coalesce(1)
        got = data.select(pii.replaced(F.col("t"), F.col("s"), lambda x: F.concat(F.lit("<"), x["end"] - x["start"], F.lit(">")))).collect()
        assert [g[0] for g in got] == ["".join(want) + text[at:], ""]


def test_seeds_of_a_passage_in_many_items_and_places():
    rng = random.Random(71)
    passage = [f"p{i}" for i in range(12)]
    items = [(k, " ".join([f"q{k}_{i}" for i in range(3)] + passage + [rng.choice("xyz")])) for k in range(40)]
    text = " ".join(w for _ in range(30) for w in [*passage, rng.choice("uvw")])
    made = decontaminate.Items(items, 5)
    ids, at = made.shared(text)
    every = [tuple(map(int, x)) for part in made.starts(ids, at, 10**9) for x in zip(*part)]
    parts = list(made.starts(ids, at, 50))
    assert len(parts) > 10 and all(len(set(p[0])) == 1 or len(p[0]) <= 50 for p in parts)
    assert sorted(tuple(map(int, x)) for p in parts for x in zip(*p)) == sorted(every) and len(every) == 40 * 30  # one match for each of both, not one for each seed
    share, item, tiles, covered = made.best(text)
    assert (item, tiles, covered) == (0, 1, 12) and share == 12 / 16


def test_tiles_of_texts_that_repeat_themselves():
    rng = random.Random(72)
    for k in range(250):
        kind = k % 5
        draw = lambda n, letters: [rng.choice(letters) for _ in range(n)]
        if kind == 0:
            item, doc = draw(rng.randint(2, 25), "a"), draw(rng.randint(2, 30), "a")
        elif kind == 1:
            item, doc = draw(rng.randint(2, 20), "ab"), draw(rng.randint(2, 30), "ab")
        elif kind == 2:
            item, doc = list("abc" * rng.randint(1, 7)), list("cab" * rng.randint(1, 9)) + draw(rng.randint(0, 5), "abcd")
        elif kind == 3:
            item, doc = list("aaaabaaaa" * rng.randint(1, 2)), draw(3, "xa") + list("aaaa" * rng.randint(1, 5)) + draw(9, "abx")
        else:
            item, doc = draw(20, "abcd"), draw(10, "abcdxyz") * 3
        least = rng.randint(2, 5)
        tiles, covered = brute_tiles(doc, item, least)
        best = decontaminate.Items([(1, " ".join(item))], least).best(" ".join(doc))
        assert (best or (0, 1, 0, 0))[2:] == (tiles, covered), (item, doc, least)


def test_tiles_of_long_repeats_cost_no_product():
    import time

    for words_, want in ((["a"], 2000), (["a", "b", "c"], 2000)):
        made = decontaminate.Items([(1, " ".join(words_[i % len(words_)] for i in range(2000)))], 5)
        text = " ".join(words_[i % len(words_)] for i in range(100_000))
        began = time.perf_counter()
        assert made.best(text)[2:] == (1, want)
        assert time.perf_counter() - began < 5  # a product of both took minutes


def test_a_hash_that_collides_is_found_out(monkeypatch):
    monkeypatch.setattr(decontaminate.Stretches, "hashes", lambda self, at, size: np.zeros(len(at), np.uint64))
    made = decontaminate.Items([(1, "a b c d e f g h")], 3)
    assert made.best("x a b c d y f g h")[2:] == (2, 7)


def test_quality(spark, docs, none):
    def brute(t):
        w = words(t)
        n, hit = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if n[tuple(w[i : i + 5])] > 1:
                hit.update(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)

    rng = random.Random(2)
    texts = [r.text for r in docs.collect()] + [" ".join(rng.choice("ab") for _ in range(40)), "x y\nx y\n\nz", "é # $\u00a0x"]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rules = [m.rule for m in quality.plan(data)]
    rows = data.select("doc_id", quality.judge(F.col("text"), rules).alias("q")).collect()
    for r in rows:
        got = r.q
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute(texts[r.doc_id])
        assert got.base_failed == (got.n_words < 10 or 100 * got.n_repeat_words > 20 * got.n_words)
        assert got.kept == (not any(x.rejects(quality.Doc(texts[r.doc_id])) for x in quality.RULES))
    assert {r.doc_id for r in quality.cascade(data, rules).collect()} == {r.doc_id for r in rows if r.q.kept}
    assert {r.doc_id for r in rows if r.q.kept} == {r.doc_id for r in data.select("doc_id", quality.judge(F.col("text"), rules[::-1]).alias("q")).where("q.kept").collect()}
    assert quality.plan(none) and quality.cascade(none, rules).count() == 0


def test_cascade_order_is_by_rejection_per_cost():
    import time

    slow = quality.Rule("slow", lambda d: time.sleep(0.002) or True)
    cheap = quality.Rule("cheap", lambda d: len(d.text) % 2 == 0)
    never = quality.Rule("never", lambda d: False)
    assert [m.rule.name for m in quality.measure(["a", "bb"] * 10, (never, slow, cheap))] == ["cheap", "slow", "never"]


def test_cascade_costs_are_those_of_what_is_left(spark):
    """A rule that shares a costly feature with one before it costs little after it, and one whose documents are all rejected by then rejects nothing."""
    import time

    class Slow(quality.Doc):
        @property
        def size(self):
            if "size" not in self.__dict__:
                time.sleep(0.002)
                self.__dict__["size"] = len(self.text)
            return self.__dict__["size"]

    rules = (
        quality.Rule("all_but_long", lambda d: Slow.size.fget(d) < 5),
        quality.Rule("same_feature", lambda d: Slow.size.fget(d) > 6),
        quality.Rule("subset", lambda d: time.sleep(0.0005) or d.text == "a"),
    )
    out = quality.measure(["a"] * 8 + ["aaaaa"] * 4 + ["aaaaaaaa"] * 2, rules)
    told = {m.rule.name: m for m in out}
    first, second = sorted((told["all_but_long"], told["same_feature"]), key=out.index)
    assert out[0].rule.name == "subset" and second.cost < first.cost / 5  # the feature is there by then
    assert abs(first.rejected - (2 / 6 if first.rule.name == "same_feature" else 0)) < 1e-9  # of the six that "subset" has left
    data = spark.createDataFrame([(1, "too few words"), (2, " ".join(f"w{i}" for i in range(20)).replace("w", "word"))], "doc_id int, text string")
    asked = {r.doc_id: r.q.asked for r in data.select("doc_id", quality.judge(F.col("text"), list(quality.RULES)).alias("q")).collect()}
    assert asked == {1: 1, 2: len(quality.RULES)}


def test_cascade_skips_features():
    d, seen = quality.Doc("no prose"), []
    rules = [quality.Rule("base", lambda d: d.base_failed), quality.Rule("late", lambda d: seen.append(d) or d.letters > 0)]
    assert any(r.rejects(d) for r in rules) and not seen and "letters" not in d.__dict__


def test_sharding(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(1500)] + [(5000 + i, "the same text " * 20) for i in range(700)] + [(9000 + i, None) for i in range(20)]
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard(data, 6).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    text = dict(rows)
    load, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) == set(range(6))
    assert max(load.values()) < 1.05 * min(load.values())
    hot = "the same text " * 20
    assert all(len(s) == 1 for t, s in of.items() if t != hot) and len(of[hot]) > 1
    assert sharding.shard(none).count() == 0 and sharding.shard(docs).count() == docs.count()


def test_sharding_is_best_fit_decreasing(spark):
    """Against a plain loop over all groups, one by one, with a list of rooms."""
    rng = random.Random(12)
    rows = [(i, "x" * rng.choice([0, 1, 3, 40, 41, 300, 900])) for i in range(900)]
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t) + 8
    rows += [(1000 + i, f"{i:04d}" * rng.randint(1, 300)) for i in range(700)]
    for _, t in rows[900:]:
        groups[t] += len(t) + 8
    total = sum(groups.values())
    room = [-(-total // 5)] * 5
    assert max(groups.values()) <= room[0]
    for size in sorted(groups.values(), reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        b = min(fits)[1] if fits else max((r, b) for b, r in enumerate(room))[1]
        room[b] -= size
    load = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5).collect():
        load[r.shard] += r.size
    assert sorted(load.values()) == sorted(-(-total // 5) - r for r in room)


def test_rooms_are_those_of_a_sorted_list():
    rng, rooms, plain = random.Random(4), sharding.Rooms(), []
    for step in range(2000):
        if plain and rng.random() < 0.5:
            size = rng.randint(0, 120)
            fits = [x for x in plain if x[0] >= size]
            found = rooms.tightest(size)
            assert found == (min(fits) if fits else None)
            if found is None:
                found = rooms.widest()
                assert found == max(plain)
            plain.remove(found)
        else:
            x = (rng.randint(0, 100), step)
            rooms.put(*x)
            plain.append(x)


def test_size_classes(spark):
    sizes = sorted({*range(0, 70000, 7), *(2**k + d for k in range(16, 40) for d in (-1, 0, 1, 2 ** (k - 3), 2 ** (k - 11)))})
    found = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "s long").coalesce(1).select(sharding.size_class(F.col("s"))).collect()]
    assert found == sorted(found) and all(c < sharding.n_classes(x) for x, c in zip(sizes, found))
    ends = {}
    for x, c in zip(sizes, found):
        ends.setdefault(c, [x, x])[1] = x
    assert all(b - a <= a / 1000 for a, b in ends.values()) and all(a == b for c, (a, b) in ends.items() if c < 1 << 16)


def test_best_fit_decreasing():
    rng = random.Random(0)
    sizes = [(rng.randint(1, 60), i) for i in range(200)]
    bins = sharding.fewest_bins(sizes, 100)
    load = Counter()
    for s, i in sizes:
        load[bins[i]] += s
    assert max(load.values()) <= 100 and len(load) <= 11 / 9 * -(-sum(s for s, _ in sizes) // 100) + 1


def test_warc(spark):
    big = "<p>ä\r\n\r\nWARC/1.1</p>" * 80
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "x\r\ny", big + "z"), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = warc.fresh_path(spark, "t")
    warc.write(pages, path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 3),
    }
    import hashlib

    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha1(raw).hexdigest()
        assert bytes(got[i].payload) == (raw if got[i].record_type == "response" else b"") and got[i].intact in (True, None)
    assert got[3].url is None and got[1].url == "http://a/1"
    path = warc.fresh_path(spark, "t")
    warc.write(pages.repartition(1), path, file_bytes=6000)  # all records make about 11,600 bytes
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content").collect()
    assert len(files) == 2 and sum(1 for f in files for _ in warc.parse(bytes(f.content))) == len(rows)
    whole = bytes(files[0].content)
    many = warc.Stream(whole, 7)  # inflated a few bytes at a time
    assert many.head().startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse(whole[: len(whole) // 2]))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_long_page_and_many_digests(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 300}</p>" * 130) for i in range(2000)] + [(5000, "http://a/long", "x" * 3_000_000), (None, "n", "<p>7</p>" * 130), (None, "n", "<p>7</p>" * 130)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    path = warc.fresh_path(spark, "t")
    warc.write(pages, path, file_bytes=1_000_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content").collect()
    sizes = [[r[2] for r in warc.parse(bytes(f.content))] for f in files]
    assert sum(map(len, sizes)) == len(rows) and [3_000_000] in sizes and len(files) <= 6  # 2.3 MB of other records, and the long one by itself
    heads = warc.headers(pages)
    one, two = (warc.decide(pages, heads, warc.owners(heads), few) for few in (500, 3))  # by broadcast and by the joins of headers
    got = [sorted(map(tuple, x.select("page_id", "digest", "refers_to", F.length("html")).collect()), key=repr) for x in (one, two)]
    assert got[0] == got[1] and sum(r[2] is None for r in got[0]) == 301


RULES = [urlfilter.UrlRule(*x) for x in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]


def test_url_filter(spark):
    rng = random.Random(3)
    good = [f"https://{rng.choice('abcdef')}{rng.randint(0, 99)}.example.com/fr/{rng.randint(0, 999)}" for _ in range(200)]
    bad = [f"http://spam-{rng.randint(0, 99)}.pills.net/es/buy?{rng.randint(0, 999)}" for _ in range(200)]
    odd = [None, "", "no url", "HTTP://WWW.Example.COM/en/x?y", "http://example.com", "http://X.com/EN/a://b", "http://x.example.com/en/1", "http://spam-7.pills.org/es/buy?1", "https://a7.example.org/fr/3", "http://notcom/", "http://com/"]
    data = spark.createDataFrame([(i, u, "c") for i, u in enumerate(good + bad + odd)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in urlfilter.judge(data, RULES).collect()}
    assert len(rows) == 411
    for i, u in enumerate(good + bad + odd):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.rule), default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule.rule)
        assert rows[i].verdict == rule.verdict if rule else rows[i].verdict in ("allow", "block")
    assert rows[407].verdict == "block" and rows[408].verdict == "allow"
    assert urlfilter.judge(data.where("false"), RULES).count() == 0
    assert urlfilter.judge(data.where("page_id = 402"), RULES).first().verdict == "allow"


def test_url_scores_are_those_of_exact_counts(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-_%éß") for _ in range(rng.randint(20, 60)))
    urls = [f"http://{rng.randint(0, 99)}.{rng.choice(['example.com/fr', 'pills.net/es', 'other.org'])}/{word()}" for _ in range(2500)]
    rows = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    hosts = spark.createDataFrame([(h,) for h in {r.host for r in rows.values()}], "host string")
    held = {r.host for r in hosts.where(F.pmod(F.xxhash64("host"), F.lit(5)) == 0).collect()}
    bytes_of = lambda r: [256] * 4 + list((r.host + r.path).encode())
    grams = {k: Counter() for k in urlfilter.KINDS}
    for r in rows.values():
        if r.rule and r.host not in held:
            x = bytes_of(r)
            grams[r.verdict].update((tuple(x[i - k : i]), x[i]) for i in range(4, len(x)) for k in range(5))
    totals, kinds = {k: Counter() for k in grams}, {k: Counter() for k in grams}
    for k, own in grams.items():
        for (c, _), n in own.items():
            totals[k][c] += n
            kinds[k][c] += 1
    assert sum(map(len, grams.values())) > 1 << 16
    for r in list(rows.values())[:300]:
        x, out = bytes_of(r), 0.0
        for i in range(4, len(x)):
            for sign, kind in ((1, "allow"), (-1, "block")):
                p = 1 / 256
                for k in range(5):
                    c = tuple(x[i - k : i])
                    if n := totals[kind][c]:
                        p = (grams[kind][c, x[i]] + kinds[kind][c] * p) / (n + kinds[kind][c])
                out += sign * np.log(p)
        assert abs(out / (len(x) - 4) - r.score) < 1e-9


def test_token_counts(spark):
    store = tokencounts.TokenTotals(spark, tokencounts_path(spark))
    feed = lambda rows: spark.createDataFrame(rows, tokencounts.CHANGE)
    a, b, c = ("s", "en", "t", 10), ("s", "en", "t", 12), (None, "de", "t", None)
    assert store.totals().count() == 0
    assert store.commit("b1", feed([("insert", None, a), ("insert", None, a), ("insert", None, c)]))
    assert not store.commit("b1", feed([("insert", None, a)]))
    assert store.commit("b2", feed([("revise", a, b)]))
    store.compact()
    assert not store.commit("b2", feed([("revise", a, b)]))
    assert store.commit("b3", feed([("delete", a, None), ("delete", c, None)]))
    assert store.commit("b4", feed([]))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "t", 1, 12)]
    with pytest.raises(Exception, match="unknown op"):
        store.commit("b5", feed([("upsert", a, b)]))
    assert not store.committed("b5") and store.committed("b1") and store.committed("b4") and [tuple(r) for r in store.totals().collect()] == [("s", "en", "t", 1, 12)]


def test_token_totals_over_many_snapshots(spark):
    store = tokencounts.TokenTotals(spark, tokencounts_path(spark))
    feed = lambda n: spark.createDataFrame([("insert", None, ("s", "en", "t", n))], tokencounts.CHANGE)
    for k in range(4):
        assert store.commit(f"b{k}", feed(1)) and store.compact()
    assert not any(store.commit(f"b{k}", feed(1)) for k in range(4)) and store._names("batches") == ["b3"] and len(store._names("snapshots")) == 2
    other = tokencounts.TokenTotals(spark, store.path)
    spark.createDataFrame([], tokencounts.TOTALS).write.parquet(f"{store.path}/aside/late")
    assert not other._publish("aside/late", "batches", "b3")  # the slower of two writers of one batch
    assert [tuple(r) for r in other.totals().collect()] == [("s", "en", "t", 4, 4)]


def test_a_batch_that_is_committed_while_another_compacts(spark, monkeypatch):
    store = tokencounts.TokenTotals(spark, tokencounts_path(spark))
    feed = lambda n: spark.createDataFrame([("insert", None, ("s", "en", "t", n))], tokencounts.CHANGE)
    total = lambda: [tuple(r) for r in store.totals().collect()]
    assert store.commit("first", feed(1))
    split, done = tokencounts.TokenTotals._split, []

    def slow(self, snapshot):
        out = split(self, snapshot)
        if len(done) < 2:
            done.append(None)
            assert tokencounts.TokenTotals(spark, store.path).commit(f"late{len(done)}", feed(10 ** len(done)))
        return out

    for _ in range(3):
        monkeypatch.setattr(tokencounts.TokenTotals, "_split", slow)
        assert store.compact()
        monkeypatch.setattr(tokencounts.TokenTotals, "_split", split)
        assert store.committed("first") and store.committed("late1")
    assert total() == [("s", "en", "t", 3, 111)]
    # two compactions at once: one wins, nothing is lost
    publish = tokencounts.TokenTotals._publish

    def beaten(self, aside, *names):
        monkeypatch.setattr(tokencounts.TokenTotals, "_publish", publish)
        assert tokencounts.TokenTotals(spark, store.path).commit("meanwhile", feed(1000)) and tokencounts.TokenTotals(spark, store.path).compact()
        return publish(self, aside, *names)

    monkeypatch.setattr(tokencounts.TokenTotals, "_publish", beaten)
    assert not store.compact() and total() == [("s", "en", "t", 4, 1111)]
    # a writer that asked before others committed, compacted twice and so dropped an equal batch
    ask = tokencounts.TokenTotals.committed

    def overtaken(self, batch_id):
        monkeypatch.setattr(tokencounts.TokenTotals, "committed", ask)
        other = tokencounts.TokenTotals(spark, store.path)
        assert not ask(self, batch_id) and other.commit(batch_id, feed(10_000)) and other.compact() and other.compact()
        return False

    monkeypatch.setattr(tokencounts.TokenTotals, "committed", overtaken)
    assert not store.commit("slow", feed(10_000)) and "slow" not in store._names("batches")
    assert total() == [("s", "en", "t", 5, 11111)] and store.committed("slow")


def test_token_counts_query(spark):
    """The query's totals, against counts by the tokenizer itself."""
    from statuta.llm import queries
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(packing.public_tokenizer())
    t.encode_special_tokens = True
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(words(r.text))
        if n >= 10:
            for name, k in (("words-1", n), ("byte_bpe_50k", len(t.encode(r.text, add_special_tokens=False).ids))):
                want[r.source, r.lang, name][0] += 1
                want[r.source, r.lang, name][1] += k
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in queries.op3_token_counts(spark, sf).collect()}
    assert got == dict(want)


def tokencounts_path(spark):
    from statuta.llm.common import fresh_path

    return fresh_path(spark, "totals")
