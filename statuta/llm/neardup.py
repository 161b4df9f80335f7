"""Removal of near-duplicate documents: SimHash and min-hash candidates, verified by the Jaccard similarity of word shingles.

Each text gets, of the set of its shingles, a SimHash fingerprint and a signature of BANDS * ROWS min-hashes, a byte
of each. Fingerprints are linked by their Golay keys (simhash.py), which finds texts that are almost equal. Texts
whose signatures are equal in a band are candidates, whatever the change: of pairs of similarity 0.8 all but
(1 - 0.8^6)^40, 5 in a million, share a band. Pairs whose signatures agree in fewer than AGREE places are not
compared (1 in a million of those at 0.8 or more agree in fewer).

Groups of any size go the same way, and what they cost grows with their members, not with their pairs:
1. each text of a band is compared with the band's representative, the text of smallest id, so bands agree on it;
2. bands whose texts are not all linked by then get a second one: the text nearest the majority of their fingerprints;
3. in bands that are still apart, each text outside the band's largest group is compared with all texts of other
   groups, in blocks of bounded rows and bytes over the tasks. A task compares signatures first, and shingle sets
   where they agree, only while the two are apart; it returns a spanning forest of the verified links.
A pair of similar texts that share a band is therefore linked, directly or through others; nothing is given up.

Defined cases: texts are copies if they are equal (by a hash of 128 bits); null and wordless texts are only ever
exact copies; of each group the row of smallest id stays (a null id last), and of repeated rows one; extra columns
are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, internal, small, stash
from statuta.llm.components import Forest, components
from statuta.llm.simhash import bit_majorities, print_links

WORDS = re.compile(r"\w+")
BANDS, ROWS = 40, 6
AGREE = 163  # of 240 places of two signatures; at similarity 0.8 the mean is 192, the deviation 6.2
BLOCK, BLOCK_BYTES = 1000, 8 << 20  # of texts that one task compares with as many others
NARROW = 50_000  # rows of two or three hashes that may be broadcast
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; of the whole sequence if it is shorter; none without words."""
    found = WORDS.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(found)}
    words = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(words) - size + 1)
    out = words[:n].copy()
    for k in range(1, min(size, len(words))):
        out *= STEP
        out += words[k : k + n]
    return np.unique(_mixed(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bytes of the min-hashes of sets of hashes, none empty: a row for each."""
    rng = np.random.default_rng(20)
    salts = rng.integers(0, 2**32, (BANDS * ROWS, 3), np.uint64).astype(np.uint32)
    salts[:, 1:] |= np.uint32(1)
    out, i = np.empty((len(sets), BANDS * ROWS), np.uint8), 0
    while i < len(sets):
        j, n = i + 1, len(sets[i])
        while j < len(sets) and n + len(sets[j]) <= 1 << 15:
            n, j = n + len(sets[j]), j + 1
        h, first = np.concatenate(sets[i:j]).astype(np.uint32), np.cumsum([0, *map(len, sets[i : j - 1])])
        for k, (x, m1, m2) in enumerate(salts):
            v = (h ^ x) * m1
            v ^= v >> np.uint32(15)
            v *= m2
            v ^= v >> np.uint32(16)
            low = np.minimum.reduceat(v, first) * np.uint32(0x9E3779B1)
            out[i:j, k] = low >> np.uint32(24)
        i = j
    return out


def prints(text: Column, size: int) -> Column:
    """A struct of fp, the SimHash of the set of shingles, and sign, its signature; both null for a wordless text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        fp, sign = np.zeros(len(texts), np.int64), np.full(len(texts), None, object)
        for i in range(0, len(texts), 256):
            sets = [shingles(x, size) for x in texts.iloc[i : i + 256]]
            some = [k for k, s in enumerate(sets) if len(s)]
            if some:
                own = [sets[k] for k in some]
                fp[np.array(some) + i] = bit_majorities(np.concatenate(own), np.fromiter(map(len, own), np.int64)).view(np.int64)
                for k, x in zip(some, signatures(own)):
                    sign[i + k] = x.tobytes()
        give_back()
        return pd.DataFrame({"fp": pd.Series(fp, dtype="Int64").mask(pd.isna(sign)), "sign": sign})

    return F.pandas_udf(run, "fp long, sign binary")(text)


def shingle_set(text: Column, size: int) -> Column:
    """Sorted hashes of 32 bits of the distinct shingles of a text."""

    def run(texts: pd.Series) -> pd.Series:
        out = [np.unique(shingles(x, size).astype(np.uint32)).view(np.int32) for x in texts]
        give_back()
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


def _signs(column) -> np.ndarray:
    """Signatures of a column as rows of bytes."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BANDS * ROWS)


def bands(texts: DataFrame) -> DataFrame:
    """Of texts (id, sign): band, id, hub, n for each band that two or more share; its last six bits are its number. The hub is the smallest id."""
    of = F.array(*(F.xxhash64(F.lit(k), F.substring("sign", k * ROWS + 1, ROWS)).bitwiseAND(F.lit(~63)).bitwiseOR(F.lit(k)) for k in range(BANDS)))
    rows = texts.select(F.explode(of).alias("band"), "id")
    hubs = stash(rows.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "band-hubs")
    return stash(rows.join(small(hubs, NARROW), "band"), "bands")


def candidates(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs a < b of ids: of Golay-linked or equal fingerprints, and of bands' texts and their hubs."""
    heads = stash(texts.groupBy("fp").agg(F.min("id").alias("head")), "fingerprint-heads")
    links = print_links(heads.select("fp"))
    for side in "ab":
        links = links.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), side)
    pairs = links.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    equal = texts.select("fp", "id").join(heads, "fp").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(equal).unionByName(shared.select(F.col("hub").alias("a"), F.col("id").alias("b"))).where("a < b").distinct()


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs a, b whose signatures agree in AGREE places."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_signs(a) == _signs(b)).sum(axis=1) >= AGREE) if len(a) else pd.Series([], dtype=bool)

    for side in "ba":
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("sign").alias(f"sign_{side}")), side)
    return pairs.where(F.pandas_udf(run, "boolean")("sign_a", "sign_b")).select("a", "b")


def sets_of(ids: DataFrame, texts: DataFrame, docs: DataFrame, text: Column, size: int) -> DataFrame:
    """id and shingles of the texts of ids, from any document that has the text."""
    named = stash(texts.select("id", "md5").join(small(ids.distinct(), NARROW), "id"), "compared")
    rows = docs.select(F.md5(text).alias("md5"), text.alias("text")).join(small(named, NARROW), "md5").dropDuplicates(["id"])
    return stash(rows.select("id", shingle_set(F.col("text"), size).alias("shingles")), "shingles")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, text: Column, size: int, similarity: float) -> DataFrame:
    """Those pairs a, b whose shingle sets reach the similarity."""
    pairs = stash(agreeing(pairs, texts), "candidates")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts, docs, text, size)
    for side in "ba":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return stash(pairs.where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"), "similar")


def apart(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows band, id, hub, root of the bands whose texts the links leave in more than one group. In a band of two the only pair has been compared."""
    roots = components(links).withColumnRenamed("node", "id")
    rows = stash(shared.where("n > 2").join(roots, "id", "left").select("band", "id", "hub", F.coalesce("root", "id").alias("root")), "band-groups")
    some = stash(rows.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band"), "bands-apart")
    return stash(rows.join(small(some, NARROW), "band"), "apart")


def second_hubs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a < b of each band's text nearest the majority of its fingerprints and the texts of other groups. Sums, bit by bit, find the majority."""
    rows = stash(rows.join(texts.select("id", "fp"), "id"), "apart-prints")
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"bit{i}") for i in range(64)]
    middle = rows.groupBy("band").agg(*bits)
    majority = F.lit(0).cast("long")
    for i in range(64):
        majority = majority.bitwiseOR(F.when(F.col(f"bit{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
    middle = stash(middle.select("band", majority.alias("middle")), "band-majorities")
    near = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))), F.col("id"))
    hubs = rows.join(small(middle, NARROW), "band").groupBy("band").agg(F.min_by(F.struct("id", "root"), near).alias("second"))
    hubs = stash(hubs, "second-hubs")
    met = rows.join(small(hubs, NARROW), "band").where("root <> second.root and hub <> second.id")
    return met.select(F.least("id", "second.id").alias("a"), F.greatest("id", "second.id").alias("b")).distinct()


def compare(block: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """A spanning forest of the links between the texts outside a band's largest group and all of it. Columns: band, outside, id, root, sign, shingles."""
    band, signs, sets = int(block["band"].iloc[0]) & 63, _signs(block["sign"]), block["shingles"].to_numpy()
    ids, roots, outside = block["id"].to_numpy(), block["root"].to_numpy(), block["outside"].to_numpy()
    every, trees, found = np.flatnonzero(~outside), Forest(), []
    every_signs, every_roots = signs[every], roots[every]
    for i in np.flatnonzero(outside):
        same = every_signs == signs[i]
        near = np.flatnonzero((same.sum(axis=1) >= AGREE) & (every_roots != roots[i]))
        first = same[near].reshape(len(near), BANDS, ROWS).all(axis=2).argmax(axis=1)  # a pair is compared in the first band that it shares
        for j in every[near[first == band]]:
            if trees.root(roots[i]) != trees.root(roots[j]):
                n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                    trees.join(roots[i], roots[j])
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])


def rest_links(rows: DataFrame, texts: DataFrame, docs: DataFrame, text: Column, size: int, similarity: float) -> DataFrame:
    """Verified links between different groups of a band, found in full."""
    sets = sets_of(rows.select("id"), texts, docs, text, size)
    groups = rows.groupBy("band", "root").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("largest"))
    rows = rows.join(small(stash(groups, "band-largest"), NARROW), "band")
    weighed = sets.join(texts.select("id", "sign"), "id").withColumn("bytes", F.size("shingles") * 4 + BANDS * ROWS)
    rows = stash(rows.select("band", "id", "root", (F.col("root") != F.col("largest")).alias("outside")).join(weighed.select("id", "bytes"), "id"), "apart-weighed")
    parts = lambda who: F.ceil(F.greatest(F.sum(F.when(who, 1).otherwise(0)) / BLOCK, F.sum(F.when(who, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    cuts = stash(rows.groupBy("band").agg(parts(F.lit(True)).alias("n_all"), parts(F.col("outside")).alias("n_out")), "band-cuts")
    rows = rows.join(small(cuts, NARROW), "band")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = rows.select("band", "id", "root", F.lit(False).alias("outside"), block("n_all").alias("i"), each("n_out").alias("j"))
    out = rows.where("outside").select("band", "id", "root", "outside", block("n_out").alias("j"), each("n_all").alias("i"))
    met = here.unionByName(out).join(weighed.select("id", "sign", "shingles"), "id")
    return met.groupBy("band", "i", "j").applyInPandas(lambda block: compare(block, similarity), "a long, b long").distinct()


def similar_groups(docs: DataFrame, text: Column, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """md5 and root of each distinct text that has words: texts of one root are linked by similarities of at least `similarity`."""
    told = docs.select(F.md5(text).alias("md5"), prints(text, size).alias("p"))
    told = told.where("p.sign is not null").groupBy("md5").agg(F.first("p.fp").alias("fp"), F.first("p.sign").alias("sign"))
    texts = stash(told.select(F.monotonically_increasing_id().alias("id"), "md5", "fp", "sign"), "texts")
    shared = bands(texts)
    links = verified(candidates(texts, shared), texts, docs, text, size, similarity)
    rest = apart(shared, links)
    if not rest.isEmpty():
        links = links.unionByName(verified(second_hubs(rest, texts), texts, docs, text, size, similarity))
        rest = apart(shared, links)
        if not rest.isEmpty():
            links = links.unionByName(stash(rest_links(rest, texts, docs, text, size, similarity), "rest-links"))
    roots = components(links).withColumnRenamed("node", "id")
    return stash(texts.select("id", "md5").join(roots, "id", "left").select("md5", F.coalesce("root", "id").alias("root")), "groups")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of equal and near texts; all columns as they were."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    groups = similar_groups(docs.select(id_col, text_col), text, size, similarity)
    order = F.struct(own.isNull().alias("last"), own.alias("id"), F.md5(text).alias("md5"), F.col(text_col).isNull().alias("none"))
    key = F.md5(F.to_json(order))
    rows = docs.select(F.md5(text).alias("md5"), F.struct(order.alias("order"), key.alias("key")).alias("row"))
    first = rows.groupBy("md5").agg(F.min("row").alias("row")).join(groups, "md5", "left")
    kept = first.groupBy(F.coalesce(F.col("root").cast("string"), "md5").alias("group")).agg(F.min("row").alias("row")).select("row.key", F.lit(True).alias("kept"))
    told = stash(rows.groupBy("row.key").agg(F.count("*").alias("n")).join(kept, "key", "left"), "kept")
    k, names = internal("key"), docs.columns
    keyed = docs.withColumn(k, key)
    alone = keyed.join(small(told.where("kept is null or n > 1").select(F.col("key").alias(k)), NARROW), k, "left_anti").select(*names)
    again = told.where("kept and n > 1").select(F.col("key").alias(k))
    if again.isEmpty():
        return alone
    return alone.unionByName(keyed.join(small(again, NARROW), k, "left_semi").dropDuplicates([k]).select(*names))
