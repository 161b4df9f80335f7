"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching (Wise, "YAP3").

A document and a test item are compared if they share a seed, a run of `min_match` words found by its rolling
hash. A shared seed whose words before differ begins a maximal match; where they are alike the match began earlier. So
of words that both repeat, pairs of places are not listed, only those where a match begins: of two texts of one word as many
as both have words. How far a match goes is found by bisection with Karp-Rabin hashes of any stretch, and the words
themselves are compared before it counts. The longest free match is marked as a tile
again and again, its tokens free no more, until no match of `min_match` words is left. Tiles may stand in any
order, so a passage whose parts were moved about is still covered. A document is contaminated if the tiles
cover at least `threshold` of some item's words.

The items travel to the tasks in blocks whose text is bounded, so neither a task nor the driver holds more of
the benchmark than a block: one block is one pass over the documents, more blocks are as many passes, of which
each document's best result is kept.

Defined cases: null and empty texts and items of fewer than min_match words match nothing; of equal coverage
the smallest item_id counts; repeated rows come out as often; an empty table of either kind gives no match; texts of
any length are searched whole, at 24 bytes a word besides its number; extra columns are kept, whatever their names, and
only one of the name that `out` gives is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, internal, small, stash

WORDS = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
BEGIN, UNKNOWN, FIRST = -1, -2, -3  # in place of a word before: the begin of a document, a word that no item has, the begin of an item
RESULT = "coverage double, item_id long, tiles long, tiled_words long"


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows, modulo 2 to the 64."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = out * BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 to the 64, kept by a worker."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)


class Stretches:
    """Karp-Rabin hashes of all stretches of a sequence: equal words have equal hashes, wherever they stand and in whatever sequence."""

    def __init__(self, ids: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(ids) * powers(len(ids) + 1)[0][: len(ids)], dtype=np.uint64)])

    def hashes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * powers(len(self.sums))[1][at]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those from first[1] on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Items:
    """Test items with their words as numbers and their seeds, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.min, self.ids, self.vocab = min_match, [i for i, _ in items], {}
        self.tokens = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)], np.int64) for _, t in items]
        hashes = [rolling(x, min_match) for x in self.tokens]
        item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
        at = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        seeds = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order], at[order]
        flat = np.concatenate([*self.tokens, np.zeros(0, np.int64)])
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(items))
        self.base = np.cumsum(self.sizes) - self.sizes
        self.stretches = Stretches(flat)
        self.left = np.where(self.at > 0, flat[np.maximum(self.base[self.item] + self.at - 1, 0)], FIRST) if len(self.at) else self.at

    def shared(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Of a document, the numbers of its words and the windows whose words all stand in the benchmark and whose hash is a seed's."""
        ids = np.fromiter(map(self.vocab.get, found, [0] * len(found)), np.int64, len(found)) if (found := words(text)) else np.zeros(0, np.int64)
        if len(ids) < self.min or not len(self.seeds):
            return ids, np.zeros(0, np.int64)
        unknown = np.cumsum(np.concatenate([[0], ids == 0]))
        at = np.flatnonzero(unknown[self.min :] == unknown[: -self.min])
        hashes = sum_windows(ids, at, self.min)
        place = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        return ids, at[self.seeds[place] == hashes]

    def best(self, text: str | None) -> tuple[float, int, int, int] | None:
        """The best covered item: coverage, item_id, tiles, tiled words."""
        ids, at = self.shared(text)
        if not len(at):
            return None
        own, results = Stretches(ids), []
        for item, test, doc in self.starts(ids, at):
            size = self.reach(own, len(ids), item, test, doc)
            cuts = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
            for i, j in zip(cuts, cuts[1:]):
                k = int(item[i])
                tiles, covered = tile(size[i:j], test[i:j], doc[i:j], self.tokens[k], ids, self.min)
                if covered:
                    results.append((-covered / len(self.tokens[k]), self.ids[k], tiles, covered))
        if not results:
            return None
        share, item_id, tiles, covered = min(results)
        return -share, item_id, tiles, covered

    def starts(self, ids: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, place in it and place in the document where maximal matches begin, by item, some items at a time: about `most` of them, or those of one item."""
        hashes = sum_windows(ids, at, self.min)
        left = np.where(at > 0, ids[np.maximum(at - 1, 0)], BEGIN)
        left[left == 0] = UNKNOWN
        order = np.lexsort((left, hashes))
        at, hashes, left = at[order], hashes[order], left[order]
        seeds, first, times = np.unique(hashes, return_index=True, return_counts=True)
        low, high = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, "right")
        seed, pick = np.repeat(np.arange(len(seeds)), high - low), spread(low, high - low)
        by_item = np.argsort(self.item[pick], kind="stable")
        seed, pick = seed[by_item], pick[by_item]
        item, width = self.item[pick], len(self.vocab) + 4  # of words before, those of the document are sorted within a seed
        keys, key = np.repeat(np.arange(len(seeds)), times) * width + left + 3, seed * width + self.left[pick] + 3
        low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")  # there the words before are alike
        before, after = low - first[seed], first[seed] + times[seed] - high
        upto, ends = np.cumsum(before + after), np.append(np.flatnonzero(np.diff(item)) + 1, len(item))
        start = 0
        while start < len(item):
            done = upto[start - 1] if start else 0
            fits = ends[(ends > start) & (upto[ends - 1] - done <= most)]
            end = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, start, "right")])
            some = slice(start, end)
            n = before[some] + after[some]
            doc = spread(first[seed[some]], n)  # places after those before jump over what is alike
            jump = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) >= np.repeat(before[some], n)
            doc += np.where(jump, np.repeat(high[some] - low[some], n), 0)
            if len(doc):
                yield np.repeat(item[some], n), np.repeat(self.at[pick[some]], n), at[doc]
            start = end

    def reach(self, own: Stretches, n: int, item: np.ndarray, test: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How many words are alike from each start on, by bisection: at least those of the seed."""
        least, most = np.full(len(item), self.min, np.int64), np.minimum(self.sizes[item] - test, n - doc)
        place = self.base[item] + test
        while (open_ := np.flatnonzero(least < most)).size:
            middle = (least[open_] + most[open_] + 1) // 2
            same = own.hashes(doc[open_], middle) == self.stretches.hashes(place[open_], middle)
            least[open_], most[open_] = np.where(same, middle, least[open_]), np.where(same, most[open_], middle - 1)
        return least


def sum_windows(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * BASE + ids[at + k].astype(np.uint64)
    return out


def free_runs(taken: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begins and ends of the stretches of at least `least` that are not taken."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
    return [(i, j) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()) if j - i >= least]


def tile(size: np.ndarray, test: np.ndarray, doc: np.ndarray, item: np.ndarray, ids: np.ndarray, min_match: int) -> tuple[int, int]:
    """Tiles and covered words of a test item, of maximal matches (length, place in the item, place in the document)."""
    order = np.lexsort((doc, test, -size))
    matches = zip((-size[order]).tolist(), test[order].tolist(), doc[order].tolist())
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(ids), bool)
    parts, tiles, now = [], 0, next(matches, None)
    while now or parts:
        if parts and (now is None or parts[0] < now):
            n, t, d = heapq.heappop(parts)
        else:
            (n, t, d), now = now, next(matches, None)
        n = -n
        taken = in_item[t : t + n] | in_doc[d : d + n]
        if taken.any():
            for i, j in free_runs(taken, min_match):  # the parts that are still free may be tiles later
                heapq.heappush(parts, (i - j, t + i, d + i))
            continue
        same = item[t : t + n] == ids[d : d + n]
        if not same.all():  # hashes may collide; words decide
            if (n := int(np.argmin(same))) >= min_match:
                heapq.heappush(parts, (-n, t, d))
            continue
        in_item[t : t + n] = in_doc[d : d + n] = True
        tiles += 1
        if not free_runs(in_item, min_match) or not free_runs(in_doc, min_match):
            break
    return tiles, int(in_item.sum())


def blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """The number of blocks, and a function that fetches one: items dealt by hash, of about block_chars characters a block."""
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, lambda k: [(r["item_id"], r["text"]) for r in items.where(of == k).collect()]


def best_item(text: Column, items: list[tuple[int, str]], min_match: int, spark) -> Column:
    """A struct of coverage, item_id, tiles, tiled_words; null where no seed is shared."""
    sent, made = spark.sparkContext.broadcast(items), []

    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Items(sent.value, min_match))
        give_back()
        out = [made[0].best(x) or (None, None, None, None) for x in texts]
        return pd.DataFrame(out, columns=["coverage", "item_id", "tiles", "tiled_words"]).astype({"coverage": "float64", "item_id": "Int64", "tiles": "Int64", "tiled_words": "Int64"})

    return F.pandas_udf(run, RESULT)(text)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5, block_chars: int = 8 << 20, text_col: str = "text", out: str = "contamination") -> DataFrame:
    """docs with one more column, named by `out`: a struct of coverage, item_id, tiles, tiled_words and contaminated."""
    spark = docs.sparkSession
    n, block = blocks(benchmark, block_chars)
    if n == 1:
        found = docs.withColumn(out, best_item(F.col(text_col), block(0), min_match, spark))
    else:
        same, key = internal("text"), F.md5(F.coalesce(F.col(text_col), F.lit("")))
        every = None
        for k in range(n):
            each = docs.select(key.alias(same), best_item(F.col(text_col), block(k), min_match, spark).alias("r")).where("r.coverage is not null")
            each = stash(each.distinct(), "contamination")
            every = each if every is None else every.unionByName(each)
        order = F.struct(F.col("r.coverage").alias("coverage"), (-F.col("r.item_id")).alias("item"))
        best = stash(every.groupBy(same).agg(F.max_by("r", order).alias(out)), "contamination-best")
        found = docs.withColumn(same, key).join(small(best), same, "left").select(*docs.columns, out)
    r = F.col(out)
    coverage = F.coalesce(r["coverage"], F.lit(0.0))
    return found.withColumn(out, F.struct(coverage.alias("coverage"), r["item_id"].alias("item_id"), F.coalesce(r["tiles"], F.lit(0)).alias("tiles"), F.coalesce(r["tiled_words"], F.lit(0)).alias("tiled_words"), (coverage >= threshold).alias("contaminated")))
