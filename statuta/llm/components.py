"""Connected components of a table of links, by alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, stash

HUB_SHARE = 1000
FEW = 50_000


class Forest:
    """Disjoint sets of ids; the smallest id of a set is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def links(self) -> pd.DataFrame:
        kids = [x for x, y in self.up.items() if x != y]
        return pd.DataFrame({"a": kids, "b": [self.root(x) for x in kids]}, dtype="int64")


def contract(links: DataFrame) -> DataFrame:
    """Fewer links (a > b) with the same components: what one task holds becomes stars. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                forest.join(a, b)
        yield forest.links()
        forest.up.clear()
        give_back()

    return links.mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for each node of a link (a, b of type long).

    Each round writes its links to the shared folder; the rounds end when the links no longer change, which count and
    checksum tell the driver, or when at most FEW links are left, which one task contracts. A node of more than one in
    HUB_SHARE of all links would fill one task of a join; there are at most 2 * HUB_SHARE such hubs, and they are broadcast.
    """
    links = stash(contract(links.select("a", "b").where("a <> b")).distinct(), "links")
    seen = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        if now["n"] <= FEW:
            links = stash(contract(links.coalesce(1)), "links")
            break
        seen = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, now["n"]).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        lower = _with_least(stash(large, "large-stars"), now["n"])
        small = lower.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        links = stash(contract(small).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """links with m, the smallest b of their a. Hubs are joined by a broadcast, the other nodes by a shuffle."""
    least = stash(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")), "least")
    hub = F.col("k") * HUB_SHARE > n
    hubs = F.broadcast(least.where(hub).drop("k"))
    rest = links.join(hubs, "a", "left_anti").join(least.where(~hub).drop("k"), "a")
    return links.join(hubs, "a").unionByName(rest)
