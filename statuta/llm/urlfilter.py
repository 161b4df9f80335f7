"""URL filter: rules first, then the ratio of two character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each character's probability
after the characters before it: counts of all orders up to `order` are interpolated, each order leaning on the
next lower by the number of distinct characters that followed its context (Witten and Bell). A URL's score is
the difference of the two log-likelihoods over its length. The threshold is calibrated on labelled hosts that
the models have not seen, where it makes the two error rates equal.

Counts are exact: a row for each (kind, context, character) that occurs, in a table that grows with the corpus; a
context and its character are packed into one number without loss. URLs are scored in blocks of bounded size: a
block's distinct contexts and characters are joined to the counts, and what is found comes back to the block. So no
task and not the driver holds the table, and a frequent context is one row of a block, however often it occurs.

Defined cases: a null url or one without `://` has an empty host and path, and the method judges its empty
text, which scores 0; with no labelled URL of either kind every score is 0 and the verdict is allow; repeated
rows are judged alike and counted each time; an empty table gives no rows; urls of any length are counted and scored
whole; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from statuta.llm.common import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("allow", "block")
BLOCK, BLOCK_BYTES = 1000, 200_000
BINS = 2000
REACH = 4.0  # of the scores that are told apart when the threshold is set


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class UrlRule:
    """verdict for the host and its subdomains where the path starts as the rule's does."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


def longest_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. The rules are configuration: a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _contexts(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all characters (bytes) of all urls: url number, and for orders 0 to `order` the (context, character) as one
    number: nine bits each for the order, the context's characters and, last, the character. The start of a url is 256."""
    raw = [x.encode("utf-8", "surrogatepass") for x in urls]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    url = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(url)) + order * (url + 1)
    codes = np.full(len(url) + order * (len(raw) + 1), 256, np.int64)
    codes[at] = np.frombuffer(b"".join(raw), np.uint8)
    gram = np.empty((len(at), order + 1), np.int64)
    before = np.zeros(len(at), np.int64)
    for k in range(order + 1):
        gram[:, k] = k << 54 | before << 9 | codes[at]
        if k < order:
            before |= codes[at - k - 1] << 9 * k
    return url, gram


def _context(gram):
    """The number of a gram's context: its character is 511."""
    return gram | 511


def _blocks(rows: DataFrame) -> DataFrame:
    """rows with a column block: at most BLOCK rows and, but for one long url, BLOCK_BYTES characters of url have one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, n, size = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            own = []
            for length in batch["url"].str.len():
                if n and (n >= BLOCK or size + length > BLOCK_BYTES):
                    number, n, size = number + 1, 0, 0
                n, size = n + 1, size + length
                own.append(part << 32 | number)
            yield batch.assign(block=np.array(own, np.int64))

    schema = StructType([*rows.schema.fields, StructField("block", LongType())])
    return stash(rows.mapInPandas(run, schema), "url-blocks")


def _count(urls: DataFrame, order: int) -> DataFrame:
    """Exact counts from rows of url and verdict. key: a gram or its context; of each kind n, how often it occurs, and t, of a context its distinct characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, own in batch.groupby("verdict")["url"]:
                own = own.tolist()
                for i in range(0, len(own), BLOCK):
                    key, n = np.unique(_contexts(own[i : i + BLOCK], order)[1], return_counts=True)
                    yield pd.DataFrame({"verdict": kind, "key": key, "n": n})

    grams = urls.mapInPandas(run, "verdict string, key long, n long").groupBy("verdict", "key").agg(F.sum("n").alias("n"))
    grams = stash(grams, "url-grams")
    contexts = grams.groupBy("verdict", F.col("key").bitwiseOR(F.lit(511)).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    every = grams.select("verdict", "key", "n", F.lit(0).cast("long").alias("t")).unionByName(contexts)
    sums = [F.sum(F.when(F.col("verdict") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in KINDS for c in "nt"]
    return stash(every.groupBy("key").agg(*sums), "url-counts")


def _log_likelihood(gram: np.ndarray, keys: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of each character; keys are sorted, those that are missing occur never."""

    def of(key: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        return np.where(keys[at] == key, values[at], 0) if len(keys) else np.zeros(len(key))

    p = np.full(len(gram), 1 / 256)
    for k in range(gram.shape[1]):
        total, kinds = of(_context(gram[:, k]), n), of(_context(gram[:, k]), t)
        p = np.where(total > 0, (of(gram[:, k], n) + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p)


def score(rows: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """rows (with url and block) and score: log-likelihood as accepted less that as rejected, by character."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, own in batch.groupby("block")["url"]:
                gram = np.unique(_contexts(own.tolist(), order)[1])
                yield pd.DataFrame({"block": block, "key": np.unique(np.concatenate([gram, _context(gram)]))})

    def run(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("key").drop_duplicates("key")
        keys, out = found["key"].to_numpy(), np.zeros(len(own))
        url, gram = _contexts(own["url"].tolist(), order)
        if len(url):
            a, b = (_log_likelihood(gram, keys, found[f"n_{k}"].to_numpy(), found[f"t_{k}"].to_numpy()) for k in KINDS)
            out = np.bincount(url, a - b, len(own)) / np.maximum(np.bincount(url, minlength=len(own)), 1)
        return own.assign(score=out)

    keys = rows.select("block", "url").mapInPandas(asked, "block long, key long")
    found = keys.join(counts, "key")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(run, schema)


def threshold(held: DataFrame) -> float:
    """Where the error rates of held rows (verdict, score) are equal, from a histogram of BINS bins a kind."""
    bins = F.least(F.greatest(((F.col("score") + REACH) / (2 * REACH) * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    counts = held.groupBy("verdict", bins.alias("bin")).count().toPandas()
    shares = []
    for kind in KINDS:
        own = counts[counts["verdict"] == kind]
        n = np.bincount(own["bin"].to_numpy(int), own["count"].to_numpy(float), BINS)
        shares.append(np.concatenate([[0], np.cumsum(n)]) / max(1, n.sum()))
    lost, caught = shares  # below a threshold: accepted URLs wrongly, rejected ones rightly
    gap = np.abs(lost - (1 - caught))
    best = np.flatnonzero(gap == gap.min())
    edge = best[np.abs(best - BINS / 2).argmin()] if lost[-1] and caught[-1] else BINS / 2
    return float(edge / BINS * 2 * REACH - REACH)


def judge(pages: DataFrame, rules: list[UrlRule], order: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict and score. The URLs that a rule decides teach the models, which judge the others;
    a fifth of their hosts, by hash, is left out of the counts and sets the threshold."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.concat(host, rest).alias("url"))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    rows = _blocks(rows.select("*", fit["rule"].alias("rule"), fit["verdict"].alias("fit")))
    held = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    counts = _count(rows.where(F.col("fit").isNotNull() & ~held).select(F.col("fit").alias("verdict"), "url"), order)
    told = stash(score(rows, counts, order), "url-scores")
    least = threshold(told.where(F.col("fit").isNotNull() & held).select(F.col("fit").alias("verdict"), "score"))
    own = F.when(F.col("score") >= least, "allow").otherwise("block")
    return told.select("page_id", "host", "path", "rule", F.coalesce("fit", own).alias("verdict"), "score")
