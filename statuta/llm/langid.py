"""Language identification by rank order: a document's most frequent n-grams against each language's, by out-of-place distance.

Cavnar and Trenkle, "N-Gram-Based Text Categorization". N-grams of one to three characters lie within
words of letters, with one mark for either end of a word. A profile is the order of the most frequent
n-grams; ties are in order of code points, so the result depends on the rows alone.

Defined cases: null or letterless texts, or no learned language at all, give `und` and score 0; rows
of null language teach nothing; equal distances give the first language by name; repeated rows count
each time; an empty table gives no rows. Texts are counted whole, in pieces of bounded size; a long text is cut into several.
Extra columns don't matter, since prediction works on a column and learning reads text and lang alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import give_back

UNKNOWN = "und"
BITS = 21  # of a code point
END = 1  # marks the end of a word; U+0001 is no letter
PIECE = 1 << 15  # characters that are counted at a time; fewer than the 65,536 letters that a count tells apart

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def _ngrams(low: list[str], known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of each text (in lower case, between spaces): text number, n-gram, count; sorted by the first two.
    known: characters at the start that have been counted, and only lead up to the rest."""
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    seen = np.flatnonzero(np.bincount(codes[is_letter], minlength=END + 1))
    seen = np.concatenate([[END], seen]).astype(np.uint64)
    dense = np.zeros(int(seen[-1]) + 1, np.uint16)
    dense[seen[1:].astype(np.int64)] = np.arange(1, len(seen))
    c = np.where(is_letter, dense[np.where(is_letter, codes, 0)], 0).astype(np.uint64)
    text = np.repeat(np.arange(len(low), dtype=np.uint64), sizes) << np.uint64(50)
    s16, n = np.uint64(16), [np.uint64(k << 48) for k in (0, 1, 2)]
    two, three = c[:-1] << s16 | c[1:], (c[:-2] << s16 | c[1:-1]) << s16 | c[2:]
    alone, either, middle = is_letter.copy(), is_letter[:-1] | is_letter[1:], is_letter[1:-1]
    alone[:known], either[: max(known - 1, 0)] = False, False
    keys = np.concatenate([(text | n[0] | c)[alone], (text[1:] | n[1] | two)[either], (text[2:] | n[2] | three)[middle]])
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    kind, low16 = keys >> np.uint64(48) & np.uint64(3), np.uint64(0xFFFF)
    a, b, d = (seen[(keys >> np.uint64(k) & low16).astype(np.int64)] for k in (32, 16, 0))
    s21, s42 = np.uint64(BITS), np.uint64(2 * BITS)
    grams = d | np.where(kind >= 1, b << s21, np.uint64(0)) | np.where(kind == 2, a << s42, np.uint64(0))
    return (keys >> np.uint64(50)).astype(np.int64), grams.astype(np.int64), count


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _ngrams, of texts that _pieces has put together; a long one is counted part by part, each with the two characters before it."""
    low = [f" {x.lower()} " for x in texts]
    if len(low) > 1 or len(low[0]) <= PIECE:
        return _ngrams(low)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(low[0]), PIECE):
        known = min(at, 2)
        parts.append(_ngrams([low[0][at - known : at + PIECE]], known)[1:])
        if len(parts) == 64:
            parts = [_merged(parts)]
    grams, n = _merged(parts)
    return np.zeros(len(grams), np.int64), grams, n


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length, with the number of the first."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if i > start and (held + len(x) > PIECE or i - start >= 8000):
            yield start, texts[start:i]
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, texts[start:]


def fold(id_col: Column) -> Column:
    """The fold of an id, 0 to 4; documents of fold 0 are held out and teach nothing. A null id is in fold 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def count_ngrams(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """Counts of all n-grams of all texts by language: lang, gram, n; each task sends one row for each of its n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, own in batch.groupby("lang")["text"]:
                parts = held.setdefault(name, [])
                for _, texts in _pieces(own.tolist()):
                    _, grams, n = ngrams(texts)
                    parts.append((grams, n))
                    if sum(len(g) for g, _ in parts[1:]) > 500_000:
                        parts[:] = [_merged(parts)]
            give_back()
        for name, parts in held.items():
            grams, n = _merged(parts)
            yield pd.DataFrame({"lang": name, "gram": grams, "n": n})

    rows = docs.select(lang.cast("string").alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    return rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Profiles:
    """ranks: for each of the sorted grams, its place in each language's order, or size where it has none."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


def learn(docs: DataFrame, text: Column | None = None, lang: Column | None = None, size: int = 400) -> Profiles:
    """Profiles of all languages from the counts of all rows; only `size` rows a language come to the driver."""
    counts = count_ngrams(docs, F.col("text") if text is None else text, F.col("lang") if lang is None else lang)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank")).toPandas()
    langs, grams = sorted(top["lang"].unique()), np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(grams), len(langs)), size, np.int64)
    ranks[np.searchsorted(grams, top["gram"].to_numpy(np.int64)), [langs.index(x) for x in top["lang"]]] = top["rank"]
    return Profiles(langs, grams, ranks, size)


def distances(texts: list[str], p: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the out-of-place distance to each profile and the number of its n-grams that take part."""
    out, kept = np.zeros((len(texts), len(p.langs))), np.zeros(len(texts), np.int64)
    for start, some in _pieces(texts):
        text, grams, n = ngrams(some)
        by = np.argsort((text << 32) - n, kind="stable")
        text, grams = text[by], grams[by]
        first = np.searchsorted(text, np.arange(len(some)))
        rank = np.arange(len(text)) - first[text]
        top = rank < p.size
        text, grams, rank = text[top], grams[top], rank[top]
        at = np.minimum(np.searchsorted(p.grams, grams), len(p.grams) - 1)
        known = p.grams[at] == grams
        for k in range(len(p.langs)):
            place = np.where(known, p.ranks[at, k], p.size)
            out[start : start + len(some), k] = np.bincount(text, np.where(place == p.size, p.size, np.abs(place - rank)), len(some))
        kept[start : start + len(some)] = np.bincount(text, minlength=len(some))
    return out, kept


def predict(text: Column, p: Profiles) -> Column:
    """A struct of lang_pred and score: one less the distance as a share of the greatest possible."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if p.langs and len(batch):
                far, kept = distances(batch.fillna("").tolist(), p)
                best, some = far.argmin(axis=1), kept > 0
                lang[some] = np.array(p.langs, object)[best[some]]
                score[some] = 1 - far[some, best[some]] / (p.size * kept[some])
            give_back()
            yield pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1)})

    return F.pandas_udf(run, "lang_pred string, score double")(text)
