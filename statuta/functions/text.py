"""Text, vector and scalar functions as column expressions."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

DIMENSIONS = 256
WORD = re.compile(r"\w+")


# The characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NO_SPACE = re.compile(f"[^{WHITE_SPACE}]+")


def py_strip(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(x, F.lit(WHITE_SPACE))


@cache
def _accents() -> tuple[str, str]:
    """Lower-case letters with marks, and the letters they are built on; marks that stand alone go by a pattern."""
    pairs = []
    for i in range(0xC0, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.decomposition(c) and c == c.lower() and c.isalpha():
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c and ord(c) < 0x10000:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(x: Column) -> Column:
    """Lower case without marks; the letter đ is no marked d and stays."""
    return F.regexp_replace(F.translate(F.lower(x), *_accents()), r"\p{Mn}", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, state: str, value: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], run: int = 128) -> Column:
    """An array of the values that step(state, x) gives, with the next state, for each x of an array in turn. state and
    value are their types. An array is copied whenever it grows, so the work is done in runs and the runs are strung together."""
    none = F.array().cast(f"array<{value}>")

    def own(at: Column, xs: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            new, out = step(acc["state"], x)
            return let(F.struct(new.alias("state"), out.alias("value")), lambda r: F.struct(r["state"].cast(state).alias("state"), F.array_append(acc["out"], r["value"].cast(value)).alias("out")))

        return F.aggregate(xs, F.struct(at.cast(state).alias("state"), none.alias("out")), one)

    def strung(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(run)), lambda at: F.slice(v, at, run))
        done = F.aggregate(runs, F.array().cast(f"array<struct<state:{state},out:array<{value}>>>"), lambda acc, xs: F.array_append(acc, own(F.coalesce(F.get(acc, F.size(acc) - 1)["state"], start), xs)))
        return F.when(F.size(v) > 0, F.flatten(F.transform(done, lambda r: r["out"]))).otherwise(none)

    return let(values, strung)


def tokenize(x: Column) -> Column:
    """Lower-case words at white space, then each occurrence's form without marks where no word has that form."""
    words = F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda t: t != "")
    marked = lambda w: F.filter(w, lambda t: F.regexp_like(t, F.lit(r"[^\x00-\x7F]")))
    bare = lambda w: F.filter(F.transform(marked(w), strip_diacritics), lambda t: t != "")
    new = lambda w, b: let(F.array_intersect(b, w), lambda held: F.filter(b, lambda t: ~F.array_contains(held, t)))
    return let(words, lambda w: F.concat(w, let(bare(w), lambda b: new(w, b))))


class _Plain(dict):
    """For str.translate: letters without their marks, and marks that stand alone gone, as strip_diacritics() has it."""

    def __missing__(self, c: int) -> int | None:
        self[c] = out = None if unicodedata.category(chr(c)) == "Mn" else c
        return out


@cache
def _plain() -> _Plain:
    return _Plain(zip(map(ord, _accents()[0]), _accents()[1]))


@lru_cache(1 << 16)
def _bare(word: str) -> str:
    return word.translate(_plain())


def tokens_of(low: str) -> list[str]:
    """What tokenize() gives for a text, from its lower case as Spark has it: for use within tasks."""
    no_space = any(c in low for c in "\x1c\x1d\x1e\x1f")  # Python splits at these, too
    words = NO_SPACE.findall(low) if no_space else low.split()
    if low.isascii():
        return words
    bare = [b for w in words if not w.isascii() and (b := _bare(w)) and b != w]
    held = set(words) if bare else ()
    return words + [b for b in bare if b not in held]


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def normalize_province(x: Column) -> Column:
    return F.lower(F.regexp_replace(py_strip(nfc(x)), r"(?iuU)^(?:tỉnh|thành\s*phố)\s+", ""))


def default_keywords(query: Column) -> Column:
    return F.filter(F.split(query, r"""[\s,.;:!?()\[\]"']+"""), lambda t: F.length(t) >= 3)


def task_prompt(model: str, text: Column, task: str = "passage") -> Column:
    """The prefix that models of the e5 family were trained with; none for others."""
    return F.concat(F.lit("query: " if task == "query" else "passage: "), text) if "e5" in model.lower() else text


class _Buckets(dict):
    """Of what stands between white space, which no word spans: the buckets of its words, a byte each. A bounded number of them is kept, those last asked for."""

    HELD = 250_000

    def __init__(self):
        self.old: dict[str, bytes] = {}

    def __missing__(self, x: str) -> bytes:
        if len(self) >= self.HELD:
            self.old = dict(self)
            self.clear()
        out = self.old.pop(x, None)
        if out is None:
            out = bytes([hashlib.md5(w.encode()).digest()[-1] for w in ((x,) if x.isalnum() else WORD.findall(x))])
        self[x] = out
        return out


@cache
def _buckets() -> _Buckets:
    return _Buckets()


def hashing_vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of word counts in 256 buckets, by the last byte of each word's MD5; zero for no words."""
    out, bucket = np.zeros((len(texts), DIMENSIONS)), _buckets().__getitem__
    for i, x in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(b"".join(map(bucket, (x or "").lower().split())), np.uint8), minlength=DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


@F.pandas_udf(ArrayType(DoubleType()))
def hashing_embedding(x: pd.Series) -> pd.Series:
    return pd.Series(list(hashing_vectors(x.tolist())))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lexical_overlap(query: Column, text: Column) -> Column:
    """The share of the query's words that the text holds."""
    terms = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: t != "")
    held = let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    return F.when(F.size(terms) > 0, F.least(F.lit(1.0), held / F.size(terms))).otherwise(F.lit(0.0))


def citation(law_name: Column, article: Column, part_index: Column, part_count: Column) -> Column:
    part = F.when(part_count > 1, F.format_string(" (part %d/%d)", part_index + 1, part_count)).otherwise("")
    return F.concat(F.coalesce(law_name, F.lit("unknown source")), F.lit(", Điều "), F.coalesce(article, F.lit("?")), part)


def excerpt(markdown: Column, start: Column, end: Column, limit: int = 600) -> Column:
    return F.coalesce(py_strip(F.substring(markdown, start + 1, F.greatest(F.least(end - start, F.lit(limit)), F.lit(0)))), F.lit(""))


def keyword_vector(x: Column, vocabulary: list[str]) -> Column:
    """How often each term stands in the text."""
    return F.array(*(F.size(F.split(F.lower(x), re.escape(v.lower()))) - 1 for v in vocabulary))
