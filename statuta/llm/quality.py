"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Word and line counts of each document are features, made when a rule first asks for one and then kept for the
document. So what a rule costs, and how many documents are left for it to reject, depends on the rules before it.
The order is found greedily on a sample of whole documents: of the rules left, the one that rejects most a second
among the documents that those chosen so far have passed, with the features that they have made at hand, comes next.
The cascade then skips all rules behind the first that rejects, and the features that only they need. The order
changes only the time, never the verdict: a document is kept if every rule passes it.

judge() also returns the base features, which are thus made for every document: they cost its rules nothing more
(`ready`), and what the cascade can save is the work of the other rules. cascade() makes none but what its rules ask.

Defined cases: a null text has no words and fails the base rule; repeated rows are judged alike; texts are read
whole; extra columns are kept by cascade() and not read by judge(); an empty table gives no rows and leaves the
rules in the order given. The sample, each row with the same chance, has about `sample_rows` rows (a documented
bound); it decides the order and nothing else.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


class Doc:
    """Features of one text, each made at its first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # splits at the six ASCII spaces, no others

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        ids: dict[bytes, int] = {}
        return np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, len(self.words))

    def repeated(self, size: int) -> int:
        """Words in windows of `size` words that the text holds twice or more, the first time included."""
        n = len(self.words) - size + 1
        if n < 2:
            return 0
        window = self.word_ids[:n]
        for k in range(1, size):  # numbers of distinct windows of k words, then of one word more
            pair = window * (len(self.words) + 1) + self.word_ids[k : k + n]
            window = np.unique(pair, return_inverse=True)[1]
        again = np.bincount(window)[window] > 1
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[np.flatnonzero(again)] += 1
        hit[np.flatnonzero(again) + size] -= 1
        return int((np.cumsum(hit)[:-1] > 0).sum())

    @cached_property
    def n_repeat_words(self) -> int:
        return self.repeated(5)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def digits(self) -> int:
        return sum(map(self.text.count, "0123456789"))

    @cached_property
    def capitals(self) -> int:
        return sum(map(self.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def most_frequent(self) -> int:
        """How often the most frequent word occurs."""
        return int(np.bincount(self.word_ids).max()) if self.words else 0


@dataclass(frozen=True)
class Rule:
    """A name and what rejects a document."""

    name: str
    rejects: Callable[[Doc], bool]


#: Wide limits: they reject what is no prose, and leave clean text of any of the languages alone.
RULES = (
    Rule("base", lambda d: d.base_failed),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("letters", lambda d: 2 * d.letters < d.word_chars),
    Rule("digits", lambda d: 10 * d.digits > 3 * d.word_chars),
    Rule("capitals", lambda d: 10 * d.capitals > 7 * d.word_chars),
    Rule("one_word", lambda d: 3 * d.most_frequent > d.n_words),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measured:
    """What the sample says of a rule in its place: seconds a document that reaches it and the share of those that it rejects."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def measure(texts: list[str | None], rules: tuple[Rule, ...] = RULES, ready: tuple[str, ...] = ()) -> list[Measured]:
    """The rules in greedy order; equal ones stay in the order given. ready: features that every document has by then."""
    docs, left, out = [Doc(x) for x in texts], list(rules), []
    for d in docs:
        for name in ready:
            getattr(d, name)
    while left:
        found = []
        for rule in left:
            tried = [copy.copy(d) for d in docs]  # with the features made so far
            began = time.perf_counter()
            told = [bool(rule.rejects(d)) for d in tried]
            cost = (time.perf_counter() - began) / max(1, len(docs))
            found.append((Measured(rule, cost, sum(told) / max(1, len(docs))), [d for d, t in zip(tried, told) if not t]))
        best, docs = max(found, key=lambda f: f[0].worth)
        left.remove(best.rule)
        out.append(best)
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, text_col: str = "text", ready: tuple[str, ...] = ()) -> list[Measured]:
    """Rules in order, measured on a Bernoulli sample of all rows of about sample_rows documents, so no one file or source decides."""
    n = docs.count()
    some = docs.select(text_col).sample(min(1.0, sample_rows / max(1, n)), seed=7).collect()
    return measure([r[0] for r in some], rules, ready)


def judge(text: Column, rules: list[Rule]) -> Column:
    """A struct of the base columns, of `kept`, and of the number of rules that were asked."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                d, asked, kept = Doc(text), 0, True
                for rule in rules:
                    asked += 1
                    if rule.rejects(d):
                        kept = False
                        break
                kept = kept and not d.base_failed
                rows.append((*(getattr(d, x) for x in BASE), d.base_failed, kept, asked))
            yield pd.DataFrame(rows, columns=[*BASE, "base_failed", "kept", "asked"])

    schema = ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean, asked int"
    return F.pandas_udf(run, schema)(text)


def cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that every rule passes, all columns as they were; a rule behind the first that rejects isn't asked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([not any(r.rejects(d) for r in rules) for d in map(Doc, batch)], dtype=bool)

    return docs.where(F.pandas_udf(run, "boolean")(F.col(text_col)))
