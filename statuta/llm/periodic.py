"""Runs of repeated words (maximal periodicities), found with a dictionary of basic factors.

For each power of two L the factors of L words get names, equal for equal words: a factor of 2L words is named by the
names of its halves, so each length is one sort. A run of period q has, for the largest L <= q, the same factor q words
apart from its first word on, that is within 2L. Occurrences of a factor are therefore read in order. Those at most L/2
apart all lie at one distance, the factor's own period, and form an arithmetic progression; such a progression
holds no run of a period of L or more, but two of them within 2L do: their distances are again a progression, and each
is a proposed period. A text of n words thus has O(n) proposals a length, whatever it repeats. A proposal is extended in
both directions by names of falling length, and of proposals that extend to the same stretch the smallest period counts.
Factors that occur once in their text get no longer ones, so prose costs little beyond the first two lengths.

Many texts are worked on side by side, with the words of each numbered apart, so no factor crosses two of them.
What is held are the numbers of a text's words and, of every third length, the names: about 4 bytes times a third of
the logarithm of the text's words for each word.

Defined cases: a null, empty or wordless text has no runs and an empty collapsed text; repeated rows come out as often;
an empty table gives no rows; ties of period go by the definition, as a stretch has one smallest period; texts of any length
are searched whole; other columns don't matter, since the functions work on a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import let
from statuta.llm.common import WORD, give_back

WORDS, SPACE = re.compile(WORD), re.compile(r"[\x20\x09-\x0D]")
AT_ONCE = 1 << 18  # words of texts that are worked on side by side
PIECE = 1 << 20  # characters of a text that are cut into words at a time
KEPT = 3  # of so many lengths, the names of one are kept for extension
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _grouped(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` of equal keys side by side in their order, with a number for each key; what occurs once is left out."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    again = times > 1
    return at[np.repeat(again, times)], np.repeat(np.arange(again.sum()), times[again])


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those from first[1] on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _proposed(at: np.ndarray, name: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of at least `size` and below twice that, of the occurrences of factors of that length."""
    gap, same = np.diff(at), name[1:] == name[:-1]
    if not (same & (gap < 2 * size)).any():
        return
    starts = np.concatenate([[True], ~(same & (2 * gap <= size))])  # of progressions
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(at)) - 1
    head, tail, of = at[first], at[last], name[first]
    for ahead in (1, 2, 3):  # heads of progressions lie over size/2 after the tails before, so there are no more within 2 * size
        a = np.flatnonzero((of[:-ahead] == of[ahead:]) & (head[ahead:] - tail[:-ahead] < 2 * size) & (tail[ahead:] - head[:-ahead] >= size))
        b = a + ahead
        n = last[a] - first[a] + 1
        left = at[_spread(first[a], n)]
        period = np.repeat(head[b], n) - left
        n = last[b] - first[b]
        more = np.repeat(head[a], n)
        left, period = np.concatenate([left, more]), np.concatenate([period, at[_spread(first[b] + 1, n)] - more])
        fits = (period >= size) & (period < 2 * size)
        yield left[fits], period[fits]


def _reach(x: np.ndarray, y: np.ndarray, levels: list[tuple[int, np.ndarray]], back: bool) -> np.ndarray:
    """How many words from x and y on are equal, or before x and y."""
    n, out = len(levels[0][1]) - 1, np.zeros(len(x), np.int64)
    for size, names in reversed(levels):
        open_ = np.arange(len(x))
        while len(open_):
            here = (x[open_] - out[open_] - size, y[open_] - out[open_] - size) if back else (x[open_] + out[open_], y[open_] + out[open_])
            equal = names[np.clip(here[0], 0, n)] == names[np.clip(here[1], 0, n)]
            open_ = open_[equal & (here[0] >= 0)]
            out[open_] += size
    return out


def runs(ids: np.ndarray, longest: int, least: int = 12) -> np.ndarray:
    """start, length and period of all runs of a sequence of numbers, by start and then by period. longest: no run is longer."""
    n = len(ids)
    alone = -1 - np.arange(n + 1, dtype=np.int32)
    levels, lefts, periods, sizes = [], [], [], []
    key, at, size, k = ids, np.arange(n), 1, 0
    while True:
        at, name = _grouped(key, at)
        if not len(at):
            break
        names = alone.copy()
        names[at] = name
        if k % KEPT == 0:
            levels.append((size, names))
        for left, period in _proposed(at, name, size):
            lefts.append(left), periods.append(period), sizes.append(np.full(len(left), size))
        if 4 * size > longest:
            break
        at = np.flatnonzero(names[: max(0, n - size)] >= 0)
        at = at[names[at + size] >= 0]
        key = names[at].astype(np.int64) * n + names[at + size]
        size, k = 2 * size, k + 1
    if not sum(map(len, lefts)):
        return np.zeros((0, 3), np.int64)
    left, period, size = np.concatenate(lefts), np.concatenate(periods), np.concatenate(sizes)
    order = np.lexsort((left, period))
    left, period, size = left[order], period[order], size[order]
    new = np.ones(len(left), bool)
    new[1:] = (period[1:] != period[:-1]) | (left[1:] > left[:-1] + size[:-1])  # else both extend to the same stretch
    left, period, size = left[new], period[new], size[new]
    before, after = _reach(left, left + period, levels, True), _reach(left + size, left + size + period, levels, False)
    start, length = left - before, before + size + after + period
    good = (length >= 2 * period) & (length >= least)
    found = np.stack([start[good], length[good], period[good]], axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)  # of one stretch the smallest period
    found = found[keep]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def numbered(text: str | None) -> tuple[np.ndarray, list[str]]:
    """The words of a text as numbers, and the word of each number."""
    known, parts, at = {}, [], 0
    text = text or ""
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        found = WORDS.findall(text, at, end)
        for w in found:
            known.setdefault(w, len(known))
        parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def _told(texts: list, least: int) -> tuple[list[np.ndarray], list[str]]:
    """Runs and collapsed texts of some texts, worked on side by side."""
    every = [numbered(x) for x in texts]
    sizes = [len(ids) for ids, _ in every]
    base = np.cumsum([0, *(len(names) for _, names in every)])
    begin = np.cumsum([0, *sizes])
    ids = np.concatenate([ids.astype(np.int64) + b for (ids, _), b in zip(every, base)])
    found = runs(ids, max(sizes), least)
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    cuts, own, left = np.searchsorted(found[:, 0], begin), [], []
    for i, (numbers, names) in enumerate(every):
        own.append(found[cuts[i] : cuts[i + 1]] - [begin[i], 0, 0])
        numbers = numbers[kept[begin[i] : begin[i + 1]]]
        left.append(" ".join(" ".join(map(names.__getitem__, numbers[k : k + PIECE].tolist())) for k in range(0, len(numbers), PIECE)))
    return own, left


def periodic(text: Column, least: int = 12) -> Column:
    """A struct of runs (start, length, period, by start and then by period) and collapsed, the words of the text without those that
    a run only repeats, that is those after the run's first period."""

    def run(texts: pd.Series) -> pd.DataFrame:
        own, left, some, held = [], [], [], 0
        for k, x in enumerate(texts, 1):
            some.append(x)
            held += len(x or "") // 4
            if held > AT_ONCE or k == len(texts):
                a, b = _told(some, least)
                own, left, some, held = own + [_dicts(r) for r in a], left + b, [], 0
        give_back()
        return pd.DataFrame({"runs": own, "collapsed": left})

    return F.pandas_udf(run, f"runs {RUN}, collapsed string")(text)


def _dicts(found: np.ndarray) -> list[dict]:
    return [dict(zip(("start", "length", "period"), r)) for r in found.tolist()]


def longest(runs_: Column) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period. Null where there is none."""
    keyed = F.transform(runs_, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    return let(F.array_max(keyed), lambda r: F.when(r.isNotNull(), F.struct((-r["start"]).alias("start"), r["length"].alias("length"), (-r["period"]).alias("period"))))
