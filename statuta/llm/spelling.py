"""Spelling variants: words one edit apart, found by pivotal grams (Deng, Li and Feng, "A pivotal prefix based filtering algorithm").

The grams of a word are its bigrams with their places, ordered by how many words of the vocabulary have them, the rarest
first. The prefix of a word are its three first grams and all that equal the third. Of these, two that don't overlap are its
pivots: those of the least sum of frequencies, by dynamic programming over the places. One edit changes at most one
of two pivots that don't overlap, so of two words one edit apart, the one whose prefix ends no later in the order has a
pivot that the other holds too, and there it lies within the prefix, since the prefix holds all grams up to its end. Pivots
are therefore joined to prefixes. The edit lies after the pivot or before it, which limits its place: either the words are
equal from their begin to the end of the gram, or from its begin to their end. These two stretches are the keys of one
equi-join. What it gives is verified: by the lengths, which differ by one at most, and by the edit distance itself.

Frequent words have no more rows than rare ones: all this is done on the vocabulary. Its counts are summed in the tasks
before they are shuffled. Grams are of two letters of the alphabet below, so there are at most its square of them, which
bounds the only table that is broadcast without a count.

Defined cases: a null text has no words and a null id counts as an empty string; words below the least length or count are
left out, and so no one's form; repeated rows count as often; ties are by code point; an empty table has no words; a word of
any length is one word; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, small, stash

LETTERS = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased
AT_ONCE = 1 << 18  # distinct words that a task counts before it hands them on
PIECE = 1 << 20  # characters of a text that are cut into words at a time
EDITS = 1
PREFIX = 2 * EDITS + 1
SHORT = 3  # letters of a stretch
NARROW = 50_000


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lists of the words of a text, in order; only A to Z are lower-cased."""
    low, at = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(low):
        end = min(at + PIECE, len(low))
        if end < len(low) and LETTERS.match(low, end):  # a word goes on: to its end
            end = LETTERS.match(low, end).end()
        yield LETTERS.findall(low, at, end)
        at = end


def vocabulary(docs: DataFrame, misspell: Callable[[bytes], Callable[[str], str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least: int = 5) -> DataFrame:
    """word and n, how often it occurs in all texts. misspell: from the id of a text to what becomes of each word in it."""

    if least_chars <= PREFIX:
        raise ValueError(f"words need {PREFIX + 1} letters, for {PREFIX} grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            words = [w for w in seen if len(w) >= least_chars]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([seen[w] for w in words], pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own: Counter[str] = Counter()
                for words in words_of(text.as_py()):
                    own.update(words)
                if misspell is None:
                    seen.update(own)
                else:
                    change = misspell((key.as_py() or "").encode())
                    for w, n in own.items():
                        seen[change(w)] += n
                if len(seen) > AT_ONCE:
                    yield told()
                    seen.clear()
        yield told()
        seen.clear()
        give_back()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def dropped_letter(key: bytes, one_in: int = 199) -> Callable[[str], str]:
    """Words of a text without one of their letters, where a checksum of the text's id and the word says so."""
    begun = zlib.crc32(key + b":")

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), begun)
        if h % one_in:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def pivots(grams: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of grams (place, frequency, gram) by place, EDITS + 1 that don't overlap and have the least sum of frequencies.

    best[k] is the cheapest choice of k grams among those so far, best_before[k] that among those two places or more before.
    """
    none = (float("inf"), ())
    best = [(0, ())] + [none] * (EDITS + 1)
    history = [(-2, best)]
    for i, (place, frequency, _) in enumerate(grams):
        before = next(b for at, b in reversed(history) if at <= place - 2)
        best = [best[0], *(min(best[k], (before[k - 1][0] + frequency, (*before[k - 1][1], i))) for k in range(1, EDITS + 2))]
        history.append((place, best))
    return [grams[i] for i in best[EDITS + 1][1]]


def chosen(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Prefix and pivots of a word, as grams (place, frequency, gram) by place. order: rank and frequency of each gram."""
    grams = sorted((order[word[i : i + 2]][0], i) for i in range(len(word) - 1))
    end = grams[PREFIX - 1][0]
    prefix = sorted((i, order[word[i : i + 2]][1], word[i : i + 2]) for rank, i in grams if rank <= end)
    return prefix, pivots(prefix)


def candidates(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: pairs of words (word, n) of at least four letters of which a pivot of a stands in the prefix of b, with all before it or all after it alike."""
    spark = words.sparkSession
    gram = F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))
    counted = words.select(gram.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()  # of two letters: at most 90 * 90
    sent = spark.sparkContext.broadcast({g: (rank, n) for rank, (n, g) in enumerate(sorted((r["n"], r["gram"]) for r in counted))})

    def run(batch: pd.Series) -> pd.DataFrame:
        prefixes, own = [], []
        for word in batch:
            prefix, pivot = chosen(word, sent.value)
            prefixes.append([i for i, _, _ in prefix])
            own.append([i for i, _, _ in pivot])
        return pd.DataFrame({"prefix": prefixes, "pivots": own})

    told = stash(words.select("word", "n", F.pandas_udf(run, "prefix array<int>, pivots array<int>")("word").alias("g")), "word-grams")
    to_gram = F.struct(F.lit("to").alias("side"), F.substring("word", F.lit(1), F.col("place") + 2).alias("part"))
    from_gram = F.struct(F.lit("from").alias("side"), F.substring("word", F.col("place") + 1, F.length("word")).alias("part"))

    def keyed(grams: str, name: str, sizes: list[Column]) -> DataFrame:
        """A number for each stretch sorts faster than the stretch itself; what collides is verified. Short ones, which many words share, are told apart by the length of b."""
        rows = told.select("word", "n", F.length("word").alias("size"), F.explode(f"g.{grams}").alias("place"))
        rows = rows.select("word", "n", "size", F.explode(F.array(to_gram, from_gram)).alias("key"))
        of = F.explode(F.when(F.length("key.part") <= SHORT, F.array(*sizes)).otherwise(F.array(F.lit(0))))
        rows = rows.select("word", "n", "size", "key", of.alias("of"))
        return rows.select(F.xxhash64("key.side", "key.part", "of").alias("key"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.col("size").alias(f"size_{name}"))

    size = F.col("size")
    met = keyed("pivots", "a", [size - 1, size, size + 1]).join(keyed("prefix", "b", [size]), "key")
    return met.where((F.abs(F.col("size_a") - F.col("size_b")) <= EDITS) & (F.col("a") != F.col("b"))).select("a", "n_a", "b", "n_b")


def near(words: DataFrame) -> DataFrame:
    """word, n, other, n_other: all words of which each differs from the other by one letter put in, left out or replaced, both ways round."""
    found = candidates(words).where(F.levenshtein("a", "b", EDITS) == EDITS)
    one, two = F.struct(F.col("a").alias("word"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"))
    pairs = stash(found.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct(), "near-words")
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", "p.x.n", F.col("p.y.word").alias("other"), F.col("p.y.n").alias("n_other"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): the last word that is reached from form to form. Each round doubles the steps; n grows with each
    step by the factor that makes a form, so a word is no form of its own and the rounds are as few as the logarithm of a logarithm of the count."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stash(at.join(small(further, NARROW), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not now.where("moved").isEmpty()
        at = now.select("word", "root")
        if not moved:
            return at


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """Of words (word, n): word, form, root, n, n_near, form_n. A form is the most frequent near word (of equals the first by code points), if it is at
    least `times` as frequent; root follows the forms."""
    words = stash(words, "vocabulary")
    best = F.min(F.struct((-F.col("n_other")).alias("minus"), F.col("other").alias("other")))
    told = near(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.minus") >= times * F.col("n")
    told = stash(told.select("word", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")), "forms")
    top = roots(told.where("form is not null").select("word", "form"))
    out = words.join(told, "word", "left").join(top, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
