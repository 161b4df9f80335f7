"""Hybrid retrieval of chunks for many queries at once: BM25 and vector similarity, fused by reciprocal rank.

queries: query_id, category, query_text, entity_type, province. chunks: chunk_id, category, entity_type,
province_scope, text. What a query may see depends on its category, entity type and province. Corpus statistics
are sums over chunks, so they are taken once for each cell of (category, entity_type, province_scope) and added
up over the cells that a query sees; queries of one view share them.

A task counts the words of its chunks before anything is shuffled, and texts are read once for these counts and once for the scores; their tokens are
nowhere written. The vocabulary is shuffled by cell, as hashes, and of all views that see the same cells only one histogram of it is kept.
Both searches are exact and shuffle no pairs of query and chunk but the best: queries travel to the tasks in blocks of
bounded number, their words weighed and their vectors made beforehand; a task scores its own chunks against a block by
one product of matrices a batch, and keeps the best of each query.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from statuta import refdata as R
from statuta.common import small, spread, stash
from statuta.functions.classify import entity_visible, province_visible
from statuta.functions.text import hashing_vectors, tokenize, tokens_of

CELL = ["category", "entity_type", "province_scope"]
QUERY_BLOCK = 5_000  # queries that a task holds at a time
AT_ONCE = 250  # of them in one product
CHUNKS_AT_ONCE = 1_000
WORDS_AT_ONCE = 4_000  # distinct words of queries in one product
BYTES_AT_ONCE = 4 << 20  # of text, cut into words at a time
PAIRS_HELD = 4_000_000  # pairs of chunk and word that a task counts before it gives their counts away


def _cells(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("entity_type", F.coalesce("entity_type", F.lit("both"))).withColumn("province_scope", F.coalesce("province_scope", F.lit("national")))


def _sees(q: str, c: str) -> Column:
    return (
        (F.col(f"{q}.category") == F.col(f"{c}.category"))
        & entity_visible(F.col(f"{c}.entity_type"), F.col(f"{q}.entity_type"))
        & province_visible(F.col(f"{c}.province_scope"), F.col(f"{q}.province"))
    )


def views(queries: DataFrame) -> DataFrame:
    """The distinct views of the queries; few, as they don't depend on who asks."""
    return with_view(queries.select("category", "entity_type", "province").distinct())


def with_view(queries: DataFrame) -> DataFrame:
    return queries.withColumn("view", F.xxhash64("category", "entity_type", F.coalesce("province", F.lit("\0"))))


def tokenized(chunks: DataFrame) -> DataFrame:
    """chunk_id, cell and tokens of the chunks, worked out once. Where the chunks carry `tokens` (with_tokens() adds them when a store is written), they are taken from there."""
    if "tokens" in chunks.columns:
        return _cells(chunks).select("chunk_id", *CELL, "tokens")
    return stash(_cells(spread(chunks.select("chunk_id", *CELL, "text"))).select("chunk_id", *CELL, tokenize(F.col("text")).alias("tokens")), "chunk-tokens")


def _readable(chunks: DataFrame) -> DataFrame:
    """chunk_id, cell and what tasks make words of: the tokens that chunks carry, or else their text in lower case."""
    if "tokens" in chunks.columns:
        return tokenized(chunks)
    return spread(_cells(chunks).select("chunk_id", *CELL, F.lower("text").alias("text")))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most CHUNKS_AT_ONCE rows and, by that column, BYTES_AT_ONCE (a row may be longer)."""
    own = batch.column(column)
    long = pc.binary_length(own) if pa.types.is_string(own.type) else pc.multiply(pc.list_value_length(own), 8)
    upto, at = np.cumsum(np.asarray(pc.fill_null(long, 0)).astype(np.int64)), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES_AT_ONCE, "right"))
        n = min(CHUNKS_AT_ONCE, max(1, end - at))
        yield batch.slice(at, n)
        at += n


def _words(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The words of chunks one after the other, and how many each has (null: none), of lists of tokens or of texts in lower case."""
    each = [tokens_of(x) if x else [] for x in column.to_pylist()] if pa.types.is_string(column.type) else [x or [] for x in column.to_pylist()]
    return list(chain.from_iterable(each)), np.fromiter(map(len, each), np.int64, len(each))


def with_tokens(rows: DataFrame) -> DataFrame:
    """A step for a chunk store: the tokens of a text are kept with it, and made anew only when it changes."""
    return rows.withColumn("tokens", tokenize(F.col("text")))


def corpus_statistics(own: DataFrame, views_: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of chunks with their tokens, or with their text in lower case, per view: lens, n, avgdl and floor, 0.25 of the mean of ln(n - df + 0.5) - ln(df + 0.5) of all its tokens; and idf of the
    tokens asked for (token), where the floor replaces what is negative.

    That mean depends on how many tokens have each document frequency, so of the whole vocabulary a histogram is all that is kept.
    Views that see the same cells are one here, a lens. A task counts its own chunks by cell and word; these counts, of words as hashes of 64 bits, are
    dealt out and sorted by word once; a task adds them up over the cells of each lens as they pass, so no row is made for a word and a view.
    """
    cell = F.xxhash64(*(F.coalesce(F.col(c), F.lit("\0")) for c in CELL))
    read = own.select(*CELL, cell.alias("cell"), "tokens" if "tokens" in own.columns else "text")
    told = stash(read.mapInArrow(_counts, "word long, cell long, df long, dl long, category string, entity_type string, province_scope string"), "word-frequencies")
    sizes = stash(told.where("word is null").groupBy(*CELL).agg(F.sum("df").alias("n"), F.sum("dl").alias("dl")), "cell-sizes")
    frequency = told.where("word is not null").select("word", "cell", "df")
    seen_cells = stash(small(sizes.withColumn("cell", cell)).alias("c").join(views_.alias("q"), _sees("q", "c")).select("view", "cell", "n", "dl"), "view-cells")
    lens = F.xxhash64(F.array_sort(F.collect_list("cell"))).alias("lens")
    seen = stash(seen_cells.groupBy("view").agg(lens, F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl")), "view-sizes")
    of = stash(seen_cells.join(small(seen.select("view", "lens")), "view").select("lens", "cell").distinct(), "lens-cells")
    cells = defaultdict(list)
    for r in of.collect():  # as few as the views
        cells[r["lens"]].append(r["cell"])
    sent = own.sparkSession.sparkContext.broadcast(dict(cells))
    dealt = frequency.repartition("word").sortWithinPartitions("word")
    histogram = dealt.mapInArrow(lambda batches: _histograms(batches, sent.value), "lens long, df long, times long").groupBy("lens", "df").agg(F.sum("times").alias("times"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    sums = seen.groupBy("lens").agg(F.first("n").alias("n"))
    floor = histogram.join(small(sums), "lens").groupBy("lens").agg((R.BM25_FLOOR * F.sum(F.col("times") * raw) / F.sum("times")).alias("floor"))
    seen = stash(seen.join(small(stash(floor, "lens-floors")), "lens", "left"), "view-statistics")
    asked = frequency.join(small(words.select("token", word_hash("token").alias("word"))), "word").join(small(of), "cell").groupBy("lens", "token").agg(F.sum("df").alias("df"))
    asked = asked.join(small(seen), "lens")
    return seen, asked.select("view", "token", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))


def _hashes(words: list[str]) -> np.ndarray:
    """64 bits of each word, the same in every task."""
    return pd.util.hash_array(np.array(words, object), categorize=False).view(np.int64)


@F.pandas_udf(LongType())
def word_hash(words: pd.Series) -> pd.Series:
    return pd.Series(_hashes(words.tolist()))


def _first(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value first stands in the order of values, and how often."""
    order = np.argsort(key)
    starts = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[starts], np.diff(np.append(starts, len(key)))


def _mixed(word: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64 bits of pairs of a word's hash and a small number."""
    return word + (number + 1) * np.int64(-7046029254386353131)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word (its hash), cell and df, the chunks of a task that hold the word, in parts that have to be added up; and with a null word the chunks of each cell, their tokens (dl)
    and what the cell is. Batches have category, entity_type, province_scope, cell, and tokens or text."""
    names = ["word", "cell", "df", "dl", *CELL]
    kind = pa.schema([*((c, pa.int64()) for c in names[:4]), *((c, pa.string()) for c in CELL)])
    totals, place, held, n = {}, {}, [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        word, unit = (np.concatenate(x) for x in zip(*held))
        at, df = _first(_mixed(word, unit))
        own = [pa.array(x) for x in (word[at], np.array(list(place), np.int64)[unit[at]], df)]
        yield from pa.Table.from_arrays([*own, *(pa.nulls(len(at), kind.field(c).type) for c in names[3:])], schema=kind).to_batches(100_000)

    for batch in batches:
        for some in _slices(batch, 4):
            words, sizes = _words(some.column(4))
            cell = np.asarray(some.column(3))
            unit = np.array([place.setdefault(c, len(place)) for c in cell.tolist()], np.int64)
            for k, c in zip(*np.unique(cell, return_index=True)):
                told = totals.setdefault(int(k), [0, 0, *(some.column(i)[int(c)].as_py() for i in range(3))])
                told[0] += int((cell == k).sum())
                told[1] += int(sizes[cell == k].sum())
            word, row = _hashes(words), np.repeat(np.arange(len(sizes)), sizes)
            once, _ = _first(_mixed(word, row))  # a word counts once a chunk
            held.append((word[once], unit[row[once]]))
            n += len(once)
            if n >= PAIRS_HELD:
                yield from counted()
                held, n = [], 0
    if n:
        yield from counted()
    if totals:
        rows = [(None, k, *told) for k, told in totals.items()]
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=kind)


def _histograms(batches: Iterator[pa.RecordBatch], lenses: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """lens, df and the number of words that have it, of rows word, cell, df in the order of words. The last word of a batch waits for the next."""
    times, rest = {lens: Counter() for lens in lenses}, np.zeros((3, 0), np.int64)

    def add(word: np.ndarray, cell: np.ndarray, df: np.ndarray) -> None:
        group = np.cumsum(np.append(0, word[1:] != word[:-1]))
        order = np.argsort(cell, kind="stable")
        names, starts = np.unique(cell[order], return_index=True)
        rows = dict(zip(names.tolist(), np.split(order, starts[1:])))
        for lens, cells in lenses.items():
            if some := [rows[c] for c in cells if c in rows]:
                at = np.concatenate(some)
                sums = np.bincount(group[at], df[at]).astype(np.int64)
                value, n = np.unique(sums[sums > 0], return_counts=True)
                times[lens].update(dict(zip(value.tolist(), n.tolist())))

    for batch in batches:
        own = np.concatenate([rest, np.stack([np.asarray(batch.column(k)) for k in range(3)])], axis=1)
        whole = int(np.searchsorted(own[0], own[0][-1])) if own.shape[1] else 0
        if whole:
            add(*own[:, :whole])
        rest = own[:, whole:]
    if rest.shape[1]:
        add(*rest)
    out = [(lens, df, n) for lens, own in times.items() for df, n in own.items()]
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("lens", "df", "times"), map(list, zip(*out)))), schema=pa.schema([(c, pa.int64()) for c in ("lens", "df", "times")]))


def _blocks(rows: DataFrame, n: int) -> Iterator[DataFrame]:
    """rows by a hash of query_id, in blocks of about QUERY_BLOCK of n queries."""
    blocks = max(1, -(-n // QUERY_BLOCK))
    for k in range(blocks):
        yield rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)


class _Best:
    """The best chunks of some queries so far: by falling score, then by id."""

    def __init__(self, top_n: int):
        self.top_n, self.scores, self.ids = top_n, None, None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row a chunk, a column a query, -inf where the query may not see it; the ids are in order."""
        if self.scores is not None and len(self.scores) == self.top_n:
            near = (scores >= self.scores[-1]).any(axis=1)  # the others are among the best of no query
            scores, ids = scores[near], ids[near]
        place = np.argsort(-scores, axis=0, kind="stable")[: self.top_n]
        scores, ids = np.take_along_axis(scores, place, axis=0), ids[place]
        if self.scores is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            by_id = np.argsort(ids, axis=0, kind="stable")
            scores, ids = np.take_along_axis(scores, by_id, axis=0), np.take_along_axis(ids, by_id, axis=0)
            place = np.argsort(-scores, axis=0, kind="stable")[: self.top_n]
            scores, ids = np.take_along_axis(scores, place, axis=0), np.take_along_axis(ids, place, axis=0)
        self.scores, self.ids = scores, ids

    def rows(self, queries: list) -> Iterator[tuple]:
        for j, q in enumerate(queries):
            for s, i in zip(self.scores[:, j].tolist(), self.ids[:, j].tolist()):
                if s != -np.inf:
                    yield q, i, s


def ranked(found: DataFrame, score: str, top_n: int) -> DataFrame:
    """The best of each query, by falling score and then by id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def _kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def bm25_top(queries: DataFrame, chunks: DataFrame, top_n: int = R.TOP_N) -> DataFrame:
    """query_id, chunk_id, bm25 and rank of the best chunks of each query, of all that it may see.

    A chunk without a query word scores 0, whatever the others score. Scores are rounded to nine digits before they are
    ranked; ties are in the order of ids.
    """
    asked, views_ = with_view(queries), stash(views(queries), "views")
    own = _readable(chunks)
    words = asked.select("query_id", "view", F.explode(tokenize(F.col("query_text"))).alias("token")).groupBy("query_id", "view", "token").agg(F.count("*").alias("times"))
    words = stash(words, "query-words")
    seen, idf = corpus_statistics(own, views_, words.select("token").distinct())
    weighed = idf.join(small(words), ["view", "token"]).groupBy("query_id").agg(F.collect_list(F.struct("token", (F.col("times") * F.col("idf")).alias("w"))).alias("words"))
    told = asked.join(small(seen), "view").join(small(weighed), "query_id", "left").select("query_id", "lens", "category", "entity_type", "province", "avgdl", "words")
    told, out = stash(told, "weighed-queries"), None
    kind = pa.schema([("query_id", to_arrow_type(queries.schema["query_id"].dataType)), ("chunk_id", pa.string()), ("bm25", pa.float64())])
    for block in _blocks(told, told.count()):
        sent = queries.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])
        part = own.mapInArrow(lambda batches, sent=sent: _bm25(batches, sent.value, top_n, kind), f"query_id {_kind(queries)}, chunk_id string, bm25 double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, "bm25", top_n)


def _sets(asked: list[tuple]) -> Iterator[list[tuple]]:
    """Queries of one lens in sets of at most AT_ONCE, whose words are at most WORDS_AT_ONCE (those of one query may be more)."""
    some, words = [], set()
    for q, own in asked:
        more = words | {k for k, _ in own}
        if some and (len(some) == AT_ONCE or len(more) > WORDS_AT_ONCE):
            yield some
            some, more = [], {k for k, _ in own}
        some.append((q, own))
        words = more
    if some:
        yield some


def _bm25(batches: Iterator[pa.RecordBatch], queries: list[tuple], top_n: int, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    by_lens, views_, place = defaultdict(list), {}, {}
    for query_id, lens, *view, words in queries:
        own = [(place.setdefault(w["token"], len(place)), w["w"]) for w in words or []]
        views_.setdefault(lens, view)  # any view of a lens tells what all of them see
        by_lens[lens].append((query_id, own))
    known, sets = place.get, []
    for lens, asked in by_lens.items():
        for some in _sets(asked):
            words = sorted({k for _, own in some for k, _ in own})
            local = {k: i for i, k in enumerate(words)}
            weights = np.zeros((len(words), len(some)))
            for j, (_, own) in enumerate(some):
                for k, w in own:
                    weights[local[k], j] = w
            sets.append((*views_[lens], [q for q, _ in some], np.array(words, np.int64), weights, _Best(top_n)))
    column = np.zeros(len(place), np.int64)  # of a set's words, where they stand in its weights
    for batch in batches:
        for some in _slices(batch, 4):
            ids, category, entity, scope = (some.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            by_id = np.argsort(ids, kind="stable")
            tokens, sizes = _words(some.column(4))
            word = np.array([known(t, -1) for t in tokens], np.int64)
            row = np.repeat(np.arange(len(ids)), sizes)[word >= 0]
            pair = row * max(1, len(place)) + word[word >= 0]
            at, tf = _first(pair)  # looked up and counted once for all sets
            pair = pair[at]
            row, word = pair // max(1, len(place)), pair % max(1, len(place))
            for c, e, p, avgdl, _, words, weights, best in sets:
                seen = (category == c) & ((entity == "both") | (entity == e)) & ((scope == "national") | ((scope == p) if p is not None else False))
                mine = by_id[seen[by_id]]
                if not len(mine):
                    continue
                column[:], column[words] = -1, np.arange(len(words))
                line = np.full(len(ids), -1)
                line[mine] = np.arange(len(mine))
                hit = (line[row] >= 0) & (column[word] >= 0)
                r, k = line[row[hit]], column[word[hit]]
                norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * sizes[mine] / avgdl)
                share = np.zeros((len(mine), len(words)))
                share[r, k] = tf[hit] * (R.BM25_K1 + 1) / (tf[hit] + norm[r])
                best.add(np.round(share @ weights, 9) + 0.0, ids[mine])
    for *_, queries_, _, _, best in sets:
        if best.scores is not None and (rows := list(best.rows(queries_))):
            yield pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*rows)))), schema=kind)


def vector_top(queries: DataFrame, chunks: DataFrame, top_n: int, embed=hashing_vectors) -> DataFrame:
    """query_id, chunk_id, similarity and rank of the nearest chunks of each query's category, exactly.

    embed: from texts to unit vectors. Each query is embedded once, in a task, and each chunk once a block of queries.
    """
    vector = F.pandas_udf(lambda texts: pd.Series(list(embed(texts.tolist()))) if len(texts) else pd.Series([], dtype=object), "array<double>")
    asked = stash(queries.select("query_id", "category", vector(F.coalesce("query_text", F.lit(""))).alias("vector")), "query-vectors")
    own, out = spread(chunks.select("chunk_id", "category", F.coalesce("text", F.lit("")).alias("text"))), None
    for block in _blocks(asked, asked.count()):
        sent = queries.sparkSession.sparkContext.broadcast([(r["query_id"], r["category"], np.array(r["vector"])) for r in block.collect()])
        made = lambda rows: embed(rows["text"].tolist())
        part = own.mapInPandas(lambda batches, sent=sent: _nearest(batches, sent.value, top_n, made), f"query_id {_kind(queries)}, chunk_id string, similarity double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, "similarity", top_n)


def nearest_vectors(queries: DataFrame, rows: DataFrame, top_n: int) -> DataFrame:
    """vector_top for vectors that are stored: queries of query_id, category, vector, rows of chunk_id, category, vector, unit vectors all. Where
    category is null on both sides, all rows are searched."""
    asked, out = queries.select("query_id", F.coalesce("category", F.lit("")).alias("category"), "vector"), None
    own = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("category", F.lit("")).alias("category"), "vector")
    for block in _blocks(asked, asked.count()):
        sent = queries.sparkSession.sparkContext.broadcast([(r["query_id"], r["category"], np.array(r["vector"])) for r in block.collect()])
        made = lambda rows: np.stack(rows["vector"].to_numpy())
        part = own.mapInPandas(lambda batches, sent=sent: _nearest(batches, sent.value, top_n, made), f"query_id {_kind(queries)}, chunk_id string, similarity double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, "similarity", top_n)


def _nearest(batches: Iterator[pd.DataFrame], queries: list[tuple], top_n: int, vectors) -> Iterator[pd.DataFrame]:
    by_category, sets = defaultdict(list), defaultdict(list)
    for query_id, category, vector in queries:
        by_category[category].append((query_id, vector))
    for c, asked in by_category.items():
        for i in range(0, len(asked), AT_ONCE):
            some = asked[i : i + AT_ONCE]
            sets[c].append(([q for q, _ in some], np.stack([v for _, v in some]).T, _Best(top_n)))
    for batch in batches:
        for c, rows in batch.groupby("category"):
            for at in range(0, len(rows) if c in sets else 0, CHUNKS_AT_ONCE):
                some = rows.iloc[at : at + CHUNKS_AT_ONCE].sort_values("chunk_id", kind="stable")
                ids, near = some["chunk_id"].to_numpy(object), np.asarray(vectors(some))
                for _, matrix, best in sets[c]:
                    best.add(np.round(near @ matrix, 9) + 0.0, ids)
    for some in sets.values():
        for names, _, best in some:
            if best.scores is not None:
                yield pd.DataFrame(list(best.rows(names)), columns=["query_id", "chunk_id", "similarity"])


def rrf(lists: DataFrame, *keys: str) -> DataFrame:
    """Sum of 1/(60 + rank) over ranked lists, by keys."""
    return lists.groupBy(*keys).agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 12).alias("fused"))


def _fused(bm25: DataFrame, vector: DataFrame) -> DataFrame:
    """Fused rows in the order of a stable sort: ties by BM25 place, then by vector place."""
    both = bm25.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), "bm25").join(vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")), ["query_id", "chunk_id"], "full_outer")
    share = lambda c: F.coalesce(1 / (R.RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumn("fused", F.round(share("bm25_rank") + share("vector_rank"), 12)).withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"))
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "fused", "bm25", "rank")


def visible(queries: DataFrame, chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose chunk the query may see."""
    q = pairs.join(queries.select("query_id", "category", "entity_type", "province"), "query_id")
    c = _cells(chunks).select("chunk_id", *CELL)
    joined = q.alias("q").join(c.alias("c"), (F.col("q.chunk_id") == F.col("c.chunk_id")) & _sees("q", "c"))
    return joined.select(*(F.col(f"q.{x}") for x in pairs.columns))


def retrieve_full(queries: DataFrame, chunks: DataFrame, top_n: int = R.TOP_N, embed=hashing_vectors) -> DataFrame:
    """For embedders that carry no meaning: BM25 over all that a query sees; the vector's best of the category, then the filter."""
    vector = visible(queries, chunks, vector_top(queries, chunks, top_n, embed))
    order = Window.partitionBy("query_id").orderBy("rank")
    vector = vector.withColumn("rank", F.row_number().over(order))
    return _fused(bm25_top(queries, chunks, top_n), vector)


def retrieve_pruned(queries: DataFrame, chunks: DataFrame, top_n: int = R.TOP_N, pool: int = R.POOL, embed=hashing_vectors) -> DataFrame:
    """For embedders that do: the nearest `pool` chunks of the category, filtered, are all that BM25 sees; all of them are fused."""
    near = visible(queries, chunks, vector_top(queries, chunks, pool, embed))
    near = stash(near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))), "pool")
    return _fused(bm25_in_pool(queries, near, chunks, top_n), near)


def bm25_in_pool(queries: DataFrame, pool: DataFrame, chunks: DataFrame, top_n: int) -> DataFrame:
    """bm25_top with each query's own pool (query_id, chunk_id, rank) as the corpus. A chunk is tokenised once, whatever pools it is in;
    its tokens travel as hashes of 64 bits. A pool has a bounded number of chunks, and is one group."""
    hashed = lambda text: F.transform(tokenize(F.col(text)), lambda t: F.xxhash64(t))
    needed = stash(pool.select("chunk_id").distinct(), "pooled-chunks")
    own = stash(chunks.join(small(needed), "chunk_id").select("chunk_id", hashed("text").alias("tokens")), "pooled-tokens")
    asked = stash(queries.select("query_id", hashed("query_text").alias("words")), "query-words")
    rows = pool.select("query_id", "chunk_id", F.col("rank").alias("place")).join(own, "chunk_id").join(small(asked), "query_id")

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        dl = group["tokens"].str.len().to_numpy()
        token, code = np.unique(np.concatenate(group["tokens"].to_numpy()), return_inverse=True)
        pair, tf = np.unique(np.repeat(np.arange(len(group)), dl) * max(1, len(token)) + code, return_counts=True)
        df = np.bincount(pair % max(1, len(token)), minlength=len(token))
        raw = np.log(len(group) - df + 0.5) - np.log(df + 0.5)
        idf = np.where(raw < 0, R.BM25_FLOOR * raw.mean(), raw) if len(raw) else raw
        words, times = np.unique(np.asarray(group["words"].iloc[0], np.int64), return_counts=True)
        at = np.minimum(np.searchsorted(token, words), max(len(token) - 1, 0))
        known = token[at] == words if len(token) else np.zeros(len(words), bool)
        weight = np.zeros(len(token))
        weight[at[known]] = times[known] * idf[at[known]]
        row, word = pair // max(1, len(token)), pair % max(1, len(token))
        norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * dl / max(dl.mean(), 1e-300))
        scores = np.round(np.bincount(row, weight[word] * tf * (R.BM25_K1 + 1) / (tf + norm[row]), len(group)), 9) + 0.0
        best = np.argsort(-scores, kind="stable")[:top_n]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "chunk_id": group["chunk_id"].to_numpy()[best], "bm25": scores[best], "rank": np.arange(1, len(best) + 1, dtype=np.int32)})

    return rows.groupBy("query_id").applyInPandas(score, f"query_id {_kind(queries)}, chunk_id string, bm25 double, rank int")


def retrieve(queries: DataFrame, chunks: DataFrame, is_semantic: bool, top_n: int = R.TOP_N, embed=hashing_vectors) -> DataFrame:
    return (retrieve_pruned if is_semantic else retrieve_full)(queries, chunks, top_n, embed=embed)


def rerank(hits: DataFrame, ranked: DataFrame, top_k: int = R.TOP_N) -> DataFrame:
    """hits (query_id, chunk_id, rank) in the order of ranked (query_id, ranked_chunk_ids), the rest behind in their own order; unknown ids go, of repeated ones the first counts."""
    told = ranked.select("query_id", F.posexplode("ranked_chunk_ids").alias("place", "chunk_id")).groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"))
    named = hits.join(told, ["query_id", "chunk_id"])
    rest = hits.join(told, ["query_id", "chunk_id"], "left_anti").withColumn("place", F.lit(None).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("place"), "rank")
    return named.unionByName(rest).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_k).drop("place", "rank").withColumnRenamed("new_rank", "rank")


def search_all_categories(asked: DataFrame, chunks: DataFrame, is_semantic: bool = False, per_category: int = 2, top_k: int = R.TOP_N, embed=hashing_vectors) -> DataFrame:
    """Each question (query_id, query_text, entity_type, province) over all categories: the best two of each, of those the best five."""
    real = [c for c in R.CATEGORIES if c != R.TEST_CATEGORY]
    each = asked.select(F.col("query_id").alias("asked"), "query_text", "entity_type", "province", F.explode(F.array(*map(F.lit, real))).alias("category"))
    each = each.withColumn("query_id", F.concat_ws("|", F.col("asked").cast("string"), "category"))
    hits = retrieve(each, chunks, is_semantic, embed=embed).where(F.col("rank") <= per_category).join(each.select("query_id", "asked", "category"), "query_id")
    order = Window.partitionBy("asked").orderBy(F.desc("fused"), F.desc("bm25"), F.array_position(F.array(*map(F.lit, real)), F.col("category")), "rank")
    best = hits.withColumn("best", F.row_number().over(order)).where(F.col("best") <= top_k)
    return best.select(F.col("asked").alias("query_id"), "category", "chunk_id", "fused", "bm25", F.col("best").alias("rank"))


def answer_text(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id and the found chunks as text blocks; a message where nothing was found."""
    block = F.concat(F.lit("Source: "), F.coalesce("law_name", F.lit("unknown source")), F.lit(", Điều "), F.coalesce("article_number", F.lit("?")), F.lit("\n"), F.col("text"))
    blocks = hits.join(chunks, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n")
    return asked.select("query_id").join(blocks, "query_id", "left").select("query_id", F.coalesce(joined, F.lit(R.NOTHING_FOUND)).alias("answer"))
