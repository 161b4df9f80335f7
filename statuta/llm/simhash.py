"""Near-duplicates by SimHash fingerprints, found through keys from the binary Golay code.

The Golay code of length 23 is perfect: every word of 23 bits lies within 3 bits of one codeword, and the
codeword's 12-bit index is the word's key. A fingerprint's 64 bits fall into segments of 23, 23 and 18 bits.
If two fingerprints differ in at most 4 bits, some two of the segments together hold at most 2 of these
errors (pigeonhole over three pairs), and a word half way is at most one bit from either. So each fingerprint
gives, for each pair of segments, the keys of the pair and of the pair with any one bit flipped: about ten
distinct keys of 24 bits, as most flips decode to the same codeword. Fingerprints that share a key are
compared; none that is near enough is missed.

Equal fingerprints are one row here, so copies cost nothing. Where many distinct ones share a key, a breadth-first
search compares them in vectors and gives a spanning forest of their links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, stash
from statuta.llm.components import Forest, components

GENERATOR = 0b101011100011  # of the Golay code, as a polynomial over GF(2); a fixed value
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and length
PAIRS = ((0, 1), (0, 2), (1, 2))
RADIUS = 4
HOT_SHARE = 1000  # a fingerprint of more than a thousandth of all rows is joined without a shuffle

_index: np.ndarray | None = None


def golay_index() -> np.ndarray:
    """For every word of 23 bits, the message of its nearest codeword; made once a task, see drop_index()."""
    global _index
    if _index is None:
        message = np.arange(4096, dtype=np.uint32)
        code = np.zeros(4096, np.uint32)
        for bit in range(12):
            code ^= np.where(message >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0)).astype(np.uint32)
        one = np.uint32(1) << np.arange(23, dtype=np.uint32)
        errors = {0, *one.tolist()}
        for _ in range(2):
            errors |= {e ^ b for e in errors for b in one.tolist()}
        index = np.zeros(1 << 23, np.uint16)
        for e in errors:
            index[code ^ np.uint32(e)] = message
        _index = index
    return _index


def drop_index() -> None:
    """Workers live on after a task, and need the index no more."""
    global _index
    _index = None
    give_back()


def bit_majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of consecutive groups of 64-bit hashes, the word of the bits that more than half of a group set."""
    out, some = np.zeros(len(sizes), np.uint64), sizes > 0
    own, n = sizes[some], np.cumsum(sizes[some])
    if not len(own):
        return out
    blocks = -(-own // 255)  # sums of up to 255 ones fit a byte
    starts = np.repeat(n - own, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    groups, lanes = np.cumsum(blocks) - blocks, np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat(hashes >> np.uint64(bit) & lanes, starts)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        most = (2 * ones > own[:, None]).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(bit))
        out[some] |= np.bitwise_or.reduce(most, axis=1)
    return out


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 with seed 42 of all runs of `size` words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, 42)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return [digest(line[a : b - 1], 42) for a, b in zip(starts, starts[size:])]


def fingerprint(text: Column, size: int = 4) -> Column:
    """The SimHash of the word shingles of a text, as a signed long; 0 where there are no words."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), 512):
            lists = [shingle_hashes(x or "", size) for x in texts.iloc[i : i + 512]]
            flat = np.fromiter((h for x in lists for h in x), np.uint64)
            out.append(bit_majorities(flat, np.fromiter(map(len, lists), np.int64, len(lists))))
        give_back()
        return pd.Series(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))

    return F.pandas_udf(run, "long")(text)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints: row number, key."""
    index = golay_index()
    decoded, flipped = [], []
    for first, size in SEGMENTS:
        word = (prints >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.uint32)
        decoded.append(index[word].astype(np.int64))
        flipped.append(index[word[:, None] ^ (np.uint32(1) << np.arange(size, dtype=np.uint32))].astype(np.int64))
    keys = []
    for k, (i, j) in enumerate(PAIRS):
        base = np.int64(k << 24)
        own = np.concatenate([(decoded[i] << 12 | decoded[j])[:, None], flipped[i] << 12 | decoded[j][:, None], decoded[i][:, None] << 12 | flipped[j]], axis=1)
        keys.append(base | own)
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints: a spanning forest of all links, by breadth-first search."""
    rest, a, b = np.arange(len(prints)), [], []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= radius
            if near.any():
                found = rest[near]
                front += found.tolist()
                a.append(np.full(len(found), at))
                b.append(found)
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


SMALL = 8


def bucket_links(key: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked rows of equal key; the rows are sorted by key. Small buckets are compared together, by distance in the order."""
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(np.append(first, len(key)))
    for f, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        a, b = forest(prints[f : f + n])
        yield a + f, b + f
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    key, own = key[rows], prints[rows]
    for d in range(1, SMALL):
        near = np.flatnonzero((key[d:] == key[:-d]) & (np.bitwise_count(own[d:] ^ own[:-d]) <= RADIUS))
        if len(near):
            yield rows[near], rows[near + d]


def by_bucket(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by the first column, dealt anew so that rows of one key come together."""
    held = None
    for batch in batches:
        new = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of at most 4 differing bits, with the components of all such links."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(i, 4096).to_numpy().view(np.uint64)
                row, key = golay_keys(own)
                yield _batch({"key": key, "fp": own[row].view(np.int64)})
        drop_index()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for key, fp in by_bucket(batches, ("key", "fp")):
            a, b = [], []
            for x, y in bucket_links(key, fp.view(np.uint64)):
                for p, q in zip(fp[x].tolist(), fp[y].tolist()):
                    if trees.join(p, q):
                        a.append(p)
                        b.append(q)
            if a:
                yield _batch({"a": np.array(a), "b": np.array(b)})
        give_back()

    rows = prints.select("fp").mapInArrow(keys, "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable over links of at most 4 differing bits.

    Defined cases: null, empty and wordless texts have fingerprint 0, which links like any other; repeated
    rows come out as often; a null doc_id is passed over in the minimum, and a component of nothing else
    has a null id; an empty table gives no rows; texts of any length are hashed whole; extra columns are
    not read, whatever their names.
    """
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    least = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    parts = components(print_links(least)).withColumnRenamed("node", "fp")
    linked = parts.join(least, "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    known = stash(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "fingerprint-components")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(known.where(F.col("n") * HOT_SHARE > total).drop("n"))  # fewer than HOT_SHARE rows, as each has more than that share of all
    rest = known.where(F.col("n") * HOT_SHARE <= total).drop("n")
    often, others = rows.join(hot, "fp"), rows.join(hot, "fp", "left_anti").join(rest, "fp")
    return often.unionByName(others).select("doc_id", "fp", "component_id")
