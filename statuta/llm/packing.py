"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each scan partition is tokenised and packed where it lies, so nothing is shuffled and a lost task is
repeated with the same result. Pieces that fill a sequence leave at once; the rest wait in a block of
bounded size, in which sequences are filled one after another with the waiting example of the largest
dot product between what it needs and what is left (Panigrahy et al., "Heuristics for Vector Bin
Packing"). A gap that no example fits is closed by cutting one, if cuts are allowed.

Defined cases: a null text is an empty one (its only id is the end id); repeated rows and repeated
doc_ids are packed as rows of their own; a null doc_id is kept, and an id may be of any type; other columns are not
read; an empty table gives no piece. Where a limit other than tokens keeps half a block from leaving, the block is
closed with the sequences it has: that costs padding (with cuts, none: they end at powers of two) and loses nothing.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from statuta.llm.common import give_back

FLUSH = 1 << 20  # ids that a task holds of packed pieces before it gives them away
AT_ONCE = 256  # texts that are encoded at a time


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. block: pieces that wait for a place at a time, in one task."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024
    block: int = 1024


class Tokens:
    """Ids of texts by a byte-level BPE in the file form of `tokenizers`. If the vocabulary's ids are in the
    order of its merges, tiktoken gives the same ids at a quarter of the time; else `tokenizers` encodes."""

    def __init__(self, path: str):
        self.ranked = self._ranks(path)
        if not self.ranked:
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
            self.t.encode_special_tokens = True
            self.t.no_padding()
            self.t.no_truncation()
        give_back()

    def _ranks(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
        before = spec.get("pre_tokenizer") or {}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocab = {w: i for w, i in model["vocab"].items() if w not in special}
        ordered = sorted(vocab, key=vocab.get)
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("type", "BPE") != "BPE" or ordered[256:] != merged:
            return None
        import tiktoken

        del spec, model, merged
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks={bytes(map(byte.__getitem__, w)): vocab[w] for w in ordered}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        if self.ranked:
            encode = self.ranked._core_bpe.encode_ordinary
            return [np.frombuffer(array("I", encode(x)), "<u4") for x in texts]
        return [np.array(e.ids, "<u4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]


_tokenizers: dict[str, Tokens] = {}


def tokenizer(path: str) -> Tokens:
    """One tokenizer a worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


class _Block:
    """Pieces that wait for a place: (key, start, ids, mask, doc_tokens); mask: which ids bear loss."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.items: list[tuple] = []

    def fill(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences, each a list of pieces; what doesn't fill one stays unless this is the last call."""
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        items = self.items
        if not items:
            return
        need = np.array([[len(x[2]), 1, np.count_nonzero(x[3])] for x in items], float)
        alive, waiting = np.ones(len(items), bool), need[:, 0].sum()
        weight = (need / cap).mean(axis=0) / cap**2  # the more a limit is asked for, the more it counts
        while alive.any() and (last or waiting >= self.limits.tokens):
            left, chosen = cap.copy(), []
            while left[0] > 0 and left[1] > 0:
                ok = alive & (need[:, 0] <= left[0]) & (need[:, 2] <= left[2])
                if ok.any():
                    i = int(np.argmax(np.where(ok, need @ (weight * left), -1.0)))
                    chosen.append(items[i])
                    alive[i] = False
                    left -= need[i]
                    waiting -= need[i, 0]
                    continue
                if not (self.cut and alive.any()):
                    break
                i = int(np.argmax(np.where(alive, need[:, 0], -1.0)))
                key, start, ids, mask, n = items[i]
                size = min(int(left[0]), len(mask) - 1)
                over = np.cumsum(mask[:size]) > left[2]
                size = int(np.argmax(over)) if over.any() else size
                if size < 1:
                    break
                chosen.append((key, start, ids[:size], mask[:size], n))
                items[i] = (key, start + size, ids[size:], mask[size:], n)
                loss = np.count_nonzero(mask[:size])
                left -= (size, 1, loss)
                waiting -= size
                need[i] -= (size, 0, loss)
            yield chosen
        self.items = [x for x, a in zip(items, alive) if a]


def _halves(chosen: list[tuple], tokens: int, cut: bool) -> Iterator[list[tuple]]:
    """A sequence that could not be filled, cut at the powers of two that make up its length: these need no padding."""
    size = sum(len(x[3]) for x in chosen)
    if not cut or size == tokens or not size & (size - 1):
        yield chosen
        return
    for bit in range(size.bit_length() - 1, -1, -1):
        room, part = size & (1 << bit), []
        while room:
            key, start, ids, mask, n = chosen[0]
            k = min(room, len(mask))
            part.append((key, start, ids[:k], mask[:k], n))
            chosen = [(key, start + k, ids[k:], mask[k:], n), *chosen[1:]] if k < len(mask) else chosen[1:]
            room -= k
        if part:
            yield part


def pack_encoded(examples: Iterator[tuple], limits: Limits, cut: bool) -> Iterator[tuple]:
    """Pieces (key, start, ids, loss tokens, doc_tokens, sequence, offset) of examples (key, ids, mask)."""
    block, sequence = _Block(limits, cut), 0

    def out(chosen: list[tuple]) -> Iterator[tuple]:
        nonlocal sequence
        at = 0
        for key, start, ids, mask, n in chosen:
            yield key, start, ids, int(np.count_nonzero(mask)), n, sequence, at
            at += len(mask)
        sequence += 1

    def close(last: bool) -> Iterator[tuple]:
        for chosen in block.fill(last):
            for part in _halves(chosen, limits.tokens, cut):
                yield from out(part)

    for key, ids, mask in examples:
        n, start = len(mask), 0
        while start < n:
            part = mask[start : start + limits.tokens]
            size = len(part)
            if np.count_nonzero(part) > limits.loss:
                size = max(1, int(np.argmax(np.cumsum(part) > limits.loss)))
            piece = (key, start, ids[start : start + size], mask[start : start + size], n)
            start += size
            if size == limits.tokens:
                yield from out([piece])
            else:
                block.items.append(piece)
        if len(block.items) >= limits.block:
            yield from close(False)
            if len(block.items) >= limits.block // 2:  # a limit other than tokens holds: don't look at the same pieces again and again
                yield from close(True)
    yield from close(True)


def _schema(df: DataFrame, id_col: str) -> StructType:
    longs = ("start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset")
    return StructType([StructField("doc_id", df.schema[id_col].dataType), StructField("ids", BinaryType()), *(StructField(n, LongType()) for n in longs)])


def pack_tokens(df: DataFrame, encode: Callable[[pa.RecordBatch], Iterator[tuple]], limits: Limits, cut: bool, id_col: str) -> DataFrame:
    """encode: from a batch of df to examples (key, ids, mask)."""
    schema = _schema(df, id_col)
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, held = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> pa.RecordBatch:
            key, start, ids, loss, n, sequence, at = zip(*rows)
            columns = (key, [x.tobytes() for x in ids], start, list(map(len, ids)), loss, n, [base + s for s in sequence], at)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kind)], schema=kind)

        for row in pack_encoded((x for b in batches for x in encode(b)), limits, cut):
            rows.append(row)
            held += len(row[2])
            if held >= FLUSH:
                yield flush()
                rows, held = [], 0
                give_back()
        if rows:
            yield flush()
        rows.clear()
        give_back()  # what the last rows took, too: the worker lives on, and by turns each idle one packs

    return df.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), cut: bool = True, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, ids (little-endian unsigned 32-bit), start, length, loss_tokens,
    doc_tokens, sequence_id, offset. Every id but the closing end_id bears loss. cut: whether an example
    that would fit whole may be cut to fill a gap; a longer one than a sequence always is."""
    end = np.array([end_id], "<u4")

    def encode(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(i, AT_ONCE)
            texts = [x or "" for x in some.column(1).to_pylist()]
            for key, ids in zip(some.column(0).to_pylist(), tokenizer(tokenizer_path).encode(texts)):
                mask = np.ones(len(ids) + 1, np.uint8)
                mask[-1] = 0
                yield key, np.concatenate([ids, end]), mask

    return pack_tokens(docs.select(id_col, text_col), encode, limits, cut, id_col)


def pack_conversations(turns: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 0, learn: str = "assistant", turns_at_once: int = 1024) -> DataFrame:
    """Whole conversations (conv_id, turn, role, text) as examples; only the turns of the role `learn` bear loss.

    A conversation is one example, and none is cut unless it is longer than a sequence; but one of more than `turns_at_once`
    turns is several, one after another, so that no row holds a conversation without end.
    """
    end = np.array([end_id], "<u4")
    told = turns.select(
        F.col("conv_id").alias("doc_id"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / turns_at_once).alias("part"),
    ).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list("said")).alias("said")).drop("part")

    def encode(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = [np.concatenate([x, end]) for x in tokenizer(tokenizer_path).encode([s["text"] for s in said])]
            yield key, np.concatenate(ids), np.concatenate([np.full(len(x), s["role"] == learn, np.uint8) for x, s in zip(ids, said)])

    return pack_tokens(told, encode, limits, False, "doc_id")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
