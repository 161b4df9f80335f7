r"""Chat formatting with typed content parts.

A turn is a role and a list of parts of kind text, image, audio or document. A visitor walks the parts in order: text is escaped
and written, any other part leaves a placeholder, and is recorded as an attachment with its reference, the place of the
placeholder and the number of tokens that it will take once expanded. A template marks where a turn, its content
and its end are. Control strings (marks and placeholders) in roles and texts are escaped by a backslash after
their first character, and those that stand escaped in a text already get one more; so what is formatted holds control
strings only where the template put them, and the text comes back as it was, whatever it holds.

Turns are formatted where they lie, each on its own: a long conversation is spread over the tasks like any rows. Only then are
pieces shuffled by conversation, sorted by turn, and strung together as a stream: a task holds one segment at a time,
of at most SEGMENT_TURNS turns and SEGMENT_CHARS characters (one turn may be longer), and a conversation is as many
segments as it needs, in order. The loss mask are spans of characters of a segment, one for each text of a role that
is learned; placeholders bear no loss.

Defined cases: a null or empty list of parts, and a null text, are empty text; a null role is an empty one; texts side by
side are one text; a kind of none of the four is an error, a null kind is text; an attachment without measures takes one token; turns
of one number, or none (first), are in the order of their formatted text, and repeated ones are kept; turns of a null conversation are
one conversation; an empty table gives no segments; other columns are not read, whatever their names; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from statuta.llm.common import give_back

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SPANS = "array<struct<start:bigint,end:bigint>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,at:bigint,n_tokens:bigint>>"
SEGMENT_TURNS, SEGMENT_CHARS = 1024, 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a turn and placeholders. Each begins with a character that stands nowhere else in any of them, or is one of such marks in a row."""

    turn: str = "<s>"
    says: str = "[INST]"
    ends: str = "[/INST]"
    closes: str = "</s>"
    image: str = "<image>"
    audio: str = "<audio>"
    document: str = "<document>"

    @property
    def placeholders(self) -> dict[str, str]:
        return {"image": self.image, "audio": self.audio, "document": self.document}

    @cached_property
    def _controls(self) -> list[str]:
        marks = [self.turn, self.says, self.ends, self.closes, *self.placeholders.values()]
        if any(len(m) < 2 or "\\" in m or set(m[1:]) & {x[0] for x in marks} for m in marks):
            raise ValueError("a control string needs two characters, no backslash, and no first character of one further on")
        return marks

    def _pattern(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(f"(?:(?<={re.escape(m[0])}){slashes}(?={re.escape(m[1:])}))" for m in self._controls))

    @cached_property
    def _plain(self) -> re.Pattern:
        return self._pattern(r"\\*")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return self._pattern(r"\\+")

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: "\\" + m.group(), text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m.group()[1:], text)

    @cached_property
    def turns(self) -> re.Pattern:
        turn, says, ends, closes = (re.escape(x) for x in (self.turn, self.says, self.ends, self.closes))
        return re.compile(f"{turn}(.*?){says}(.*?){ends}{closes}", re.DOTALL)

    @cached_property
    def parts(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, self.placeholders.values())) + ")")


@dataclass(frozen=True)
class Expansion:
    """Tokens that attachments take: an image one for each patch of a grid and one for each of its rows, audio so many a second, a document so many a page."""

    patch: int = 28
    most_pixels: int = 1540  # the longer side is scaled down to this
    audio_rate: float = 12.5
    page: int = 1024

    def image(self, width: int | None, height: int | None) -> int:
        if not width or not height:
            return 1
        scale = min(1.0, self.most_pixels / max(width, height))
        across, down = (max(1, math.ceil(round(x * scale) / self.patch)) for x in (width, height))
        return across * down + down

    def audio(self, seconds: float | None) -> int:
        return max(1, math.ceil((seconds or 0) * self.audio_rate))

    def document(self, pages: int | None) -> int:
        return max(1, (pages or 0) * self.page)


@dataclass
class Visitor:
    """Walks the parts of one turn: what is written, the spans of its texts and its attachments, by places in what is written."""

    template: Template
    expansion: Expansion
    out: list[str] = field(default_factory=list)
    at: int = 0
    texts: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: dict) -> None:
        kind = part["kind"] or "text"
        visit = getattr(self, f"visit_{kind}", None)
        if visit is None:
            raise ValueError(f"unknown kind of content part: {kind}")
        visit(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self.attach(part, self.expansion.image(part["width"], part["height"]))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, self.expansion.audio(part["seconds"]))

    def visit_document(self, part: dict) -> None:
        self.attach(part, self.expansion.document(part["pages"]))

    def attach(self, part: dict, n_tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": part["kind"], "ref": part["ref"], "at": self.at, "n_tokens": n_tokens})
        self.write(self.template.placeholders[part["kind"]])

    def flush(self) -> None:
        """Texts side by side are escaped as one: a control string may lie across them."""
        text = self.template.escape("".join(self.pending))
        self.pending.clear()
        if text:
            self.texts.append({"start": self.at, "end": self.at + len(text)})
            self.write(text)

    def turn(self, role: str | None, parts: list[dict] | None) -> str:
        self.write(self.template.turn + self.template.escape(role or "") + self.template.says)
        for part in parts or []:
            self.visit(part)
        self.flush()
        self.write(self.template.ends + self.template.closes)
        return "".join(self.out)


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (x.split(":") for x in PART[7:-1].split(","))}
    return F.array(F.struct(*(none | {"kind": F.lit("text").alias("kind"), "text": text.cast("string").alias("text")}).values()))


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(f"x {ddl}")["x"].dataType)


def formatted_turns(turns: DataFrame, template: Template = Template(), expansion: Expansion = Expansion(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, piece (the turn as formatted), loss and attachments by places in the piece. turns: conv_id, turn, role, parts. No shuffle."""
    names = ["conv_id", "turn"]
    kinds = [to_arrow_type(turns.schema[n].dataType) for n in names] + [pa.string(), _arrow(SPANS), _arrow(ATTACHMENTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, loss, attached = [], [], []
            for role, parts in zip(batch.column(2), batch.column(3)):
                role, visitor = role.as_py(), Visitor(template, expansion)
                pieces.append(visitor.turn(role, parts.as_py()))
                loss.append(visitor.texts if role in learn else [])
                attached.append(visitor.attachments)
            columns = [batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip((pieces, loss, attached), kinds[2:]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "piece", "loss", "attachments"])

    schema = ", ".join([*(f"{n} {turns.schema[n].dataType.simpleString()}" for n in names), f"piece string, loss {SPANS}, attachments {ATTACHMENTS}"])
    return turns.select(*names, "role", F.col("parts").cast(f"array<{PART}>").alias("parts")).mapInArrow(run, schema)


def format_conversations(turns: DataFrame, template: Template = Template(), expansion: Expansion = Expansion(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, segment (from 0), n_turns, formatted, loss, attachments, n_tokens (of the attachments, expanded), of turns (conv_id, turn, role, parts).

    All segments of a conversation lie in one partition, one after another.
    """
    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    fields = [("conv_id", kind), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", _arrow(SPANS)), ("attachments", _arrow(ATTACHMENTS)), ("n_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, segment, pieces, loss, attached, at, held, begun = None, 0, [], [], [], 0, 0, False

        def close() -> None:
            nonlocal segment, pieces, loss, attached, at, held
            if pieces:
                done.append((conv, segment, len(pieces), "".join(pieces), loss, attached, sum(a["n_tokens"] for a in attached)))
                held += at
                segment, pieces, loss, attached, at = segment + 1, [], [], [], 0

        def told() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in done], t) for k, (name, t) in enumerate(fields)})
            done.clear()
            held = 0
            return out

        for batch in batches:
            for key, piece, spans, files in zip(*(batch.column(k) for k in range(4))):
                key, piece = key.as_py(), piece.as_py()
                if not begun or key != conv:
                    close()
                    conv, segment, begun = key, 0, True
                elif len(pieces) == SEGMENT_TURNS or at + len(piece) > SEGMENT_CHARS:
                    close()
                loss += [{"start": s["start"] + at, "end": s["end"] + at} for s in spans.as_py()]
                attached += [a | {"at": a["at"] + at} for a in files.as_py()]
                pieces.append(piece)
                at += len(piece)
                if len(done) >= 1000 or held > 4 * SEGMENT_CHARS:
                    yield told()
        close()
        yield told()
        give_back()

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, segment long, n_turns long, formatted string, loss {SPANS}, attachments {ATTACHMENTS}, n_tokens long"
    own = formatted_turns(turns, template, expansion, learn).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return own.select("conv_id", "piece", "loss", "attachments").mapInArrow(run, schema)


def parse(formatted: str, template: Template = Template()) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Roles and parts (kind, text) of the turns of a formatted segment; an error if it holds anything else."""
    kinds, end = {mark: kind for kind, mark in template.placeholders.items()}, 0
    for m in template.turns.finditer(formatted):
        if m.start() != end:
            break
        end = m.end()
        parts = [(kinds[x], "") if x in kinds else ("text", template.unescape(x)) for x in template.parts.split(m.group(2)) if x]
        yield template.unescape(m.group(1)), parts
    if end != len(formatted):
        raise ValueError("what stands here is no turn of the template")


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Of segments as format_conversations gives them, read back: conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn),
    loss_chars and loss_sha256 of the unescaped text under the loss mask, formatted_chars, n_attachments, n_tokens. A stream: a task holds a segment."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"]
    kind = to_arrow_type(segments.schema["conv_id"].dataType)

    class Conversation:
        def __init__(self, key):
            self.key, self.next, self.n_turns, self.loss_chars, self.chars, self.files, self.tokens = key, 0, 0, 0, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, segment: int, formatted: str, loss: list[dict], files: list[dict]) -> None:
            if segment != self.next:
                raise ValueError("segments of a conversation are not in order")
            self.next += 1
            for role, parts in parse(formatted, template):
                self.n_turns += 1
                text = "".join(text for _, text in parts)
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                text = template.unescape(formatted[span["start"] : span["end"]])
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
            for file in files:
                if not formatted.startswith(template.placeholders[file["kind"]], file["at"]):
                    raise ValueError("an attachment is not where it was recorded")
                self.files, self.tokens = self.files + 1, self.tokens + file["n_tokens"]
            self.chars += len(formatted)

        def row(self) -> tuple:
            return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.files, self.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def told() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 8
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.string() if n.endswith("sha256") else pa.int64()) for n, x in zip(names, columns[1:]))], names=["conv_id", *names])
            done.clear()
            return out

        for batch in batches:
            for key, *rest in zip(*(batch.column(k) for k in range(5))):
                key = key.as_py()
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(key)
                now.add(*(x.as_py() for x in rest))
                if len(done) >= 10_000:
                    yield told()
        if now is not None:
            done.append(now.row())
        yield told()
        give_back()

    schema = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long"
    return segments.select("conv_id", "segment", "formatted", "loss", "attachments").mapInArrow(run, schema)
