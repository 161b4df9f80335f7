"""Article sections of a document's structure, and the citation that best fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import excerpt, py_strip
from statuta.refdata import EXCERPT_CHARS

SECTION = "struct<kind:string,type:string,label:string,dieu_number:string,article_number:string,number:string,start:int,end:int,char_start:int,char_end:int>"
STRUCTURE = f"struct<sections:array<{SECTION}>>"
REFS = "struct<statute_refs:array<struct<target_doc_name:string,relation:string,confidence:double>>>"


def sections(structure: Column) -> Column:
    """The sections of a JSON text; none if it is malformed."""
    found = F.filter(F.from_json(structure, STRUCTURE)["sections"], lambda s: s.isNotNull())
    return F.coalesce(found, F.array().cast(f"array<{SECTION}>"))


def label_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(py_strip(label), r"(?U)^Điều\s+(\d+)\b", 1), F.lit("")).try_cast("int")


def is_article(s: Column) -> Column:
    kind = F.lower(F.coalesce(F.nullif(s["kind"], F.lit("")), s["type"], F.lit("")))
    return kind.contains("dieu") | kind.contains("article") | s["dieu_number"].isNotNull() | s["article_number"].isNotNull() | label_number(s["label"]).isNotNull()


def number_of(s: Column) -> Column:
    return F.coalesce(*(s[k].try_cast("int") for k in ("dieu_number", "article_number", "number")), label_number(s["label"]))


def span_of(s: Column, legacy: bool = False) -> Column:
    """start and end, or null. legacy: a start of 0 counts as missing."""
    zero = (lambda c: F.nullif(c, F.lit(0))) if legacy else (lambda c: c)
    start, end = F.coalesce(zero(s["start"]), s["char_start"]), F.coalesce(zero(s["end"]), s["char_end"])
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def locate_article(structure: Column, markdown: Column, number: Column | None = None, offset: Column | None = None, legacy_span: bool = False) -> Column:
    """dieu_number, span_start, span_end and excerpt: by number, else the smallest span around the offset, else the first article, else the document."""
    nodes = F.filter(sections(structure), is_article)
    chosen = F.get(nodes, F.lit(0))
    if offset is not None:
        width = lambda n: span_of(n, legacy_span)["end"] - span_of(n, legacy_span)["start"]
        around = F.filter(nodes, lambda n: F.coalesce((span_of(n, legacy_span)["start"] <= offset) & (offset <= span_of(n, legacy_span)["end"]), F.lit(False)))
        chosen = F.coalesce(F.get(F.array_sort(around, lambda a, b: width(a) - width(b)), F.lit(0)), chosen)
    if number is not None:
        chosen = F.coalesce(F.get(F.filter(nodes, lambda n: number_of(n) == number), F.lit(0)), chosen)
    size = F.coalesce(F.length(markdown), F.lit(0))
    top = F.struct(F.lit(0).alias("start"), F.least(F.lit(EXCERPT_CHARS), size).alias("end"))
    span = F.coalesce(span_of(chosen, legacy_span), top)
    text = F.when(chosen.isNotNull(), excerpt(markdown, span["start"], span["end"])).otherwise(F.coalesce(F.left(markdown, F.lit(EXCERPT_CHARS)), F.lit("")))
    return F.struct(number_of(chosen).alias("dieu_number"), span["start"].alias("span_start"), span["end"].alias("span_end"), text.alias("excerpt"))


def statute_refs(extracted: Column) -> Column:
    """References of a JSON text in their order; none if it is malformed."""
    found = F.filter(F.from_json(extracted, REFS)["statute_refs"], lambda r: r.isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<target_doc_name:string,relation:string,confidence:double>>"))
