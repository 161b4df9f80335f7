"""From HTML and running text to lines, chapters, articles and chunks; each document is a row, its parts arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import let, py_strip, scan
from statuta.refdata import LOOKBACK, MAX_CHARS

# The patterns that tell chapters, articles and citations.
CHAPTER = r"(?iu)^(?U:\s*)Ch(?:ươ|uơ)ng(?U:\s+)([IVXLCDM]+|\d+)\.?(?U:\s*)(.*)$"
ARTICLE = r"(?iu)^(?U:\s*)Điều(?U:\s+)(\d+)\.?(?U:\s*)(.*)$"
INLINE_CHAPTER = r"(?iu)(?<!\n)(Ch(?:ươ|uơ)ng(?U:\s+)(?:[IVXLCDM]+|\d+)\.?)"
CITED = r"(?iuU)(?:tại|theo|của|sửa\s*đổi|bổ\s*sung|bãi\s*bỏ|hủy\s*bỏ|thay\s*thế|nêu\s*ở|quy\s*định\s*ở)\s*$"
LINE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_to_lines(html: Column, inline_join: bool = False) -> Column:
    """Text lines of a page: every tag ends a line (inline_join: block tags only), blank lines go, entities are read last."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>", "")
    if inline_join:
        x = F.regexp_replace(x, r"(?i)</?(?:a|abbr|b|em|font|i|small|span|strong|sub|sup|u)(?:\s[^>]*)?>", "")
    x = F.regexp_replace(x, r"(?s)<[A-Za-z/][^>]*>", "\n")
    for name, value in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(value))
    lines = F.filter(F.transform(F.split(x, LINE), py_strip), lambda t: t != "")
    return F.array_join(lines, "\n")


def content_region(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    """What stands in the first element of a tag, with all that is nested in it; null where there is none. It stands for a content selector.

    attribute, value: the first element of that tag whose attribute holds the value as one of its words. The page is cut at the tags of that name,
    and a fold over the parts counts the depth: from the opening tag on, until as many have closed as opened; an element
    that nothing closes goes to the end of the page. Tags in comments don't count. Of scripts' texts nothing is known.
    """
    name = re.escape(tag)
    parts = F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), rf"(?i)(?=</?{name}(?:[\s>]|/>))", -1)
    opens, closes = (lambda x, end=end: F.regexp_like(x, F.lit(rf"(?is)^<{end}{name}\s*(?:>|\s[^>]*>)")) for end in ("", "/"))
    alone = lambda x: F.regexp_like(x, F.lit(rf"(?is)^<{name}(?:\s[^>]*)?/>"))
    wanted = opens
    if attribute is not None:
        held = rf"""(?is)^<{name}\s(?:[^>]*\s)?{re.escape(attribute)}\s*=\s*(?:"(?:[^"]*\s)?{re.escape(value)}(?:\s[^"]*)?"|'(?:[^']*\s)?{re.escape(value)}(?:\s[^']*)?'|{re.escape(value)}(?=[\s>]))"""
        wanted = lambda x: opens(x) & F.regexp_like(x, F.lit(held))
    state = "struct<depth:int,done:boolean>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        depth = at["depth"] + F.when(at["done"] | alone(x), 0).when((at["depth"] > 0) & opens(x) | (at["depth"] == 0) & wanted(x), 1).when((at["depth"] > 0) & closes(x), -1).otherwise(0)
        inside = F.when(at["depth"] > 0, F.when(depth > 0, x).otherwise("")).when(depth > 0, F.regexp_replace(x, r"(?s)^<[^>]*>", ""))  # without the region's own tags
        return F.struct(depth.alias("depth"), (at["done"] | ((at["depth"] > 0) & (depth == 0))).alias("done")), inside

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"))
    return let(scan(parts, state, "string", start, step), lambda found: F.when(F.exists(found, lambda x: x.isNotNull()), F.array_join(found, "")))


def guess_title(text: Column) -> Column:
    """The first line that isn't blank, white space collapsed, 200 characters at most."""
    first = F.get(F.filter(F.split(text, LINE), lambda t: py_strip(t) != ""), F.lit(0))
    return F.coalesce(F.left(py_strip(F.regexp_replace(first, r"(?U)\s+", " ")), F.lit(200)), F.lit(""))


def break_chapters(text: Column) -> Column:
    """A line break before every chapter heading within a line."""
    return F.regexp_replace(text, INLINE_CHAPTER, "\n$1")


def break_articles(text: Column) -> Column:
    """A line break before the article headings within lines: those whose number is above all before and that aren't cited.

    The text is cut before each candidate, and a fold over the parts carries the last heading's number.
    """
    parts = F.split(text, r"(?=Điều(?U:\s+)\d+)", -1)
    number = lambda p: F.nullif(F.regexp_extract(p, r"^Điều(?U:\s+)(\d+)", 1), F.lit("")).try_cast("decimal(38,0)")
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("last"), F.lit("").alias("tail"))

    def step(acc: Column, p: Column) -> tuple[Column, Column]:
        n, before = number(p), acc["tail"]
        heading = F.coalesce(n > acc["last"], F.lit(False)) & ~F.regexp_like(before, F.lit(CITED))
        cut = heading & (before != "") & ~before.endswith("\n")
        after = F.struct(F.when(heading, n).otherwise(acc["last"]).alias("last"), F.right(F.concat(before, p), F.lit(LOOKBACK)).alias("tail"))
        return after, F.when(cut, F.concat(F.lit("\n"), p)).otherwise(p)

    return F.when(text.isNotNull(), F.array_join(scan(parts, "struct<last:decimal(38,0),tail:string>", "string", start, step), ""))


def normalize_markdown(text: Column) -> Column:
    return break_articles(break_chapters(text))


def lines_of(text: Column) -> Column:
    lines = F.split(text, LINE, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


CHAPTER_HEAD = "struct<number:string,title:string>"
TIMES = "struct<number:string,times:int>"


def article_array(text: Column) -> Column:
    """The articles of a text in order, as an array: chapter_number, chapter_title, article_number, article_title, body, and again, the how
    manieth of its number it is. Row-local, and linear in the lines: the text moves nowhere, whatever its length.

    Headings are found line by line; a scan over them alone carries the last chapter. What stands before the first heading,
    or between a chapter's and the next, belongs to no article.
    """

    def in_lines(lines: Column) -> Column:
        kind = lambda x: F.when(F.regexp_like(x, F.lit(CHAPTER)), "chapter").when(F.regexp_like(x, F.lit(ARTICLE)), "article")
        every = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), kind(x).alias("kind")))
        return let(F.filter(every, lambda h: h["kind"].isNotNull()), lambda heads: among(lines, heads))

    def among(lines: Column, heads: Column) -> Column:
        def step(last: Column, x: Column) -> tuple[Column, Column]:
            own = F.struct(F.regexp_extract(x["line"], CHAPTER, 1).alias("number"), py_strip(F.regexp_extract(x["line"], CHAPTER, 2)).alias("title"))
            now = F.when(x["kind"] == "chapter", own).otherwise(last)
            return now, now

        def article(x: Column, k: Column, chapters: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1)["pos"], F.size(lines))
            return F.struct(
                x["kind"].alias("kind"), F.get(chapters, k)["number"].alias("chapter_number"), F.get(chapters, k)["title"].alias("chapter_title"),
                F.regexp_extract(x["line"], ARTICLE, 1).alias("article_number"), py_strip(F.regexp_extract(x["line"], ARTICLE, 2)).alias("article_title"),
                py_strip(F.array_join(F.slice(lines, x["pos"] + 2, F.greatest(end - x["pos"] - 1, F.lit(0))), "\n")).alias("body"),
            )

        chapters = scan(heads, CHAPTER_HEAD, CHAPTER_HEAD, F.lit(None).cast(CHAPTER_HEAD), step)
        found = let(chapters, lambda c: F.filter(F.transform(heads, lambda x, k: article(x, k, c)), lambda a: a["kind"] == "article"))
        return let(found, numbered)

    def numbered(found: Column) -> Column:
        """With the times that its number has come up to an article: sorted by number these stand side by side."""

        def step(last: Column, x: Column) -> tuple[Column, Column]:
            times = F.when(last["number"] == x["number"], last["times"] + 1).otherwise(1)
            return F.struct(x["number"].alias("number"), times.alias("times")), F.struct(x["seq"].alias("seq"), times.alias("times"))

        own = F.array_sort(F.transform(found, lambda a, i: F.struct(a["article_number"].alias("number"), i.alias("seq"))))
        times = F.array_sort(scan(own, TIMES, "struct<seq:int,times:int>", F.lit(None).cast(TIMES), step))
        return F.zip_with(found, times, lambda a, t: a.withField("again", t["times"]).dropFields("kind"))

    return let(lines_of(text), in_lines)


def articles(docs: DataFrame, text: str = "raw_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each article of docs (doc_id, title, text), with what `keep` names of its document."""
    return docs.select("doc_id", "title", *keep, F.posexplode(article_array(F.col(text))).alias("article_seq", "a")).select("doc_id", "title", *keep, "article_seq", "a.*")


def article_heading(number: Column, title: Column) -> Column:
    return py_strip(F.concat(F.lit("Điều "), number, F.lit(". "), title))


def full_text(number: Column, title: Column, body: Column) -> Column:
    return py_strip(F.concat_ws("\n", article_heading(number, title), body))


def pack_clauses(heading: Column, body: Column, max_chars: int = MAX_CHARS) -> Column:
    """Clauses of a body in groups below max_chars with the heading; a clause is never cut. A body without text gives one empty group."""
    clauses = F.filter(F.split(body, r"(?md)(?=^(?U:\s*)\d+\.(?U:\s))"), lambda p: py_strip(p) != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        grown = F.when(acc["now"] != "", py_strip(F.concat_ws("\n", acc["now"], part))).otherwise(py_strip(part))
        full = (acc["now"] != "") & (F.length(heading) + F.length(grown) > max_chars)
        return F.struct(F.when(full, py_strip(part)).otherwise(grown).alias("now"), F.when(full, F.array_append(acc["out"], acc["now"])).otherwise(acc["out"]).alias("out"))

    groups = F.aggregate(clauses, start, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["out"], acc["now"])).otherwise(acc["out"]))
    return F.when(F.size(groups) > 0, groups).otherwise(F.array(F.lit("")))


def chunk_articles(rows: DataFrame, max_chars: int = MAX_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk of articles(): the whole article, or groups of its clauses under its heading.

    Articles of one number in a document would share ids; from the second on they are told apart by a suffix.
    """
    number, title, body = F.col("article_number"), F.col("article_title"), F.col("body")
    base = F.concat(F.col("doc_id"), F.lit(":dieu"), number, F.when(F.col("again") > 1, F.concat(F.lit(":dup"), F.col("again") - 1)).otherwise(""))

    def cut(x: Column) -> Column:
        split = F.length(x["whole"]) > max_chars
        groups = F.transform(pack_clauses(x["heading"], body, max_chars), lambda g: py_strip(F.concat_ws("\n", x["heading"], g)))
        return F.struct(split.alias("split"), F.when(split, groups).otherwise(F.array(x["whole"])).alias("groups"))

    parts = let(F.struct(article_heading(number, title).alias("heading"), full_text(number, title, body).alias("whole")), cut)
    told = rows.withColumn("parts", parts).select("*", F.col("parts.split").alias("split"), F.col("parts.groups").alias("groups"))
    parts = told.select("*", F.size("groups").alias("part_count"), F.posexplode("groups").alias("part_index", "text"))
    chunk_id = F.concat(base, F.when(F.col("split"), F.concat(F.lit(":part"), F.col("part_index"))).otherwise(""))
    return parts.select(
        chunk_id.alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("title").alias("document_title"), "chapter_number", "chapter_title",
        "article_number", "article_title", "part_index", "part_count", "text", F.sha2("text", 256).alias("content_hash"), *keep,
    )
