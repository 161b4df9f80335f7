"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

First, patterns find the entities that are protected: mail and IP addresses, card and phone numbers. Then the
corpus tells which other terms reveal them (Chow, Golle and Staddon, "Detecting Privacy Leaks Using
Corpus-based Association Rules"; Sanchez and Batet, "C-sanitized"): a term t that stands near an entity e
discloses it as far as seeing t tells that e is there, so by P(e|t) = n(t near e) / n(t) and by the
information log2 P(e|t)/P(e). A term whose P(e|t) and information reach the disclosure thresholds, in at least
`support` different contexts, is generalised (its place holds a label); beyond the higher threshold it is
removed. Terms are marked wherever they stand, not only near the entity.

All three counts are of documents, so an entity that one document repeats counts once. Copies give the same context,
so they add no support. The rows that are shuffled are those of terms near
entities, the corpus's counts by term (summed in each task first), and the documents' matched terms. The terms, and the documents that hold one, are
broadcast if they are few enough (`broadcast_rows`, checked by a count) and joined by a shuffle if not.

Defined cases: a null text is an empty one; repeated rows are treated alike and each counts; a null id is a
value of its own; an empty table gives no rows; a document without spans keeps its text; other columns stay as they
were, whatever their names. Texts are read whole; the work grows with the text and the entities in it, not their product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import let
from statuta.llm.common import internal, small, stash

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Look-behinds only keep the search from starting anew within a run that has failed,
#: and possessive repeats from going back into one; neither changes what matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
SPAN = "struct<kind:string,start:int,end:int,found:string>"
NO_SPANS = f"array<{SPAN}>"
TERM = r"\p{L}{3,}"
NO_TERM = r"[^\p{L}]+"
RUN, PART = 128, 4096  # places and characters that are worked on at a time
MASK = "\ua015"  # a letter: what stands in place of an entity ends no word and starts none


@dataclass(frozen=True)
class Disclosure:
    """near: characters on either side of an entity that are its context; the rest are the thresholds."""

    near: int = 60
    support: int = 3
    generalise: float = 0.5
    remove: float = 0.9
    bits: float = 3.0
    broadcast_rows: int = 50_000


def _running(values: Column, add) -> Column:
    """For each place of an array of ints, add() of all values up to it. Arrays are copied when they grow, so the work is
    done in runs of RUN places and the runs are strung together."""
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(RUN)), lambda at: F.slice(v, at, RUN))

    def step(done: Column, run: Column) -> Column:
        start = F.struct(F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0)).alias("at"), F.array().cast("array<int>").alias("out"))
        own = F.aggregate(run, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], add(acc["at"], x)).alias("out")))
        return F.array_append(done, own)

    done = lambda v: F.aggregate(runs(v), F.array().cast("array<struct<at:int,out:array<int>>>"), step)
    return let(values, lambda v: F.when(F.size(v) > 0, F.flatten(F.transform(done(v), lambda r: r["out"]))).otherwise(F.array().cast("array<int>")))


def spans_of(text: Column, pattern: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points: the parts between them and the matches add up."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: g + F.length(f))
        span = lambda f, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(f)).alias("start"), e.alias("end"), f.alias("found"))
        return F.zip_with(found, _running(steps, lambda a, x: a + x), span)

    return F.when(F.regexp_like(text, pattern), let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)).otherwise(F.array().cast(NO_SPANS))


def _sorted(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))


def _parts(text: Column) -> Column:
    """A text in parts of PART characters: a place in a text is found by a walk from its start, one in a part by a short one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(PART)), lambda at: F.substring(text, at, F.lit(PART)))


def _between(parts: Column, first: Column, last: Column) -> Column:
    a, b = F.floor(first / PART).cast("int"), F.floor(last / PART).cast("int")
    head, tail = F.coalesce(F.get(parts, a), F.lit("")), F.coalesce(F.get(parts, b), F.lit(""))
    within = F.substring(head, first % PART + 1, last - first)
    across = F.concat(F.substring(head, first % PART + 1, F.lit(PART)), F.array_join(F.slice(parts, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), last % PART))
    return F.when(a == b, within).otherwise(across)


def replaced(text: Column, spans: Column, label) -> Column:
    """The text with label(span) in place of each span; overlapping ones become one, under the label of the first."""

    def built(x: Column) -> Column:
        cut, own, upto = x["cut"], x["spans"], x["upto"]
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(_between(cut, before(i), s["start"]), label(s))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(own, piece), ""), _between(cut, before(F.size(own)), F.length(text)))

    ends = lambda own: _running(F.transform(own, lambda s: s["end"]), F.greatest)
    known = lambda own: F.struct(_parts(text).alias("cut"), own.alias("spans"), ends(own).alias("upto"))
    return let(let(_sorted(spans), known), built)


def _luhn(found: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(found, r"[\x20-]", "")), ""), lambda c: c != "")
    values = F.transform(digits, lambda c, i: (c.cast("int") * (i % 2 + 1)).cast("int"))
    return F.aggregate(F.transform(values, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def _digits(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", ""))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, in the order of KINDS and then of their start."""

    def valid(kind: str) -> Column:
        return F.filter(spans_of(text, F.lit(PATTERNS[kind]), kind), lambda x: VALID[kind](x["found"]))

    return F.concat(*map(valid, KINDS))


def _key(id_col: str, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.md5(text)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), NO_TERM), lambda w: F.length(w) >= 3))


def _contexts(text: Column, spans: Column, near: int) -> Column:
    """entity, a hash of kind and value, and context of each span: the words wholly within `near` characters of it; a word that the edge cuts is left out."""

    def context(x: Column, s: Column) -> Column:
        first, last = F.greatest(s["start"] - near, F.lit(0)), F.least(s["end"] + near, x["n"])
        before, after = _between(x["parts"], first, s["start"]), _between(x["parts"], s["end"], last)
        before = F.when(first > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
        after = F.when(last - s["end"] == near, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
        return F.struct(F.xxhash64(s["kind"], F.lower(s["found"])).alias("entity"), F.concat_ws(" ", before, after).alias("context"))

    return let(F.struct(_parts(text).alias("parts"), F.length(text).alias("n")), lambda x: F.transform(spans, lambda s: context(x, s)))


def disclosing_terms(docs: DataFrame, spans: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """term and disclosure, the greatest P(e|t) of an entity that the term discloses. spans: doc (a number of the row), text and base of
    the rows with entities. All counts are of rows: those with t near e, those with t, those with e."""
    near = spans.select("doc", _contexts(F.col("text"), F.col("base"), rule.near).alias("c"))
    near = stash(near.select("doc", F.explode("c").alias("c")).select("doc", "c.*"), "contexts")
    held, near = near, near.select("doc", "entity", F.xxhash64("context").alias("context"), F.explode(_terms(F.col("context"))).alias("term"))
    contexts = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    often = stash(contexts.where(F.col("contexts") >= rule.support).select("entity", "term"), "often")
    joint = near.select("entity", "term", "doc").join(small(often, rule.broadcast_rows), ["entity", "term"]).distinct()
    joint = stash(joint.groupBy("entity", "term").agg(F.count("*").alias("joint")), "joint")
    entities = held.select("entity", "doc").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    candidates = stash(joint.select("term").distinct(), "candidates")
    words = docs.select(F.explode(_terms(F.col(text_col))).alias("term"))
    total = words.groupBy("term").agg(F.count("*").alias("n_term")).join(small(candidates, rule.broadcast_rows), "term")
    n = docs.count()
    share = F.col("joint") / F.col("n_term")
    bits = F.log2(share * n / F.col("n_entity"))
    told = joint.join(total, "term").join(entities, "entity").where((share >= rule.generalise) & (bits >= rule.bits))
    return told.groupBy("term").agg(F.max(share).alias("disclosure"))


def find(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each distinct pair of id and text that has spans: key, base (spans of the four kinds) and terms
    (spans of kind `term`, or `drop` for those to be removed). Documents that are not listed have none. Terms are
    sought in what the entities leave of a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(id_col, text).alias("key"), text.alias("text"))
    base = rows.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    base = stash(base.withColumn("doc", F.monotonically_increasing_id()), "base-spans")
    terms = stash(disclosing_terms(rows, base, rule), "terms")
    words = rows.select("key", F.explode(_terms(F.col("text"))).alias("term"))
    matched = words.join(small(terms, rule.broadcast_rows), "term").groupBy("key").agg(F.collect_set(F.struct("term", "disclosure")).alias("held"))
    matched = stash(matched, "matched")
    inner = rows.join(small(matched, rule.broadcast_rows), "key").dropDuplicates(["key"])

    def pattern(drop: bool) -> Column:
        own = F.transform(F.filter("held", lambda x: (x["disclosure"] >= rule.remove) == drop), lambda x: x["term"])
        return F.when(F.size(own) > 0, F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(own), "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(r"(?!)"))

    none = F.array().cast(NO_SPANS)
    inner = inner.select("key", "text", pattern(False).alias("general"), pattern(True).alias("removed"))
    both = inner.join(base.select("key", "base").dropDuplicates(["key"]), "key", "full_outer").withColumn("base", F.coalesce("base", none))
    hidden = F.when(F.size("base") > 0, replaced(F.col("text"), F.col("base"), lambda s: F.repeat(F.lit(MASK), s["end"] - s["start"]))).otherwise(F.col("text"))
    both = stash(both.select("key", "base", hidden.alias("rest"), "general", "removed"), "hidden")
    found = F.concat(spans_of(F.col("rest"), F.col("general"), "term"), spans_of(F.col("rest"), F.col("removed"), "drop"))
    return stash(both.select("key", "base", F.when(F.col("rest").isNull(), none).otherwise(found).alias("terms")), "spans")


def _listed(spans: Column) -> Column:
    kind = lambda x: F.when(x["kind"] == "drop", "term").otherwise(x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def report(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term of every document."""
    keys = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    all_spans = keys.join(find(docs, rule, id_col, text_col), "key", "left")
    none = F.array().cast(NO_SPANS)
    base, terms = F.coalesce("base", none), F.array_sort(F.coalesce("terms", none), lambda a, b: a["start"] - b["start"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return all_spans.select("doc_id", *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, terms)).alias("spans"), F.size(terms).cast("long").alias("n_term"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they were but for the text: entities become [EMAIL], [IP], [CARD] or [PHONE], disclosing
    terms [TERM] or nothing. Spans that overlap become one, under the label of the first. A null text stays null."""
    key, spans = internal("key"), internal("spans")
    found = find(docs.select(id_col, text_col), rule, id_col, text_col).select(F.col("key").alias(key), F.concat("base", "terms").alias(spans))
    found = found.where(F.size(spans) > 0)
    names, text = docs.columns, F.col(text_col)
    joined = docs.withColumn(key, _key(id_col, F.coalesce(text, F.lit("")))).join(small(found, rule.broadcast_rows), key, "left")
    label = lambda x: F.when(x["kind"] == "drop", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    clean = F.when(F.col(spans).isNull(), text).otherwise(replaced(text, F.col(spans), label))
    return joined.withColumn(text_col, clean).select(*names)
