"""Checklists: obligations extracted from chunks become dated items, which users replace, update and ask for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.common import small, stash
from statuta.functions.deadlines import due_date
from statuta.functions.text import citation
from statuta.operators.retrieval import retrieve

OBLIGATION = (
    "struct<title:string,description:string,deadline_type:string,deadline_month:int,deadline_day:int,period_months:int,"
    "days_after_event:int,event_description:string,penalty_summary:string>"
)
OUTPUT = f"struct<obligations:array<{OBLIGATION}>>"
REQUIRED = ["title", "description", "deadline_type", "penalty_summary"]


def extract(chunks: DataFrame, extractor: Callable[[str, str], str]) -> DataFrame:
    """chunks with `extraction`, the JSON that the extractor gives for (text, category): a client of a model, or rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(extraction=[extractor(t, c) for t, c in zip(b["text"], b["category"])])

    return chunks.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", extraction string")


def rule_extractor(text: str, category: str, duty: str = r"(?i)\b(?:phải|có nghĩa vụ|shall|must)\b") -> str:
    """The extractor that needs no model: the first sentence with a word of duty, due on the 20th of January and every three months."""
    for sentence in re.split(r"(?<=[.;])\s+", text or ""):
        if re.search(duty, sentence):
            item = {"title": sentence[:60], "description": sentence[:300], "deadline_type": "recurring", "deadline_month": 1, "deadline_day": 20, "period_months": 3, "penalty_summary": ""}
            return json.dumps({"obligations": [item]}, ensure_ascii=False)
    return json.dumps({"obligations": []})


def obligations(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Obligation rows of the column `extraction`, and those that lack a required field. Text that is no JSON gives none."""
    rows = extracted.withColumn("o", F.explode(F.from_json("extraction", OUTPUT)["obligations"]))
    whole = F.lit(True)
    for f in REQUIRED:
        whole = whole & F.col(f"o.{f}").isNotNull()
    rows = rows.drop("extraction").withColumn("whole", F.coalesce(whole, F.lit(False))).select("*", "o.*").drop("o")
    return rows.where("whole").drop("whole"), rows.where("not whole").drop("whole")


def items(found: DataFrame, today: Column) -> DataFrame:
    """Checklist items of obligation rows with user_id, category, chunk_id, law_name, article_number, part_index, part_count."""
    due = due_date(*(F.col(c) for c in ("deadline_type", "deadline_month", "deadline_day", "period_months", "days_after_event")), F.lit(None).cast("date"), today)
    return found.select(
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "category", "chunk_id", "title")).alias("id"), "user_id", "title", "category", "description",
        "deadline_type", "deadline_month", "deadline_day", "period_months", "days_after_event", "event_description", due.alias("due_date"), "penalty_summary",
        citation(F.col("law_name"), F.col("article_number"), F.col("part_index"), F.col("part_count")).alias("source_citation"),
        F.col("chunk_id").alias("source_chunk_id"), F.lit("pending").alias("status"),
    )


def _extracted(pairs: DataFrame, chunks: DataFrame, extractor: Callable[[str, str], str]) -> DataFrame:
    """Obligations of distinct pairs of category and chunk_id."""
    needed = chunks.drop("category").join(pairs, "chunk_id")
    return obligations(extract(needed.select("chunk_id", "category", "text", "law_name", "article_number", "part_index", "part_count"), extractor))[0]


def generate(hits: DataFrame, queries: DataFrame, chunks: DataFrame, extractor: Callable[[str, str], str], today: Column, top_k: int = 3) -> DataFrame:
    """Items of all users. Each pair of chunk and category is extracted once, whoever asked for it."""
    best = hits.where(F.col("rank") <= top_k).join(queries.select("query_id", "user_id", "category"), "query_id").select("user_id", "category", "chunk_id")
    return items(best.join(_extracted(best.select("category", "chunk_id").distinct(), chunks, extractor), ["category", "chunk_id"]), today)


def generate_for_users(queries: DataFrame, chunks: DataFrame, today: Column, is_semantic: bool = False, extractor: Callable[[str, str], str] = rule_extractor, top_k: int = 3) -> DataFrame:
    """Items for the category queries of all users. Users who ask the same see the same, so each distinct question is retrieved, and what it finds extracted, once;
    then users come to what their questions found."""
    same = ["category", "query_text", "entity_type", "province"]
    shared = queries.withColumn("shared", F.xxhash64(*(F.coalesce(F.col(c), F.lit("\0")) for c in same)))
    asked = stash(shared.select(F.col("shared").alias("query_id"), *same).dropDuplicates(["query_id"]), "questions")
    hits = retrieve(asked, chunks, is_semantic).where(F.col("rank") <= top_k).select("query_id", "chunk_id")
    best = stash(hits.join(small(asked.select("query_id", "category")), "query_id").select(F.col("query_id").alias("shared"), "category", "chunk_id"), "best")
    pairs = small(best.select("category", "chunk_id").distinct())
    found = stash(best.join(_extracted(pairs, chunks, extractor), ["category", "chunk_id"]), "found")
    return items(shared.select("shared", "user_id").join(small(found), "shared"), today)


def replace_items(stored: DataFrame, users: DataFrame, new: DataFrame, preserve_status: bool = False) -> DataFrame:
    """The checklist with the items of `users` replaced by new ones."""
    if preserve_status:
        old = stored.select("id", F.col("status").alias("old"))
        new = new.join(old, "id", "left").withColumn("status", F.coalesce("old", "status")).drop("old")
    return stored.join(users.select("user_id").distinct(), "user_id", "left_anti").unionByName(new)


def pending(stored: DataFrame, today: Column, days_ahead: int | None = None) -> DataFrame:
    """Pending items; with days_ahead only those due by then, overdue ones too."""
    own = stored.where("status = 'pending'")
    return own if days_ahead is None else own.where(F.col("due_date") <= F.date_add(today, days_ahead))


def status_text(users: DataFrame, stored: DataFrame, today: Column, days_ahead: int | None = None) -> DataFrame:
    """user_id and the pending items as lines, or a message."""
    line = F.concat(F.lit("- ["), "category", F.lit("] "), "title", F.lit(" — due "), F.coalesce(F.col("due_date").cast("string"), F.lit("None")), F.lit(" — "), "source_citation")
    lines = pending(stored, today, days_ahead).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l"))
    none = R.NO_PENDING if days_ahead is None else R.NO_PENDING_WITHIN.format(days_ahead)
    return users.select("user_id").join(lines, "user_id", "left").select("user_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(none)).alias("message"))


def stored_items(users: DataFrame, asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Items of the users that were asked for; `found` tells an unknown user from an empty list."""
    known = asked.join(users.select("user_id", F.lit(True).alias("found")), "user_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return known.join(stored, "user_id", "left").withColumn("due_date", F.col("due_date").cast("string"))


def update_status(stored: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The checklist with updates (user_id, id, status) of own items, and the updates that are refused."""
    valid = updates.where(F.col("status").isin(R.ITEM_STATUSES)).join(stored.select("user_id", "id"), ["user_id", "id"], "left_semi")
    refused = updates.join(valid, ["user_id", "id", "status"], "left_anti")
    new = valid.groupBy("user_id", "id").agg(F.max("status").alias("new"))
    return stored.join(new, ["user_id", "id"], "left").withColumn("status", F.coalesce("new", "status")).select(*stored.columns), refused


def mark_done(stored: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: request_id, user_id, title_contains. The checklist with items done that one request alone names, and a message for each request."""
    at = requests.join(stored.select("user_id", "id", "title"), "user_id", "left").withColumn("hit", F.coalesce(F.ilike("title", F.concat(F.lit("%"), "title_contains", F.lit("%"))), F.lit(False)))
    told = at.groupBy("request_id", "user_id", "title_contains").agg(
        F.count_if("hit").alias("n"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("id", "title")))).alias("found")
    )
    titles = F.array_join(F.transform("found", lambda x: x["title"]), "; ")
    message = (
        F.when(F.col("n") == 0, F.format_string(R.NONE_MATCHES, "title_contains"))
        .when(F.col("n") > 1, F.format_string(R.MANY_MATCH, "title_contains", titles))
        .otherwise(F.format_string(R.MARKED, titles))
    )
    done = told.where("n = 1").select("user_id", F.get("found", F.lit(0))["id"].alias("id")).distinct().withColumn("done", F.lit("done"))
    out = stored.join(done, ["user_id", "id"], "left").withColumn("status", F.coalesce("done", "status")).select(*stored.columns)
    return out, told.select("request_id", "n", message.alias("message"))
