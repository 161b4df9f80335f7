"""From source rows (parquet, text, JSON details, HTML) to documents: doc_id, title, raw_text, law_name, category, entity_type, province_scope, dates, url."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.common import small
from statuta.functions import classify, segment
from statuta.functions.text import py_strip

CORPUS = (
    "doc_name string, title string, doc_type string, legal_type string, scope string, issuing_authority string, doc_number array<string>, legal_area string, "
    "issue_date string, markdown string, extracted_json string, structure_json string, confidence double, source_url string, van_ban_hop_nhat string"
)
DETAIL = (
    "id string, docId string, docNum string, docNumber string, title string, docName string, name string, effStatus string, effectStatus string, effFrom string, "
    "effectiveFrom string, effTo string, effectiveTo string, documentContent struct<content:string>, content string"
)
SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9-]*)(?:([.#])([\w-]+))?")
REGIONS = 200
META = ["law_name", "category", "entity_type", "province_scope", "effective_from", "effective_to", "source_url"]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: doc_id from the name, title from the first line."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw_text"))
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_id"), segment.guess_title(F.col("raw_text")).alias("title"), "raw_text")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETAIL).json(path)


def _first(*names: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def listing_ids(pages: DataFrame) -> DataFrame:
    """Document ids of listing pages, whose entries stand under `items` or `data`: id or docId, blank ones left out."""
    entries = pages.select(F.explode(F.coalesce("items", "data")).alias("e"))
    ids = F.coalesce(F.nullif(F.col("e.id").cast("string"), F.lit("")), F.nullif(F.col("e.docId").cast("string"), F.lit("")))
    return entries.select(ids.alias("doc_id")).where("doc_id is not null")


def detail_fields(details: DataFrame) -> DataFrame:
    """One set of names for the variants that details come with."""
    empty = F.lit("")
    return details.select(
        F.coalesce(_first("id", "docId"), empty).alias("id"), F.coalesce(_first("docNum", "docNumber"), empty).alias("doc_num"), F.coalesce(_first("title", "docName", "name"), empty).alias("title"),
        F.coalesce(_first("effStatus", "effectStatus"), empty).alias("eff_status"), _first("effFrom", "effectiveFrom").alias("eff_from"), _first("effTo", "effectiveTo").alias("eff_to"),
        F.coalesce(_first("documentContent.content"), _first("content"), empty).alias("content_html"),
    )


def documents_of_details(fields: DataFrame, overrides: DataFrame | None = None, base_url: str = "") -> tuple[DataFrame, DataFrame]:
    """Documents of details in force; the others with the reason: status, no content, or no text."""
    rows = fields.withColumn("raw_text", segment.html_to_lines(F.col("content_html")))
    reason = (
        F.when((F.col("eff_status") != "") & ~F.col("eff_status").isin(R.INGESTIBLE_STATUSES), "status")
        .when(F.col("content_html") == "", "no content")
        .when(F.col("raw_text") == "", "no text")
    )
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("override", F.lit(None).cast("string")) if overrides is None else rows.join(small(overrides.select(F.col("doc_id").alias("id"), F.col("category").alias("override"))), "id", "left")
    law = F.when(F.col("doc_num") != "", F.concat("title", F.lit(" ("), "doc_num", F.lit(")"))).otherwise(F.col("title"))
    docs = rows.where("reason is null").select(
        F.concat(F.lit("vbpl-"), "id").alias("doc_id"), "title", "raw_text", law.alias("law_name"),
        classify.category(F.col("title"), F.lit(None).cast("string"), F.col("override")).alias("category"), F.lit("both").alias("entity_type"), F.lit(None).cast("string").alias("province_scope"),
        F.col("eff_from").alias("effective_from"), F.col("eff_to").alias("effective_to"), F.concat(F.lit(base_url), F.lit("/"), "id").alias("source_url"),
    )
    return docs, rows.where("reason is not null").select("id", "title", "reason")


def documents_of_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """pages: url, html. specs: url, doc_id and, each may be null, region (a tag, tag.class or tag#id), title, category, law_name, entity_type, province_scope, effective_from, effective_to.

    specs name few different regions, REGIONS at most; a region that is none of these forms gives no document.
    """
    rows, region = pages.join(specs, "url"), F.lit(None).cast("string")
    named = [r["region"] for r in specs.select("region").where("region is not null").distinct().limit(REGIONS + 1).collect()]
    if len(named) > REGIONS:
        raise ValueError(f"more than {REGIONS} different regions")
    for name in named:
        if told := SELECTOR.fullmatch(name):
            tag, kind, value = told.groups()
            region = F.when(F.col("region") == name, segment.content_region(F.col("html"), tag, {".": "class", "#": "id"}.get(kind), value)).otherwise(region)
    rows = rows.withColumn("raw_text", segment.html_to_lines(F.when(F.col("region").isNull(), F.col("html")).otherwise(region))).where("raw_text <> ''")
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), segment.guess_title(F.col("raw_text"))))
    return rows.select(
        "doc_id", "title", "raw_text", F.coalesce("law_name", "title").alias("law_name"), classify.category(F.col("title"), F.lit(None).cast("string"), F.col("category")).alias("category"),
        F.coalesce("entity_type", F.lit("both")).alias("entity_type"), "province_scope", "effective_from", "effective_to", F.col("url").alias("source_url"),
    )


def refusal(excluded: list[str] = R.EXCLUDED_DOC_TYPES) -> Column:
    """Why a row makes no document: no body, no title, no name, or an excluded type (a null type isn't); null where it makes one."""
    body = F.coalesce(F.regexp_like("markdown", F.lit(r"(?U)\S")), F.lit(False))
    missing = F.when(~body, "body").when(F.coalesce("title", F.lit("")) == "", "title").when(F.coalesce("doc_name", F.lit("")) == "", "name")
    return missing.when(F.coalesce("doc_type", F.lit("")).isin(excluded), "type")


def usable(corpus: DataFrame, excluded: list[str] = R.EXCLUDED_DOC_TYPES) -> DataFrame:
    """Rows with a body, a title and a name whose type isn't excluded; a null type stays."""
    return corpus.where(refusal(excluded).isNull())


def law_name(legal_type: Column, numbers: Column, title: Column) -> Column:
    kind, joined = F.coalesce(legal_type, F.lit("")), F.array_join(numbers, "; ")
    numbered = F.btrim(F.concat(kind, F.lit(" "), joined, F.lit(" - "), title), F.lit(" -"))
    return F.when(F.coalesce(joined, F.lit("")) != "", numbered).otherwise(py_strip(F.concat(kind, F.lit(" "), title)))


def documents_of_corpus(corpus: DataFrame, overrides: DataFrame | None = None, max_documents: int | None = None, excluded: list[str] = R.EXCLUDED_DOC_TYPES) -> DataFrame:
    """Documents of corpus rows; max_documents counts those that pass, in the order of their names."""
    rows = usable(corpus, excluded)
    rows = rows.withColumn("override", F.lit(None).cast("string")) if overrides is None else rows.join(small(overrides.select("doc_name", F.col("category").alias("override"))), "doc_name", "left")
    if max_documents is not None:
        first = rows.select("doc_name").orderBy("doc_name").limit(max_documents)  # of the names alone, the bodies stay where they are
        rows = rows.join(small(first), "doc_name", "left_semi")
    return rows.select(
        F.concat(F.lit("vbpl-hf-"), "doc_name").alias("doc_id"), "title", segment.normalize_markdown(F.col("markdown")).alias("raw_text"),
        law_name(F.col("legal_type"), F.col("doc_number"), F.col("title")).alias("law_name"), classify.category(F.col("title"), F.col("legal_area"), F.col("override")).alias("category"),
        F.lit("both").alias("entity_type"), classify.province_scope(F.col("scope"), F.col("issuing_authority")).alias("province_scope"),
        F.col("issue_date").alias("effective_from"), F.lit(None).cast("string").alias("effective_to"), "source_url",
    )


def validated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of a known category and entity type, and the others."""
    known = F.coalesce(F.col("category").isin(R.CATEGORIES) & F.col("entity_type").isin(R.ENTITY_TYPES), F.lit(False))
    return docs.where(known), docs.where(~known)


def chunks_of(docs: DataFrame, max_chars: int = R.MAX_CHARS) -> DataFrame:
    """The chunk table of documents, missing strings empty and the province `national` by default."""
    told = {"law_name": F.col("law_name"), "category": F.col("category"), "entity_type": F.col("entity_type")}
    told |= {"province_scope": F.coalesce(F.nullif("province_scope", F.lit("")), F.lit("national"))} | {c: F.coalesce(c, F.lit("")) for c in ("effective_from", "effective_to", "source_url")}
    own = docs.select("doc_id", "title", "raw_text", *(c.alias(n) for n, c in told.items()))
    rows = segment.chunk_articles(segment.articles(own, keep=tuple(told)), max_chars, tuple(told))
    text = ("chapter_number", "chapter_title")
    return rows.select(
        "chunk_id", "document_id", "document_title", "law_name", "category", "entity_type", "province_scope", "effective_from", "effective_to",
        *(F.coalesce(c, F.lit("")).alias(c) for c in text), "article_number", "article_title", "part_index", "part_count", "source_url", "content_hash", "text",
    )
