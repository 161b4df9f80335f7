"""Document-level obligation retrieval: candidates, the text in force, coverage, citation, order by authority, and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.common import small, stash
from statuta.functions import citations, classify
from statuta.functions.text import clip01
from statuta.operators import facets
from statuta.operators.consolidation import first_of


def candidates(lexical: DataFrame, embedding: DataFrame) -> DataFrame:
    """query_id, doc_name, lexical_score, embedding_score (null if only words matched): the best of each source."""
    a = lexical.groupBy("query_id", "doc_name").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("lexical_score"))
    b = embedding.groupBy("query_id", "doc_name").agg(F.max(clip01(F.col("score"))).alias("embedding_score"))
    both = a.join(b, ["query_id", "doc_name"], "full_outer")
    return both.withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0)))


def coverage(in_jurisdiction: Column, lexical: Column, embedding: Column, boost: Column, ranked: Column, consolidation: Column) -> Column:
    w = R.WEIGHTS
    return (
        w["jurisdiction_match"] * in_jurisdiction.cast("double") + w["lexical_score"] * lexical + w["embedding_score"] * F.coalesce(embedding, F.lit(0.0))
        + w["legal_area_boost"] * boost + w["hierarchy_confidence"] * F.when(ranked, 1.0).otherwise(0.5) + w["consolidation_confidence"] * consolidation
    )


def retrieve_obligations(queries: DataFrame, corpus: DataFrame, lexical: DataFrame, embedding: DataFrame, consolidated: DataFrame, top_k: int = 10, dedupe: bool = False, legacy_span: bool = False) -> tuple[DataFrame, DataFrame]:
    """queries: query_id, province, keywords. Gives the obligations of each query, and its gaps.

    consolidated is the walk of all documents, made once, as it doesn't depend on the query. dedupe: of candidates
    that come to one document in force, keep the best.
    """
    names = corpus.select("doc_name", "title", "doc_type", "scope", "issuing_authority", "legal_area", "issue_date", "markdown", "structure_json")
    inside = lambda: classify.in_jurisdiction(F.col("scope"), F.col("issuing_authority"), F.col("province"))
    found = candidates(lexical, embedding).join(queries, "query_id").join(names.select("doc_name", "scope", "issuing_authority"), "doc_name").where(inside()).drop("scope", "issuing_authority")
    current = found.join(consolidated, "doc_name").withColumnRenamed("doc_name", "candidate").withColumn("doc_name", F.col("effective"))
    rows = current.join(names, "doc_name").withColumn("jurisdiction_match", inside()).withColumn("boost", classify.legal_area_boost(F.col("legal_area"), F.col("keywords")))
    rows = rows.withColumn("ranked", classify.is_ranked(F.col("doc_type"))).withColumn("hierarchy_rank", classify.rank_of(F.col("doc_type"), F.col("scope")))
    total = coverage(F.col("jurisdiction_match"), F.col("lexical_score"), F.col("embedding_score"), F.col("boost"), F.col("ranked"), F.col("confidence"))
    rows = rows.withColumn("coverage_total", F.round(total, 9))
    kept = first_of(rows, ["query_id", "doc_name"], [F.desc("coverage_total"), "candidate"]) if dedupe else rows
    order = Window.partitionBy("query_id").orderBy("hierarchy_rank", F.desc("coverage_total"), "candidate")
    cited = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).withColumn("at", citations.locate_article(F.col("structure_json"), F.col("markdown"), legacy_span=legacy_span))
    hits = cited.select(
        "query_id", "rank", "candidate", "doc_name", "title", "at.*", "doc_type", "issue_date", (F.col("used_pointer") | (F.size("chain") > 1)).alias("is_consolidated"),
        "hierarchy_rank", F.array_join("chain", " -> ").alias("chain"), "confidence", "unresolved", "coverage_total",
    )
    return hits, gaps(queries, names, rows)


def gaps(queries: DataFrame, corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, kind, doc_name, title, reason: low coverage, unresolved consolidation, and documents without a body that may matter."""
    low = rows.where(F.col("coverage_total") < R.TRUSTED_COVERAGE).select(
        "query_id", F.lit("low_coverage").alias("kind"), "doc_name", "title",
        F.format_string("Coverage is %.2f, and %.2f is trusted.", "coverage_total", F.lit(R.TRUSTED_COVERAGE)).alias("reason"), "candidate",
    )
    open_ = rows.where("unresolved").select(
        "query_id", F.lit("unresolved_consolidation").alias("kind"), "doc_name", "title",
        F.concat(F.lit("What is in force is open after: "), F.array_join("chain", " -> ")).alias("reason"), "candidate",
    )
    empty = corpus.where(~F.coalesce(F.regexp_like("markdown", F.lit(r"(?U)\S")), F.lit(False))).drop("markdown", "structure_json")
    same = queries.withColumn("asked", F.xxhash64(F.coalesce("province", F.lit("\0")), F.to_json("keywords")))
    asked = stash(same.select("asked", F.col("asked").alias("query_id"), "province", "keywords").dropDuplicates(["asked"]), "asked")  # questions of one province and the same keywords share their documents
    words = asked.select("asked", F.explode("keywords").alias("k")).select("asked", F.lower("k").alias("term"))
    placed = facets.areas_of(facets.places_of(empty, facets.provinces_of(asked)), words.select("term")).select("doc_name", "title", "place", "area")
    areas = words.select("asked", F.col("term").alias("area")).unionByName(asked.select("asked", F.lit(facets.UNTOLD).alias("area")))
    seen = facets.places_seen(asked).withColumnRenamed("query_id", "asked").join(areas, "asked").distinct()
    matched = placed.join(small(seen), ["place", "area"]).select("asked", "doc_name", "title").distinct()
    bodyless = matched.join(same.select("asked", "query_id"), "asked").select(
        "query_id", F.lit("null_markdown_match").alias("kind"), "doc_name", "title", F.lit("Without a body, the document is out of reach of any search; it needs review.").alias("reason"), F.col("doc_name").alias("candidate")
    )
    every = low.unionByName(open_).unionByName(bodyless)
    return first_of(every, ["query_id", "kind", "doc_name"], ["candidate"]).drop("candidate")


def unreviewed(queries: DataFrame, gaps_: DataFrame) -> DataFrame:
    """query_id and whether any gap is left to review."""
    n = gaps_.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) > 0).alias("has_unreviewed_gaps"))
