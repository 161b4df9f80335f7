"""What a question may see of documents, as keys: places (central law, or a province) and areas (a keyword, or none told).

That an authority names a province, or an area a keyword, is a matter of one text within another. Both sides have few distinct values, so
an Aho-Corasick automaton of the terms passes once over the distinct texts, and what it finds are the rows of an equi-join; no
document is compared with a question.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.common import small, stash
from statuta.functions.classify import is_tagged
from statuta.functions.text import normalize_province
from statuta.operators import retrieval

CENTRAL = "*"
UNTOLD = "*"
AT_ONCE = 50_000  # terms in one automaton


def _finder(sent):
    """From a batch of texts to the terms that each holds."""

    def run(batch: pd.Series) -> pd.Series:
        automaton = ahocorasick.Automaton()
        for term in sent.value:
            if term:
                automaton.add_word(term, term)
        everywhere = [""] if "" in sent.value else []
        if len(automaton):
            automaton.make_automaton()
        return pd.Series([everywhere + sorted({t for _, t in automaton.iter(x)} if len(automaton) else []) for x in batch], dtype=object)

    return run


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """text, term: which of the distinct terms stand in which of the distinct texts. The empty term stands in every text, a null one in none. A pass over the texts for each AT_ONCE terms."""
    texts = texts.toDF("text").where("text is not null").distinct()
    terms = stash(terms.toDF("term").where("term is not null").distinct(), "terms")
    blocks, out = -(-terms.count() // AT_ONCE) or 1, None
    for k in range(blocks):
        some = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        sent = texts.sparkSession.sparkContext.broadcast([r["term"] for r in some.collect()])
        part = texts.select("text", F.explode(F.pandas_udf(_finder(sent), "array<string>")("text")).alias("term"))
        out = part if out is None else out.unionByName(part)
    return stash(out, "contained")


def places_of(documents: DataFrame, provinces: DataFrame) -> DataFrame:
    """documents (scope, issuing_authority and others) with `place`, a row for each: central law under CENTRAL, provincial law under each of the
    normalised provinces that its authority names. Those of neither scope, and those that name none, are left out."""
    named = contained(documents.where("scope = 'dia_phuong'").select(F.lower("issuing_authority")), provinces)
    central = documents.where("scope = 'trung_uong'").withColumn("place", F.lit(CENTRAL))
    own = documents.where("scope = 'dia_phuong'").withColumn("_authority", F.lower("issuing_authority"))
    return central.unionByName(own.join(small(named.select(F.col("text").alias("_authority"), F.col("term").alias("place"))), "_authority").drop("_authority"))


def places_seen(questions: DataFrame) -> DataFrame:
    """query_id, place: what each question (query_id, province) may see."""
    province = normalize_province(F.col("province"))
    every = F.array(F.lit(CENTRAL), province)
    return questions.select("query_id", F.explode(F.array_compact(every)).alias("place"))


def provinces_of(questions: DataFrame) -> DataFrame:
    return questions.select(normalize_province(F.col("province")).alias("term"))


def areas_of(documents: DataFrame, keywords: DataFrame) -> DataFrame:
    """documents (legal_area and others) with `area`, a row for each: UNTOLD where no area is told, else each of the keywords (term) that it holds."""
    tagged = is_tagged(F.col("legal_area"))
    told = documents.where(tagged).withColumn("_area", F.lower("legal_area"))
    found = contained(told.select("_area"), keywords.where("term <> ''"))
    untold = documents.where(~tagged).withColumn("area", F.lit(UNTOLD))
    return untold.unionByName(told.join(small(found.select(F.col("text").alias("_area"), F.col("term").alias("area"))), "_area").drop("_area"))


class DocumentStore:
    """Documents (doc_name, scope, issuing_authority, text and others) for questions (query_id, query_text, province), each searched within its jurisdiction before anything is cut."""

    def __init__(self, documents: DataFrame, questions: DataFrame):
        self.documents, self.questions = documents, questions
        self.placed = places_of(documents, provinces_of(questions))
        self.seen = places_seen(questions)

    def get(self, names: DataFrame) -> DataFrame:
        return self.documents.join(names.select("doc_name").distinct(), "doc_name", "left_semi")

    def by_jurisdiction(self) -> DataFrame:
        """query_id, doc_name of all documents that a question may see, with a text or without."""
        return self.placed.select("doc_name", "place").join(small(self.seen), "place").select("query_id", "doc_name")

    def _bodies(self) -> DataFrame:
        """A chunk for each place of a document; its id starts with the document's name and keeps the order of names."""
        chunk = F.concat("doc_name", F.lit("\x1f"), "place").alias("chunk_id")
        return self.placed.where("text is not null").select(chunk, F.lit("all").alias("category"), F.lit("both").alias("entity_type"), "place", "text")

    def search_fulltext(self, limit: int) -> DataFrame:
        """query_id, doc_name, score: of the best by BM25 over what the question may see, the share of its words that they hold."""
        from statuta.functions.text import lexical_overlap

        body = self._bodies().withColumn("province_scope", F.when(F.col("place") == CENTRAL, "national").otherwise(F.col("place"))).drop("place")
        q = self.questions.select("query_id", F.lit("all").alias("category"), "query_text", F.lit("individual").alias("entity_type"), normalize_province(F.col("province")).alias("province"))
        best = stash(retrieval.bm25_top(q, body, limit).select("query_id", "chunk_id"), "lexical-best")
        words = body.join(small(best), "chunk_id").join(small(q.select("query_id", "query_text")), "query_id")
        return words.select("query_id", F.substring_index("chunk_id", "\x1f", 1).alias("doc_name"), lexical_overlap(F.col("query_text"), F.col("text")).alias("score"))

    def search_embeddings(self, limit: int, embed=retrieval.hashing_vectors) -> DataFrame:
        """query_id, doc_name, score: the nearest of what the question may see. Each place is searched by itself, and the best of a question's places are merged."""
        body = self._bodies().withColumn("category", F.col("place")).drop("place")
        key = F.concat_ws("\x1f", F.col("query_id").cast("string"), "place")
        each = self.questions.join(small(self.seen), "query_id").select(key.alias("query_id"), F.col("query_id").alias("asked"), F.col("place").alias("category"), "query_text")
        each = stash(each, "asked-places")
        near = retrieval.vector_top(each.drop("asked"), body, limit, embed).join(small(each.select("query_id", "asked")), "query_id")
        near = near.select(F.col("asked").alias("query_id"), "chunk_id", F.col("similarity").alias("score"))
        return retrieval.ranked(near, "score", limit).select("query_id", F.substring_index("chunk_id", "\x1f", 1).alias("doc_name"), "score")
