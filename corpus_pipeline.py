"""A training corpus from raw documents: five stages, each over all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder
and reads it again as the next stage's docs. All stages but the last return the columns of documents, extra ones
included, whatever their names. A null or wordless text has no language and goes in the first stage; repeated rows are
copies, of which the second keeps one; an empty table passes all stages and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import decontaminate, langid, neardup, packing, pii
from statuta.llm.common import bounded_batches, fresh_path, internal, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; a text without letters is in none and goes, and so do all where no language is labelled."""
    bounded_batches(spark)
    fold = langid.fold(F.col("doc_id"))
    profiles = langid.learn(docs.where(fold != 0))
    told = internal("told")
    return docs.withColumn(told, langid.predict(F.col("text"), profiles)).where(F.col(told)["lang_pred"] != langid.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return neardup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in whatever order its parts stand."""
    told = internal("contamination")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=told)
    return found.where(~F.col(told)["contaminated"]).select(*docs.columns)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced; n_chars is that of the new text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1,024: the pieces of all documents with their ids."""
    bounded_batches(spark)
    return packing.pack_documents(docs, packing.public_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", sanitise_personal_data),
    ("packing", pack_sequences),
]

#: Trained profiles, verified hash candidates and a tokenizer: no stage but the base patterns can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage leaves besides its result goes once that is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
