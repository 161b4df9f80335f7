"""Queries over what arrives bit by bit: feeds of profile changes, runs of ingest that fail and are mended, embedding by a model."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.common import fresh_path, stash
from statuta.operators import profiles, retrieval
from statuta.plans import corpus_queries as C
from statuta.plans import lifecycle_queries as L
from statuta.plans import user_queries as U
from statuta.plans import views as V
from statuta.registry import query
from statuta.sources import corpus as S
from statuta.sources import models
from statuta.sources.store import ChunkStore
from statuta.streaming import feed, ingest

_EVERY = "'" + ",".join(profiles.FIELDS) + "'"


@query(
    "r2_profile_feed",
    f"""WITH {V.PROFILES_SQL.replace("profiles AS (", "base AS (")}, {U.HISTORY_SQL.replace("FROM profiles", "FROM base")},
    profiles AS (SELECT b.* REPLACE (h.user_id * 1000000 + version AS user_id, h.age AS age, h.dependents AS dependents, h.occupation_type AS occupation_type) FROM history h JOIN base b ON b.user_id = h.user_id), {U.TRAITS_SQL},
    t AS (SELECT user_id, md5(array_to_string(list_sort(list(DISTINCT tag)), ',')) AS tags FROM traits GROUP BY 1)
    SELECT h.user_id, CAST(version AS INT) AS version, CASE WHEN version = 1 THEN {_EVERY} ELSE changed_fields END AS changed_fields, age, dependents, occupation_type, tags
    FROM history h LEFT JOIN t ON t.user_id = h.user_id * 1000000 + version""",
)
def profile_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and traits of users from changes that arrive in three parts, every fifth a tenth of the whole time late."""
    base, changes = V.profiles(spark, sf_dir), V.changes(spark, sf_dir)
    to, out, checkpoint = (fresh_path(spark, f"feed-{x}") for x in ("in", "out", "checkpoint"))
    at = F.col("ts").cast("timestamp").cast("double")
    first, last = changes.agg(F.min(at), F.max(at)).first()
    span = (last or 0) - (first or 0)
    arrives = (at - F.lit(first)) / F.lit(span or 1.0) + F.when(F.col("event_id") % 5 == 0, 0.1).otherwise(0.0)
    part = F.least(F.floor(3 * arrives), F.lit(2))
    seen = stash(changes.withColumn("part", part).drop("event_id"), "changes")
    for k in range(3):
        seen.where(F.col("part") == k).drop("part").write.mode("append").parquet(to)
        arriving = spark.readStream.schema(seen.drop("part").schema).parquet(to)
        feed.profile_stream(arriving, base, out, checkpoint, lateness=f"{int(span * 0.1) + 1} seconds").awaitTermination()
    tags = feed.traits(spark, out).groupBy("user_id", "version").agg(F.md5(F.array_join(F.array_sort(F.collect_set("tag")), ",")).alias("tags"))
    rows = feed.history(spark, out).join(tags, ["user_id", "version"], "left")
    return rows.select("user_id", "version", F.array_join("changed_fields", ",").alias("changed_fields"), "age", "dependents", "occupation_type", "tags")


_BODY = "has_body AND coalesce(len(l), 0) > 0"
_KIND = C.USABLE.split(" AND ")[-1]


@query(
    "r1_resumable_ingest",
    f"""{L.STORED_SQL}, k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
    r AS (SELECT doc_id, doc_name, CASE WHEN NOT ({_BODY}) THEN 'body' WHEN NOT ({_KIND}) THEN 'type' END AS reason, NOT ({_BODY}) AND doc_id % 28 = 0 AS mended, {_KIND} AS kind FROM corpus)
    SELECT doc_name, CASE WHEN reason IS NULL THEN 1 ELSE 2 END AS attempt, CASE WHEN mended AND kind THEN NULL WHEN mended THEN 'type' ELSE reason END AS reason, coalesce(n, CASE WHEN mended AND kind THEN 1 ELSE 0 END) AS n_chunks
    FROM r LEFT JOIN k USING (doc_id) UNION ALL SELECT 'versions by the run after it', NULL, NULL, 0""",
)
def resumable_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of ingest over files that arrive one after the other, a try of what failed with some bodies mended, and a run that finds nothing to do."""
    rows = V.corpus(spark, sf_dir)
    names = [f.split()[0] for f in S.CORPUS.split(", ")]
    to, store, letters, checkpoint = (fresh_path(spark, f"ingest-{x}") for x in ("in", "store", "letters", "checkpoint"))
    kept = ChunkStore(spark, store)
    run = lambda: ingest.ingest_stream(spark, to, checkpoint, kept, letters).awaitTermination()
    for k in range(2):
        rows.where(F.col("doc_id") % 2 == k).select(*(n for n in names if n in rows.columns)).write.mode("append").parquet(to)
        run()
    every = spark.read.schema(S.CORPUS).parquet(to)
    bad = every.where((S.refusal() == "body") & (F.substring("doc_name", 2, 20).cast("long") % 28 == 0)).withColumn("markdown", F.lit("Điều 1. mended"))
    left = ingest.retry(spark, letters, kept, bad, "mended").select("doc_name", "reason")
    before = len(kept.versions())
    run()
    tried = spark.read.parquet(letters).groupBy("doc_name").agg(F.max("attempt").alias("attempt"))
    chunks = kept.chunks().groupBy(F.regexp_replace("document_id", "^vbpl-hf-", "").alias("doc_name")).agg(F.count("*").alias("n_chunks"))
    out = every.select("doc_name").join(tried, "doc_name", "left").join(left, "doc_name", "left").join(chunks, "doc_name", "left")
    out = out.select("doc_name", F.coalesce("attempt", F.lit(1)).alias("attempt"), "reason", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return out.unionByName(spark.createDataFrame([("versions by the run after it", None, None, len(kept.versions()) - before)], "doc_name string, attempt int, reason string, n_chunks long"))


MODEL = "e5-of-word-shapes"


def word_shapes():
    """A model that needs no training: counts of words of Latin letters by first letter and length, in 64 buckets."""
    word = re.compile("[A-Za-z]+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 64))
        for i, x in enumerate(texts):
            out[i] = np.bincount(np.array([(ord(w[0]) * 7 + len(w)) % 64 for w in word.findall(x)], np.int64), minlength=64)
        return out

    return encode


_SHAPES = lambda rel, key, text: f"""(SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, (ascii(t) * 7 + length(t)) % 64 AS bucket, count(*) AS n
        FROM (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z]+')) AS t FROM {rel}) GROUP BY 1, 2))"""  # noqa: E731


@query(
    "x7_model_search",
    f"""{L.STORED_SQL}, cv AS MATERIALIZED {_SHAPES("c", "chunk_id", "'passage: ' || text")}, qv AS MATERIALIZED {_SHAPES("benchmark", "item_id", "'query: ' || coalesce(text, '')")},
    s AS (SELECT item_id, chunk_id, round(sum(cv.w * qv.w), 9) AS similarity FROM cv JOIN qv USING (bucket) GROUP BY 1, 2),
    p AS (SELECT item_id AS query_id, c.chunk_id, coalesce(similarity, 0) AS similarity FROM benchmark CROSS JOIN c LEFT JOIN s USING (item_id, chunk_id)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INT) AS rank FROM p)
    SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""",
)
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded by a model as the store takes them up, those of every fourth document later; the five nearest of each question by the vectors stored."""
    chunks = stash(S.chunks_of(C.documents(spark, sf_dir)), "chunks")
    kept = ChunkStore(spark, fresh_path(spark, "vector-store"), embed=models.embed_column(word_shapes, MODEL))
    kept.upsert(chunks.where(F.regexp_extract("document_id", r"(\d+)$", 1).cast("long") % 4 != 0))
    kept.upsert(chunks)
    none = F.lit(None).cast("string").alias("category")
    asked = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), none, "text")
    asked = models.embed_column(word_shapes, MODEL, task="query")(asked).withColumnRenamed("embedding", "vector")
    found = retrieval.nearest_vectors(stash(asked.drop("text"), "query-vectors"), kept.chunks().select("chunk_id", none, F.col("embedding").alias("vector")), 5)
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")
