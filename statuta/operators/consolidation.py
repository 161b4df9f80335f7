"""Which document is in force in place of another: a pointer to a consolidated text, else a walk over references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta import refdata as R


def edges(refs: DataFrame) -> DataFrame:
    """From rows of src, pos, relation, target, confidence: per document its first superseding reference, or that it is repealed."""
    own = refs.where(F.col("relation").isin(R.SUPERSEDING + R.REPEALING))
    first = F.min_by(F.struct("target", "confidence"), F.when(F.col("relation").isin(R.SUPERSEDING), F.col("pos")))
    by = own.groupBy("src").agg(first.alias("first"), F.max(F.col("relation").isin(R.SUPERSEDING)).alias("supersedes"))
    return by.select("src", F.when(F.col("supersedes"), F.nullif(F.col("first.target"), F.lit(""))).alias("target"), F.coalesce(F.when(F.col("supersedes"), F.col("first.confidence")), F.lit(R.HOP_DECAY)).alias("hop"), (~F.col("supersedes")).alias("repealed"))


def consolidate(docs: DataFrame, refs: DataFrame, max_hops: int = R.MAX_HOPS) -> DataFrame:
    """docs: doc_name, pointer. Gives doc_name, effective, chain, confidence, used_pointer, unresolved.

    Each hop is one join of the documents still on their way with the edges and the names that exist. A walk ends
    settled where no reference is left; unresolved at a repeal, a missing or dead target, a circle, or the last hop.
    """
    e, names = edges(refs), docs.select(F.col("doc_name").alias("known"))
    pointed = docs.where("coalesce(pointer, '') <> ''").join(names, F.col("pointer") == F.col("known"), "left")
    found = F.col("known").isNotNull()
    by_pointer = pointed.select(
        "doc_name", F.when(found, F.col("pointer")).otherwise(F.col("doc_name")).alias("effective"),
        F.when(found, F.array("doc_name", "pointer")).otherwise(F.array("doc_name")).alias("chain"),
        F.when(found, R.POINTER_CONFIDENCE).otherwise(0.0).alias("confidence"), found.alias("used_pointer"), (~found).alias("unresolved"),
    )
    now = docs.where("coalesce(pointer, '') = ''").select("doc_name", F.col("doc_name").alias("effective"), F.array("doc_name").alias("chain"), F.lit(1.0).alias("confidence"), F.lit("open").alias("state"))
    for _ in range(max_hops):
        step = now.join(e, now["effective"] == e["src"], "left").join(names, F.col("target") == F.col("known"), "left")
        state = (
            F.when(F.col("state") != "open", F.col("state"))
            .when(F.col("src").isNull(), "settled")
            .when(F.col("repealed") | F.col("target").isNull() | F.array_contains("chain", F.col("target")) | F.col("known").isNull(), "unresolved")
            .otherwise("open")
        )
        step = step.withColumn("new", state)
        go = F.col("new") == "open"
        now = step.select(
            "doc_name", F.when(go, F.col("target")).otherwise(F.col("effective")).alias("effective"),
            F.when(go, F.concat("chain", F.array("target"))).otherwise(F.col("chain")).alias("chain"),
            F.when(go, F.col("confidence") * F.col("hop")).otherwise(F.col("confidence")).alias("confidence"), F.col("new").alias("state"),
        )
    walked = now.select("doc_name", "effective", "chain", "confidence", F.lit(False).alias("used_pointer"), (F.col("state") != "settled").alias("unresolved"))
    return by_pointer.unionByName(walked)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
