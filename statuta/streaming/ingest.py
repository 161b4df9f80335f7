"""Incremental ingest: files that arrive, applied once; what fails is put aside and taken up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statuta.common import scratch, stash
from statuta.sources import corpus
from statuta.sources.store import ChunkStore


def ingest(docs: DataFrame, store: ChunkStore) -> tuple[dict[str, int], DataFrame]:
    """Documents to the chunk table: the counts of chunks written, skipped and in all, and the documents that the taxonomy refuses."""
    good, refused = corpus.validated(docs)
    with scratch(docs.sparkSession):
        return store.upsert(stash(corpus.chunks_of(good), "chunks")), refused


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, store: ChunkStore, letters: str | None = None) -> StreamingQuery:
    """Corpus files not yet read, in one run that resumes where the last ended. A batch that comes again writes nothing, as its chunks are unchanged.

    Rows that give no document become dead letters with the reason, so a skip isn't taken for a failure; retry() takes them up again.
    """
    rows = spark.readStream.schema(corpus.CORPUS).parquet(path)

    def apply(batch: DataFrame, number: int) -> None:
        _apply(batch.withColumns({"key": _key(batch.columns), "attempt": F.lit(1)}), store, f"{letters}/run=batch-{number}" if letters else None)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Dead letters. `run=<id>/` holds what one run says of rows that failed, then or before: the row, its key, the attempt, and the reason, null where
# it has succeeded. A folder is written whole, or again alike; no other is touched, so what is open is what was said last of each key.


def _key(fields: list[str]) -> Column:
    """A row's name for good, by what it holds: rows without a doc_name, or of one doc_name, are told apart; equal rows are one."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def _apply(rows: DataFrame, store: ChunkStore, to: str | None) -> None:
    """Corpus rows with key and attempt to the chunk table, and what is to be said of them to the letters."""
    with scratch(store.spark):  # an upsert reads its rows more than once
        store.upsert(stash(corpus.chunks_of(corpus.documents_of_corpus(rows)), "chunks"))
    if to:
        told = rows.withColumn("reason", corpus.refusal()).where("reason is not null or attempt > 1")  # what never failed needs no letter
        told.withColumn("markdown", F.when(F.col("reason").isNotNull(), F.col("markdown"))).write.mode("overwrite").parquet(to)


def _open(said: DataFrame) -> DataFrame:
    rest = [c for c in said.columns if c not in ("key", "run")]
    order = F.struct("attempt", F.col("reason").isNull(), F.xxhash64(*rest))  # of rows that mend one letter, one that succeeds is enough
    return said.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("key", "r.*").where("reason is not null")


def open_letters(spark: SparkSession, letters: str) -> DataFrame:
    """What failed and has not succeeded since: corpus rows with key, attempt (how often each was tried) and reason."""
    return _open(spark.read.parquet(letters))


def retry(spark: SparkSession, letters: str, store: ChunkStore, mended: DataFrame, run: str, attempts: int = 5) -> DataFrame:
    """Try again what is open and was tried fewer than `attempts` times; gives what is open then.

    mended: corpus rows that stand for the letters of their `key`, if they have that column, or else of their doc_name; other letters are tried
    as they are. run names this try: under its name it may be started anew after a crash, and says the same again.
    """
    due = _open(spark.read.parquet(letters).where(F.col("run") != run)).where(F.col("attempt") < attempts).drop("reason")
    due = due.withColumn("attempt", F.col("attempt") + 1)
    by = "key" if "key" in mended.columns else "doc_name"
    new = mended.join(due.select("attempt", *{"key", by}), by)
    rows = due.join(new.select("key").distinct(), "key", "left_anti").unionByName(new.select(*due.columns))
    _apply(rows, store, f"{letters}/run={run}")
    return open_letters(spark, letters)
