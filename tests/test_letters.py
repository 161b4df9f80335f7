"""Dead letters: each failed row is one, is tried so often and no more, and is done when it succeeds."""

import tempfile

from statuta.sources import corpus
from statuta.sources.store import ChunkStore
from statuta.streaming import ingest


def row(name, text, kind="luat", title="Luật thuế"):
    return (name, title, kind, "Luật", "trung_uong", "Quốc hội", None, None, None, text, None, None, None, None, None)


def test_letters_are_rows_with_attempts(spark):
    root = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    store, letters = ChunkStore(spark, root + "/store"), root + "/letters"
    rows = [row("a", "Điều 1. x"), row("a", None), row("", "Điều 1. y"), row(None, "Điều 1. z"), row("b", " "), row("b", " "), row("c", "Điều 1. q", title=""), row("d", "Điều 1. q", kind=None)]
    spark.createDataFrame(rows, corpus.CORPUS).write.parquet(root + "/in")
    ingest.ingest_stream(spark, root + "/in", root + "/checkpoint", store, letters).awaitTermination()
    told = ingest.open_letters(spark, letters).collect()
    assert sorted((r.reason, r.doc_name or "") for r in told) == [("body", "a"), ("body", "b"), ("name", ""), ("name", ""), ("title", "c")] and store.count() == 2
    key = next(r.key for r in told if r.doc_name is None)
    by_key = spark.createDataFrame([row("named", "Điều 1. z")], corpus.CORPUS).selectExpr("*", f"'{key}' AS key")
    assert ingest.retry(spark, letters, store, by_key, "one").count() == 4 and store.count() == 3
    by_name = spark.createDataFrame([row("b", None), row("b", "Điều 1. b"), row("a", None)], corpus.CORPUS)
    left = ingest.retry(spark, letters, store, by_name, "two", attempts=3)
    assert sorted((r.doc_name or "", r.attempt) for r in left.collect()) == [("", 3), ("a", 3), ("c", 3)] and store.count() == 4
    again = ingest.retry(spark, letters, store, spark.createDataFrame([row("a", "Điều 1. too late")], corpus.CORPUS), "three", attempts=3)
    assert {(r.doc_name or "", r.attempt) for r in again.collect()} == {("", 3), ("a", 3), ("c", 3)} and store.count() == 4
    versions = store.versions()
    ingest.ingest_stream(spark, root + "/in", root + "/checkpoint", store, letters).awaitTermination()
    assert store.versions() == versions
