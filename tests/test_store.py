"""The chunk store: two writers, small writes, compaction, moves between categories, old versions, lookups."""

import os

import pytest
from pyspark.sql import functions as F

from statuta.common import fresh_path
from statuta.sources.store import COLUMNS, ChunkStore


def chunk(spark, rows):
    """Rows (chunk_id, document_id, category, text)."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    data = [tuple({"chunk_id": c, "document_id": d, "category": k, "text": t, "content_hash": f"h{t}", "part_index": 0, "part_count": 1}.get(n) for n in names) for c, d, k, t in rows]
    return spark.createDataFrame(data, COLUMNS)


def held(store, version=None):
    return sorted((r.chunk_id, r.category, r.text) for r in store.chunks(version).collect())


@pytest.fixture
def store(spark):
    return ChunkStore(spark, fresh_path(spark, "store"))


def size(path):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path.removeprefix("file:")) for x in names if x.endswith(".parquet"))


def between(monkeypatch, store, other):
    """other() happens just before the store's next version is published."""
    publish = ChunkStore._publish

    def late(self, version, manifest):
        monkeypatch.setattr(ChunkStore, "_publish", publish)
        other()
        return publish(self, version, manifest)

    monkeypatch.setattr(ChunkStore, "_publish", late)


def test_two_writers_keep_both(spark, store, monkeypatch):
    store.upsert(chunk(spark, [("a", "A", "tax", "1"), ("b", "B", "tax", "1")]))
    second = ChunkStore(spark, store.path)
    between(monkeypatch, store, lambda: second.upsert(chunk(spark, [("c", "C", "tax", "1"), ("a", "A", "tax", "2")])))
    assert store.upsert(chunk(spark, [("d", "D", "tax", "1"), ("a", "A", "tax", "2")])) == {"written": 1, "skipped": 1, "total": 2}  # a is no longer new to it
    assert held(store) == [("a", "tax", "2"), ("b", "tax", "1"), ("c", "tax", "1"), ("d", "tax", "1")]
    between(monkeypatch, store, lambda: second.upsert(chunk(spark, [("b2", "B", "tax", "1")])))
    store.delete_documents(spark.createDataFrame([("B",)], "document_id string"))  # what came in between goes, too
    assert [r[0] for r in held(store)] == ["a", "c", "d"]
    between(monkeypatch, store, lambda: second.upsert(chunk(spark, [("a", "A", "tax", "3")])))
    store.compact()
    assert held(store) == [("a", "tax", "3"), ("c", "tax", "1"), ("d", "tax", "1")]
    between(monkeypatch, store, store.compact)
    assert store.upsert(chunk(spark, [("a", "A", "tax", "4")]))["written"] == 1 and ("a", "tax", "4") in held(store)
    folders = set(os.listdir(f"{store.path.removeprefix('file:')}/data"))
    named = {m["folder"] for v in store.versions() for m in store._manifest(v) if m["kind"] == "data"}
    assert folders == named  # what the slower writer wrote for nothing is gone


def test_a_small_write_writes_little(spark, store):
    rows = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("string").alias("document_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    full = rows.select(*(F.col(n) if n in rows.columns else (F.lit("tax") if n == "category" else F.md5("text") if n == "content_hash" else F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in COLUMNS.split(", "))))
    assert store.upsert(full) == {"written": 20_000, "skipped": 0, "total": 20_000}
    before = size(store.path)
    part = full.withColumn("content_hash", F.when(F.col("document_id").cast("int") % 100 == 0, "new").otherwise(F.col("content_hash")))
    assert store.upsert(part) == {"written": 200, "skipped": 19_800, "total": 20_000}
    assert size(store.path) - before < before / 20 and store.count() == 20_000
    assert store.upsert(part) == {"written": 0, "skipped": 20_000, "total": 20_000} and len(store.versions()) == 2
    assert store.chunks().where("content_hash = 'new'").count() == 200


def test_moves_removals_and_compaction(spark, store):
    store.upsert(chunk(spark, [("a", "A", "tax", "1"), ("b", "B", None, "1"), ("c", "C", "x/y=z", "1"), ("d", "D", "tax", "1"), ("d", "D", "tax", "1")]))
    store.upsert(chunk(spark, [("a", "A", "labor", "2"), ("b", "B", "tax", "2")]))
    want = [("a", "labor", "2"), ("b", "tax", "2"), ("c", "x/y=z", "1"), ("d", "tax", "1")]
    assert held(store) == want
    for some in (["labor"], ["x/y=z", "none such"], ["tax"], None):
        store.compact(some)
        assert held(store) == want
    store.upsert(chunk(spark, [("a", "A", "tax", "3")]))
    store.upsert(chunk(spark, [("a", "A", "labor", "4")]))
    store.compact(["tax"])
    assert held(store)[0] == ("a", "labor", "4") and len(held(store)) == 4
    store.delete_documents(spark.createDataFrame([("D",), ("none",)], "document_id string"))
    store.upsert(chunk(spark, [("d", "D", "tax", "5")]))
    store.compact()
    assert [r for r in held(store) if r[0] == "d"] == [("d", "tax", "5")]
    n = len(store.versions())
    store.delete_documents(spark.createDataFrame([("none",)], "document_id string"))
    assert len(store.versions()) == n and held(store, 1)[0] == ("a", "tax", "1")
    store.vacuum(1)
    assert store.versions() == [n] and len(held(store)) == 4 and len(os.listdir(f"{store.path.removeprefix('file:')}/data")) == 1


def test_new_columns_gone_chunks_and_due_compaction(spark):
    store = ChunkStore(spark, fresh_path(spark, "store"), sync_deletes=True, compact_after=3)
    store.upsert(chunk(spark, [("a1", "A", "tax", "1"), ("a2", "A", "tax", "1"), ("b", "B", "tax", "1")]))
    wide = ChunkStore(spark, store.path, embed=lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0))), sync_deletes=True, compact_after=3)
    wide.upsert(chunk(spark, [("a1", "A", "tax", "2")]))
    assert [(r.chunk_id, r.embedding) for r in wide.chunks().orderBy("chunk_id").collect()] == [("a1", [1.0]), ("b", None)]
    for k in range(4):
        wide.upsert(chunk(spark, [("b", "B", "tax", f"{k}")]))
    assert len({m["folder"] for m in wide._manifest(wide.versions()[-1]) if m["kind"] == "data"}) < 4 and held(wide) == [("a1", "tax", "2"), ("b", "tax", "3")]
    meta = ChunkStore(spark, store.path, hash_metadata=True)
    assert meta.upsert(wide.chunks().withColumn("law_name", F.lit("L"))) == {"written": 2, "skipped": 0, "total": 2}
    none = ChunkStore(spark, fresh_path(spark, "store"))
    assert none.count() == 0 and none.upsert(chunk(spark, [])) == {"written": 0, "skipped": 0, "total": 0} and none.versions() == []


def scanned(df):
    """Rows that the scans of a plan gave."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        for name in ("executedPlan", "plan"):
            if hasattr(p, name) and p.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
                return walk(getattr(p, name)())
        if p.nodeName().startswith("Scan parquet"):
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(out)


def test_a_lookup_skips_row_groups(spark):
    store = ChunkStore(spark, fresh_path(spark, "store"), row_group_bytes=64 << 10)
    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("chunk_id"), F.lit("D").alias("document_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    full = rows.select(*(F.col(n) if n in rows.columns else (F.lit("tax") if n == "category" else F.md5("text") if n == "content_hash" else F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in COLUMNS.split(", "))))
    store.upsert(full)
    wanted = rows.where("id in (5, 7000)").select("chunk_id")
    assert store.get(wanted).count() == 2 and scanned(store.get(wanted)) < 20_000 / 2
    assert store.get(wanted.where("false")).count() == 0 and store.get(rows.select("chunk_id").limit(1500)).count() == 1500


def test_no_text_moves_to_find_out_whether_a_model_is_asked(spark, monkeypatch):
    from statuta.sources import store as S

    asked, compared = [], []
    own = ChunkStore(spark, fresh_path(spark, "store"), embed=lambda rows: asked.append(1) or rows.withColumn("embedding", F.array(F.lit(1.0))))
    rows = chunk(spark, [("a", "d", "tax", "x"), ("b", "d", "tax", "y"), ("b", "d", "tax", "z")])
    own.upsert(rows)
    plain = S.diff
    monkeypatch.setattr(S, "diff", lambda incoming, *rest, **more: compared.append(incoming.columns) or plain(incoming, *rest, **more))
    assert own.upsert(rows)["written"] == 0 and asked == [1]
    assert ["chunk_id", "content_hash"] in compared
    assert own.upsert(rows.where("text <> 'y'"))["written"] == 1 and asked == [1, 1] and held(own) == [("a", "tax", "x"), ("b", "tax", "z")]


def test_an_upsert_moves_only_the_text_that_it_writes(spark, store):
    """Rows of 20 kB of text that doesn't compress: a first write moves each once, one that finds nothing to do moves none."""
    from pyspark.sql import types as T

    long = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(300)), lambda k: F.sha2(F.concat("chunk_id", k.cast("string")), 256)), "")
    rows = chunk(spark, [(f"c{k}", f"D{k % 9}", "tax", "") for k in range(200)]).withColumn("text", long).withColumn("content_hash", F.md5("text"))
    rows.write.parquet(path := fresh_path(spark, "long"))
    rows = spark.read.schema(T.StructType(rows.schema)).parquet(path)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def moved(work):
        before = shuffled()
        return work(), shuffled() - before

    told, first = moved(lambda: store.upsert(rows))
    assert told == {"written": 200, "skipped": 0, "total": 200} and first < 1.5 * 200 * 19264
    told, again = moved(lambda: store.upsert(rows))
    assert told == {"written": 0, "skipped": 200, "total": 200} and again < 200_000 and store.versions() == [1]
    both = rows.unionByName(rows.withColumn("text", F.lit("other")).withColumn("content_hash", F.lit("0")).limit(3))  # ids that come twice
    assert store.upsert(both) == {"written": 3, "skipped": 197, "total": 200} and store.chunks().where("text = 'other'").count() == 3
