"""The chunk table: merge on read. Writes add small files, a manifest says which files make a version, and readers see whole versions only.

A store is a folder. `data/at=<version>-<id>/category=<c>/` holds the rows that one write found new or changed, with the category of the
row that each replaces; `removed/at=.../category=<c>/` holds the ids that one write took away, and the version until which that
holds. A row counts unless a later write replaced or removed it. So an upsert reads the hashes of what is stored and writes only what differs, and a removal writes ids.
`compact()` writes the rows that count of some categories to new files, which then stand for all older ones of these categories.

`manifests/<version>` names the folders of a version. It is written aside and moved into place in one step, which
fails if that version is there already. A writer that loses does its work anew on what the winner has published, so of two
writers neither undoes the other. Older manifests stay until vacuum(), which deletes those files that only they name.

Rows are sorted by chunk_id within files, which carry Bloom filters of it, so a lookup of few ids skips most row groups.

Defined cases: of rows with one chunk_id in an upsert one counts, the one of smallest hash; a null category is a category; a write that
finds nothing to do makes no version; an empty store has no rows; new columns are null in older rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from statuta.common import scratch, small, stash

COLUMNS = (
    "chunk_id string, document_id string, document_title string, law_name string, category string, entity_type string, province_scope string, effective_from string, effective_to string, "
    "chapter_number string, chapter_title string, article_number string, article_title string, part_index int, part_count int, source_url string, content_hash string, text string"
)
FEW = 1000  # ids that a lookup gives to the scan
MANIFEST = "kind string, folder string, value string"


def diff(incoming: DataFrame, stored: DataFrame, by: list[str] = ("content_hash",), keep: tuple[str, ...] = ()) -> DataFrame:
    """incoming with `change`: new, changed or unchanged, by the hash of the text (and whatever else `by` names). keep: columns of stored to take along, as old_<name>."""
    old = stored.select("chunk_id", F.struct(*by).alias("_old"), *(F.col(c).alias(f"old_{c}") for c in keep))
    rows = incoming.join(old, "chunk_id", "left")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.struct(*by), "unchanged").otherwise("changed")
    return rows.withColumn("change", change).drop("_old")


def counted() -> list:
    """written, skipped and total of the rows of a diff."""
    return [F.count_if(F.col("change") != "unchanged").alias("written"), F.count_if(F.col("change") == "unchanged").alias("skipped"), F.count("*").alias("total")]


def counters(changes: DataFrame) -> DataFrame:
    """written, skipped and total of a diff."""
    return changes.agg(*counted())


def _once(incoming: DataFrame) -> DataFrame:
    """Of rows with one chunk_id the one of smallest hash."""
    first = F.min_by(F.struct(*incoming.columns), F.struct("content_hash", F.xxhash64(*incoming.columns)))
    return incoming.groupBy("chunk_id").agg(first.alias("r")).select("r.*")


def _until(rows: DataFrame, folder: str) -> DataFrame:
    """Ids to be removed, as of the write with that folder."""
    return rows.select("chunk_id", F.lit(folder[3:11]).alias("until"), "category")


class Lost(Exception):
    """Another writer has published the version."""


class ChunkStore:
    """A store in a folder. sync_deletes: chunks that a document no longer has go, too; hash_metadata: a change of what is told of a text counts as a change;
    compact_after: how many writes readers may have to merge."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame] | None = None, sync_deletes: bool = False, hash_metadata: bool = False, compact_after: int = 32, row_group_bytes: int = 16 << 20):
        self.spark, self.path, self.embed, self.sync_deletes, self.compact_after, self.row_group_bytes = spark, path.rstrip("/"), embed, sync_deletes, compact_after, row_group_bytes
        self.by = ["content_hash", "law_name", "entity_type", "province_scope", "effective_from", "effective_to"] if hash_metadata else ["content_hash"]
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at().getFileSystem(self.conf)

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("manifests")]

    def _manifest(self, version: int | None) -> list[dict]:
        """Rows kind, folder, value of a version: the folders of `data` and `removed` with the name of a category's folder, and the schema."""
        return [] if version is None else [r.asDict() for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{version:08d}").collect()]

    def _publish(self, version: int, manifest: list[dict]) -> None:
        aside, to = self._at("aside", uuid.uuid4().hex), self._at("manifests", f"{version:08d}")
        self.fs.mkdirs(aside.getParent())
        self.fs.mkdirs(to.getParent())
        out = self.fs.create(aside, False)
        out.write(bytearray("\n".join(map(json.dumps, manifest)).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        try:
            files.rename(aside, to, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            self.fs.delete(aside, True)
            if not self.fs.exists(to):
                raise
            raise Lost from None

    def _commit(self, work: Callable[[int | None, list[dict], str], tuple[list[dict] | None, object]], tries: int = 20) -> object:
        """work(version, manifest, folder) writes to folders of that name and gives the manifest after it, or None where there is nothing to do, and a result."""
        for _ in range(tries):
            version = (self.versions() or [None])[-1]
            following = (version or 0) + 1
            folder = f"at={following:08d}-{uuid.uuid4().hex}"
            manifest, result = work(version, self._manifest(version), folder)
            if manifest is None:
                return result
            try:
                self._publish(following, manifest)
                return result
            except Lost:
                self._drop(folder)
        raise RuntimeError(f"other writers were faster {tries} times")

    def _write(self, rows: DataFrame, kind: str, folder: str) -> list[dict]:
        """What a manifest says of the rows, written by category."""
        to = f"{self.path}/{kind}/{folder}"
        sorted_ = rows.hint("rebalance", "category").sortWithinPartitions("category", "chunk_id")
        options = {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(self.row_group_bytes)}
        sorted_.write.options(**options).partitionBy("category").parquet(to)
        return [{"kind": kind, "folder": folder, "value": c} for c in self._names(kind, folder) if c.startswith("category=")]

    def _read(self, manifest: list[dict], kind: str, schema: StructType) -> DataFrame | None:
        paths = [f"{self.path}/{kind}/{m['folder']}/{m['value']}" for m in manifest if m["kind"] == kind]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else None

    def _schema(self, manifest: list[dict]) -> StructType:
        told = [m["value"] for m in manifest if m["kind"] == "schema"]
        return StructType.fromJson(json.loads(told[0])) if told else StructType.fromDDL(COLUMNS)

    def _live(self, manifest: list[dict]) -> DataFrame:
        """The rows that count, with `at`, the write that they come from, and `replaces`."""
        own = StructType().add("at", StringType())
        schema = StructType([*self._schema(manifest).fields, *own.fields, *StructType().add("replaces", StringType()).fields])
        data = self._read(manifest, "data", schema)
        if data is None:
            return self.spark.createDataFrame([], schema)
        writes = {m["folder"] for m in manifest if m["kind"] in ("data", "removed")}
        if len(writes) == 1:
            return data
        number = F.substring("at", 1, 8)
        later = data.where("replaces is not null").select("chunk_id", F.nullif("replaces", F.lit("\0")).alias("category"), number.alias("until"))
        removed = self._read(manifest, "removed", StructType.fromDDL("chunk_id string, until string, category string, at string"))
        if removed is not None:
            later = later.unionByName(removed.select("chunk_id", "category", "until"))
        later = small(later.groupBy("chunk_id", "category").agg(F.max("until").alias("until")).select(F.col("chunk_id").alias("_id"), F.col("category").alias("_category"), "until"))
        rows = data.join(later, (F.col("chunk_id") == F.col("_id")) & F.col("category").eqNullSafe(F.col("_category")), "left")
        return rows.where(F.col("until").isNull() | (F.col("until") <= number)).drop("_id", "_category", "until")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The table, as it is or as it was at a version that vacuum() has left."""
        manifest = self._manifest(version if version is not None else (self.versions() or [None])[-1])
        return self._live(manifest).select(*self._schema(manifest).names)

    def upsert(self, incoming: DataFrame) -> dict[str, int]:
        """Write what is new or changed; only that is moved and embedded. incoming is read again and again, for its ids and hashes and for the rows to write, so dear ones are stashed before."""

        def work(version: int | None, manifest: list[dict], folder: str) -> tuple[list[dict] | None, dict[str, int]]:
            with scratch(self.spark):  # what tells the rows to write goes once they are written
                return told_of(self._live(manifest), manifest, folder)

        def told_of(live: DataFrame, manifest: list[dict], folder: str) -> tuple[list[dict] | None, dict[str, int]]:
            rows, plan = incoming, self._plan(incoming, live)
            counts = plan.agg(*counted(), F.count_if(F.col("change") == "new").alias("new")).first().asDict()
            new = counts.pop("new")
            if counts["total"] < incoming.select("chunk_id").count():  # some ids come twice: which row counts is found out once, with the whole rows
                rows = stash(_once(incoming), "once")
                plan = self._plan(rows, live)
                counts = counters(plan).first().asDict()
            if new == counts["total"]:  # no id is known: all rows are written, and none is looked for
                written = rows.withColumn("replaces", F.lit(None).cast("string"))
            else:
                due = plan.where("change <> 'unchanged'").select(F.col("chunk_id").alias("_id"), F.when(F.col("change") == "changed", F.coalesce("old_category", F.lit("\0"))).alias("replaces"))
                written = rows.join(small(due), F.col("chunk_id").eqNullSafe(F.col("_id"))).drop("_id")
            if self.embed and counts["written"]:  # else no model is asked for
                written = self.embed(written)
            entries = self._write(written, "data", folder) if counts["written"] else []
            if self.sync_deletes:
                gone = live.join(incoming.select("document_id").distinct(), "document_id", "left_semi").join(incoming.select("chunk_id"), "chunk_id", "left_anti")
                entries += self._write(_until(gone, folder), "removed", folder)
            if not entries:
                self._drop(folder)
                return None, counts
            known = self._schema(manifest)
            schema = StructType([*known.fields, *(f for f in written.schema.fields if f.name not in {*known.names, "replaces"})])
            for f in schema.fields:
                f.nullable = True
            kept = [m for m in manifest if m["kind"] != "schema"]
            return [{"kind": "schema", "folder": None, "value": json.dumps(schema.jsonValue())}, *kept, *entries], counts

        told = self._commit(work)
        self._compact_when_due()
        return told

    def _plan(self, incoming: DataFrame, live: DataFrame) -> DataFrame:
        """chunk_id, change and old_category: found out by ids and hashes alone, so no text is moved for it."""
        keys = incoming.groupBy("chunk_id").agg(F.min(F.struct(*self.by)).alias("r")).select("chunk_id", "r.*")
        return stash(diff(keys, live, self.by, keep=("category",)).select("chunk_id", "change", "old_category"), "upsert")

    def _drop(self, folder: str) -> None:
        for kind in ("data", "removed"):
            self.fs.delete(self._at(kind, folder), True)

    def delete_documents(self, ids: DataFrame) -> None:
        """Without the chunks of the documents named in the column document_id."""

        def work(version: int | None, manifest: list[dict], folder: str) -> tuple[list[dict] | None, None]:
            gone = self._live(manifest).join(ids.select("document_id").distinct(), "document_id", "left_semi")
            entries = self._write(_until(gone, folder), "removed", folder)
            if not entries:
                self._drop(folder)
            return ([*manifest, *entries] if entries else None), None

        self._commit(work)
        self._compact_when_due()

    def _compact_when_due(self) -> None:
        manifest = self._manifest((self.versions() or [None])[-1])
        many: dict[str, int] = {}
        for m in manifest:
            if m["kind"] != "schema":
                many[m["value"]] = many.get(m["value"], 0) + 1
        if due := [c for c, n in many.items() if n > self.compact_after]:
            self._compact(due)

    def compact(self, categories: list[str] | None = None) -> None:
        """One folder for the rows of each of these categories, or of all; the same rows as before."""
        escape = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        self._compact(None if categories is None else [f"category={escape(c)}" for c in categories])

    def _compact(self, folders: list[str] | None) -> None:
        def work(version: int | None, manifest: list[dict], folder: str) -> tuple[list[dict] | None, None]:
            due = lambda m: m["kind"] != "schema" and (folders is None or m["value"] in folders)
            if not any(map(due, manifest)):
                return None, None
            live = self._live(manifest)
            told = self._read([m for m in manifest if due(m)], "data", StructType.fromDDL("chunk_id string, replaces string, category string, at string"))
            if told is None:
                return [m for m in manifest if not due(m)], None
            of = F.broadcast(told.select(F.coalesce("category", F.lit("\0")).alias("_own")).distinct())  # of partition values: few
            rows = live.join(of, F.coalesce("category", F.lit("\0")) == F.col("_own"), "left_semi")
            entries = self._write(rows.withColumn("replaces", F.lit(None).cast("string")).drop("at"), "data", folder)
            # what these rows, that count or not, replaced in other categories stays replaced
            others = told.where("replaces is not null").join(of, F.col("replaces") == F.col("_own"), "left_anti")
            others = others.select("chunk_id", F.substring("at", 1, 8).alias("until"), F.nullif("replaces", F.lit("\0")).alias("category"))
            entries += self._write(others, "removed", folder)
            return [*(m for m in manifest if not due(m)), *entries], None

        self._commit(work)

    def vacuum(self, keep: int = 2) -> None:
        """Without the versions before the last `keep`, and the files that only they name. Not for versions that someone still reads."""
        versions = self.versions()
        of = {v: {(m["kind"], m["folder"]) for m in self._manifest(v) if m["kind"] != "schema"} for v in versions}
        kept = set().union(*(of[v] for v in versions[-keep:])) if versions else set()
        for v in versions[:-keep]:
            for kind, folder in of[v] - kept:
                self.fs.delete(self._at(kind, folder), True)
            self.fs.delete(self._at("manifests", f"{v:08d}"), True)

    def get(self, ids: DataFrame) -> DataFrame:
        """The chunks of these ids (chunk_id). Few ids go to the scan, which skips what min, max and Bloom filters of a row group rule out."""
        few = [r["chunk_id"] for r in ids.select("chunk_id").distinct().limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return self.chunks().where(F.col("chunk_id").isin(few) if few else F.lit(False))
        return self.chunks().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def by_category(self, category: str) -> DataFrame:
        return self.chunks().where(F.col("category") == category)

    def count(self) -> int:
        return self.chunks().count()
