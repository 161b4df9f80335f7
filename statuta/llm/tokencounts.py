"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change is an insert, a delete or a revised count of one document under one tokenizer. It carries the count
and the group before and after, so it adds -before and +after to two groups at most, and a batch of changes is
one map-side sum and a shuffle of group totals: no look-up of the document's earlier state. Totals are sums of
the deltas of all committed batches, so the order of batches doesn't matter.

A store is a folder. A batch is written aside and then moved to `batches/<id>` in one step, which fails if that is
there: of two writers of one id the first wins, a batch that broke off leaves nothing that counts, and to send a
committed one again changes nothing. compact() adds committed batches up into a snapshot that names them, moved into
place alike; readers take the newest snapshot and the batches that it doesn't name. The folders of batches that the
snapshot before already named are dropped, and no others, whatever is committed meanwhile; so what a reader or writer has
to list are the batches since then. Whether an id was ever committed is asked of the names as a table; a writer asks once
more when its batch is in place, since the folder of an equal one may have been dropped while it was writing.

Defined cases: a null source, language or tokenizer is a group of its own; a null count is 0; a row of unknown
op is an error; repeated rows of a batch each count (each is a change); an empty batch commits and adds
nothing; a store without batches has no totals. Changes are built from columns that the caller names, so extra ones
don't matter.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import give_back
from statuta.llm.packing import tokenizer

GROUP = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: op: insert, delete or revise; the fields before are of use to delete and revise, those after to insert and revise.
CHANGE = "op string, before struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>, after struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"


def state(source: Column, lang: Column, tokenizer: Column, n_tokens: Column) -> Column:
    return F.struct(source.cast("string").alias("source"), lang.cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), n_tokens.cast("long").alias("n_tokens"))


def change(op: str, before: Column | None = None, after: Column | None = None) -> list[Column]:
    """The columns of a change feed."""
    kind = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"
    none = F.lit(None).cast(kind)
    return [F.lit(op).alias("op"), (none if before is None else before).alias("before"), (none if after is None else after).alias("after")]


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of a batch by group; groups in which nothing changed are left out."""
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    minus = F.when(F.col("known").isin("delete", "revise"), F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("s")))
    plus = F.when(F.col("known").isin("insert", "revise"), F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("s")))
    each = changes.withColumn("known", known).select(F.explode(F.array_compact(F.array(minus, plus))).alias("d"))
    each = each.select(*(F.col(f"d.s.{g}").alias(g) for g in GROUP), F.col("d.sign").alias("n_docs"), (F.col("d.sign") * F.coalesce(F.col("d.s.n_tokens"), F.lit(0))).alias("n_tokens"))
    return _added(each).where("n_docs <> 0 or n_tokens <> 0")


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenTotals:
    """The totals in a folder, by whatever file system Spark reads it with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at().getFileSystem(self.conf)

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _publish(self, aside: str, *names: str) -> bool:
        """Move a written folder to its place; False, and the folder is gone, if that is taken."""
        to = self._at(*names)
        self.fs.mkdirs(to.getParent())
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._at(aside), to, none)
        except Py4JJavaError:
            if not self.fs.exists(to):
                raise
            self.fs.delete(self._at(aside), True)
            return False
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it had been committed before and nothing was done."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch_id):
            raise ValueError("a batch id is letters, digits and hyphens")
        if self.committed(batch_id):
            return False
        aside = f"aside/{batch_id}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{aside}")
        if not self._publish(aside, "batches", batch_id):
            return False
        found = self._names("snapshots")
        if len(found) > 1 and self._held([batch_id], f"{self.path}/snapshots/{found[-2]}"):  # named before the last compaction: its own folder is gone, this one is a second
            self.fs.delete(self._at("batches", batch_id), True)
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        return self.fs.exists(self._at("batches", batch_id)) or batch_id in self._held([batch_id], self._snapshot())

    def _snapshot(self) -> str | None:
        """The newest snapshot."""
        found = self._names("snapshots")
        return f"{self.path}/snapshots/{found[-1]}" if found else None

    def _held(self, ids: list[str], snapshot: str | None) -> set[str]:
        """Those of a few ids that a snapshot names."""
        if not snapshot or not ids:
            return set()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{snapshot}/of").where(F.col("batch").isin(ids)).collect()}

    def _split(self, snapshot: str | None) -> tuple[list[str], list[str]]:
        """Of the folders of batches, those that a snapshot doesn't name, and those that it does."""
        listed = self._names("batches")
        held = self._held(listed, snapshot)
        return [b for b in listed if b not in held], [b for b in listed if b in held]

    def _rows(self, path: str | None, new: list[str]) -> DataFrame:
        rows = [self.spark.read.schema(TOTALS).parquet(f"{path}/totals")] if path else []
        if new:
            rows.append(self.spark.read.schema(TOTALS).parquet(*(f"{self.path}/batches/{b}" for b in new)))
        if not rows:
            return self.spark.createDataFrame([], TOTALS)
        every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        return _added(every).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        snapshot = self._snapshot()
        return self._rows(snapshot, self._split(snapshot)[0])

    def compact(self) -> bool:
        """A new snapshot of all committed batches; False if another writer made one meanwhile."""
        before = self._snapshot()
        new, held = self._split(before)
        number = int(before.rsplit("/", 1)[1]) + 1 if before else 0
        aside = f"aside/snapshot-{uuid.uuid4().hex}"
        self._rows(before, new).write.parquet(f"{self.path}/{aside}/totals")
        names = self.spark.createDataFrame([(b,) for b in new], "batch string").coalesce(1)
        if before:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{before}/of"))
        names.write.parquet(f"{self.path}/{aside}/of")
        if not self._publish(aside, "snapshots", f"{number:08d}"):
            return False
        for b in held:
            self.fs.delete(self._at("batches", b), True)
        for old in self._names("snapshots")[:-2]:
            self.fs.delete(self._at("snapshots", old), True)
        return True


def word_count(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed, return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def bpe_count(text: Column, path: str) -> Column:
    """Ids of a text by the tokenizer of that vocabulary file; 0 for a null text."""

    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.int64)
        for i in range(0, len(texts), 512):
            some = [x or "" for x in texts.iloc[i : i + 512]]
            out[i : i + len(some)] = [len(x) for x in tokenizer(path).encode(some)]
        give_back()
        return pd.Series(out)

    return F.pandas_udf(run, "long")(text)
