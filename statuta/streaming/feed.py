"""A feed of profile changes to versions of the history and their traits, with a state for each user.

The state of a user is the profile as of a settled time and the changes since. It begins with the user's first change, from
the profile in `base`, which stays as it is, so a batch touches only the users that it names. A change that comes late stands where its time says: the versions from there on are told again, and readers
take what was told last. A user's changes older than `lateness` before the newest one are settled: a change that
comes later still counts directly after what is settled, and keeps its own time.

Written are `history/batch=N` and, where the profiles have all fields, `traits/batch=N`; a batch that comes again is
written again alike, since the state is as old as the batch. history() and traits() read the last telling.

Defined cases: a null time comes before all others; changes of one time are taken in the order of what they send; a
change that alters nothing makes no version, as does one of a user that `base` doesn't name, or a value that its field can't take; a change late enough
to undo a version leaves the numbers without gaps; an empty feed has no history. One task holds what a user changed
within a batch and the lateness, which the parameters of the source and `lateness` bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from statuta.operators import profiles

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEFORE_ALL = -(1 << 62)
TOLD = "version int, at long, changed_fields array<string>, profile string, gone boolean"


def versions(version: int, profile: dict, changes: list[tuple[int, str]], fields: list[str]) -> tuple[list[tuple], list[tuple[int, dict]]]:
    """The versions that changes (time, what was sent as JSON) make of a profile: number, time, changed fields, profile; and number and profile after each change."""
    made, after = [], []
    for at, sent in changes:
        new = profile | json.loads(sent)
        if changed := [f for f in fields if new.get(f) != profile.get(f)]:
            version += 1
            made.append((version, at, changed, new))
        profile = new
        after.append((version, profile))
    return made, after


class Versions(StatefulProcessor):
    """Rows of TOLD for the versions of a user that are new or other than they were told."""

    def __init__(self, fields: list[str], lateness: int):
        self.fields, self.lateness = fields, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "version int, since long, profile string, recent string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new, start = [], None
        for some in rows:
            start = some["profile"].iloc[0]
            new += [(int(at), sent) for at, sent in zip(some["at"], some["sent"])]
        state = self.state.get() or (1, BEFORE_ALL, start, "[]")
        version, since, profile, old = state[0], state[1], json.loads(state[2]), [tuple(x) for x in json.loads(state[3])]
        place = lambda x: (max(x[0], since), x)
        every = sorted(old + new, key=place)
        before = {v[0]: v for v in versions(version, profile, sorted(old, key=place), self.fields)[0]}
        made, after = versions(version, profile, every, self.fields)
        told = [(*v[:3], json.dumps(v[3]), False) for v in made if before.get(v[0]) != v]
        told += [(n, None, None, None, True) for n in before if n > version + len(made)]
        until = max(at for at, _ in every) - self.lateness
        n = max((i for i, (at, _) in enumerate(every, 1) if at < until), default=0)
        if n:
            (version, profile), since = after[n - 1], max(since, every[n - 1][0])
        self.state.update((version, since, json.dumps(profile), json.dumps(every[n:])))
        if told:
            out = pd.DataFrame(told, columns=["version", "at", "changed_fields", "profile", "gone"]).astype({"at": "Int64"})
            out.insert(0, "user_id", [key[0]] * len(out))
            yield out

    def close(self) -> None:
        pass


def _sent(changes: DataFrame, types: dict[str, str]) -> DataFrame:
    """user_id, at in microseconds, and the fields that were sent as JSON, each as the text of a value of its type."""

    def entry(f: str, kind: str):
        given = F.try_element_at("changes", F.lit(f))
        value = given.try_cast(kind)
        return F.when(F.map_contains_key("changes", F.lit(f)) & (given.isNull() | value.isNotNull()), F.struct(F.lit(f).alias("key"), value.cast("string").alias("value")))

    sent = F.to_json(F.map_from_entries(F.array_compact(F.array(*(entry(f, t) for f, t in types.items())))))
    return changes.where("changes is not null").select("user_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(BEFORE_ALL)).alias("at"), sent.alias("sent"))


def _profile(types: dict[str, str]):
    return F.to_json(F.map_from_entries(F.array(*(F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in types))))


def profile_stream(changes: DataFrame, base: DataFrame, out: str, checkpoint: str, lateness: str = "30 days") -> StreamingQuery:
    """Start the feed on all that has arrived. changes: user_id, ts, changes (map of the fields that were sent, as strings); base: profiles at version 1, one a user."""
    spark = base.sparkSession
    types = {f: base.schema[f].dataType.simpleString() for f in profiles.FIELDS if f in base.columns}
    wait = spark.range(1).select((F.expr(f"cast(timestamp'1970-01-01 00:00:00Z' + interval {lateness} as double)") * 1_000_000).cast("long")).first()[0]
    start = base.select("user_id", _profile(types).alias("profile"))
    kind = StructType([base.schema["user_id"], *StructType.fromDDL(TOLD).fields])
    told = _sent(changes, types).join(start, "user_id").groupBy("user_id").transformWithStateInPandas(Versions(list(types), wait), kind, "append", "None")
    typed = [F.try_element_at("p", F.lit(f)).cast(t).alias(f) for f, t in types.items()]

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("p", F.from_json("profile", "map<string,string>"))
        ts = F.when(F.col("at") > BEFORE_ALL, F.timestamp_micros("at"))
        rows = rows.select("user_id", "version", ts.alias("ts"), "changed_fields", "gone", *typed)
        if not number:
            first = base.select("user_id", F.lit(1).alias("version"), F.lit(None).cast("timestamp").alias("ts"), F.array(*map(F.lit, types)).alias("changed_fields"), F.lit(False).alias("gone"), *types)
            rows = first.unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{out}/history/batch={number}")
        if len(types) == len(profiles.FIELDS):
            new = spark.read.parquet(f"{out}/history/batch={number}").where("not gone")
            each = profiles.trait_rows(new.withColumn("user_id", F.struct("user_id", "version")))
            each.select("user_id.*", "tag", "source_rule").write.mode("overwrite").parquet(f"{out}/traits/batch={number}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # a query takes the session's settings as they are at its start
    try:
        return told.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def _last(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(f"{out}/history")
    rest = [c for c in rows.columns if c not in ("user_id", "version")]
    return rows.groupBy("user_id", "version").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("user_id", "version", "r.*").where("not gone").drop("gone")


def history(spark: SparkSession, out: str) -> DataFrame:
    """user_id, version, ts, changed_fields and the fields, as told last."""
    return _last(spark, out).drop("batch")


def traits(spark: SparkSession, out: str) -> DataFrame:
    """user_id, version, tag, source_rule of each version, as told last."""
    return spark.read.parquet(f"{out}/traits").join(_last(spark, out).select("user_id", "version", "batch"), ["user_id", "version", "batch"], "left_semi").drop("batch")
