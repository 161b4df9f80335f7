"""The profile feed against a plain loop, with changes that come late, and from one run to the next."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from statuta.operators import profiles
from statuta.streaming import feed

CHANGES = "user_id string, ts timestamp, changes map<string,string>"


def fed(spark, base, parts, lateness):
    root = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    for rows in parts:
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(root + "/in")
        feed.profile_stream(spark.readStream.schema(CHANGES).parquet(root + "/in"), base, root + "/out", root + "/checkpoint", lateness).awaitTermination()
    return root + "/out"


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def test_late_changes_stand_where_their_time_says(spark):
    rng = random.Random(5)
    base = spark.createDataFrame([(f"u{k}", 20 + k, "driver") for k in range(12)], "user_id string, age int, occupation_type string")
    every = []
    for k in rng.sample(range(300), 120):
        sent = {"age": str(rng.randrange(20, 24))} if rng.random() < 0.6 else {"occupation_type": rng.choice(["driver", "cook", None])}
        every.append((f"u{rng.randrange(15)}", day(k), sent))
    parts = [every[:50], every[50:90], every[90:]]
    out = fed(spark, base, parts, "400 days")
    got = feed.history(spark, out).select("user_id", "version", "ts", F.array_sort("changed_fields").alias("c"), "age", "occupation_type").collect()
    want = []
    for k in range(12):
        now, version = {"age": 20 + k, "occupation_type": "driver"}, 1
        want.append((f"u{k}", 1, None, ["age", "occupation_type"], *now.values()))
        for _, ts, sent in sorted((e for e in every if e[0] == f"u{k}"), key=lambda e: e[1]):
            new = now | {f: int(v) if f == "age" else v for f, v in sent.items()}
            if changed := sorted(f for f in new if new[f] != now[f]):
                version += 1
                want.append((f"u{k}", version, ts, changed, *new.values()))
            now = new
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    told = spark.read.parquet(out + "/history")
    assert not [x for x in told.where("batch = 1").select("user_id").distinct().collect() if x[0] not in {e[0] for e in parts[1]}]


def test_settled_changes_stay_and_odd_rows_do_no_harm(spark):
    rest = [F.lit(None).cast("boolean" if f.startswith(("has", "owns")) else "int" if f == "dependents" else "string").alias(f) for f in profiles.FIELDS if f != "age"]
    base = spark.createDataFrame([("a", 1), ("b", 1), ("d", 1)], "user_id string, age int").select("*", *rest)
    parts = [
        [("a", day(1), {"age": "2"}), ("a", day(50), {"age": "3"}), ("b", None, {"dependents": "2"}), ("b", day(3), {"age": "many"}), ("b", day(4), {}), ("b", day(5), None), ("c", day(1), {"age": "9"}), ("d", day(3), {"age": "2"}), ("d", day(4), {"province": "P"})],
        [("a", day(0), {"age": "7"}), ("a", day(49), {"has_business": "true"}), ("d", day(2), {"age": "2", "province": "P"})],
    ]
    out = fed(spark, base, parts, "10 days")
    rows = [(r.user_id, r.version, r.ts, r.age, r.dependents, r.has_business) for r in feed.history(spark, out).orderBy("user_id", "version").collect()]
    a = [(1, None, 1, None), (2, day(1), 2, None), (3, day(0), 7, None), (4, day(49), 7, True), (5, day(50), 3, True)]  # day 0 is settled by then, day 49 isn't
    assert rows == [("a", v, ts, age, None, own) for v, ts, age, own in a] + [("b", 1, None, 1, None, None), ("b", 2, None, 1, 2, None), ("d", 1, None, 1, None, None), ("d", 2, day(2), 2, None, None)]  # one change now makes what two made
    assert [(r.user_id, r.version, r.batch) for r in spark.read.parquet(out + "/history").where("gone").collect()] == [("d", 3, 1)]
    tags = {(r.user_id, r.version, r.tag) for r in feed.traits(spark, out).collect()}
    assert tags == {("a", 4, "small_business_owner"), ("a", 5, "small_business_owner"), ("b", 2, "has_dependents"), ("d", 2, "resident_of_P")}


def test_what_a_user_is_told_by_a_plain_fold():
    made, after = feed.versions(3, {"x": "1"}, [(5, '{"x": "1"}'), (6, '{"x": "2"}'), (7, '{"y": null}')], ["x", "y"])
    assert made == [(4, 6, ["x"], {"x": "2"})] and [n for n, _ in after] == [3, 4, 4]


def test_only_users_that_changed_have_a_state(spark):
    root = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    base = spark.createDataFrame([(f"u{k}", 20, "driver") for k in range(50)], "user_id string, age int, occupation_type string")
    for rows, states in (([("u1", day(1), {"age": "21"}), ("u1", day(2), {"age": "22"}), ("u2", day(1), {"age": "20"}), ("x", day(1), {"age": "1"})], 2), ([("u1", day(3), {"age": "23"}), ("u3", day(1), {"age": "9"})], 3)):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(root + "/in")
        q = feed.profile_stream(spark.readStream.schema(CHANGES).parquet(root + "/in"), base, root + "/out", root + "/checkpoint")
        q.awaitTermination()
        assert q.recentProgress[0].stateOperators[0].numRowsTotal == states
    got = feed.history(spark, root + "/out").where("version > 1").select("user_id", "version", "age").orderBy("user_id", "version").collect()
    assert [tuple(r) for r in got] == [("u1", 2, 21), ("u1", 3, 22), ("u1", 4, 23), ("u3", 2, 9)] and feed.history(spark, root + "/out").count() == 54
