"""Removal of users with all that hangs on them."""

from statuta.operators import profiles


def test_a_removed_user_leaves_nothing_behind(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "users": frame([(1,), (2,), (3,)], "user_id long"), "profiles": frame([(1, "a"), (2, "b")], "user_id long, x string"), "history": frame([(1, 1), (1, 2), (2, 1)], "user_id long, v int"),
        "traits": frame([(1, "t"), (2, "t"), (2, "u")], "user_id long, tag string"), "items": frame([(1, 5), (3, 6)], "user_id long, item int"), "other": frame([(1,)], "user_id long"),
    }
    left = profiles.removed_with(tables, frame([(1,), (1,), (9,), (None,)], "user_id long"))
    rows = {n: sorted(map(tuple, t.collect())) for n, t in left.items()}
    assert rows == {"users": [(2,), (3,)], "profiles": [(2, "b")], "history": [(2, 1)], "traits": [(2, "t"), (2, "u")], "items": [(3, 6)], "other": [(1,)]}
    assert all(r.n == 0 for r in profiles.left_behind(left).collect())
    assert {r.table_name: r.n for r in profiles.left_behind(left | {"users": frame([(3,)], "user_id long")}).collect()} == {"profiles": 1, "history": 0, "traits": 0, "items": 0}


def test_rows_are_not_sorted_to_find_the_removed(spark):
    rows = spark.range(1000).selectExpr("id % 5 AS user_id", "id AS item")
    users = spark.range(5).withColumnRenamed("id", "user_id")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = profiles.removed_with({"users": users, "profiles": users, "history": rows, "traits": rows, "items": rows}, users.where("user_id < 2"))
        plans = [left[n]._jdf.queryExecution().executedPlan().toString() for n in ("history", "items")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert all("ShuffledHashJoin" in p and "Sort " not in p for p in plans)


def test_tables_may_be_counted_before_what_is_left_behind(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {n: frame([(1, 1), (2, 1)], "user_id long, n long") for n in ("users", "profiles")} | {n: frame([(1, 4), (3, 5), (None, 2)], "user_id long, n long") for n in ("history", "traits", "items")}
    assert {r.table_name: r.n for r in profiles.left_behind(tables, rows="n").collect()} == {"profiles": 0, "history": 7, "traits": 7, "items": 7}


def test_the_counts_of_what_is_left_are_made_once(spark):
    from statuta.plans.user_queries import removed_users

    plan = removed_users(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "lag(" not in plan
