"""Users: profiles with history, traits, and the queries that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.functions import classify

FIELDS = ["age", "gender", "marital_status", "province", "dependents", "occupation_type", "has_business", "business_sector", "owns_property", "owns_vehicle"]


def trait_rows(profiles: DataFrame) -> DataFrame:
    """user_id, tag, source_rule."""
    return profiles.select("user_id", F.explode(classify.traits()).alias("t")).select("user_id", "t.tag", "t.source_rule")


def sorted_traits(traits: DataFrame) -> DataFrame:
    return traits.groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def triggers(spark) -> DataFrame:
    """The seven categories with what makes them apply and what they ask."""
    return spark.createDataFrame([(i, c, R.TRIGGERS[c], R.QUERY_TEMPLATES[c]) for i, c in enumerate(R.TRIGGERS)], "pos int, category string, triggers array<string>, template string")


def category_queries(users: DataFrame) -> DataFrame:
    """users: user_id, tags, province. A query for each category that applies: query_id, user_id, category, query_text, matched_traits, entity_type, province."""
    applies = F.col("triggers").isNull() | F.arrays_overlap("tags", "triggers")
    rows = users.join(F.broadcast(triggers(users.sparkSession)), applies)
    matched = F.array_sort(F.array_distinct(F.coalesce(F.array_intersect("tags", "triggers"), F.array().cast("array<string>"))))
    sectors = F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.startswith("business_sector_"))))
    context = F.array_join(F.concat(matched, sectors), ", ")
    text = F.when(context == "", F.col("template")).otherwise(F.concat("template", F.lit(" đối với "), context))
    return rows.select(
        F.concat_ws("|", F.col("user_id").cast("string"), "category").alias("query_id"), "user_id", "category", text.alias("query_text"),
        matched.alias("matched_traits"), classify.entity_type(F.col("tags")).alias("entity_type"), "province",
    )


def create_profiles(incoming: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New profiles at version 1, and those refused because the username exists or comes twice."""
    once = incoming.withColumn("_n", F.row_number().over(Window.partitionBy("username").orderBy("user_id")))
    fresh = once.where("_n = 1").drop("_n").join(users.select("username"), "username", "left_anti")
    refused = once.where("_n > 1").drop("_n").unionByName(once.where("_n = 1").drop("_n").join(users.select("username"), "username", "left_semi").select(*incoming.columns))
    return fresh.withColumn("version", F.lit(1)), refused


def snapshot_json(fields: list[str] = FIELDS):
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def apply_changes(profiles: DataFrame, changes: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """The history of profiles: user_id, version, ts, changed_fields and the fields after each change.

    profiles: user_id and the fields, version 1. changes: user_id, ts, changes (map of the fields that were sent, as
    strings). A change that alters nothing makes no version. Each field's value at a change is the last that was
    sent up to it; what differs from the value before is changed.
    """
    types = {f.name: f.dataType.simpleString() for f in profiles.schema}
    first = profiles.select("user_id", F.lit(None).cast("timestamp").alias("ts"), *(F.struct(F.col(f).alias("v")).alias(f) for f in fields))
    sent = [F.when(F.map_contains_key("changes", F.lit(f)), F.struct(F.try_element_at("changes", F.lit(f)).cast(types[f]).alias("v"))).alias(f) for f in fields]
    known = profiles.select("user_id").hint("shuffle_hash")  # one row a user, so changes need no sort to find theirs
    every = first.unionByName(changes.join(known, "user_id", "left_semi").select("user_id", "ts", *sent))
    order = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("ts"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    filled = every.select("user_id", "ts", *(F.last(f, True).over(upto)["v"].alias(f) for f in fields))
    start = F.row_number().over(order) == 1
    differs = [F.when(start | ~F.col(f).eqNullSafe(F.lag(f).over(order)), F.lit(f)) for f in fields]
    told = filled.withColumn("changed_fields", F.array_compact(F.array(*differs))).where(F.size("changed_fields") > 0)
    return told.withColumn("version", F.row_number().over(order)).select("user_id", "version", "ts", "changed_fields", *fields)


def current(history: DataFrame) -> DataFrame:
    """The last version of each profile."""
    rest = [c for c in history.columns if c != "user_id"]
    return history.groupBy("user_id").agg(F.max_by(F.struct(*rest), "version").alias("p")).select("user_id", "p.*")


def recompute_traits(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """All traits, those of changed profiles made anew."""
    return stored.join(changed.select("user_id"), "user_id", "left_anti").unionByName(trait_rows(changed))


def remove_users(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables without the rows of removed users."""
    return [t.join(gone.select("user_id"), "user_id", "left_anti") for t in tables]


#: What each table's rows hang on: the table and its column, and the own column that names it.
BELONGS = {"users": None, "profiles": ("users", "user_id", "user_id"), "history": ("profiles", "user_id", "user_id"), "traits": ("profiles", "user_id", "user_id"), "items": ("users", "user_id", "user_id")}


def removed_with(tables: dict[str, DataFrame], gone: DataFrame, root: str = "users", belongs: dict = BELONGS) -> dict[str, DataFrame]:
    """The tables without the rows of `gone` (a key of the root table) and without all that hangs on these, from table to table.

    What is hashed are keys, each once; the rows of the tables, of which many may share a key, are not sorted.
    """
    keys, out = {root: gone.distinct().hint("shuffle_hash")}, {}
    for name, link in belongs.items():  # a table stands after that which it hangs on
        if name == root:
            out[name] = tables[name].join(keys[name], keys[name].columns, "left_anti")
        elif link and link[0] in keys:
            parent, key, own = link
            lost = keys[parent].select(F.col(key).alias(own)).distinct().hint("shuffle_hash")
            out[name] = tables[name].join(lost, own, "left_anti")
            further = {child[1] for child in belongs.values() if child and child[0] == name}
            if further:
                keys[name] = tables[name].join(lost, own, "left_semi").select(*sorted(further)).distinct()
    return tables | out


def left_behind(tables: dict[str, DataFrame], belongs: dict = BELONGS, rows: str | None = None) -> DataFrame:
    """table_name and n, the rows that hang on nothing: none where all was removed that had to be. A null key hangs on nothing, too.
    Tables that are counted already have in `rows` how many rows each of theirs stands for."""
    every = None
    for name, link in belongs.items():
        if link:
            parent, key, own = link
            each = tables[name].groupBy(own).agg((F.sum(rows) if rows else F.count("*")).alias("n"))  # counted by key before they meet the keys
            lone = each.join(tables[parent].select(F.col(key).alias(own)).distinct(), own, "left_anti")
            lone = lone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(name).alias("table_name"), "n")
            every = lone if every is None else every.unionByName(lone)
    return every


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, with their count: none in a sound table."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles in range, with defaults; and the others."""
    good = F.coalesce(F.col("age").isNull() | F.col("age").between(0, 120), F.lit(False)) & F.coalesce(F.length("username").between(1, 64), F.lit(False))
    defaults = {"dependents": 0, "has_business": False, "owns_property": False, "owns_vehicle": False}
    return rows.where(good).fillna({k: v for k, v in defaults.items() if k in rows.columns}), rows.where(~good)
