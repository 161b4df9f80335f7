"""Due dates by arithmetic, against a plain walk over the months."""

import datetime as dt

from pyspark.sql import functions as F

from statuta.functions import deadlines


def walked(month, day, period, today):
    for k in range(0, 121, period):
        at = (month or 1) - 1 + k
        try:
            found = dt.date(today.year + at // 12, at % 12 + 1, day)
        except ValueError:
            return None
        if found >= today:
            return found
    return None


def test_recurring_dates_follow_from_the_months_between(spark):
    days = [dt.date(2024, 5, 15), dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2024, 1, 1)]
    rows = [(m, d, p, t) for m in (None, 0, 1, 2, 7, 12, -30) for d in (0, 1, 15, 28, 29, 30, 31, 32) for p in (1, 2, 5, 12, 120, 121) for t in days]
    df = spark.createDataFrame(rows, "m int, d int, p int, t date")
    df = df.select("*", deadlines.recurring(*map(F.col, "mdpt")).alias("due"))
    assert all(r.due == walked(r.m, r.d, r.p, r.t) for r in df.collect())


def test_no_row_parses_a_date_for_every_month(spark, capsys):
    df = spark.range(1).select(F.col("id").cast("int").alias("m")).select(deadlines.recurring(F.col("m"), F.col("m"), F.lit(3), F.lit("2024-05-15").cast("date")))
    df.explain(True)
    told = capsys.readouterr().out
    assert "make_date" in told and "format_string" not in told and "gettimestamp" not in told


def test_a_replaced_checklist_parses_its_items_once(spark):
    from statuta.plans.user_queries import replaced

    plan = replaced(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "extraction" not in plan


def steps(df):
    """How often the step to the month that is due is worked out in the plan of df."""
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("ceil(")


def test_a_status_text_works_out_its_months_few_times(spark):
    from statuta.plans.user_queries import status_text

    assert steps(status_text(spark, "/root/testdata/sf0.001")) <= 8  # 4 for the filter, 4 for the text


def test_due_dates_end_with_year_9999(spark):
    rows = [("fixed", 5, 1, None), ("fixed", 12, 31, None), ("recurring", 12, 1, 1), ("recurring", 13, 1, 1), ("recurring", -2_000_000_000, 1, 1), ("recurring", 2_000_000_000, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, m int, d int, p int")
    none = F.lit(None)
    due = deadlines.due_date(F.col("kind"), F.col("m"), F.col("d"), F.col("p"), none.cast("int"), none.cast("date"), F.lit("9999-06-15").cast("date"))
    assert [r.due for r in df.select("i", due.alias("due")).orderBy("i").collect()] == [None, dt.date(9999, 12, 31), dt.date(9999, 12, 1), None, None, None]


def test_stored_items_work_out_their_months_few_times(spark):
    from statuta.plans.lifecycle_queries import stored_items

    assert steps(stored_items(spark, "/root/testdata/sf0.001")) <= 4
