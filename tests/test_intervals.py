from helpers import day, month, rows
from pyspark.sql import functions as F

from stormglass import fixed
from stormglass.operators import intervals as iv


def days(spark, *texts):
    return spark.createDataFrame([("a", day(t)) for t in texts], "entity string, date date")


def test_bounds_are_inside_and_the_last_listed_period_wins(spark):
    periods = iv.periods_table(spark, [("2000-01-10", "2000-03-01", "one"),
                                       ("2000-02-01", "2000-02-05", "two")])
    df = days(spark, "2000-01-09", "2000-01-10", "2000-02-01", "2000-02-06", "2000-03-01", "2000-03-02")
    labelled = iv.label_periods(df, "date", periods)
    got = rows(labelled.select("date", "CRISIS", "CRISIS_NAME"), "date")
    listed = iv.label_listed_periods(df, "date", [("2000-01-10", "2000-03-01", "one"),
                                                  ("2000-02-01", "2000-02-05", "two")])
    assert rows(listed, "date") == rows(labelled, "date")
    assert [r[1:] for r in got] == [(0, "None"), (1, "one"), (1, "two"), (1, "one"), (1, "one"),
                                    (0, "None")]


def test_month_grain_equals_day_grain_on_month_starts(spark):
    df = spark.createDataFrame([("a", month(i, 1970)) for i in range(12 * 57)],
                               "entity string, date date")
    p = iv.periods_table(spark)
    assert rows(iv.label_periods(df, "date", p, "month"), "date") == \
        rows(iv.label_periods(df, "date", p), "date")
    assert len(fixed.CRISIS_PERIODS) == 6


def flagged(spark, *items, entity="a"):
    return spark.createDataFrame([(entity, month(i), f, n) for i, (f, n) in enumerate(items)],
                                 "entity string, date date, CRISIS int, CRISIS_NAME string")


def test_runs_close_on_a_calm_row_or_a_new_name(spark):
    df = flagged(spark, (1, "x"), (1, "x"), (0, "None"), (1, "x"), (1, "y"), (1, " "), (1, None),
                 (None, "x"), (1, "y"))
    got = rows(iv.islands(df, ["entity"]), "start_date")
    assert got == [("a", "x", month(0), month(1)), ("a", "x", month(3), month(3)),
                   ("a", "y", month(4), month(4)), ("a", "Historical Crisis", month(5), month(6)),
                   ("a", "y", month(8), month(8))]


def test_runs_join_over_removed_rows(spark):
    df = flagged(spark, (1, "x"), (0, "None"), (1, "x")).where(F.col("date") != month(1))
    assert len(iv.islands(df, ["entity"]).collect()) == 1


def test_trailing_window_starts_at_the_same_day_years_before(spark):
    df = days(spark, "2000-05-31", "2000-06-01", "2004-01-01", "2005-06-01")
    assert [r[1] for r in rows(iv.trailing_window(df, ["entity"], years=5), "date")] == \
        [day("2000-06-01"), day("2004-01-01"), day("2005-06-01")]
    assert iv.trailing_window(df, ["entity"]).count() == 4


def test_replay_is_exact_to_the_day(spark):
    p = spark.createDataFrame([("one", day("2001-06-15"), day("2001-08-10"))],
                              "name string, start_date date, end_date date")
    df = days(spark, "2000-06-14", "2000-06-15", "2001-07-01", "2002-02-10", "2002-02-11")
    got = [r.date for r in iv.event_replay(df, "date", p).orderBy("date").collect()]
    assert got == [day("2000-06-15"), day("2001-07-01"), day("2002-02-10")]


def test_visible_periods_and_selection(spark):
    p = spark.createDataFrame(
        [("a", "old", day("1990-01-01"), day("1990-06-01")),
         ("a", "edge", day("1999-01-01"), day("2000-01-01")),
         ("a", "new", day("2001-01-01"), day("2001-02-01"))],
        "entity string, name string, start_date date, end_date date")
    shown = days(spark, "2000-01-01", "2003-01-01")
    assert {r.name for r in iv.visible_periods(p, shown, ["entity"]).collect()} == {"edge", "new"}
    assert [r.name for r in iv.visible_periods(p, shown, ["entity"], selected="old").collect()] == ["old"]
    assert [r.name for r in iv.reverse_periods(p).collect()] == ["new", "edge", "old"]
