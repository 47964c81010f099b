"""Times of scheduled jobs: next runs in a job's own zone, due jobs, missed days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(day: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), time), "yyyy-MM-dd HH:mm")


def next_daily(now: Column, time: Column) -> Column:
    """The next HH:mm after the wall time now."""
    today = _at(now, time)
    return F.when(today <= now, today + F.expr("INTERVAL 1 DAY")).otherwise(today)


def next_weekly(now: Column, time: Column, days: Column) -> Column:
    """The next HH:mm on one of the days (mon .. sun), within eight days; null without any."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: _at(F.date_add(F.to_date(now), i), time))
    good = F.filter(tries, lambda t: (t > now) & F.array_contains(F.transform(days, lambda d: F.lower(F.substring(d, 1, 3))), F.lower(F.date_format(t, "EEE"))))
    return F.array_min(good)


def next_monthly(now: Column, time: Column, day: Column) -> Column:
    """HH:mm on that day of this month or the next, whichever is later than now; null if neither has it."""
    month = F.trunc(now, "month")
    tries = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.add_months(month, i))
    good = F.filter(tries, lambda m: (day <= F.day(F.last_day(m))) & (_at(F.date_add(m, day - 1), time) > now))
    return _at(F.date_add(F.get(good, F.lit(0)), day - 1), time)


def next_interval(now: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, now)


def next_run(now: Column, kind: Column, time: Column, days: Column, day: Column, minutes: Column) -> Column:
    return F.when(kind == "daily", next_daily(now, time)).when(kind == "weekly", next_weekly(now, time, days)).when(kind == "monthly", next_monthly(now, time, day)).when(kind == "interval", next_interval(now, minutes)).otherwise(F.raise_error(F.concat(F.lit("unsupported schedule: "), kind)))


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs whose next_run_at, a wall time in the job's zone, is not after now (UTC); unreadable times are passed over."""
    return jobs.where("status = 'active'").where(F.to_utc_timestamp(F.try_to_timestamp("next_run_at"), F.col("timezone")) <= now)


def missing_days(events: DataFrame, day: str = "day", *by: str) -> DataFrame:
    """Days between the first and the last, of all events or of each group's, that no event has."""
    days = events.select(*by, day).distinct()
    span = days.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select(*by, F.explode(F.sequence("a", "b")).alias(day)).join(days, [*by, day], "left_anti")


def month_ranges(rows: DataFrame, key: str, year: Column, spec: Column) -> DataFrame:
    """(key, label, first, last) of the months of each row's list such as 1-3,7, each once; a month outside of 1 to 12 is an error."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda p: p != "")
    months = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))))
    first = F.when(F.col("m").between(1, 12), F.make_date("y", "m", F.lit(1))).otherwise(F.raise_error(F.lit("months are 1 to 12")))
    each = rows.select(key, year.alias("y"), F.explode(months).alias("m")).withColumn("first", first)
    return each.select(key, F.date_format("first", "yyyy-MM").alias("label"), F.col("first").cast("string").alias("first"), F.last_day("first").cast("string").alias("last"))


def quarter_ranges(rows: DataFrame, year: str) -> DataFrame:
    """(year, label, first, last) of the four quarters of each row's year."""
    each = rows.select(year, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")).withColumn("d", F.add_months(F.make_date(F.col(year), F.lit(1), F.lit(1)), F.col("q") * 3))
    return each.select(year, F.concat(F.lit("Q"), (F.col("q") + 1).cast("string")).alias("label"), F.col("d").cast("string").alias("first"), F.last_day(F.add_months("d", 2)).cast("string").alias("last"))
