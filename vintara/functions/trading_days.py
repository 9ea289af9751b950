"""Trading calendar as a table, availability of documents, and the last completed session for a clock time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
FIRST_DAY, LAST_DAY = "2023-01-01", "2028-12-31"
# Closures outside the rules, and days that close at 13:00.
EXTRA_CLOSURES = ("2025-01-09",)
EARLY_CLOSES = (
    "2023-07-03", "2023-11-24", "2024-07-03", "2024-11-29", "2024-12-24", "2025-07-03", "2025-11-28", "2025-12-24",
    "2026-11-27", "2026-12-24", "2027-11-26", "2028-07-03", "2028-11-24",
)
# Easter Sundays of the supported years.
EASTER_SUNDAYS = ("2023-04-09", "2024-03-31", "2025-04-20", "2026-04-05", "2027-03-28", "2028-04-16")


def holiday(day: Column) -> Column:
    """Whether a date is a full-day holiday: fixed dates moved off weekends, n-th weekdays, and Good Friday."""
    month, dom, dow = F.month(day), F.dayofmonth(day), F.dayofweek(day)  # 1 is Sunday

    def observed(m: int, d: int) -> Column:
        on = (month == m) & (dom == d) & ~dow.isin(1, 7)
        monday = (dow == 2) & (F.month(F.date_sub(day, 1)) == m) & (F.dayofmonth(F.date_sub(day, 1)) == d)
        friday = (dow == 6) & (F.month(F.date_add(day, 1)) == m) & (F.dayofmonth(F.date_add(day, 1)) == d)
        # New Year's Day on a Saturday would fall in the year before, whose list does not have it
        return on | monday | (friday if (m, d) != (1, 1) else F.lit(False))

    def nth(m: int, weekday: int, n: int) -> Column:
        return (month == m) & (dow == weekday) & (F.floor((dom - 1) / 7) + 1 == n)

    last_monday_of_may = (month == 5) & (dow == 2) & (dom > 24)
    good_friday = F.date_add(day, 2).cast("string").isin(*EASTER_SUNDAYS)
    return observed(1, 1) | nth(1, 2, 3) | nth(2, 2, 3) | good_friday | last_monday_of_may | observed(6, 19) | observed(7, 4) | nth(9, 2, 1) | nth(11, 5, 4) | observed(12, 25)


def trading_calendar(spark: SparkSession, extra_closures: bool = False) -> DataFrame:
    """One row per day of the supported years: day, is_session, close_hour, next_session, session_after_next, last_session.

    Availability ignores the extra closures and the request resolver knows them, as the method has
    it; ``extra_closures`` chooses. About 2,200 rows, so it is always a broadcast side.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))).alias("day"))
    closed = F.dayofweek("day").isin(1, 7) | holiday(F.col("day"))
    if extra_closures:
        closed = closed | F.col("day").cast("string").isin(*EXTRA_CLOSURES)
    days = days.withColumn("is_session", ~closed).withColumn("close_hour", F.when(F.col("is_session"), F.when(F.col("day").cast("string").isin(*EARLY_CLOSES), 13).otherwise(16)))
    forward = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    back = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    session = F.when(F.col("is_session"), F.col("day"))
    days = days.withColumn("next_session", F.min(session).over(forward)).withColumn("last_session", F.max(session).over(back))
    after = days.select(F.col("day").alias("next_session"), F.col("next_session").alias("session_after_next"))
    return days.join(F.broadcast(after), "next_session", "left").select("day", "is_session", "close_hour", "next_session", "session_after_next", "last_session")


def availability(events: DataFrame, calendar: DataFrame, accepted: str) -> DataFrame:
    """Add local_time, buffer_day and available_date for a UTC timestamp column.

    Accepted before 09:30 local time on a session, that session is the buffer; otherwise the next
    one is. The document can be used from the session after the buffer.
    """
    rows = events.withColumn("local_time", F.from_utc_timestamp(accepted, ZONE)).withColumn("_day", F.to_date("local_time"))
    sessions = F.broadcast(calendar.select(F.col("day").alias("_day"), "is_session", "next_session", "session_after_next"))
    early = F.col("is_session") & (F.date_format("local_time", "HH:mm:ss") < "09:30:00")
    return (
        rows.join(sessions, "_day", "left")
        .withColumn("buffer_day", F.when(early, F.col("_day")).otherwise(F.col("next_session")))
        .withColumn("available_date", F.when(early, F.col("next_session")).otherwise(F.col("session_after_next")))
        .drop("_day", "is_session", "next_session", "session_after_next")
    )


def resolve_requests(requests: DataFrame, calendar: DataFrame, requested: str, now: str) -> DataFrame:
    """Add effective_date, adjusted and reason: the last session on or before the requested day that has closed by ``now`` (UTC).

    ``requested`` is a date or null for the latest. A request after the local day of ``now`` has no
    date and the reason FUTURE_DATE.
    """
    rows = requests.withColumn("_now", F.from_utc_timestamp(now, ZONE)).withColumn("_day", F.coalesce(F.col(requested), F.to_date("_now")))
    c = calendar.select(F.col("day").alias("_day"), "is_session", "close_hour", "last_session")
    before = calendar.select(F.col("day").alias("_prior"), F.col("last_session").alias("_earlier"))
    rows = rows.join(F.broadcast(c), "_day", "left").withColumn("_prior", F.date_sub("last_session", 1)).join(F.broadcast(before), "_prior", "left")
    same_day = F.col("last_session") == F.to_date("_now")
    hour = F.when(F.col("_day") == F.col("last_session"), F.col("close_hour"))
    open_now = same_day & (F.col("_now") < F.expr("make_timestamp(year(last_session), month(last_session), day(last_session), 0, 0, 0)") + F.make_interval(hours=hour))
    future = F.col("_day") > F.to_date("_now")
    effective = F.when(future, F.lit(None)).when(open_now, F.col("_earlier")).otherwise(F.col("last_session"))
    reason = F.when(future, "FUTURE_DATE").when(F.dayofweek("_day").isin(1, 7), "WEEKEND").when(~F.col("is_session"), "MARKET_HOLIDAY").when(open_now, "SESSION_NOT_CLOSED").otherwise("NONE")
    return rows.select(*requests.columns, effective.alias("effective_date"), (effective != F.col("_day")).alias("adjusted"), reason.alias("reason"))
