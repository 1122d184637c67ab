"""Calendar columns: parts, cyclic codes, holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.sources.schemas import EASTER_OFFSETS, FIXED_HOLIDAYS


def local(ts: str | Column, zone: str) -> Column:
    """UTC time in a zone's wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value of a period."""
    angle = 2 * F.pi() * value / period
    return F.sin(angle), F.cos(angle)


def monday_zero(ts: str | Column) -> Column:
    """SC1: 0 is Monday."""
    return F.weekday(ts)


def monday_one(ts: str | Column) -> Column:
    """SC2: 1 is Monday."""
    return F.weekday(ts) + 1


def is_weekend(ts: str | Column) -> Column:
    """SC3."""
    return (F.weekday(ts) >= 5).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the century's epact and the Sunday that follows the
    paschal full moon."""
    century = F.floor(year / 100)
    golden = year % 19
    leap_rule = F.floor((century + 8) / 25)
    epact = (19 * golden + century - F.floor(century / 4) - F.floor((century - leap_rule + 1) / 3) + 15) % 30
    to_sunday = (32 + 2 * (century % 4) + 2 * F.floor((year % 100) / 4) - epact - (year % 100) % 4) % 7
    late = F.floor((golden + 11 * epact + 22 * to_sunday) / 451)
    after_march_first = (epact + to_sunday - 7 * late + 21).cast("int")
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(1)), after_march_first)


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """SC6: (holiday) of the fixed days and of those that move with Easter, for a table of years."""
    y = F.col(year).cast("int")
    fixed = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    moving = [F.date_add(easter(y), k) for k in EASTER_OFFSETS]
    return years.select(F.explode(F.array(*fixed, *moving)).alias("holiday")).distinct()


def with_holiday_flag(df: DataFrame, day: Column, name: str = "is_holiday") -> DataFrame:
    """J7, SC6: 1 on a holiday.  The years are those of the table, at most a few hundred rows."""
    years = df.select(F.year(day).alias("year")).where("year is not null").distinct()
    dates = F.broadcast(holidays(years).withColumnRenamed("holiday", "_holiday"))
    joined = df.withColumn("_day", day).join(dates, F.col("_day") == F.col("_holiday"), "left")
    return joined.withColumn(name, F.col("_holiday").isNotNull().cast("int")).drop("_day", "_holiday")


def calendar_v1(df: DataFrame, ts: str = "ts") -> DataFrame:
    """SC1, SC3, SC4, SC6 in UTC: the calendar part of feature matrix v1."""
    hour, month = cyclic(F.hour(ts), 24), cyclic(F.month(ts), 12)
    out = df.withColumns({"hour_sin": hour[0], "hour_cos": hour[1], "weekday": monday_zero(ts), "is_weekend": is_weekend(ts), "month_sin": month[0], "month_cos": month[1]})
    return with_holiday_flag(out, F.to_date(ts))


def calendar_v2(df: DataFrame, zone: str = "Europe/Zurich", ts: str = "ts") -> DataFrame:
    """SC2, SC5, SC6 in local time: the calendar part of feature matrix v2."""
    at = local(ts, zone)
    day, year = cyclic(F.hour(at) + F.minute(at) / 60, 24), cyclic(F.dayofyear(at), 365.25)
    out = df.withColumns({"time_of_day_sin": day[0], "time_of_day_cos": day[1], "day_of_year_sin": year[0], "day_of_year_cos": year[1], "day_of_week": monday_one(at)})
    return with_holiday_flag(out, F.to_date(at))
