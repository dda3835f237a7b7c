"""Transit access from GTFS tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gtfs_minutes
from .near import count_and_sum


def representative_tuesday(feed_start: Column | None, starts: Column) -> Column:
    """The Tuesday strictly after a week of the feed's start; without one, after the latest start of service."""
    to_date = lambda c: F.to_date(c.cast("string"), "yyyyMMdd")
    by_service = F.next_day(to_date(starts), "TU")
    return by_service if feed_start is None else F.coalesce(F.next_day(F.date_add(to_date(feed_start), 7), "TU"), by_service)


def active_services(calendar: DataFrame, calendar_dates: DataFrame, day: int, weekday: str) -> DataFrame:
    """Services that run on a day (YYYYMMDD): those of the weekday, without removed ones, with added ones."""
    base = calendar.filter((F.col(weekday) == 1) & F.lit(day).between(F.col("start_date"), F.col("end_date"))).select("service_id")
    on_day = calendar_dates.filter(F.col("date") == day)
    removed = on_day.filter("exception_type = 2").select("service_id")
    return base.subtract(removed).union(on_day.filter("exception_type = 1").select("service_id")).distinct()


def trips_per_stop(stop_times: DataFrame, trips: DataFrame, services: DataFrame, first: int = 360, last: int = 1320) -> DataFrame:
    """Different trips at each stop that leave in [first, last) minutes after midnight, and per hour."""
    running = trips.join(services, "service_id", "left_semi").select("trip_id")
    minutes = gtfs_minutes(F.col("departure_time"))
    in_time = stop_times.filter((minutes >= first) & (minutes < last)).join(running, "trip_id", "left_semi")
    counts = in_time.groupBy("stop_id").agg(F.count_distinct("trip_id").alias("n_trips"))
    return counts.withColumn("trips_per_hour", F.col("n_trips") / ((last - first) / 60.0))


def access(points: DataFrame, stops: DataFrame, per_stop: DataFrame, key: list[str], radii: dict[str, float]) -> DataFrame:
    """Boarding stops near each point and their trips per hour; stops without trips count with 0."""
    boarding = stops.filter((F.coalesce("location_type", F.lit(0)) <= 1) & F.col("stop_lat").isNotNull())
    valued = boarding.join(per_stop, "stop_id", "left").fillna(0.0, ["trips_per_hour"])
    return count_and_sum(points, valued, key, radii, "trips_per_hour", ("stop_lat", "stop_lon"))
