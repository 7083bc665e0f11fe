"""Wall-clock and timetable time as columns.  Instants are UTC; local time is subtracted, never shifted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Australia/Sydney"
#: Hour of the wall clock at which a service day turns.
TURNOVER_HOURS = 3
#: First and past-the-last hours of the weekday peaks.
PEAKS = ((6, 10), (15, 19))


def local(instant: Column, zone: str = ZONE) -> Column:
    """The wall clock (timestamp without zone) at an instant; a plain timestamp counts as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))


def service_day(instant: Column, zone: str = ZONE) -> Column:
    """The service day (yyyy-MM-dd) of an instant: the wall clock's date three hours earlier."""
    return F.date_format(local(instant, zone) - F.expr(f"INTERVAL {TURNOVER_HOURS} HOURS"), "yyyy-MM-dd")


def service_date_or(start_date: Column, instant: Column, zone: str = ZONE) -> Column:
    """A feed's eight-digit start date as ISO text, else the service day of the instant."""
    iso = F.concat_ws("-", F.substring(start_date, 1, 4), F.substring(start_date, 5, 2), F.substring(start_date, 7, 2))
    return F.when(start_date.rlike("^[0-9]{8}$"), iso).otherwise(service_day(instant, zone))


def gtfs_seconds(clock: Column) -> Column:
    """Seconds of the service day of HH:MM:SS, where HH may exceed 23; NULL if malformed."""
    good = F.trim(clock).rlike("^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$")
    part = F.split(F.trim(clock), ":")
    return F.when(good, part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int"))


def clock(seconds: Column) -> Column:
    """HH:MM of seconds of the service day."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.pmod(F.floor(s / 3600), F.lit(24)), F.pmod(F.floor(s / 60), F.lit(60)))


def service_origin(service_date: Column, zone: str = ZONE) -> Column:
    """The instant from which timetable seconds count: twelve hours before local noon."""
    noon = F.to_timestamp_ntz(F.concat(service_date.cast("string"), F.lit(" 12:00:00")))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), noon).cast("timestamp") - F.expr("INTERVAL 12 HOURS")


def service_seconds(instant: Column, service_date: Column, zone: str = ZONE) -> Column:
    """An instant as seconds of its service date, as timetables count them."""
    return (F.unix_micros(instant.cast("timestamp")) - F.unix_micros(service_origin(service_date, zone))) / 1_000_000


def cutoff(service_date: Column, zone: str = ZONE) -> Column:
    """The instant at which a service day ends: 03:00 local time of the next day."""
    end = F.date_add(F.to_date(service_date), 1).cast("timestamp_ntz") + F.expr(f"INTERVAL {TURNOVER_HOURS} HOURS")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), end).cast("timestamp")


def floor_to(instant: Column, seconds: int) -> Column:
    """The start of the window of so many seconds, counted from the epoch in UTC."""
    return F.timestamp_seconds(F.floor(F.unix_micros(instant.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def ceil_to(instant: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.ceil(F.unix_micros(instant.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def calendar(instant: Column, zone: str = ZONE) -> dict[str, Column]:
    """hour_local, day_of_week (Monday 0), is_weekend and is_peak."""
    wall = local(instant, zone)
    hour, day = F.hour(wall), F.weekday(wall)
    busy = F.lit(False)
    for a, b in PEAKS:
        busy = busy | ((hour >= a) & (hour < b))
    return {"hour_local": hour, "day_of_week": day, "is_weekend": day >= 5, "is_peak": busy & (day < 5)}


def spoken_date(instant: Column, zone: str = ZONE) -> Column:
    """Such as Sunday 4 October 2026."""
    return F.date_format(local(instant, zone), "EEEE d MMMM yyyy")


def spoken_moment(instant: Column, zone: str = ZONE) -> Column:
    """Such as 08:30 on Sunday 4 October 2026."""
    return F.concat(spoken_time(instant, zone), F.lit(" on "), spoken_date(instant, zone))


def spoken_time(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(instant, zone), "HH:mm")
