import datetime as dt

from pyspark.sql import functions as F

from headway.functions import time as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def stamp(text):
    return F.lit(text).cast("timestamp")


def test_service_day_turns_at_three(spark):
    # 03:00 in Sydney is 17:00 UTC of the day before (16:00 in summer time)
    assert one(spark, t.service_day(stamp("2026-06-10 16:59:59"))) == "2026-06-10"
    assert one(spark, t.service_day(stamp("2026-06-10 17:00:00"))) == "2026-06-11"
    assert one(spark, t.service_day(stamp("2026-12-10 15:59:59"))) == "2026-12-10"
    assert one(spark, t.service_day(stamp("2026-12-10 16:00:00"))) == "2026-12-11"


def test_origin_on_the_day_clocks_change(spark):
    assert one(spark, F.date_format(t.service_origin(F.lit("2026-10-04")), "yyyy-MM-dd HH:mm")) == "2026-10-03 13:00"
    assert one(spark, F.date_format(t.service_origin(F.lit("2026-06-10")), "yyyy-MM-dd HH:mm")) == "2026-06-09 14:00"


def test_cutoff(spark):
    assert one(spark, F.date_format(t.cutoff(F.lit("2026-06-10")), "yyyy-MM-dd HH:mm")) == "2026-06-10 17:00"


def test_gtfs_times(spark):
    for text, want in (("25:10:00", 90_600), ("00:00:05", 5), (" 08:30:00", 30_600), ("8:30", None), ("aa:bb:cc", None), (None, None)):
        assert one(spark, t.gtfs_seconds(F.lit(text).cast("string"))) == want
    assert one(spark, t.clock(F.lit(90_600))) == "01:10"


def test_start_date_wins(spark):
    assert one(spark, t.service_date_or(F.lit("20260102"), stamp("2026-06-10 00:00:00"))) == "2026-01-02"
    assert one(spark, t.service_date_or(F.lit(""), stamp("2026-06-10 00:00:00"))) == "2026-06-10"


def test_windows_and_peaks(spark):
    assert one(spark, t.floor_to(stamp("2026-06-10 00:14:59"), 900)) == dt.datetime(2026, 6, 10)
    assert one(spark, t.ceil_to(stamp("2026-06-10 00:00:01"), 900)) == dt.datetime(2026, 6, 10, 0, 15)
    c = t.calendar(stamp("2026-06-09 22:30:00"))  # Wednesday 08:30 in Sydney
    assert [one(spark, c[k]) for k in ("hour_local", "day_of_week", "is_weekend", "is_peak")] == [8, 2, False, True]
    c = t.calendar(stamp("2026-06-12 22:30:00"))  # Saturday
    assert [one(spark, c[k]) for k in ("day_of_week", "is_weekend", "is_peak")] == [5, True, False]
    assert one(spark, t.spoken_date(stamp("2026-10-03 20:00:00"))) == "Sunday 4 October 2026"
