from __future__ import annotations

import datetime
from zoneinfo import ZoneInfo

import pytest

from siltwork.operators.timestamps import normalise_timestamps

ZONES = [("msk", "Europe/Moscow", True), ("ber", "Europe/Berlin", True), ("ny", "America/New_York", False), ("none", None, True), ("odd", "No/Where", True)]


def micros(*parts: int, tz: str = "UTC", fold: int = 0) -> int:
    at = datetime.datetime(*parts, tzinfo=ZoneInfo(tz), fold=fold)
    return int(round((at - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1)))


def run(spark, rows, **options):
    zones = spark.createDataFrame(ZONES, "source string, tz string, day_first boolean")
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "id long, ts string, source string")
    out = normalise_timestamps(df, zones, **options).select("id", "ts_us").collect()
    return [r["ts_us"] for r in sorted(out, key=lambda r: r["id"])]


CASES = [
    ("2024-01-02T03:04:05.123456789Z", "msk", micros(2024, 1, 2, 3, 4, 5, 123456)),
    ("2024-01-02 03:04:05", "msk", micros(2024, 1, 2, 0, 4, 5)),
    ("2024-01-02", "ber", micros(2024, 1, 1, 23)),
    ("02.01.2024 03:04", "msk", micros(2024, 1, 2, 0, 4)),
    ("02.01.24 3:04:05", "msk", micros(2024, 1, 2, 0, 4, 5)),
    ("02.01.2024 03:04 UTC+03:00", "ny", micros(2024, 1, 2, 0, 4)),
    ("02/01/2024 03:04", "msk", micros(2024, 1, 2, 0, 4)),
    ("01/02/2024 11:37 PM", "ny", micros(2024, 1, 3, 4, 37)),
    ("01/02/2024 12:05 AM", "ny", micros(2024, 1, 2, 5, 5)),
    ("Apr 1, 2023 2:45:34 PM", "msk", micros(2023, 4, 1, 11, 45, 34)),
    ("10 августа 2023 г., 02:28", "msk", micros(2023, 8, 9, 23, 28)),
    ("Tue, 19 Mar 2024 14:53:53 -0400", "msk", micros(2024, 3, 19, 18, 53, 53)),
    ("2024-03-31 05:13:40 MSK", "ny", micros(2024, 3, 31, 2, 13, 40)),
    ("2024-02-24T19:02:19+03:00[Europe/Moscow]", "ny", micros(2024, 2, 24, 16, 2, 19)),
    ("20230120T005725Z", "ny", micros(2023, 1, 20, 0, 57, 25)),
    ("20230120005725", "msk", micros(2023, 1, 19, 21, 57, 25)),
    ("1672567825", "msk", 1672567825_000000),
    ("1672567825.5", "msk", 1672567825_500000),
    ("1672567825123", "msk", 1672567825_123000),
    ("1672567825123456", "msk", 1672567825_123456),
    ("44927.5", None, micros(2023, 1, 1, 12)),
    ("2024-01-02 03:04:05,978", "none", micros(2024, 1, 2, 3, 4, 5, 978000)),
    ("2024-01-02 03:04:05", "odd", micros(2024, 1, 2, 3, 4, 5)),
    (" \t2024-01-02  ", "new", micros(2024, 1, 2)),
    # Clocks set back: the first; set forward: on by the gap.
    ("2024-10-27 02:30:00", "ber", micros(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "ber", micros(2024, 3, 31, 1, 30)),
    *[(x, "msk", None) for x in (None, "", " \t", "-", "n/a", "вчера", "25:61", "T12:30", "2024-13-05 09:00:00", "0000-00-00 00:00:00",
                                 "2024-02-30", "2024-01-02 24:00:00", "2024-01-02 03:04:60", "31.04.2024 10:00", "13:00 PM", "01/02/2024 13:05 PM")],
]


def test_notations(spark):
    got = run(spark, [(t, s) for t, s, _ in CASES])
    for (text, source, want), value in zip(CASES, got):
        assert value == want, (text, source)


def test_policies(spark):
    rows = [("2024-10-27 02:30:00", "ber"), ("2024-03-31 02:30:00", "ber"), ("2024-06-01 00:00:00", "ber")]
    assert run(spark, rows, ambiguous="last")[0] == micros(2024, 10, 27, 1, 30)
    assert run(spark, rows, ambiguous="null")[0] is None
    assert run(spark, rows, nonexistent="null")[1] is None
    assert run(spark, rows, ambiguous="null", nonexistent="null")[2] == micros(2024, 5, 31, 22)
    with pytest.raises(ValueError):
        run(spark, rows, ambiguous="maybe")


def test_against_zoneinfo(spark):
    """Every hour around both changes of a year, by the rules of the standard library."""
    start = datetime.datetime(2024, 3, 30)
    walls = [start + datetime.timedelta(minutes=30 * i) for i in range(100)] + [datetime.datetime(2024, 10, 26) + datetime.timedelta(minutes=30 * i) for i in range(100)]
    got = run(spark, [(f"{w:%Y-%m-%d %H:%M:%S}", "ber") for w in walls])
    for w, us in zip(walls, got):
        at = w.replace(tzinfo=ZoneInfo("Europe/Berlin"))
        assert us == int(at.timestamp()) * 1_000_000, w


def test_shapes_of_tables(spark):
    zones = spark.createDataFrame(ZONES + [("msk", "Europe/Moscow", True)], "source string, tz string, day_first boolean")
    empty = spark.createDataFrame([], "ts string, source string")
    assert normalise_timestamps(empty, zones).count() == 0
    rows = spark.createDataFrame([("2024-01-02", "msk", "x", 7)] * 2, "ts string, source string, tz string, ts_us int")
    out = normalise_timestamps(rows, zones.limit(0))
    assert out.columns == ["ts", "source", "tz", "ts_us"]
    assert {r["ts_us"] for r in out.collect()} == {micros(2024, 1, 2)} and out.count() == 2
