"""Publication times against the standard library, read one at a time."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressfold.functions.zones import transitions, wall_to_utc
from pressfold.operators.timestamps import iso_millis, mask, normalise_times, to_utc_millis

ZONES = ["Asia/Seoul", "UTC", "Australia/Sydney", "Europe/London", "America/New_York", "America/Los_Angeles", "Africa/Casablanca"]


def read(text, zone="Asia/Seoul", month_first=False, crawled="2025-07-03T12:00:00"):
    value, good = to_utc_millis([text], np.array([crawled], dtype="datetime64[ms]"), np.array([zone], dtype=object), np.array([month_first]))
    return iso_millis(value)[0] if good[0] else None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2023-06-11T16:35:50.966313+05:30", "2023-06-11T11:05:50.966Z"),
        ("2025-02-16T11:19:44,932+02:00", "2025-02-16T09:19:44.932Z"),
        ("20210904T082600+0000", "2021-09-04T08:26:00.000Z"),
        ("Sat, 20 Jan 2024 05:47:41 +1100", "2024-01-19T18:47:41.000Z"),
        ("Sun, 4 Sep 2022 09:44:29 CET", "2022-09-04T08:44:29.000Z"),
        ("2025-02-28 13:45:33 PDT", "2025-02-28T20:45:33.000Z"),
        ("2022년 3월 2일 오전 10:43", "2022-03-02T01:43:00.000Z"),
        ("2022년 3월 2일 오후 12:05", "2022-03-02T03:05:00.000Z"),
        ("작성일 2024. 6. 3.", "2024-06-02T15:00:00.000Z"),
        ("2022.10.02. 01:31 | 조회 772", "2022-10-01T16:31:00.000Z"),
        ("Nov 4, 2024 1:42 AM / Platform", "2024-11-03T16:42:00.000Z"),
        ("November 25, 2021 · 3 min read", "2021-11-24T15:00:00.000Z"),
        ("20211121", "2021-11-20T15:00:00.000Z"),
        ("1741470162", "2025-03-08T21:42:42.000Z"),
        ("1661588830691", "2022-08-27T08:27:10.691Z"),
        ("2021-01-15T19:25:01-05:00[America/New_York]", "2021-01-16T00:25:01.000Z"),
        ("2022-10-01 02:04:48 Asia/Kolkata", "2022-09-30T20:34:48.000Z"),
        ("52 minutes ago", "2025-07-03T11:08:00.000Z"),
        ("6일 전", "2025-06-27T12:00:00.000Z"),
        ("21시간 전", "2025-07-02T15:00:00.000Z"),
        ("  2024-06-24 02:59 -03:30 \n", "2024-06-24T06:29:00.000Z"),
    ],
)
def test_notations(text, expected):
    assert read(text) == expected


@pytest.mark.parametrize("text", [None, "", "  ", "-", "null", "TBD", "미정", "coming soon", "2023-13-05T10:00:00Z", "32 Jan 2023", "2024-02-30", "2022.04.31", "0000-00-00 00:00:00", "2024년 14월 2일", "2024-01-01 25:00", "x" * 100_000])
def test_no_time(text):
    assert read(text) is None


def test_order_of_slashed_dates():
    assert read("06/10/2023", "UTC", month_first=True) == "2023-06-10T00:00:00.000Z"
    assert read("06/10/2023", "UTC") == "2023-10-06T00:00:00.000Z"
    assert read("13/10/2023 04:05", "UTC", month_first=True) is None


def test_daylight_saving():
    assert read("2024-11-03 01:30", "America/New_York") == "2024-11-03T05:30:00.000Z"  # the earlier of two
    assert read("2024-03-10 02:30", "America/New_York") == "2024-03-10T07:30:00.000Z"  # skipped: 03:30


def test_without_zone():
    assert read("2024-03-10 02:30", None) is None
    assert read("2024-03-10 02:30", "No/Such_Zone") is None
    assert read("2024-03-10T02:30:00Z", None) == "2024-03-10T02:30:00.000Z"


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2090, 1, 1)), st.sampled_from(ZONES))
def test_zone_tables_agree_with_zoneinfo(wall, zone):
    wall = wall.replace(microsecond=0)
    seconds = np.array([int((wall - datetime(1970, 1, 1)).total_seconds())])
    expected = wall.replace(tzinfo=ZoneInfo(zone), fold=0)
    assert wall_to_utc(seconds, zone)[0] == expected.timestamp()


@settings(max_examples=100, deadline=None)
@given(st.datetimes(datetime(1980, 1, 1), datetime(2060, 1, 1)), st.integers(-14 * 60, 14 * 60))
def test_offsets(wall, minutes):
    wall = wall.replace(microsecond=wall.microsecond // 1000 * 1000, tzinfo=timezone(timedelta(minutes=minutes)))
    expected = wall.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{wall.microsecond // 1000:03d}Z"
    assert read(wall.isoformat(timespec="milliseconds")) == expected


def test_mask_has_the_length_of_its_text():
    for text in ("Sat, 20 Jan 2024 05:47:41 +1100", "2022년 3월 2일 오전 10:43", "İstanbul 3"):
        assert len(mask(text)) == len(text)
    assert transitions("No/Such_Zone") is None


def test_table(spark):
    schema = "id bigint, corporation_id bigint, published_raw string, crawled_at timestamp_ntz, zone string"
    when = datetime(2025, 7, 1)
    rows = [(1, 1, "2024-01-01", when, "clash"), (1, 1, "2024-01-01", when, "clash"), (2, 2, "2024-01-01", None, None), (3, None, "1 day ago", None, None), (None, 1, "2024-01-01", when, None), (4, 9, "2024-01-01T00:00:00Z", when, None)]
    zones = spark.createDataFrame([(1, "Asia/Seoul", "DMY"), (1, "Asia/Seoul", "DMY"), (2, None, None)], "corporation_id bigint, zone_name string, date_order string")
    found = sorted(tuple(r) for r in normalise_times(spark.createDataFrame(rows, schema), zones).collect())
    assert found == [(1, "2023-12-31T15:00:00.000Z"), (1, "2023-12-31T15:00:00.000Z"), (4, "2024-01-01T00:00:00.000Z")]
    assert normalise_times(spark.createDataFrame([], schema), zones).count() == 0


def test_units_of_the_calendar_and_short_offsets():
    for text, expected in (("1 month ago", "2024-02-29T10:00:00.000Z"), ("2개월 전", "2024-01-31T10:00:00.000Z"), ("3달 전", "2023-12-31T10:00:00.000Z"), ("1년 전", "2023-03-31T10:00:00.000Z"), ("2 years ago", "2022-03-31T10:00:00.000Z"), ("어제", "2024-03-30T10:00:00.000Z"), ("yesterday", "2024-03-30T10:00:00.000Z"), ("방금 전", "2024-03-31T10:00:00.000Z")):
        assert read(text, "UTC", crawled="2024-03-31T10:00:00") == expected
    assert read("2024-01-02T10:00:00+09", "UTC") == "2024-01-02T01:00:00.000Z"
    assert read("2024-01-02 10:00:00 GMT+0900", "UTC") == "2024-01-02T01:00:00.000Z"
    assert read("2024-01-02 10:00:00 GMT", "Asia/Seoul") == "2024-01-02T10:00:00.000Z"
