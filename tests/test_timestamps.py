from datetime import datetime, timezone

import pytest

from sangam.operators.timestamps import normalise_timestamps, read_text


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    "text, want",
    [
        ("2025-06-01T06:43:41+05:30", us(2025, 6, 1, 1, 13, 41)), ("2025-06-03T02:14:48", us(2025, 6, 2, 20, 44, 48)), ("2025-06-01T04:32:27.351364Z", us(2025, 6, 1, 4, 32, 27, micro=351364)),
        ("१४ मई २०२५ १२:३०", us(2025, 5, 14, 7, 0)), ("02/06/2025 7:47 PM", us(2025, 6, 2, 14, 17)), ("04/06/25 01:46", us(2025, 6, 3, 20, 16)), ("12 Jun 2025, 12:39 am", us(2025, 6, 11, 19, 9)),
        ("Sun, 01 Jun 2025 14:12:28 +0530", us(2025, 6, 1, 8, 42, 28)), ("20250602T150142+0530", us(2025, 6, 2, 9, 31, 42)), ("1749008731", 1749008731 * 10**6), ("1749008731266", 1749008731266000),
        ("2025-06-04 09:48:44 BST", us(2025, 6, 4, 8, 48, 44)), ("2025-11-02 02:14:14 America/New_York", us(2025, 11, 2, 7, 14, 14)), ("2025-11-02T01:05:16-04:00[America/New_York]", us(2025, 11, 2, 5, 5, 16)),
        (" 2025-06-03 01:51:58+05:30 ", us(2025, 6, 2, 20, 21, 58)), ("2025-06-01T17:30:36.996+0530", us(2025, 6, 1, 12, 0, 36, micro=996000)),
    ],
)
def test_instants(text, want):
    assert read_text(text, "Asia/Kolkata")[0][1] == want


@pytest.mark.parametrize("text", ["2025-03-30T02:30:00[Europe/Berlin]", "2025-10-26T02:30:00[Europe/Berlin]", "31/02/2026 10:15", "2026-02-30T08:10:00Z", "25:71", "", "unknown", "Mon, 01 Jun 2025 10:00:00 +0530", "2025-06-01 13:00 XYZ", "05/06/2025 13:07 PM"])
def test_no_instant(text):
    assert all(u is None for _, u, _ in read_text(text, "Asia/Kolkata")[:1])


def test_em_learns_the_day_order(spark):
    rows = [("uk", f"{d}/05/2025 10:00") for d in range(13, 29)] + [("us", f"05/{d}/2025 10:00") for d in range(13, 29)] + [("uk", "03/04/2025 10:00"), ("us", "03/04/2025 10:00"), ("new", "03/04/2025 10:00"), (None, None), ("uk", ""), ("uk", "04/04/2025 10:00")]
    d = spark.createDataFrame(rows, "src string, ts string")
    got = {(r["src"], r["ts"]): (r["ts_status"], r["ts_reading"]) for r in normalise_timestamps(d, "ts", "src", day_first=None, min_posterior=0.9).collect()}
    assert got["uk", "03/04/2025 10:00"] == ("resolved", "dmy")
    assert got["us", "03/04/2025 10:00"] == ("resolved", "mdy")
    assert got["new", "03/04/2025 10:00"][0] == "ambiguous"
    assert got[None, None][0] == "missing" and got["uk", ""][0] == "invalid"
    assert got["uk", "04/04/2025 10:00"][0] == "resolved"  # both readings are one instant


def test_empty_table_and_clashing_columns(spark):
    d = spark.createDataFrame([], "src string, ts string, utc_us string")
    assert normalise_timestamps(d, "ts", "src").count() == 0
    d = spark.createDataFrame([("a", "2025-06-01T00:00:00Z", "x")] * 2, "src string, ts string, utc_us string")
    assert [r["utc_us"] for r in normalise_timestamps(d, "ts", "src").collect()] == [us(2025, 6, 1)] * 2
