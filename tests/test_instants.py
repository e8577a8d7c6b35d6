import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from newsloom.functions.instants import compile_mask
from newsloom.functions.zones import transitions, wall_to_utc, zone_version
from newsloom.operators.instants import utc_instants

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*a, tz=timezone.utc):
    return int((datetime(*a, tzinfo=tz) - EPOCH).total_seconds() * 1_000_000)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Shanghai", "Australia/Lord_Howe", "UTC"])
def test_walls_like_the_standard_library(zone):
    rng, tz = random.Random(zone), ZoneInfo(zone)
    walls = [datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(3 * 365 * 86400)) for _ in range(3000)]
    got = wall_to_utc(np.array([int((w.replace(tzinfo=timezone.utc) - EPOCH).total_seconds()) * 1_000_000 for w in walls]), zone)
    # fold=0: the first of two, and the offset before a gap
    assert got.tolist() == [int((w.replace(tzinfo=tz).astimezone(timezone.utc) - EPOCH).total_seconds()) * 1_000_000 for w in walls]


@pytest.mark.parametrize("zone", ["Europe/London", "Europe/Berlin", "Asia/Shanghai", "America/New_York"])
def test_walls_of_all_years(zone):
    rng, tz = random.Random(zone), ZoneInfo(zone)
    walls = [datetime(y, m, 1 + rng.randrange(28), rng.randrange(24), 30) for y in (1, 1850, 1900, 1941, 1945, 1947, 1968, 1969, 1999, 2037, 2099, 2150, 2400, 2499, 2500, 3000, 9990) for m in range(1, 13)]
    micros = [(w.replace(tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1) for w in walls]
    want = [m - round(tz.utcoffset(w).total_seconds() * 1_000_000) for m, w in zip(micros, walls)]
    assert wall_to_utc(np.array(micros), zone).tolist() == want
    # a value alone is read like in company
    assert [int(wall_to_utc(np.array([m]), zone)[0]) for m in micros[::17]] == want[::17]


def test_unknown_zone_and_version():
    assert transitions("Nowhere/Land") is None and wall_to_utc(np.array([0]), "Nowhere/Land") is None and zone_version()


def test_masks():
    assert compile_mask("0000-00-00a00:00:00a").kind == "date" and compile_mask("00-00").kind == "clock"
    assert compile_mask("0000000000").unit == 1_000_000 and compile_mask("0000000000000000").unit == 1
    assert compile_mask("0000小时前") is None and compile_mask("aaaaaaaaa") is None and compile_mask("00000000") is None


CASES = [
    ("2025-10-26T02:30:00", "Europe/Berlin", False, us(2025, 10, 26, 0, 30)),  # twice: the first
    ("2026-03-29 02:30", "Europe/Berlin", False, us(2026, 3, 29, 1, 30)),  # skipped: forward by the gap
    ("2026-03-08T07:00:00Z", None, False, us(2026, 3, 8, 7)),
    ("2026-01-08T02:30:00+05:30", None, False, us(2026, 1, 7, 21)),
    ("2025-10-18T06:41:00-09:30", None, False, us(2025, 10, 18, 16, 11)),
    ("Mon, 06 Oct 2025 20:41:42 +0800", None, False, us(2025, 10, 6, 12, 41, 42)),
    ("Sun, 05 Oct 2025 22:11:30 EDT", None, False, us(2025, 10, 6, 2, 11, 30)),
    ("11.2.2026 16:26 +00:00", None, False, us(2026, 2, 11, 16, 26)),
    ("12/02/2026 18:21", "UTC", True, us(2026, 2, 12, 18, 21)),
    ("12/02/2026 6:21 PM", "UTC", False, us(2026, 12, 2, 18, 21)),
    ("13/02/2026 18:21", "UTC", False, None),
    ("1757000000", None, False, 1757000000 * 10**6),
    ("1757000000123", None, False, 1757000000123 * 1000),
    ("1757000000123456", None, False, 1757000000123456),
    ("20251006020537", "UTC", False, us(2025, 10, 6, 2, 5, 37)),
    ("20251006T020537Z", None, False, us(2025, 10, 6, 2, 5, 37)),
    ("2025年10月9日 00:39", None, False, us(2025, 10, 8, 16, 39)),
    ("2025年10月07日下午7:09", None, False, us(2025, 10, 7, 11, 9)),
    ("上午12:05", "UTC", False, us(2026, 1, 2, 0, 5)),
    ("12:15 AM", "UTC", False, us(2026, 1, 2, 0, 15)),
    ("04时03分", "UTC", False, us(2026, 1, 2, 4, 3)),
    ("08-44", "UTC", False, us(2026, 1, 2, 8, 44)),
    ("09:16:08", "Mars/Base", False, us(2026, 1, 2, 1, 16, 8)),
    ("2025-11-11T14:00:00[Asia/Tokyo]", None, False, us(2025, 11, 11, 5)),
    ("2025-11-01 03:37:36 America/New_York", None, False, us(2025, 11, 1, 7, 37, 36)),
    ("2025-12-31 09:57:00,583940", "UTC", False, us(2025, 12, 31, 9, 57) + 583940),
    (" Feb 10, 2026 5:37 AM ", "UTC", False, us(2026, 2, 10, 5, 37)),
    ("26 Feb 2026 19:58", "UTC", False, us(2026, 2, 26, 19, 58)),
    *((v, "UTC", False, None) for v in ("", "   ", "-", "yesterday", "3小时前", "2025-02-30 10:00:00", "2025-11-31 08:15", "25:61", "24-70", "0000-00-00 00:00:00", "2026-13-01T00:00:00Z", "13:05 PM", "N/A", None)),
]


def test_values(spark):
    sources = spark.createDataFrame([(f"s{i}", z, f) for i, (_, z, f, _) in enumerate(CASES)], "id string, tz string, day_first boolean")
    rows = [(i, f"s{i}", v, date(2026, 1, 2), "x") for i, (v, _, _, _) in enumerate(CASES)]
    # redelivered rows, and columns with the names that the operator uses itself
    df = spark.createDataFrame(rows + rows[:5], "row_id long, src string, v string, d date, utc_us string")
    got = {r.row_id: r.utc_us for r in utc_instants(df, "row_id", ["v"], sources, "src", "d").collect()}
    assert got == {i: want for i, (_, _, _, want) in enumerate(CASES) if want is not None}


def test_unknown_source_no_date_and_empty(spark):
    sources = spark.createDataFrame([], "id string, tz string, day_first boolean")
    df = spark.createDataFrame([(1, None, "2026-01-01 08:00"), (2, "?", "08:00"), (None, "?", "2026-01-01 08:00")], "i long, s string, v string")
    got = {(r.row_id, r.utc_us) for r in utc_instants(df, "i", ["v"], sources, "s").collect()}
    assert got == {(1, us(2026, 1, 1)), (None, us(2026, 1, 1))}
    assert utc_instants(df.limit(0), "i", ["v"], sources, "s").count() == 0
