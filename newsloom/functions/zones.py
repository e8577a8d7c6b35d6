"""Zone transition tables for vectorised conversion of wall times.

A table holds, per IANA zone, the instants at which the offset from UTC changes. It is derived from the zone database
that is installed, whose version `zone_version()` names, so that a result can be traced to its rules. Tables are made for
the years that a batch of values spans, SPAN years at a time. Rules repeat with the calendar, every 400 years, and the
first offset of a zone holds for all time before it, so there is no year that they don't cover.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

US = 1_000_000
#: Years of one table; the first and the last year for which tables are made (before it a zone has its first offset, after
#: it rules repeat every CYCLE years); seconds of those.
SPAN, FIRST_YEAR, LAST_YEAR, CYCLE = 50, 1800, 2500, 400
CYCLE_S = 146_097 * 86_400


def zone_version() -> str:
    """Version of the zone database behind the tables: the installed package's, else the system's, else a digest of its rules."""
    import hashlib
    import zoneinfo
    from importlib.metadata import PackageNotFoundError, version
    from pathlib import Path

    roots = [Path(p) for p in zoneinfo.TZPATH if (Path(p) / "UTC").exists()]
    if not roots:
        try:
            return version("tzdata")
        except PackageNotFoundError:
            return "none"
    for name in ("tzdata.zi", "+VERSION"):
        if (roots[0] / name).exists():
            return (roots[0] / name).read_text().split("\n")[0].replace("# version ", "")
    rules = b"".join(p.read_bytes() for z in ("Europe/London", "America/New_York", "Asia/Shanghai", "Africa/Casablanca") if (p := roots[0] / z).exists())
    return "rules " + hashlib.sha256(rules).hexdigest()[:12]


def _year_start(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


@lru_cache(maxsize=4096)
def _span(zone: str, year: int) -> tuple[list[int], list[int]] | None:
    """(instants, offsets: one more) of the SPAN years from a year on."""
    try:
        tz = ZoneInfo(zone)
    except Exception:
        return None

    def offset(s: int) -> int:
        return int(datetime.fromtimestamp(s, timezone.utc).astimezone(tz).utcoffset().total_seconds())

    lo, hi = _year_start(year), _year_start(year + SPAN)
    step = 7 * 86400
    instants, offsets = [], [offset(lo)]
    for s in range(lo, hi, step):
        to = min(s + step, hi)
        if offset(to) != offsets[-1]:
            a, b = s, to
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if offset(m) == offsets[-1] else (a, m)
            instants.append(b)
            offsets.append(offset(b))
    return instants, offsets


@lru_cache(maxsize=4096)
def transitions(zone: str, first: int = 1970, last: int = 2037) -> tuple[np.ndarray, np.ndarray] | None:
    """(change instants in seconds, offsets in seconds: one more than the instants) over years, or None for an unknown zone."""
    instants: list[int] = []
    offsets: list[int] = []
    for year in range(first - first % SPAN, last + 1, SPAN):
        if (part := _span(zone, year)) is None:
            return None
        instants += part[0]
        offsets += part[1][1:] if offsets else part[1]
    return np.array(instants, "int64"), np.array(offsets, "int64")


def wall_to_utc(wall_us: np.ndarray, zone: str) -> np.ndarray | None:
    """UTC microseconds of wall times in a zone.

    A wall time that occurs twice means its first occurrence, one that a change skipped moves forward by the gap: in
    both cases the offset before the change holds up to the later of the change's two wall readings.
    """
    years = wall_us.astype("datetime64[us]").astype("datetime64[Y]").astype("int64") + 1970
    turns = np.where(years >= LAST_YEAR - 1, (years - (LAST_YEAR - CYCLE)) // CYCLE, 0)
    wall = wall_us - turns * CYCLE_S * US
    near = np.clip(years - turns * CYCLE, FIRST_YEAR, LAST_YEAR - 1)
    t = transitions(zone, int(near.min()), int(near.max()) + 1) if len(near) else transitions(zone)
    if t is None:
        return None
    instants, offsets = t
    until = (instants + np.maximum(offsets[:-1], offsets[1:])) * US
    return wall_us - offsets[np.searchsorted(until, wall, side="right")] * US
