"""Parsing of timestamps in mixed formats: one parser per shape, applied to all values of the shape at once.

A value's shape mask replaces every digit by 0 and every Latin letter by a. All values of a mask have their fields at
the same places, so `compile_mask` works the places out once and `parse_shape` reads them from a character matrix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from newsloom.functions.zones import US, wall_to_utc

DAY_US = 86400 * US
#: Abbreviations of zones in mail dates, with their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AEST": 600, "AEDT": 660,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())} | {
    m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())
}
#: Chinese words for parts of the day; hours under 12 after the second kind are past noon.
MORNING, EVENING = ("凌晨", "清晨", "早上", "上午"), ("中午", "下午", "傍晚", "晚上")


@dataclass(frozen=True)
class Shape:
    """Places of the fields in a mask: (start, end), or None."""

    kind: str  # date, clock, epoch
    year: tuple[int, int] | None = None
    month: tuple[int, int] | None = None
    day: tuple[int, int] | None = None
    name: tuple[int, int] | None = None  # month's name
    slash: bool = False  # the order of month and day is the source's
    hour: tuple[int, int] | None = None
    minute: tuple[int, int] | None = None
    second: tuple[int, int] | None = None
    fraction: tuple[int, int] | None = None
    half: tuple[int, int] | None = None  # AM, PM
    part: str | None = None  # Chinese part of the day
    sign: int | None = None  # place of the offset's sign
    off_hour: tuple[int, int] | None = None
    off_minute: tuple[int, int] | None = None
    zone: tuple[int, int] | None = None  # abbreviation or IANA name
    letter: int | None = None  # place of the T between date and time
    unit: int = 0  # microseconds of an epoch's unit


_PART = "|".join(MORNING + EVENING)
_ZONE = r"(?:\s*(?P<sign>[+\-−])(?P<oh>00):?(?P<om>00)|\s*\[(?P<zone>a[a/_+\-0]*)\]|\s*(?P<zone2>a[a/_]*))?"
_TIME = rf"(?P<part>{_PART})?\s*(?P<hour>0{{1,2}})[:：](?P<minute>00)(?:[:：](?P<second>00)(?:[.,](?P<fraction>0{{1,9}}))?)?(?:\s*(?P<half>aa)(?![a/_]))?"
_SHAPES = [
    ("date", rf"(?P<year>0000)-(?P<month>0{{1,2}})-(?P<day>0{{1,2}})(?:(?P<letter>a)|\s+){_TIME}{_ZONE}"),
    ("date", rf"(?P<year>0000)/(?P<month>0{{1,2}})/(?P<day>0{{1,2}})\s+{_TIME}{_ZONE}"),
    ("slash", rf"(?P<month>0{{1,2}})/(?P<day>0{{1,2}})/(?P<year>0000),?\s+{_TIME}{_ZONE}"),
    ("date", rf"(?P<day>0{{1,2}})\.(?P<month>0{{1,2}})\.(?P<year>0000),?\s+{_TIME}{_ZONE}"),
    ("date", rf"(?P<year>0000)年(?P<month>0{{1,2}})月(?P<day>0{{1,2}})日\s*{_TIME}{_ZONE}"),
    ("date", rf"(?P<year>0000)年(?P<month>0{{1,2}})月(?P<day>0{{1,2}})日\s*(?P<part>{_PART})?(?P<hour>0{{1,2}})[时点](?P<minute>00)分(?:(?P<second>00)秒)?"),
    ("date", rf"(?:a{{3,9}},?\s+)?(?P<day>0{{1,2}})\s+(?P<name>a{{3,9}})\s+(?P<year>0000),?\s+{_TIME}{_ZONE}"),
    ("date", rf"(?:a{{3,9}},\s+)?(?P<name>a{{3,9}})\s+(?P<day>0{{1,2}}),\s+(?P<year>0000),?\s+{_TIME}{_ZONE}"),
    ("date", r"(?P<year>0000)(?P<month>00)(?P<day>00)(?P<letter>a)(?P<hour>00)(?P<minute>00)(?P<second>00)?" + _ZONE),
    ("date", r"(?P<year>0000)(?P<month>00)(?P<day>00)(?P<hour>00)(?P<minute>00)(?P<second>00)"),
    ("clock", _TIME),
    ("clock", r"(?P<hour>0{1,2})-(?P<minute>00)"),
    ("clock", rf"(?P<part>{_PART})?(?P<hour>0{{1,2}})[时点](?P<minute>00)分(?:(?P<second>00)秒)?"),
]
_SHAPES = [(k, re.compile(p)) for k, p in _SHAPES]
_EPOCHS = {9: US, 10: US, 12: 1000, 13: 1000, 15: 1, 16: 1}


@lru_cache(maxsize=100_000)
def compile_mask(mask: str) -> Shape | None:
    """The parser of a mask, or None if values of the shape denote no instant."""
    if not mask.strip("0") and len(mask) in _EPOCHS:
        return Shape("epoch", unit=_EPOCHS[len(mask)])
    for kind, pattern in _SHAPES:
        if m := pattern.fullmatch(mask):
            g = m.groupdict()
            at = lambda k: m.span(k) if g.get(k) else None  # noqa: B023, E731
            return Shape(
                "date" if kind == "slash" else kind, at("year"), at("month"), at("day"), at("name"), kind == "slash", at("hour"), at("minute"), at("second"),
                at("fraction"), at("half"), g.get("part"), m.start("sign") if g.get("sign") else None, at("oh"), at("om"), at("zone") or at("zone2"),
                m.start("letter") if g.get("letter") else None,
            )
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    return (y - 1970).astype("datetime64[Y]").astype("datetime64[M]").__add__(m - 1).astype("datetime64[D]").astype("int64") + d - 1


def parse_shape(shape: Shape, values: np.ndarray, day: np.ndarray | None, zones: np.ndarray, day_first: np.ndarray, default_zone: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of values of one mask, and which of them are valid.

    day: days since 1970 on which a clock time alone is meant, or None; zones: each row's own zone, or None.
    """
    n = len(values)
    chars = np.array(values, "U").view("uint32").reshape(n, -1)
    ok = np.ones(n, bool)

    def number(at: tuple[int, int] | None, otherwise: int = 0) -> np.ndarray:
        out = np.zeros(n, "int64")
        if at is None:
            return out + otherwise
        for i in range(*at):
            out = out * 10 + (chars[:, i].astype("int64") - 48)
        return out

    def text(at: tuple[int, int]) -> np.ndarray:
        return np.ascontiguousarray(chars[:, at[0] : at[1]]).view(f"U{at[1] - at[0]}").ravel()

    if shape.kind == "epoch":
        return number((0, chars.shape[1])) * shape.unit, ok
    if shape.letter is not None:
        ok &= np.isin(chars[:, shape.letter], [ord("T"), ord("t")])
    hour, minute, second = number(shape.hour), number(shape.minute), number(shape.second)
    if shape.half is not None:
        half = np.char.lower(text(shape.half))
        ok &= np.isin(half, ["am", "pm"]) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == "pm")
    elif shape.part in EVENING:
        ok &= (hour >= 1) & (hour <= 23)
        hour = np.where(hour < 12, hour + 12, hour)
    elif shape.part in MORNING:
        ok &= hour <= 12
        hour = hour % 12
    ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
    fraction = 0
    if shape.fraction is not None:
        width = shape.fraction[1] - shape.fraction[0]
        fraction = number(shape.fraction) * US // 10**width
    if shape.kind == "clock":
        if day is None:
            return np.zeros(n, "int64"), np.zeros(n, bool)
        ok &= day > np.iinfo("int32").min
        days = np.where(ok, day, 0)
    else:
        y, d = number(shape.year), number(shape.day)
        if shape.name is not None:
            names, back = np.unique(np.char.lower(text(shape.name)), return_inverse=True)
            m = np.array([MONTHS.get(x, 0) for x in names], "int64")[back]
        else:
            m = number(shape.month)
        if shape.slash:
            m, d = np.where(day_first, d, m), np.where(day_first, m, d)
        ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
        y, m, d = np.where(ok, y, 1970), np.where(ok, m, 1), np.where(ok, d, 1)
        first = _days(y, m, np.ones(n, "int64"))
        ok &= d <= _days(y + (m == 12), m % 12 + 1, np.ones(n, "int64")) - first
        days = first + d - 1
    wall = days * DAY_US + ((hour * 60 + minute) * 60 + second) * US + fraction
    if shape.sign is not None:
        oh, om = number(shape.off_hour), number(shape.off_minute)
        ok &= (oh <= 18) & (om <= 59)
        sign = np.where(chars[:, shape.sign] == ord("+"), 1, -1)
        return wall - sign * (oh * 60 + om) * 60 * US, ok
    named = text(shape.zone) if shape.zone is not None else np.array([z if z else default_zone for z in zones], "U")
    out = np.zeros(n, "int64")
    for z in np.unique(named):
        at = named == z
        if shape.zone is not None and z.upper() in ABBREVIATIONS:
            out[at] = wall[at] - ABBREVIATIONS[z.upper()] * 60 * US
            continue
        utc = wall_to_utc(wall[at], str(z))
        if utc is None and shape.zone is None:
            utc = wall_to_utc(wall[at], default_zone)
        if utc is None:
            ok &= ~at
        else:
            out[at] = utc
    return out, ok
