"""Text functions as Column expressions; all stay in the JVM but for the full HTML unescape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import lexicon

#: White space of Unicode; \s alone is ASCII in Java.
SPACE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(c: Column) -> Column:
    """Common entities resolved, tags removed, white space collapsed; '' for null. One level of escapes is resolved."""
    out = F.coalesce(c, F.lit(""))
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return trimmed(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", ""), f"[{SPACE}]+", " "))


def html_unescape(c: Column) -> Column:
    """All named and numeric character references resolved, in Arrow batches."""

    @F.pandas_udf("string")
    def unescape(texts):  # type: ignore[no-untyped-def]
        import html

        return texts.map(lambda t: None if t is None else html.unescape(t))

    return unescape(c)


def html_escape(c: Column) -> Column:
    """&, <, >, double and single quotes as references."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def title_key(title: Column, noise: Sequence[str] = lexicon.TITLE_NOISE, clean: bool = True) -> Column:
    """Lower case without signs and white space, and without one word of noise at the end."""
    base = F.lower(clean_text(title) if clean else F.coalesce(title, F.lit("")))
    return F.regexp_replace(F.regexp_replace(base, f"[{lexicon.TITLE_SIGNS}{SPACE}]+", ""), f"({'|'.join(noise)})$", "")


def _has(text: Column, low: Column, term: str) -> Column:
    """Whether a term occurs, letter case aside; only terms with cased letters need the text in lower case."""
    return F.contains(text, F.lit(term)) if term.lower() == term.upper() else F.contains(low, F.lit(term.lower()))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur in the text, letter case aside, in the list's order; one column of the scan, no join."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(_has(text, low, t), F.lit(t)) for t in terms)))


def hit_count(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    plain = [t for t in terms if t.lower() == t.upper()]
    cased = [F.contains(F.lower(text), F.lit(t.lower())).cast("int") for t in terms if t not in plain]
    # a loop over a constant array is quicker than as many expressions
    parts = ([F.size(F.filter(F.array(*map(F.lit, plain)), lambda t: F.contains(text, t)))] if plain else []) + cased
    return sum(parts[1:], parts[0])


def capped(text: Column, terms: Sequence[str], each: int, most: int) -> Column:
    """Points per term that occurs, up to a most."""
    return F.least(F.lit(most), hit_count(text, terms) * each)


def shortened(text: Column, limit: int, drop: str | None = None) -> Column:
    """White space collapsed, a pattern dropped, cut to `limit` characters plus dots."""
    out = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    if drop:
        out = trimmed(F.regexp_replace(out, drop, ""))
    return F.when(F.length(out) > limit, F.concat(F.regexp_replace(F.substring(out, 1, limit), f"[{SPACE}]+$", ""), F.lit("..."))).otherwise(out)


def looks_mojibake(text: Column, signs: str = lexicon.MOJIBAKE_SIGNS, least: int = 4) -> Column:
    """Whether at least so many characters are typical of a wrong decoding."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{signs}]")) >= least


def url_date(url: Column) -> Column:
    """The date of a path part /20YYMMDD/, null if there is none or it is impossible."""
    digits = F.regexp_extract(url, r"/(20\d{6})/", 1)
    return F.when(digits != "", F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def crawl_time(day: Column, clock: Column) -> Column:
    """A clock time HH:MM or HH-MM on a day, without zone; midnight if it is missing or impossible."""
    hm = F.replace(F.coalesce(clock, F.lit("00:00")), F.lit("-"), F.lit(":"))
    valid = hm.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.concat(day.cast("string"), F.lit(" "), F.when(valid, hm).otherwise(F.lit("00:00")), F.lit(":00")).cast("timestamp_ntz")


def positive(value: Column) -> Column:
    """A whole number over zero, or null."""
    number = value.try_cast("int")
    return F.when(number > 0, number)


def iso_time(value: Column, day: Column, clock: Column) -> Column:
    """An ISO date-time, its zone dropped and not converted; a clock time on a day where there is none."""
    plain = F.regexp_replace(value, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    iso = plain.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$")
    return F.coalesce(F.when(iso, plain.try_cast("timestamp_ntz")), crawl_time(day, clock))


def zone_day(instant: Column, zone: Column, default: str = "Asia/Shanghai") -> Column:
    """The date that a named zone has at an instant in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.coalesce(zone, F.lit(default)), instant.cast("timestamp_ntz")).cast("date")


def change_class(change: Column, least: float = 0.0001) -> Column:
    """up, down or flat; flat without a number."""
    return F.when(change > least, "up").when(change < -least, "down").otherwise("flat")


def signed(change: Column, digits: int = 2) -> Column:
    """A number with its sign and so many digits; a dash without one."""
    size = F.format_number(F.abs(change), digits)
    return F.coalesce(F.concat(F.when(change > 0, "+").when(change < 0, "-").otherwise(""), size), F.lit("-"))
