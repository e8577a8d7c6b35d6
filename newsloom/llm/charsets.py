"""Text decoded with a wrong character encoding: hypotheses about what happened, and their inverses.

A chain names the encoding that the bytes were in and the one they were read by. Its inverse is applied to the spans of
a text that are images of such a reading, so a text may be garbled in part and by several passes.
"""

from __future__ import annotations

from functools import lru_cache

import regex

REPLACEMENT = "�"
#: What two replacement characters become where their UTF-8 is read as GBK.
REPLACED_AS_GBK = (REPLACEMENT * 2).encode("utf-8").decode("gbk")
#: UTF-8 sequences of two to four bytes, as Latin-1 characters.
_UTF8 = regex.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: What restored characters may be: Latin-1 signs and letters, Greek and Cyrillic letters, punctuation, CJK, emoji.
_PLAUSIBLE = regex.compile(r"[\x00-\x7f -ÿͰ-ϿЀ-џ -⁯€№™☀-➿　-〿一-鿿️＀-￯\U0001f000-\U0001faff]*+")
#: Accented letters of the Latin texts of this domain; others don't come out of Chinese characters.
_ACCENTED = frozenset("ÀÁÂÃÄÅÇÈÉÊÑÒÓÔÕÖØÙÚÛÜßàáâãäåçèéêñòóôõöøùúûü")
_ODD = regex.compile(r"[\u0080-ÿŒœŠšŸŽžƒˆ˜Ѐ-џҐґ–-›€№™�]")
_ASSIGNED = regex.compile(r"[^\p{C}]*+")
_CONTROLS = regex.compile("[\x80-\x9f]")


@lru_cache(maxsize=None)
def _images(codec: str) -> tuple[dict[int, str], regex.Pattern]:
    """Translation of a codec's characters of bytes 128 to 255 to these, and a pattern of their runs.

    Bytes that the codec leaves undefined were passed on as control characters.
    """
    to = {}
    for b in range(128, 256):
        try:
            to[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
        if b < 160:
            to.setdefault(b, chr(b))
    return to, regex.compile("[" + "".join(regex.escape(chr(c), special_only=False) for c in to) + "]+")


def _utf8_read_as(codec: str, letters: bool = False):
    def undo(text: str) -> str:
        to, runs = _images(codec)

        def run(m: regex.Match) -> str:
            now = m[0]
            while True:  # a text may have been garbled several times; each undoing shortens it
                raw = now.translate(to)
                if not _UTF8.fullmatch(raw):
                    break
                try:
                    now = raw.encode("latin-1").decode("utf-8")
                except UnicodeError:
                    break
                if not runs.fullmatch(now):
                    break
            if now == m[0] or not _PLAUSIBLE.fullmatch(now) or _CONTROLS.search(now):
                return m[0]
            # two letters of a script of its own make a sequence by chance; an accent, CJK or a longer run doesn't
            return now if not letters or len(now) > 3 or any(c in _ACCENTED or c >= "‐" for c in now) else m[0]

        return runs.sub(run, text)

    return undo


def _utf8_read_as_gbk(text: str) -> str:
    try:
        back = text.encode("gbk").decode("utf-8")
    except UnicodeError:
        return text
    new = [c for c in back if c > "\x7f"]
    if not new or not _PLAUSIBLE.fullmatch(back) or any("\x80" <= c < "Ͱ" and c not in _ACCENTED for c in new) or not any(c in _ACCENTED or c >= "‐" for c in new):
        return text
    return back


_WESTERN = regex.compile(r"[\x00-\xffŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]+")
_HIGH = regex.compile(r"[^\x00-\x7f]+")


def _gbk_read_as_western(text: str) -> str:
    to, _ = _images("cp1252")

    def span(m: regex.Match) -> str:
        runs = [len(r) for r in _HIGH.findall(m[0])]
        # accents of a Latin text stand alone, the images of Chinese text in runs
        if not runs or max(runs) < 4 or sum(r for r in runs if r > 2) < 0.6 * sum(runs):
            return m[0]
        try:
            now = m[0].translate(to).encode("latin-1").decode("gbk")
        except UnicodeError:
            return m[0]
        new = [c for c in now if c > "\x7f"]
        cjk = sum("一" <= c <= "鿿" for c in new)
        return now if new and cjk >= 0.6 * len(new) else m[0]

    return _WESTERN.sub(span, text)


#: name -> inverse. Order settles ties of support.
CHAINS = {
    "utf-8 as cp1252": _utf8_read_as("cp1252"),
    "utf-8 as cp1251": _utf8_read_as("cp1251", letters=True),
    "gbk as cp1252": _gbk_read_as_western,
    "utf-8 as gbk": _utf8_read_as_gbk,
}


@lru_cache(maxsize=16)
def _learned(table: tuple[tuple[int, int], ...]) -> tuple[regex.Pattern, dict[int, str]]:
    return regex.compile("[" + "".join(regex.escape(chr(c), special_only=False) for c, _ in table) + "]+"), {c: chr(b) for c, b in table}


def undone_by(table: tuple[tuple[int, int], ...], text: str) -> str:
    """The text with its runs of a learned table's characters read as the UTF-8 bytes that the table gives them."""
    runs, to = _learned(table)

    def run(m: regex.Match) -> str:
        raw = m[0].translate(to)
        if not _UTF8.fullmatch(raw):
            return m[0]
        try:
            now = raw.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]
        return now if _ASSIGNED.fullmatch(now) else m[0]

    return runs.sub(run, text)


@lru_cache(maxsize=1)
def single_byte_codecs() -> dict[str, dict[int, int]]:
    """Every codec of the standard library that reads one byte as one character: characters of bytes 128 to 255 to these."""
    from encodings.aliases import aliases

    out = {}
    for name in sorted(set(aliases.values())):
        try:
            if all(len(bytes([b]).decode(name)) == 1 and bytes([b]).decode(name) == chr(b) for b in range(32, 127)):
                out[name] = {ord(c): b for b in range(128, 256) if len(c := bytes([b]).decode(name, "ignore")) == 1 and ord(c) > 127}
        except (LookupError, UnicodeError, TypeError, AttributeError):
            continue
    return {name: t for name, t in out.items() if len(t) > 64}


def completed(learned: dict[int, int]) -> dict[int, int]:
    """A learned table with what all codecs that have the whole of it agree on besides; as it is if none has."""
    having = [t for t in single_byte_codecs().values() if all(t.get(c) == b for c, b in learned.items())]
    return learned | {c: b for c, b in having[0].items() if all(t.get(c) == b for t in having)} if having else learned


def explanations(text: str) -> dict[str, str]:
    """Every chain that explains the text as garbled, with what it makes of it."""
    if text.isascii():
        return {}
    out = {}
    for name, undo in CHAINS.items():
        if (back := undo(text)) != text:
            out[name] = back
    return out


def is_lost(text: str) -> bool:
    """Whether characters are gone for good: replacement characters, also read as GBK, or control characters."""
    return REPLACEMENT in text or REPLACED_AS_GBK in text or bool(_CONTROLS.search(text))


def is_garbled(text: str) -> bool:
    """Whether a text, or part of it, was decoded with a wrong encoding."""
    if text.isascii():
        return False
    if is_lost(text):
        return True
    if _ODD.search(text) and any(CHAINS[c](text) != text for c in ("utf-8 as cp1252", "utf-8 as cp1251", "gbk as cp1252")):
        return True
    return _utf8_read_as_gbk(text) != text
