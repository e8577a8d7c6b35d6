"""One consistent form for text that is written with look-alike or invisible characters.

A transducer, compiled as a trie when the module loads, reads a text once, grapheme cluster by grapheme cluster. At each
place it takes the longest key of a mapping that begins there; keys may have several characters (decomposed accents,
half-width kana with their marks). The mapping is made by rule from the character database: widths, fonts, Roman
numerals, ligatures, radicals, canonical forms, spaces, hyphens. Letters of other scripts are arcs that a word opens when
it ends: a word that mixes scripts is brought to one, a word of look-alikes alone waits until the text's end shows
whether the text has a script of its own. The mapping is conflict-checked with all arcs: no key has two images, and every
image is a fixed point.
"""

from __future__ import annotations

import unicodedata

import regex

#: Letters of other scripts and the Latin letters that they look like.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјԛԝһкмтвн", "ABEKMHOPCTYXSIJQWaeopcyxsijqwhkmtbh"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυκιχγ", "ABEZHIKMNOPTYXavopukixy"))
#: Phonetic letters and the Latin letters that they look like.
PHONETIC = {"ɡ": "g", "ɑ": "a"}
#: Simplified and other radicals that normalisation forms leave alone, and the characters they look like.
RADICALS = dict(zip("⺁⺄⺈⺊⺌⺍⺗⺝⺟⺠⺩⺪⺬⺭⺮⺯⺶⺷⺸⺻⺾⺿⻁⻄⻅⻆⻉⻋⻍⻎⻏⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻨⻩⻫⻬⻮⻰⻳", "厂乙刀卜小小心月母民王疋示示竹糸羊羊羊聿艹艹虎西见角贝车辶辶邑长长长门阜雨青韦页风飞食饣饣马骨鬼鱼鸟麦黄齐齐齿龙龟"))
#: Signs of full width that Chinese text uses as its own.
CHINESE_SIGNS = frozenset("，。、；：！？（）【】《》〈〉「」『』〔〕“”‘’…—～｜·￥　")
SPACES = frozenset("               ")
HYPHENS = frozenset("‐‑−﹣－")
_INVISIBLE = regex.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_PICTURE = regex.compile(r"\p{Extended_Pictographic}|[\U0001f1e6-\U0001f1ff]|⃣")
_JOINED = regex.compile(r"(?<=[\p{Extended_Pictographic}️\U0001f3fb-\U0001f3ff])‍(?=\p{Extended_Pictographic})")
_JOINING_SCRIPTS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Gurmukhi}\p{Kannada}\p{Malayalam}\p{Oriya}\p{Sinhala}\p{Tamil}\p{Telugu}\p{Khmer}\p{Mongolian}\p{Syriac}]")
#: Kinds of compatibility forms that a reader takes for the plain characters, and ranges of other kinds that are so as well.
_FORMS, _RANGES = ("<wide>", "<narrow>", "<font>"), ((0x2160, 0x217F), (0x2F00, 0x2FD5), (0xFB00, 0xFB06))
_PLAIN, _KEEP = regex.compile(r"[\x20-\x7e一-鿿，。、；：！？（）【】《》“”｜·…—]*+"), regex.compile(r"[^\p{L}\p{Nd}]+")
_WORD = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Nd}\p{M}\-]+")
_FOREIGN, _LATIN, _JAMO = regex.compile(r"[\p{Greek}\p{Cyrillic}]"), regex.compile(r"\p{Latin}"), regex.compile("[\u1100-\u11ff]")
_MARKS = regex.compile(r"\p{M}")
_ARC = regex.compile(rf"[\p{{Greek}}\p{{Cyrillic}}{''.join(PHONETIC)}]")
#: Arcs of letters: to Latin in words that mix scripts, and back for a Latin letter inside a word of Cyrillic.
TO_LATIN = {**CYRILLIC, **GREEK}
TO_CYRILLIC = {CYRILLIC[c]: c for c in "АВЕКМНОРСТХаеорсух"}


def build_mapping() -> dict[str, str]:
    """The mapping. Raises ValueError if two rules conflict or an image isn't a fixed point."""
    out: dict[str, str] = {}

    def add(key: str, image: str) -> None:
        if out.setdefault(key, image) != image:
            raise ValueError(f"two images for {key!a}")

    for code in range(0x80, 0x20000):
        c = chr(code)
        made = unicodedata.decomposition(c)
        if not made or c in CHINESE_SIGNS or c in HYPHENS or c in SPACES or _INVISIBLE.match(c) or _PICTURE.match(c):
            continue
        if made[0] != "<":
            plain = unicodedata.normalize("NFC", c)
            if plain != c:
                add(c, plain)
            elif " " in made:
                # decomposed in one step, and wholly
                add("".join(chr(int(x, 16)) for x in made.split()), c)
                add(unicodedata.normalize("NFD", c), c)
        elif made.startswith(_FORMS) or any(lo <= code <= hi for lo, hi in _RANGES):
            plain = unicodedata.normalize("NFKC", c)
            if not _INVISIBLE.search(plain):
                add(c, plain)
    for base in map(chr, range(0xFF66, 0xFF9E)):
        for mark in "ﾞﾟ":
            if len(plain := unicodedata.normalize("NFKC", base + mark)) == 1:
                add(base + mark, plain)
    for c, to in RADICALS.items():
        add(c, to)
    for c in SPACES:
        add(c, " ")
    for c in HYPHENS:
        add(c, "-")
    for c, to in {**TO_LATIN, **PHONETIC}.items():
        if c in out or to in out:
            raise ValueError(f"the arc of {c!a} meets a rule")
    for c, to in out.items():
        if any(to[i:j] in out for i in range(len(to)) for j in range(i + 1, len(to) + 1)):
            raise ValueError(f"the image of {c!a} isn't a fixed point")
    return out


class Transducer:
    """A mapping compiled as a trie: node = [image or None, {character: node}]."""

    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping, self.root = mapping, [None, {}]
        for key, image in mapping.items():
            node = self.root
            for c in key:
                node = node[1].setdefault(c, [None, {}])
            node[0] = image
        single = "".join(regex.escape(k, special_only=False) for k in mapping if len(k) == 1)
        several = "|".join(regex.escape(k, special_only=False) for k in mapping if len(k) > 1 and not any(_MARKS.match(c) for c in k[1:]))
        # characters that no key begins with and that nothing extends are taken in runs
        heads = {k[0] for k in mapping if len(k) > 1 and not any(_MARKS.match(c) for c in k[1:])}
        runs = [{c for c in map(chr, range(0x20, 0x100)) if c.isprintable() and bool(_WORD.match(c)) == word and c not in mapping} - heads for word in (True, False)]
        runs = ["".join(regex.escape(c, special_only=False) for c in sorted(r)) for r in runs]
        extend = r"(?![\p{M}\u200c\u200d\uff9e\uff9f\U000e0000-\U000e0fff])"
        chinese = "".join(sorted(CHINESE_SIGNS - heads))
        self.token = regex.compile(rf"(?P<w>[{runs[0]}]+{extend})|(?P<o>[{runs[1]}{chinese}{'' if heads & set(map(chr, range(0x4E00, 0xA000))) else '一-鿿'}]+{extend})|\X")
        #: Where a text may change: texts without any such place are left at once.
        self.place = regex.compile(rf"[{single}{''.join(PHONETIC)}\p{{M}}\p{{Greek}}\p{{Cyrillic}}\u1100-\u11ff]|{_INVISIBLE.pattern}" + (f"|{several}" if several else ""))

    def longest(self, text: str, at: int) -> tuple[int, str | None]:
        """Where the longest key that begins at a place ends, and its image; (at, None) without one."""
        node, end, image = self.root, at, None
        for i in range(at, len(text)):
            if (node := node[1].get(text[i])) is None:
                break
            if node[0] is not None:
                end, image = i + 1, node[0]
        return end, image

    def _cluster(self, c: str) -> str:
        """Image of a grapheme cluster that no key covers as a whole."""
        if _INVISIBLE.search(c) and not _JOINING_SCRIPTS.search(c):
            if _PICTURE.search(c):
                kept = _JOINED.sub("\x00", c).replace("️", "\x01")
                return _INVISIBLE.sub("", kept).replace("\x00", "‍").replace("\x01", "️")
            c = _INVISIBLE.sub("", c)
        if _JAMO.search(c) or len(_MARKS.findall(c)) > 1:
            c = unicodedata.normalize("NFC", c)  # syllables of signs; marks in canonical order
        out: list[str] = []
        at = 0
        while at < len(c):
            end, image = self.longest(c, at)
            if image is None:
                end, image = at + 1, c[at]
            if out and (both := self.mapping.get(out[-1] + image)):
                out[-1] = both  # a mark after a character that has just been replaced
            else:
                out += image
            at = end
        return "".join(out)

    def run(self, text: str) -> tuple[str, bool]:
        """The consistent form of a text and whether it differs for the look or the invisibility of characters."""
        out: list[str] = []
        word: list[str] = []
        waiting: list[int] = []
        case, own, skip = False, False, 0

        def close() -> None:
            nonlocal case, own
            w = "".join(word)
            word.clear()
            if not _ARC.search(w):
                out.append(w)
            elif _LATIN.search(w):
                now = one_script(w)
                case |= now != w
                out.append(now)
            else:
                own |= len(w) > 1 and any(c not in TO_LATIN for c in _FOREIGN.findall(w))
                waiting.append(len(out))
                out.append(w)

        for m in self.token.finditer(text):
            start, end = m.span()
            if start < skip:
                continue
            if kind := m.lastgroup:
                if kind == "w":
                    word.append(m[0])
                else:
                    if word:
                        close()
                    out.append(m[0])
                continue
            upto, image = self.longest(text, start)
            if image is None or upto < end:
                upto, c = end, m[0]
                image = c if end - start == 1 and not _INVISIBLE.match(c) else self._cluster(c)
            skip = upto
            case |= image != text[start:upto]
            if word and image and (both := self.mapping.get(word[-1][-1] + image)):
                word[-1], case = word[-1][:-1] + both, True  # a mark after what nobody sees
            elif image and _WORD.fullmatch(image):
                word.append(image)
            elif image:
                if word:
                    close()
                out.append(image)
        if word:
            close()
        if not own:
            # a script is a text's own if a word has letters of it that look like no Latin letter
            for k in waiting:
                now = one_script(out[k])
                case |= now != out[k]
                out[k] = now
        return "".join(out), case


def one_script(w: str) -> str:
    """A word that mixes scripts, or that consists of look-alikes alone, in one script."""
    foreign = _FOREIGN.findall(w)
    if not foreign:
        plain = [c for c in w if c not in PHONETIC]
        return "".join(PHONETIC.get(c, c) for c in w) if any(c.isascii() and c.isalpha() for c in plain) else w
    if sum(map(str.isalpha, w)) < 2 and foreign[0] in GREEK and (foreign[0].islower() or not any(map(str.isdigit, w))):
        return w  # a Greek letter alone is a symbol
    if all(c in TO_LATIN for c in foreign):
        return unicodedata.normalize("NFC", "".join(TO_LATIN.get(c) or PHONETIC.get(c) or c for c in w))
    latin = [i for i, c in enumerate(w) if _LATIN.match(c)]
    if latin and all(0 < i < len(w) - 1 and w[i] in TO_CYRILLIC and _FOREIGN.match(w[i - 1]) and _FOREIGN.match(w[i + 1]) for i in latin):
        return "".join(TO_CYRILLIC.get(c, c) for c in w)
    return w


MAPPING = build_mapping()
TRANSDUCER = Transducer(MAPPING)


def fold(text: str) -> tuple[str, bool]:
    """The consistent form of a text and whether it differs for the look or the invisibility of characters."""
    return (text, False) if _PLAIN.fullmatch(text) or not TRANSDUCER.place.search(text) else TRANSDUCER.run(text)


def plain_key(text: str) -> str:
    """Plain form in lower case, letters and digits only."""
    return _KEEP.sub("", fold(text)[0].lower())
