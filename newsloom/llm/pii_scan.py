"""One pass over a text that finds everything that may be personal information, with its context.

Digits, signs and spaces of full width are read as ordinary ones, character for character, so positions are those of the
text. Where a form alone decides (e-mail addresses, telephone numbers), a candidate is certain; the rest comes with its
left and right context and is decided by what the whole corpus says about these (`pii`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from newsloom.llm.lookalikes import SPACES

#: Frequent Chinese surnames, of one and of two characters.
SURNAMES = "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦阎薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严尹钱施牛洪龚汤陶黎温莫易樊乔文安殷颜庄章鲁倪庞邢俞翟聂齐向葛柴伍覃骆关焦柳欧祝纪尚毕耿芦左季管符辛苗詹曲靳祁路涂兰甘裴梅童翁霍游阮尤岳柯牟滕谷舒卜饶宁凌盛查单冉鲍华包屈房喻解蒲卫简时连车项闵邬吉党阳司费蒙席晏隋古强穆姬申佟卞"
COMPOUND = ("欧阳", "上官", "司徒", "诸葛", "司马", "夏侯", "皇甫", "尉迟", "公孙", "慕容", "令狐", "东方", "南宫", "长孙", "宇文", "端木")
#: Words before a name that aren't part of it.
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau doktor sprecher sprecherin minister ministerin president direktor direktorin chef chefin von by contact photo foto reporting editing text".split())
#: Weights and check characters of the eighteen-digit identity number.
_WEIGHTS, _CHECK = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"

_SAME = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c) not in "，：；！？"}
_SAME |= {ord(c): 32 for c in SPACES | {"\u3000"}} | {c: 45 for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)}

_OTHER = re.compile("[" + "".join(re.escape(chr(c)) for c in _SAME) + "]")

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*(?:@|\s?[(\[]at[)\]]\s?)[A-Za-z0-9\-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9\-]+)+")
_MAYBE_EMAIL = re.compile(r"@|[(\[]at[)\]]")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[0-9()/.\- ]*[0-9])?[Xx]?")
_PHONE = re.compile(
    r"""(?:
    (?:\(?(?:\+|00)86\)?[\- ]?)?1[3-9]\d(?P<s>[\- ]?)\d{4}(?P=s)\d{4}
  | (?:(?:\+|00)?1[\-. ])?(?:\(\d{3}\)\ ?|\d{3}[\-. ])\d{3}[\-. ]\d{4}
  | (?:\+\d{2}[\- ]?|00\d{2}[\- ])(?:\(0\)\ ?)?\d{2,4}[\- /]?\d{3,4}[\- ]?\d{3,5}
  | \(0\d{2,4}\)\ ?\d{3,4}[\- ]?\d{3,5}
  | 0\d{2,4}[\- /]\d{3,4}[\- ]?\d{3,5}
  )""",
    re.X,
)
_CHINESE_ID = re.compile(r"\d{6}([\- ]?)(?:19|20)\d{6}\1\d{3}[0-9Xx]")
_SOCIAL = re.compile(r"\d{3}([\- ])\d{2}\1\d{4}")
_INSURANCE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}( ?)\d{2}\1\d{2}\1\d{2}\1[A-D](?![A-Za-z0-9])")
_CHINESE_STREET = re.compile(r"(?:大道|胡同|路|街|巷|弄)\d{1,5}号(?:\d{1,4}(?:栋|幢|号楼|单元))?(?:[一-鿿]{2,4}(?:大厦|广场|小区)\d{0,3}(?:层|楼)?)?(?:\d{1,4}(?:室|层|楼))?")
#: Signs of areas around a street, inner ones first; each has a name before it.
_AREAS = (("新区", "区", "镇", "乡", "县"), ("市", "县", "州"), ("自治区", "省"))
_ROAD = r"(?:Road|Rd\.?|Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Court|Ct\.?|Drive|Boulevard|Blvd\.?|Way|Place|Square|Terrace|Crescent)(?![A-Za-z])"
_ENGLISH_ADDRESS = re.compile(rf"(?<![0-9A-Za-z.,\-/])\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’\-]* ){{1,3}}{_ROAD}(?:,? (?:Apt|Suite|Unit|Flat)\.? \d+[A-Z]?)?(?:, [A-Z][a-z]+)?")
_GERMAN_ADDRESS = re.compile(r"(?<![\w\-])[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|gasse|platz|allee|weg|ring|damm|ufer|-(?:Weg|Straße|Allee|Platz|Ring|Gasse|Damm|Ufer)) \d{1,4}[a-z]?(?![\w])(?:, \d{5} [A-ZÄÖÜ][\wäöüß]+)?")
#: Words without which the patterns above can't match.
_ROADS = (" Road", " Rd", " St", " Ave", " Lane", " Ln", " Court", " Ct", " Drive", " Boulevard", " Blvd", " Way", " Place", " Square", " Terrace", " Crescent")
_STREETS = tuple(f"{w} " for w in "straße strasse str. gasse platz allee weg ring damm ufer -Weg -Straße -Allee -Platz -Ring -Gasse -Damm -Ufer".split())
_CAPITAL = re.compile(r"(?<![\w@.\-])[A-ZÄÖÜÀ-Ý](?:[\w’']+(?:-[A-ZÄÖÜ][\w’']+)*|\.)")
_DIGIT = re.compile("[1-9]")
_TWO = re.compile("[一-鿿]{2}")
_IDEOGRAPH, _IDEOGRAPHS = re.compile("[一-鿿]"), re.compile("[一-鿿]+")
#: Characters of a street's or area's name at most.
MOST_NAME = 6
#: Characters after which a name may begin whatever its first character: the ends of labels and of callings.
_LABELS = re.compile("(?:(?:系人|编辑|供图|摄影|作者|记者|实习生|通讯员|负责人|主任|教授|发言人)[：: ]?)(?=[一-鿿]{2})")
_CHINESE_NAME = re.compile(f"(?:{'|'.join(COMPOUND)}|[{SURNAMES}])(?=[一-鿿])")


#: Begin of the token of a name whose surname isn't listed.
UNLISTED = "?"


class Candidate(NamedTuple):
    """kind, character positions from 1 (end excluded), left and right context, what the graph knows the instance by."""

    kind: str
    start: int
    end: int
    left: str
    right: str
    token: str


def right_check(number: str) -> bool:
    """Whether an identity number of eighteen digits has its right check character."""
    digits = [c for c in number if c.isalnum()]
    return len(digits) == 18 and _CHECK[sum(int(d) * w for d, w in zip(digits, _WEIGHTS)) % 11] == digits[17].upper()


def _numbers(t: str, masked: str) -> Iterator[Candidate]:
    for m in _NUMBER.finditer(t):
        a, b = m.span()
        if b - a < 8:
            continue
        s, at = m[0], 0
        while at < len(s):
            ok = at == 0 or s[at - 1] in " ,;"
            hit = None
            if ok:
                for kind, pattern in (("id", _CHINESE_ID), ("id", _SOCIAL), ("phone", _PHONE)):
                    if (h := pattern.match(s, at)) and (h.end() == len(s) or not s[h.end()].isdigit() and s[h.end()] not in "-/Xx"):
                        hit = kind, h.end()
                        break
            if hit:
                kind, end = hit
                edge = t[a + at - 1 : a + at]
                if not (edge.isalnum() and edge.isascii()) and edge not in ("-", "/", ".", "#", "@"):
                    number = s[at:end]
                    token = "" if kind == "phone" else "good" if sum(map(str.isalnum, number)) < 18 or right_check(number) else "bad"
                    yield Candidate(kind, a + at, a + end, masked[max(0, a + at - 4) : a + at], "", token)
                at = end
            else:
                at += 1
    for m in _INSURANCE.finditer(t):
        yield Candidate("id", *m.span(), masked[max(0, m.start() - 4) : m.start()], "", "good")


def _area(t: str, end: int, signs: tuple[str, ...]) -> int | None:
    """Where the name of an area whose sign ends at a place begins, as one of two characters; None without one."""
    for sign in signs:
        at = end - len(sign)
        if at >= 2 and t.startswith(sign, at) and _TWO.fullmatch(t, at - 2, at):
            return at - 2
    return None


def _chinese_addresses(t: str) -> Iterator[Candidate]:
    """Addresses from a street with a number outwards. The first part's name is read as of two characters; what may belong to
    it besides comes as left context, its name and sign as right context (`pii` decides by the corpus)."""
    for m in _CHINESE_STREET.finditer(t):
        a = m.start() - 2
        if a < 0 or not _TWO.fullmatch(t, a, a + 2):
            continue
        sign, inner = m.start(), _AREAS[0] + _AREAS[1]
        if _area(t, a, inner) is None:
            # a longer name of the street, if an area ends where it begins
            longer = (m.start() - n for n in range(3, MOST_NAME + 1) if m.start() >= n and _IDEOGRAPHS.fullmatch(t, m.start() - n, m.start()))
            a = next((x for x in longer if _area(t, x, inner) is not None), a)
        for signs in _AREAS:
            if (outer := _area(t, a, signs)) is not None:
                sign, a = outer + 2, outer
        left = a
        while left > 0 and a - left < MOST_NAME - 2 and _IDEOGRAPH.match(t, left - 1):
            left -= 1
        if a - left < MOST_NAME - 2 and t[left - 1 : left] in ("：", ":"):
            a = left  # all that follows a label
        yield Candidate("address", a, m.end(), t[left:a], t[a : sign + 1], "zh")


def _addresses(t: str) -> Iterator[Candidate]:
    if "号" in t:
        yield from _chinese_addresses(t)
    if any(w in t for w in _ROADS):
        for m in _ENGLISH_ADDRESS.finditer(t):
            yield Candidate("address", *m.span(), "", "", "en")
    if any(w in t for w in _STREETS):
        for m in _GERMAN_ADDRESS.finditer(t):
            yield Candidate("address", *m.span(), "", "", "de")


def _western_names(t: str, masked: str) -> Iterator[tuple]:
    words = [(m.start(), m.end(), m[0]) for m in _CAPITAL.finditer(t)]
    size = len(t)
    for k in range(len(words) - 1):
        a, ae, first = words[k]
        b, end, last = words[k + 1]
        if b != ae + 1 or t[ae] != " " or (first[-1] == "." and ae - a > 2):
            continue
        if last[-1] == ".":
            # an initial between the names
            if end - b != 2 or k + 2 == len(words) or words[k + 2][0] != end + 1:
                continue
            b, end, last = words[k + 2]
            if last[-1] == ".":
                continue
        left, right = "^", t[end : end + 1] or "$"
        if a and t[a - 1] == " ":
            left = masked[max(t.rfind(" ", 0, a - 1), t.rfind("\n", 0, a - 1)) + 1 : a - 1]
        if right == " ":
            to = t.find(" ", end + 1, end + 24)
            right = masked[end + 1 : to if to >= 0 else min(size, end + 24)]
        start = b if first.casefold().rstrip(".:") in TITLES else a
        yield "name", start, end, "L " + left, "R " + right, last.casefold()


def _chinese_names(t: str, masked: str) -> Iterator[tuple]:
    for m in _CHINESE_NAME.finditer(t):
        a, b = m.span()
        left, token = "l" + masked[a - 3 if a > 3 else 0 : a], m[0]
        if "一" <= t[b + 1 : b + 2] <= "鿿":
            yield "name", a, b + 2, left, "r" + masked[b + 2 : b + 5], token
        yield "name", a, b + 1, left, "r" + masked[b + 1 : b + 4], token
    for m in _LABELS.finditer(t):
        a = m.end()
        if not _CHINESE_NAME.match(t, a):
            # no listed surname: the token says so, and only trusted contexts on both sides make it a name
            for b in (a + 2, a + 3):
                if _IDEOGRAPHS.fullmatch(t, a, b):
                    yield "name", a, b, "l" + masked[a - 3 if a > 3 else 0 : a], "r" + masked[b : b + 3], UNLISTED + t[a]


def scan(text: str) -> list[tuple]:
    """All candidates of a text, as the fields of Candidate; positions from 0."""
    t = _OTHER.sub(lambda m: chr(_SAME[ord(m[0])]), text)
    masked = _DIGIT.sub("0", t)
    out: list[tuple] = [*_numbers(t, masked), *_addresses(t)]
    out += _western_names(t, masked)
    if not t.isascii() and _IDEOGRAPH.search(t):
        out += _chinese_names(t, masked)
    if _MAYBE_EMAIL.search(t) and (mails := [m.span() for m in _EMAIL.finditer(t)]):
        out = [c for c in out if not any(a < c[2] and c[1] < b for a, b in mails)]
        out += [("email", a, b, "", "", "") for a, b in mails]
    return out
