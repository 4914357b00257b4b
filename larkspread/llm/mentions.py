"""Places in a text that may be personal information.

``mentions`` reads one text and yields candidates with the patterns they stand in.
Entities of a layout that nothing else has (an e-mail address, a phone number in a
national or international grouping, an identity number of a known layout, a house
number with a street) are seeds. Everything else is open: figures and codes after a
word (``number``), capitalised words with a house number before or after (``place``) and
pairs of capitalised words (``name``). Their contexts and their own layout decide.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import regex

#: Words and layouts that mark the kinds.
TITLES = frozenset(
    "mr mrs ms miss dr prof sir herr frau fräulein mme madame mlle mademoiselle monsieur m sr sra señor señora don doña dona lic".split()
)
_STREET_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|boulevard|blvd|close|crescent|cres|mews|row|terrace|ter|way|place|pl|square|sq|gardens|grove|hill|walk|parade|quay"
_STREET_DE = "straße|strasse|str|allee|weg|gasse|ring|platz|damm|ufer|graben|steig|markt|chaussee"
_STREET_FR = "rue|avenue|av|impasse|chemin|place|boulevard|bd|allée|quai|route|passage|cours|square"
_STREET_ES = "calle|c/|avenida|avda|av|paseo|plaza|camino|carretera|ronda|travesía|callejón|vía"
_PARTICLES = "van der|van den|van de|van|von der|von dem|von|zu|de la|de las|de los|de|del|della|di|da|du|des|le|la"

_S = r"\s{1,12}"
_H = r"[-‐‑‒–]"
_O = r"\s{0,12}"
_SP = r"[\s.‐‑‒–-]"
_FLAGS = regex.IGNORECASE | regex.V0

_AT = rf"(?:[@＠]|\s{{1,12}}[@＠]\s{{1,12}}|\s?[\[({{<]\s?(?:at|[@＠])\s?[\])}}>]\s?|{_S}at{_S}(?=[\w-]+{_S}dot{_S}))"
_DOT = rf"(?:[.．]|\s?[\[({{<]\s?(?:dot|[.．])\s?[\])}}>]\s?|{_S}dot{_S})"
EMAIL = regex.compile(
    rf"(?<![\w.+-])[\p{{L}}\d](?:[\p{{L}}\d._%+-]{{0,62}}[\p{{L}}\d])?{_AT}[\p{{L}}\d](?:[\p{{L}}\d-]{{0,62}})(?:{_DOT}[\p{{L}}\d][\p{{L}}\d-]{{0,62}}){{0,4}}{_DOT}\p{{L}}{{2,24}}(?![\p{{L}}\d@＠])", _FLAGS
)
#: Where an e-mail address may have its at-sign; the address is read around it.
_AT_SIGN = re.compile(r"[@＠]|[\[({<]\s?[aA][tT]\s?[\])}>]")
_AT_WORD = re.compile(rf"{_S}at(?={_S}[\w-]+{_S}dot{_S})", re.I)
PHONE = re.compile(
    rf"(?<![\w+/.,:-])(?:"
    rf"\+\s?44{_SP}?(?:\(0\){_SP}?)?(?:\d{{2}}{_SP}\d{{4}}{_SP}?\d{{4}}|\d{{3}}{_SP}\d{{3}}{_SP}?\d{{4}}|\d{{4}}{_SP}\d{{3}}{_SP}?\d{{3}}|\d{{10}})"
    rf"|\+\s?1{_SP}?\(?\d{{3}}\)?{_SP}?\d{{3}}{_SP}?\d{{4}}"
    rf"|\+\s?(?!1|44)\d{{2,3}}{_SP}?(?:\(0\){_SP}?)?\d{{1,5}}(?:(?:[\s./‐‑‒–-]\d{{2}}){{4}}|[\s./‐‑‒–-]\d{{3,8}}(?:[\s./‐‑‒–-]\d{{2,5}})?)|\+\s?(?!1|44)\d{{9,14}}"
    rf"|00\d{{2}}(?P<z>{_SP})\d{{1,5}}(?:(?P=z)\d{{2,8}}){{1,3}}"
    rf"|0\d{{1,4}}/\d{{5,9}}"
    rf"|0\d{{2}}{_S}\d{{4}}{_S}\d{{4}}|0\d{{4}}{_S}\d{{3}}{_O}\d{{3}}"
    rf"|\([2-9]\d{{2}}\){_O}\d{{3}}{_SP}\d{{4}}|[2-9]\d{{2}}(?P<g>{_H}|\.|\s)\d{{3}}(?:(?P=g)|{_H})\d{{4}}"
    rf")(?![^\W_]|[.,]\d|{_H}\d)", re.I
)
IDENTITY = regex.compile(
    rf"(?<![\p{{L}}\d.,:/+‐‑‒–-])(?:"
    rf"\d{{3}}(?P<s>{_H}|{_S})\d{{2}}(?P=s)\d{{4}}|\d{{3}}{_H}\d{{2}}{_H}\d{{4}}"
    rf"|\d{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{2}}"
    rf"|\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}"
    rf"|\d{{8}}{_H}?\p{{Lu}}|[XYZ]{_H}?\d{{7}}{_H}?\p{{Lu}}"
    rf"|\p{{Lu}}\d{{8}}|\p{{Lu}}{{2}}{_H}\d{{4}}{_H}\d{{4}}"
    rf"|\p{{Lu}}{{2}}{_O}\d{{2}}{_O}\d{{2}}{_O}\d{{2}}{_O}\p{{Lu}}"
    rf")(?![\p{{L}}\d]|{_H}[\p{{L}}\d]|[.,]\d)", regex.V0
)
_NO = r"\d{1,4}(?:\s?[a-dA-D](?![\p{L}\d]))?(?:[-–/]\d{1,4}[a-dA-D]?)?"
_NO_RE = _NO.replace(r"\p{L}\d", r"^\W_").replace("[^\\W_]", r"[^\W_]")
#: Words that never are part of a street's name, though capitals may hide it.
_NOT_STREET = frozenset("per of the and or to in on is are was gb about for with".split())
_PROPER = r"[\p{Lu}][\p{L}'’-]+"
#: Number first, as in English and French, and street first, as in German and Spanish.
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\d.,:/@#+‐‑‒–-])(?:"
    rf"{_NO}{_S}(?:(?:St\.|ST\.|Mt\.|{_PROPER}){_S}){{1,3}}(?i:{_STREET_EN})(?![\p{{L}}\d'’-])"
    rf"|\d{{1,4}}[a-dA-D]?,?{_S}(?i:{_STREET_FR}){_S}(?:(?i:de la|de l['’]|de|du|des|d['’]){_O})?{_PROPER}(?:{_S}(?:(?i:de|du|des|la|le){_S})?{_PROPER}(?!{_S}{_PROPER}\s*,)){{0,2}}"
    rf")", regex.V0
)
_UPPER = "".join(c for c in map(chr, range(0x10000)) if c.isupper())
_L = r"[^\W\d_]"
_CAPITAL = rf"[{_UPPER}](?:{_L}|['’-])+"
STREET_FIRST = re.compile(
    rf"(?<![^\W_])(?<![.,:/@#+‐‑‒–-])(?:"
    rf"(?:Am|An der|Auf der|Auf dem|Im|In der|Zum|Zur|Alte|Alter|Neue|Obere|Untere|Große|Kleine){_S}(?:{_CAPITAL}{_S}){{1,2}}{_NO_RE}(?=\s*,\s*\d{{5}}|\s*[,.;)]|{_S}|$)"
    rf"|{_CAPITAL}(?<={_L})(?:(?i:{_STREET_DE}))\.?{_S}{_NO_RE}(?![\d.:%]\d|[^\W_])"
    rf"|(?i:{_STREET_ES})\.?{_S}(?:(?i:de la|de las|de los|del|de){_S})?{_CAPITAL}(?:{_S}(?:(?i:de la|de las|de los|del|de|y){_S})?{_CAPITAL}){{0,2}},?{_S}(?:n[.º°]\s?)?\d{{1,4}}[a-dA-D]?(?![\d.:%]\d|[^\W_])"
    rf")"
)
#: A word right before a number, which may be a street's last with its house number.
_BEFORE_NUMBER = re.compile(r"([^\W\d_]+)[.,]{0,2}\s{0,12}(?:n[.º°]\s?)?$")
_ENDS_STREET = tuple(_STREET_DE.split("|"))
_STREET_HINTS = frozenset([*_STREET_ES.split("|"), *"am an auf im in zum zur alte alter neue obere untere große kleine".split()])
_LOCAL = re.compile(r"[\w.%+-]{1,66}\s{0,12}(?:[\[({<]\s?)?$")
_DIGIT = re.compile(r"\d")

#: Open candidates: figures in groups or in a code; words with a house number.
_OPEN_NUMBER = re.compile(rf"(?:[{_UPPER}]{{1,4}}[\s‐‑‒–-]?)?[+(]?\d{{1,15}}\)?(?:[ ./‐‑‒–-]{{1,2}}\(?\d{{1,12}}\)?){{0,7}}(?:[‐‑‒–-]?[{_UPPER}])?(?![^\W_]|[.,:/‐‑‒–-]\d)")
_OPEN_PLACE = re.compile(rf"\d{{1,4}}[a-dA-D]?,?[ ](?:\d{{1,3}}(?:st|nd|rd|th)[ ](?={_CAPITAL})|(?=.{_L}{{2}})){_CAPITAL}(?:[ ]{_CAPITAL}){{0,2}}(?![^\W_])")
#: Plain decimal amounts, dates and network addresses: figures that identify nobody.
_AMOUNT = re.compile(r"\d+[.,]\d{1,4}|\d{4}-\d\d-\d\d|\d{1,3}(?:\.\d{1,3}){3}")
_OPEN_STREET = re.compile(rf"(?<![\w@.'’/#&-]){_CAPITAL}(?:[ ]{_CAPITAL}){{0,2}}[ ]$")
_OPEN_HOUSE = re.compile(r"\d{1,4}[a-dA-D]?(?![^\W_]|[.,:/%‐‑‒–-]\d|%)")
_LABEL = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|\n|\x02")

_FULL = rf"(?:[{_UPPER}]{_L}+(?:['’‐‑-]{_L}+)*|[{_UPPER}]['’]{_L}+(?:-{_L}+)*)"
_PART = rf"(?:(?i:{_PARTICLES}){_S})?"
_INIT = rf"[{_UPPER}]\."
_END = rf"(?![^\W_]|['’@_]|[-‐‑]{_L})"
_BEGIN = rf"(?<![^\W]|[@.'’/#&-])(?=[{_UPPER}]|(?i:{_PARTICLES}){_S}[{_UPPER}])"
#: family, given / given family / given initial / initial family; initials between are allowed.
NAME = re.compile(
    rf"{_BEGIN}(?:(?P<f1>{_PART}{_FULL}),\s{{1,12}}(?P<g1>{_FULL})(?:{_S}{_INIT})?"
    rf"|(?P<g2>{_FULL}){_S}(?:{_INIT}\s{{0,12}})?(?P<f2>{_PART}{_FULL})"
    rf"|(?P<g3>{_FULL}){_S}(?P<f3>{_INIT})"
    rf"|(?P<g4>{_INIT})\s{{0,12}}(?:{_INIT}\s{{0,12}})?(?P<f4>{_PART}{_FULL}))(?:(?<=\.)|{_END})"
)
_NAME_PLAIN = re.compile(rf"{_BEGIN}(?P<g2>{_FULL}){_S}(?:{_INIT}\s{{0,12}})?(?P<f2>{_PART}{_FULL}){_END}")

_NAME_SHORT = re.compile(rf"{_BEGIN}(?P<g3>{_FULL}){_S}(?P<f3>{_INIT})")
_MIDDLE = re.compile(rf"[\s,]{_INIT}")
#: What lies between a street and its town.
_TO_TOWN = re.compile(r"\.?\s*,\s*(?:[^\W\d_]+\.?\s{1,12}\w{1,4}\s*,\s*)?(?:\d{4,6}\s{1,12})?")
_IN_TOWN = re.compile(_TO_TOWN.pattern + rf"[{_UPPER}](?:{_L}|[-'’])+\s{{1,12}}")


#: Where a number or an identity may begin. Here and below the pattern begins with a set
#: of characters, by which the search jumps, and looks at the character before it after.
_NUMBER_START = re.compile(r"[+(\d](?<![^\W_].)(?<![.,:/-].)")
_CODE_START = re.compile(rf"[{_UPPER}](?<![^\W_].)(?<![.,:/+-].)(?=[{_UPPER}]?[\s‐‑‒–-]{{0,12}}\d)")
#: Where a name may begin: a capitalised word or an initial before another or a particle.
_NAME_START = re.compile(
    rf"[{_UPPER}](?<![\w@.'’/#&-].)(?:\.|{_L}*(?:['’‐‑-]{_L}+)*)(?=,?\s{{0,12}}(?:[{_UPPER}]|(?i:van|von|der|den|dem|zu|de|las|los|la|del|della|di|da|du|des|le)\s))"
)
_COMMA_NAME = re.compile(rf",\s{{1,12}}[{_UPPER}]")
_PARTICLE_START = re.compile(rf"(?<![\w@.'’/#&-])(?=[a-z])(?:{_PARTICLES.lower()}){_S}{_FULL},\s{{1,12}}[{_UPPER}]", re.I)


def _starts(v: str):
    """Every place at which a name may begin."""
    for m in _NAME_START.finditer(v):
        yield m.start()
    if _COMMA_NAME.search(v):
        for m in _PARTICLE_START.finditer(v):
            yield m.start()


def _matches(pattern, v: str, starts: list[int]):
    """Matches at the given places that do not overlap, the leftmost first."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(v, at)):
            end = m.end()
            yield m

_LINE_TAG = regex.compile(r"</?(?:br|p|div|blockquote|cite|pre|li|ul|ol|code)\b[^<>]*>|\[/?(?:quote|code)\b(?!=)[^\[\]]*\]|\[quote=|\[/?(?:size|b|i|u|url|list)\b[^\[\]]*\]", regex.I)
_RULE = regex.compile(r"<hr\b[^<>]*>", regex.I)
_TAG = regex.compile(r"</?(?!at>|dot>)[a-zA-Z][^<>@＠]*>|\[/?(?:b|i|u|size|url|em|strong)(?:=[^\[\]]*)?\]", regex.I)
_PREFIX = regex.compile(r"(?<=^|\n)[ \t]*(?:>[> \t]*)+")
_ENTITY = regex.compile(r"&(?:amp|nbsp|lt|gt|quot|#\d+);")
_SEPARATOR = regex.compile(r"(?<=^|\n)[ \t]*(?:-{2,}|_{2,}|—{1,})[ \t]*(?=\n|$)")
_INVISIBLE = regex.compile(r"[­​-‏⁠﻿‪-‮]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|\d[\d.,:/-]*|\n|\x02|[^\w\s]")
_RULE_MARK = "\x02"


def _spaces(m: regex.Match) -> str:
    return " " * (m.end() - m.start())


def _line(m: regex.Match) -> str:
    return "\n" + " " * (m.end() - m.start() - 1)


def view(text: str) -> tuple[str, list[int] | None]:
    """The text with markup blanked out, character for character, and the places
    of its characters where invisible ones were left out (else None)."""
    v = text
    if "<" in v or "[" in v:
        v = _RULE.sub(lambda m: "\n" + _RULE_MARK + "\n" + " " * (m.end() - m.start() - 3), v)
        v = _TAG.sub(_spaces, _LINE_TAG.sub(_line, v))
    if ">" in v:
        v = _PREFIX.sub(_spaces, v)
    if "&" in v:
        v = _ENTITY.sub(lambda m: ("&" if m.group() == "&amp;" else " ") + " " * (m.end() - m.start() - 1), v)
    if "--" in v or "__" in v or "—" in v:
        v = _SEPARATOR.sub(lambda m: _RULE_MARK + " " * (m.end() - m.start() - 1), v)
    if not v.isascii() and _INVISIBLE.search(v):
        hidden = {c for c in set(v) if not c.isascii() and _INVISIBLE.match(c)}
        kept = [i for i, c in enumerate(v) if c not in hidden]
        return "".join(v[i] for i in kept), kept
    return v, None


_NO_LETTER = re.compile(r"[\W_]+")


def squeeze(mention: str) -> str:
    """A mention lower-cased, with letters and digits only."""
    return _NO_LETTER.sub("", mention.lower())


def _word(token: str) -> str:
    if token[0].isdigit():
        return "9"
    return token.casefold()


class Spans:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Takes the span unless it overlaps one that is there."""
        if not self.free(start, end):
            return False
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start


@dataclass(frozen=True, slots=True)
class Mention:
    """A candidate: kind, value, place, whether its shape decides, name parts, the
    patterns it stands in, whether it is all capitals and whether names may be
    learned from it."""

    kind: str
    value: str
    start: int
    end: int
    seed: bool
    given: str
    family: str
    patterns: tuple[str, ...]
    shouted: bool = False
    teaches: bool = False


_BREAKS = ("\n", _RULE_MARK)


def _words(tokens) -> list[str]:
    """The first two tokens that are no line breaks, as words."""
    out = []
    for t in tokens:
        if t not in _BREAKS:
            out.append(_word(t))
            if len(out) == 2:
                break
    return out


def _context(v: str, start: int, end: int) -> tuple[str, ...]:
    left_text = v[max(0, start - 48) : start]
    left = _TOKEN.findall(left_text)
    if len(left_text) == 48 and left and left_text[0] not in " \n":
        left = left[1:]
    right = _TOKEN.findall(v[end : end + 40])[:8]
    begins = "in" if left else "line"
    for t in reversed(left):
        if t == _RULE_MARK:
            begins = "rule"
            break
        if t != "\n":
            break
        begins = "line"
    ends = "line" if not right or right[0] in _BREAKS else "in"
    lw = _words(reversed(left))[::-1]
    rw = _words(right)
    out = [f"S {begins} {ends}"]
    if lw and begins != "rule":
        out.append(f"L1 {lw[-1]}")
        if len(lw) == 2:
            out.append(f"L2 {lw[0]} {lw[1]}")
    if rw and ends == "in":
        out.append(f"R1 {rw[0]}")
        if len(rw) == 2:
            out.append(f"R2 {rw[0]} {rw[1]}")
    elif len(rw) == 2:
        out.append(f"N2 {rw[0]} {rw[1]}")
    if lw and rw and begins != "rule" and ends == "in":
        out.append(f"C {lw[-1]} _ {rw[0]}")
    return tuple(out)


def _open(v: str, numbers: list[int]):
    """(start, end, kind) of open candidates at numbers that follow a word."""
    end = 0
    for at in numbers:
        if at < end:
            continue
        j, low = at - 1, max(-1, at - 6)
        while j > low and not v[j].isalnum():
            j -= 1
        if j < 0 or not v[j].isalpha():
            continue
        first = at
        if j >= at - 2 and v[j].isupper() and not (j and v[j - 1].islower()):  # letters of a code
            while first and first > at - 6 and (v[first - 1].isupper() or first == at and not v[first - 1].isalnum()):
                first -= 1
            if first and v[first - 1].isalnum():
                first = at
        m = _OPEN_NUMBER.match(v, first) or (_OPEN_NUMBER.match(v, at) if first < at else None)
        if m:
            size = sum(map(str.isdigit, m.group()))
            if 6 <= size <= 15:
                end = m.end()
                if _AMOUNT.fullmatch(m.group()):
                    continue
                yield m.start(), end, "number"
                continue
        if m := _OPEN_PLACE.match(v, at):
            end = m.end()
            yield at, end, "place"
            continue
        if v[at - 1] == " " and v[j].isalpha() and j == at - 2:
            house = _OPEN_HOUSE.match(v, at)
            street = house and _OPEN_STREET.search(v, max(0, at - 40), at)
            if street:
                end = house.end()
                yield street.start(), end, "place"


def _labels(v: str, start: int) -> list[str]:
    """The two and the three words or signs on the line before a place, where a word is
    among the nearest two; the one word that begins the line."""
    tokens = _LABEL.findall(v[max(0, start - 32) : start])
    if start > 32 and len(tokens) > 2:
        tokens = tokens[1:]
    words: list[str] = []
    for t in reversed(tokens):
        if t in _BREAKS or len(words) == 3:
            break
        words.append("9" if t[0].isdigit() else t.casefold())
    if not words or not any(w[0].isalpha() for w in words[:2]):
        return []
    two = f"L2 {words[1]} {words[0]}" if len(words) > 1 else ""
    three = f"L3 {words[2]} {words[1]} {words[0]}" if len(words) > 2 else ""
    one = f"L1 {words[0]}" if len(words) == 1 or len(words) == 2 and not words[0][0].isalpha() else ""
    return [x for x in (one, two, three) if x]


def _layout(kind: str, mention: str) -> list[str]:
    """What a mention itself looks like: its figures and letters, or its words. In
    capitals any words look like a street's, so there only those before it tell."""
    if kind == "place" and mention.isupper():
        return []
    if kind in ("address", "place"):
        words = re.findall(r"[^\W\d_]+", mention.casefold())
        return [f"W1 {words[0]}", f"W2 {words[-1]}", f"W3 {words[-1][-4:]}"] if words else []
    if kind == "email":
        return []
    return ["W " + "".join("9" if c.isdigit() else "A" if c.isalpha() else " " if c.isspace() else "-" if c in "‐‑‒–" else c for c in mention[:40])]


def mentions(text: str) -> list[Mention]:
    """All candidates of one text."""
    v, places = view(text)
    out: list[Mention] = []
    taken, streets = Spans(), []

    def place(start: int, end: int) -> tuple[int, int]:
        return (start, end) if places is None else (places[start], places[end - 1] + 1)

    def emails():
        end = 0
        signs = list(_AT_SIGN.finditer(v))
        if " dot" in v or " DOT" in v or "dot" in v.casefold():
            signs = sorted([*signs, *_AT_WORD.finditer(v)], key=lambda m: m.start())
        for at in signs:
            if at.start() >= end:
                local = _LOCAL.search(v, max(end, at.start() - 80), at.start())
                m = local and EMAIL.match(v, local.start())
                if m and m.end() > at.end():
                    end = m.end()
                    yield m

    def streets_first():
        end = 0
        for at in numbers:
            if v[at] in "+(" or not at or not v[at - 1].isspace():
                continue
            before = v[max(end, at - 31) : at].rstrip()
            if not before or not (before[-1].isalpha() or before[-1] in ".,º°"):
                continue
            low = max(end, at - 71)
            tail = v[low : at - 1].casefold().split()[-7:]
            if not tail or not (tail[-1].rstrip(".,").endswith(_ENDS_STREET) or tail[-1][:1] == "n" or not _STREET_HINTS.isdisjoint(tail)):
                continue
            word = _BEFORE_NUMBER.search(v, max(end, at - 31), at - 1)
            if word and (word.group(1).casefold().endswith(_ENDS_STREET) or not _STREET_HINTS.isdisjoint(tail)):
                high = min(len(v), at + 44)
                for m in STREET_FIRST.finditer(v, low, high):
                    if m.end() < high or high == len(v):  # else the number may go on
                        end = m.end()
                        yield m

    def strong(kind: str, matches) -> None:
        for m in matches:
            if kind == "address" and m.group().isupper() and not _NOT_STREET.isdisjoint(m.group().lower().split()):
                continue
            if taken.add(m.start(), m.end()):
                if kind == "address":
                    streets.append(m.end())
                out.append(Mention(kind, squeeze(m.group()), *place(m.start(), m.end()), True, "", "", (*_labels(v, m.start()), *_layout(kind, m.group()))))

    strong("email", emails())
    numbers: list[int] = []
    if _DIGIT.search(v):
        numbers = [m.start() for m in _NUMBER_START.finditer(v)]
        digits = [at for at in numbers if v[at] not in "+("]
        strong("id_number", _matches(IDENTITY, v, sorted(digits + [m.start() for m in _CODE_START.finditer(v)])))
        strong("phone", _matches(PHONE, v, numbers))
        strong("address", _matches(ADDRESS, v, digits))
        strong("address", streets_first())
        for start, end, kind in _open(v, numbers):
            if taken.free(start, end) and (labels := _labels(v, start)):
                shown = v[start:end]
                out.append(Mention(kind, squeeze(shown), *place(start, end), False, "", "", (*labels, *_layout(kind, shown))))
    streets.sort()
    seen = set()
    for start in _starts(v):
        found = NAME.match(v, start)
        if not found:  # it has every form of the others
            continue
        others = [p.match(v, start) for p in ((_NAME_PLAIN, _NAME_SHORT) if found["f1"] else (_NAME_SHORT,) if found["g2"] else ())]
        for m in (found, *others):
            if not m:
                continue
            at = (m.start(), m.end())
            if at in seen or not taken.free(*at):
                continue
            seen.add(at)
            near = streets[bisect_left(streets, at[0] - 60) : bisect_right(streets, at[0])]
            if any(_TO_TOWN.fullmatch(v, e, at[0]) for e in near):
                continue
            context = _context(v, *at)
            in_town = any(_IN_TOWN.fullmatch(v, e, at[0]) for e in near)
            if in_town:  # it may be a town's second word: what is left of it tells nothing
                context = tuple(c for c in context if c[0] == "R")
            parts = {k[0]: x for k, x in m.groupdict().items() if x is not None}
            given, family = parts["g"].casefold(), " ".join(parts["f"].casefold().split())
            if given in TITLES or family in TITLES or "\n" in m.group().strip() and "\n" in v[m.start() : m.end()] and v[m.start() : m.end()].count("\n") > 1:
                continue
            value = squeeze(m.group())
            out.append(Mention("name", value, *place(*at), False, given.replace("’", "'"), family.replace("’", "'"), context, m.group().isupper(), not (in_town or m.group().isupper() or _MIDDLE.search(m.group()))))
    return out
