"""Surface forms of personal information: grammars of plain cases, and candidates that only their contexts can decide."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

from lorefold.llm.names import plain

KINDS = ("email", "phone", "id_number", "address", "other")
EMAIL, PHONE, ID, ADDRESS, OTHER = range(5)

# Digit words, joining words, street words and labels of identity numbers in English, German, French and Spanish.
_DIGIT = (
    "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|"
    "quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
)
_SPOKEN = rf"(?:(?:plus )?(?:(?:double|triple|doppel|doble) )?(?:{_DIGIT})\b[ ,.\-]{{0,2}})"
_JOIN = r"(?:dot|underscore|dash|hyphen|minus|plus|punkt|punto|point|unterstrich|tiret)"
_STREET_WORDS = (
    "street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "drive", "dr", "close", "cl", "court", "ct", "terrace", "ter", "way", "square", "sq",
    "place", "pl", "crescent", "row", "mews", "boulevard", "blvd",
)
_STREET = rf"(?:{'|'.join(_STREET_WORDS)})"
_NO_NAME = r"(?:more|days?|entries|will|of|in|the|and|on|at|is|has|was|for|to|we|i|it|a|an|with|by|new|back|from|page|lines?)"
_LABEL = (
    r"(?:ssn|social security(?: number| no\.?)?|social insurance(?: number| no\.?)?|nino|ni (?:no\.?|number)|national insurance(?: number| no\.?)?|dni|nie|steuer-?id(?:nummer)?|"
    r"steuernummer|nir|sécu|n° sécu|numéro de sécu|passport(?: no\.?| number)?|reisepass|passeport|pasaporte|tax id|taxpayer (?:number|id)|tax identification number|"
    r"national id(?: card)?|id card|ausweis)"
)
_LABEL_SIGNS = ("ssn", "social", "nino", "ni n", "national", "dni", "nie", "steuer", "nir", "sécu", "pass", "pasap", "tax", "id card", "ausweis")
_CODE = r"(?:[a-z]{1,3} ?)?\d[\da-z]*(?:[ ./-]{1,2}\d[\da-z]*)*(?:(?: ?- ?| (?=[a-d]\b))[a-z])?(?!\w)"
_SHORT_WORDS = frozenset("on at by to in is no of al el le la am as an or so we he me my us up go do if it im um zu da de du et un en au es se su".split())
_DAYS = frozenset(
    "january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag".split()
)

_I = re.IGNORECASE
_WRITTEN_EMAIL = re.compile(r"(?<![\w.+@-])[\w](?:[\w.+'-]*[\w+])? ?(?:@|\(at\)|\[at\]) ?(?:[^\W_][\w-]*(?:\.| ?\(dot\) ?| ?\[dot\] ?))+[^\W\d_]{2,}", _I)
_SPOKEN_EMAIL = re.compile(rf"(?<![\w.+@-])[\w.+-]+(?: {_JOIN} [\w+-]+)* (?:at|arroba|arobase|klammeraffe) [\w-]+(?: {_JOIN} [\w-]+)*(?: (?:dot|punkt|punto|point) [\w-]+)+", _I)
_LABELLED_ID = re.compile(rf"(?<!\w){_LABEL}[\s:.#]*(?:is |ist |est |es )?(?P<code>{_CODE}|(?:[a-z] ?){{0,2}}{_SPOKEN}{{5,}}(?:[a-d]\b)?)", _I)
#: Identity numbers told by their shape alone: an insurance number in pairs, dashed 3-2-4, and 1-2-2-2-3-3 digits.
_SHAPED_ID = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]\b|[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d]\b|\d{3}-\d\d-\d{4}(?![\w-])|[1-478] \d\d \d\d \d[\dAB] \d{3} \d{3}(?: \d\d)?(?![\w-]))")
_SPOKEN_ID = re.compile(rf"(?<!\w)[a-z] ?[a-z] (?:{_SPOKEN}){{6,7}}[a-d]\b", _I)
_CHECKED_ID = re.compile(r"(?<![\w-])(\d{8})[ -]?([A-Z])(?![\w-])", _I)
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_FLAT = re.compile(r"(?<!\w)(?:flat|apt\.?|apartment|unit) \d+[a-z]?,? $", _I)
_FLAT_SIGNS = ("flat", "apt", "apartment", "unit")
_NUMBER_FIRST = re.compile(rf"(?<!\w)\d{{1,4}}[a-z]?,? (?:[nsew]\.? |(?:north|south|east|west) )?(?!{_NO_NAME}\b)[^\W\d_][\w'’]*(?: (?!{_NO_NAME}\b)[^\W\d_][\w'’]*)?,? {_STREET}\b(?! (?:fair|food))\.?(?:,? apt\.? \d+[a-z]?)?", _I)
_NUMBER_FIRST_FR = re.compile(r"(?<!\w)\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.?|bd\.?|boulevard|quai|allée|impasse|place|chemin|cours|passage|route)(?: (?:de la|de l'|des|du|de))?\s?[^\W\d_][\w'’-]*", _I)
_STREET_FIRST = (
    (("calle", "avenida", "avda", "av.", "paseo", "pza", "plaza", "camino", "ronda", "travesía", "c/"), re.compile(r"(?<!\w)(?:(?:calle|avenida|avda\.?|av\.|paseo|plaza|pza\.?|camino|ronda|travesía)(?: del| de la| de los| de las| de) [^\W\d_][\w'-]*|c/ ?(?:[^\W\d_][\w'-]*\.? ){0,3}[^\W\d_][\w'-]*),? \d{1,4}(?:,? \d{1,2} ?º ?[a-z]?\b)?", _I)),
    (("am ", "an der", "im ", "zum", "zur", "auf der", "alte", "unter den", "hinter der"), re.compile(r"(?<!\w)(?:am|an der|im|zum|zur|auf der|alte[rs]?|unter den|hinter der) [^\W\d_]{4,} \d{1,4}[a-z]?\b(?![:./]\d)(?:,? \d{5} [^\W\d_][\w-]+)?", _I)),
)
_STREET_ENDS = ("straße", "strasse", "str.", "str", "gasse", "allee", "wall", "weg", "platz", "ring", "damm", "ufer", "graben", "steig")
_HOUSE_NUMBER = re.compile(r"\d{1,4}[a-z]?\b(?![:./]\d)(?:,? \d{5} [^\W\d_][\w-]+)?", _I)
_PHONE = re.compile(
    r"(?<![\w.,/+€-])(?:\+\d{1,3} ?(?:\(0\) ?)?(?:\d[ ./()-]{0,2}){6,11}\d|00\d{1,3}[ .-](?:\d[ ./()-]{0,2}){6,11}\d|\(\d{2,5}\) ?\d{3}[ .-]?\d{4}|\(0\d{1,4}\) ?\d[\d -]{4,9}\d|"
    r"0\d{2,4}/\d{3,6}(?:-\d{1,4})?|0\d{3,4} ?\d{6}|0\d{2,4} \d{6,8}|0\d{2} ?\d{4} ?\d{4}|0\d(?:[ .]\d\d){4}|0\d{9,10}|[2-9]\d\d[2-9]\d{6}|\d{3}[-.]\d{3}[-.]\d{4}|\d{3} \d{3} \d{4}|555[-. ]\d{4})"
    r"(?![\w-])(?:,? (?:ext|x|durchwahl|poste)\.? ?\d+)?",
    _I,
)
_LABELLED_PHONE = re.compile(r"(?<!\w)(?:tel|phone|mobile|cell|handy|telefon|tél|teléfono|móvil|portable)\b[.: ]*(?P<code>\+?\(?\d(?:[ ./()-]{0,2}\d){5,14})(?![\w-])", _I)
_PHONE_LABELS = ("tel", "phone", "mobile", "cell", "handy", "tél", "móvil", "portable")
_SPOKEN_PHONE = re.compile(rf"(?<!\w){_SPOKEN}{{6,}}", _I)

_DIGIT_WORDS = frozenset(_DIGIT.split("|"))
_AT_SIGN = re.compile(r"@|[(\[]at[)\]]", _I)
_RUN = re.compile(r"\d+")
_SIX_DIGITS = re.compile(r"\d(?:[ ./()-]{0,3}\d){5}")
_NUMBER = re.compile(r"(?<![\w.,/+€$£-])\+?\(?\d(?:[ ./()-]{0,2}\d){6,}(?: ?-? ?[A-Z](?!\w))?(?![\w])")
_PREFIX = re.compile(r"(?<!\w)[A-Z]{1,2} ?$")
_NUMBERED_STREET = re.compile(rf"(?<![\w.,:/-])\d{{1,3}}[a-z]?,? (?!{_NO_NAME}\b)[^\W\d_]{{3,}} ([^\W\d_]{{3,}})", _I)
_LEFT = re.compile(r"[^\W_]+")


def digest(text: str) -> int:
    """A stable signed 64-bit hash."""
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


kept_digest = lru_cache(maxsize=200_000)(digest)


def _at(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Matches of ``pattern`` that begin at one of the places, which ascend; they don't overlap."""
    end = -1
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def _widened(text: str, at: int) -> int:
    """The start of a number with the plus sign and bracket before it."""
    while at and text[at - 1] in "+(":
        at -= 1
    return at


def _local_part(text: str, at: int) -> int:
    """The start of what may be the name before an at-sign."""
    if at and text[at - 1] == " ":
        at -= 1
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+'-"):
        at -= 1
    while at < len(text) and text[at] in ".+'-":
        at += 1
    return at


def _word_before(text: str, at: int) -> int:
    while at and (text[at - 1].isalnum() or text[at - 1] in "-_"):
        at -= 1
    return at


def _spans(text: str, low: str, runs: list[int]) -> Iterator[tuple[int, int, int]]:
    """What the grammars find, the surest first; later ones may overlap earlier ones."""
    if "@" in low or "(at)" in low or "[at]" in low:
        for m in _at(_WRITTEN_EMAIL, text, sorted({_local_part(text, sign.start()) for sign in _AT_SIGN.finditer(text)})):
            yield *m.span(), EMAIL
    if (" at " in low or " arroba " in low or " arobase " in low or " klammeraffe " in low) and (" dot " in low or " punkt " in low or " punto " in low or " point " in low):
        for m in _SPOKEN_EMAIL.finditer(text):
            yield *m.span(), EMAIL
    digits = bool(runs) and _SIX_DIGITS.search(text, runs[0]) is not None
    words = low.replace("-", " ").replace(",", " ").replace(".", " ").replace("\n", " ").split(" ")
    said = 0 if _DIGIT_WORDS.isdisjoint(words) else sum(map(_DIGIT_WORDS.__contains__, words))
    if (digits or said >= 5 or runs and "pass" in low) and any([s in low for s in _LABEL_SIGNS]):
        for m in _LABELLED_ID.finditer(text):
            written = sum(c.isdigit() for c in m["code"])
            if written >= 4 or not written:
                yield *m.span("code"), ID
    if digits:
        for m in _at(_IBAN, text, [a - 2 for a in runs if a > 1 and text[a - 2].isupper()]):
            yield *m.span(), OTHER
        for m in _at(_SHAPED_ID, text, sorted({b for a in runs for b in (a - 3, a - 2, a) if b >= 0 and (b == a or text[b].isalpha())})):
            if text[m.start() : m.start() + 2] not in _SHORT_WORDS:
                yield *m.span(), ID
        for m in _at(_CHECKED_ID, text, runs):
            if _CHECK_LETTERS[int(m[1]) % 23] == m[2].upper():
                yield *m.span(), ID
    if said >= 6:
        for m in _SPOKEN_ID.finditer(text):
            yield *m.span(), ID
    if runs:
        for m in _at(_NUMBER_FIRST, text, runs):
            flat = _FLAT.search(text, max(0, m.start() - 24), m.start()) if any([s in low for s in _FLAT_SIGNS]) else None
            yield flat.start() if flat else m.start(), m.end(), ADDRESS
        for m in _at(_NUMBER_FIRST_FR, text, runs):
            yield *m.span(), ADDRESS
        for signs, pattern in _STREET_FIRST:
            if any([s in low for s in signs]):
                for m in pattern.finditer(text):
                    words = m.group().split()
                    if plain(words[0]) not in ("am", "im") or plain(words[1]) not in _DAYS:
                        yield *m.span(), ADDRESS
        for at in runs:
            if at > 3 and text[at - 1] == " " and low.endswith(_STREET_ENDS, 0, at - 1) and (m := _HOUSE_NUMBER.match(text, at)):
                yield _word_before(text, at - 2 if text[at - 2] == "." else at - 1), m.end(), ADDRESS
    if digits:
        if any([s in low for s in _PHONE_LABELS]):
            for m in _LABELLED_PHONE.finditer(text):
                yield *m.span("code"), PHONE
        for m in _at(_PHONE, text, [_widened(text, a) for a in runs]):
            yield *m.span(), PHONE
    if said >= 6:
        for m in _SPOKEN_PHONE.finditer(text):
            yield *m.span(), PHONE


def digit_runs(text: str) -> list[int]:
    """Where runs of digits start."""
    return [m.start() for m in _RUN.finditer(text)]


def surface_spans(text: str, runs: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what grammars decide, as indices of ``KINDS``; they don't overlap."""
    taken: list[tuple[int, int, int]] = []
    for a, b, kind in _spans(text, text.lower(), digit_runs(text) if runs is None else runs):
        while b > a and text[b - 1] in " ,.-":
            b -= 1
        if not any(a < y and x < b for x, y, _ in taken):
            taken.append((a, b, kind))
    return sorted(taken)


def shape(code: str) -> str:
    """A code with its first digit and leading letters kept, other digits as 9 and later letters as A."""
    head = re.match(r"[A-Za-z]*[ +(]*\d?", code).end()
    return code[:head].upper() + re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", code[head:]))


_WIDE = (1 << 64) - 1


@lru_cache(maxsize=100_000)
def _word_hash(word: str) -> int:
    return digest(word if word.isalpha() else re.sub(r"\d", "9", word)) & _WIDE


def _contexts(text: str, at: int, group: int) -> tuple[int, int, int]:
    """Hashes of the patterns that end before ``at``: the word before, the two before, and the second and third before."""
    words = _LEFT.findall(text[max(0, at - 40) : at].lower())
    n = len(words)
    one, two, three = (_word_hash(words[-1 - i]) if i < n else 1 for i in range(3))
    one = one * 0x9E3779B97F4A7C15 + group
    pair, skip = one ^ two * 0xC2B2AE3D27D4EB4F, two * 0x165667B19E3779F9 ^ three * 0x27D4EB2F165667C5
    return _signed(one), _signed(pair), _signed(skip + group)


def _signed(value: int) -> int:
    value &= _WIDE
    return value - (1 << 64) if value >> 63 else value


def candidates(text: str, spans: list[tuple[int, int, int]], runs: list[int]) -> list[int]:
    """Instances for the graph of numbers and streets, CODE_WIDTH integers each: start, end, form, three patterns, kind.

    The kind is that of the grammar for a seed, and -1 for what is still open.
    Numbers are known by their shape, streets by their last word or its end.
    """
    out: list[int] = []
    if not runs:
        return out

    def put(a: int, b: int, form: str, kind: int) -> None:
        out.extend((a, b, kept_digest(form), *_contexts(text, a, form[0] == "a"), kind))

    for a, b, kind in spans:
        if kind in (PHONE, ID) and any(c.isdigit() for c in text[a:b]):
            put(a, b, f"n|{shape(text[a:b])}", kind)
        elif kind == ADDRESS:
            words = [w for w in re.split(r"[\s,]+", text[a:b].lower()) if w.isalpha()]
            if words:
                put(a, b, f"a|{words[-1]}" if text[a].isdigit() else f"a|*{words[0][-4:]}", ADDRESS)
    open_runs = [at for at in runs if not any([a <= at < b for a, b, _ in spans])] if spans else runs
    if not open_runs:
        return out
    for m in _at(_NUMBER, text, [_widened(text, at) for at in open_runs]):
        before = _PREFIX.search(text, max(0, m.start() - 4), m.start())
        put(before.start() if before else m.start(), m.end(), f"n|{shape(text[before.start() if before else m.start() : m.end()])}", -1)
    for m in _at(_NUMBERED_STREET, text, open_runs):
        put(*m.span(), f"a|{m[1].lower()}", -1)
    for at in open_runs:
        if at > 6 and text[at - 1] == " " and (m := _HOUSE_NUMBER.match(text, at)) and at - 1 - (start := _word_before(text, at - 1)) >= 6 and text[start : at - 1].isalpha():
            put(start, m.end(), f"a|*{text[at - 5 : at - 1].lower()}", -1)
    return out


#: Integers that ``candidates`` gives for each instance.
CODE_WIDTH = 7
