"""Personal data in texts, also where it is disguised, with offsets of the source text.

Plain identifiers are found in the text as it stands. For disguised ones three transducers rewrite
the text one after the other: look-alike and invisible characters, spelled ``at`` and ``dot``,
spelled digits. Each keeps its edits (source span, replacement), the same detectors read what comes
out, and a span found there is carried back through the edits to the source characters. A text
without any trace of a disguise is not rewritten.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from findlake.llm.scratch import prepare

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    disguised: bool


# --- detectors -------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from every ``@`` with a domain back over the local part, which is linear
    where a pattern that starts with the local part is not."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers of a dotted chain, from its left."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(_FIND[kind](text)) if _NEEDS[kind] in text else [] for kind in KINDS}


# --- transducers -----------------------------------------------------------------------------


class Rewrite:
    """A text with parts replaced, and the way back."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.edits, parts, done, size = edits, [], 0, 0
        self.at: list[int] = []  # where each replacement begins in the new text
        for start, end, new in edits:
            parts += [source[done:start], new]
            self.at.append(size + start - done)
            size += start - done + len(new)
            done = end
        self.text = "".join([*parts, source[done:]])

    def _place(self, position: int) -> tuple[int, int]:
        """The source span of one character of the new text."""
        k = bisect.bisect_right(self.at, position) - 1
        while k >= 0 and not self.edits[k][2] and self.at[k] == position:
            k -= 1  # a deletion holds no character
        if k < 0:
            return position, position + 1
        start, end, new = self.edits[k]
        inside = position - self.at[k]
        if inside < len(new):
            return start, end
        last = bisect.bisect_right(self.at, position) - 1
        end, inside = self.edits[last][1], position - self.at[last] - len(self.edits[last][2])
        return end + inside, end + inside + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start)[0], self._place(end - 1)[1]


# fixed values: letters of other scripts that look like Latin ones, and marks that look like others
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaivopuABEZHIKMNOPTYX", strict=True))
_MARKS = {"․": ".", "。": ".", "｡": ".", "‧": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹫": "@", "⁺": "+", "﹢": "+"}
_UNSEEN = frozenset("­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿")
_FOREIGN = re.compile("[ ­ɐ-\U0010ffff]")


def _likeness(c: str) -> str | None:
    """The ASCII character that ``c`` looks like, nothing for an invisible one, null for others."""
    if c in _UNSEEN:
        return ""
    found = _LOOKS.get(c) or _MARKS.get(c)
    if found:
        return found
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else None


def homoglyphs(text: str) -> Rewrite:
    """Look-alikes as ASCII; invisible characters vanish."""
    edits = []
    for m in _FOREIGN.finditer(text):
        new = _likeness(m[0])
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return Rewrite(text, edits)


# fixed values: the words by which people spell the two marks
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase", "dot|punkt|punto|point"
_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_AT = re.compile(rf"(?P<boxed>\s?{_OPEN}(?:{_AT_WORDS}|@){_CLOSE}\s?)|(?P<plain>(?<=[A-Za-z0-9])\s(?:{_AT_WORDS})\s(?=[A-Za-z0-9]))|(?P<mark>\s{{0,2}}@\s{{0,2}}(?=[A-Za-z0-9]))|(?P<tight>(?<=[A-Za-z0-9])(?:_(?:{_AT_WORDS})_|\(a\))(?=[A-Za-z0-9]))", re.I)
_DOT = rf"(?:\s?{_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}\s?|\s(?:{_DOT_WORDS})\s|_(?:{_DOT_WORDS})_)"
_HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[a-z]{2,}")
# fixed values: words that stand before "at" and a host in prose
_BEFORE_AT = frozenset("us me them it him her here there found available online located hosted look looked visit site website page pages more information info documentation docs read work works worked".split())
_LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*", re.I)
_ONE_DOT = re.compile(_DOT, re.I)
_LEFT = re.compile(rf"(?:(?:^|(?<=[^A-Za-z0-9._%+-]))[A-Za-z0-9_%+-]{{1,64}}{_DOT})+(?=[A-Za-z0-9._%+-]{{1,64}}$)", re.I)
_NUMBERS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_WORD_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A local part has 64 characters at most; what stands further left can't belong to it.
_REACH = 140


def at_and_dot(text: str) -> Rewrite:
    """``name [at] host [dot] tld`` and ``name at host dot tld`` as addresses, ``1[.]2[.]3[.]4`` as
    numbers. A bare ``at`` counts before a host name, unless a word of prose stands before it; the
    mark itself only where a dot is spelled."""
    edits, done = [], 0
    for m in _AT.finditer(text):
        if m.start() < done or m.start() == 0 or text[m.start() - 1] not in _LOCAL:
            continue
        labels = _LABELS.match(text, m.end())
        if not labels:
            continue
        dots = [(labels.start() + d.start(), labels.start() + d.end(), ".") for d in _ONE_DOT.finditer(labels[0])]
        if not dots and (m["mark"] or "." not in labels[0]):
            continue
        if not dots and not m["boxed"]:
            word = _WORD_BEFORE.search(text, max(0, m.start() - 64), m.start())
            if not _HOST.fullmatch(labels[0].rstrip("-")) or (m["plain"] and word and word[0].lower() in _BEFORE_AT):
                continue
        low = max(done, m.start() - _REACH)
        left = text[low : m.start()]
        for before in _LEFT.finditer(left):
            edits += [(low + before.start() + d.start(), low + before.start() + d.end(), ".") for d in _ONE_DOT.finditer(before[0])]
        edits += [(m.start(), m.end(), "@"), *dots]
        done = labels.end()
    ends = [end for _, end, _ in edits]
    numbers = []
    for m in _NUMBERS.finditer(text):
        dots = [(m.start() + d.start(), m.start() + d.end(), ".") for d in _ONE_DOT.finditer(m[0])]
        k = bisect.bisect_right(ends, m.start())  # the first edit that ends behind its start
        if dots and not (k < len(edits) and edits[k][0] < m.end()):
            numbers += dots
    return Rewrite(text, sorted(edits + numbers))


# fixed values: digits as words in English, German, French and Spanish
_DIGITS = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
_VALUE = {word: str(d) for d, words in enumerate(_DIGITS) for word in words}
_DIGIT_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_TOKEN = rf"(?:plus|{_DIGIT_WORD}|{_DOT_WORDS}|\+?[0-9]+)"
_RUN = re.compile(rf"(?<![^\W_])(?:{_TOKEN})(?:[\s.,()-]{{1,3}}{_TOKEN})+(?![^\W_])", re.I)
_PART = re.compile(rf"([\s.,()-]*)({_TOKEN})(?![^\W_])", re.I)
#: A run of so many spelled digits counts as dictated: it is read as one number first.
SPELLED = 3


def spelled_digits(text: str, least: int = 1, joined: bool = True) -> Rewrite:
    """Runs of numerals, ``least`` of them spelled, in digits; ``plus`` as ``+``, a dot word between
    digits as a dot. What stands between the numerals goes if ``joined``, else it stays, but for the
    white space about the marks."""
    edits = []
    for m in _RUN.finditer(text):
        parts = [(p.start(1), p.start(2), p.end(2), p[2].lower()) for p in _PART.finditer(m[0])]
        if sum(word in _VALUE for *_, word in parts) < least:
            continue
        marked = False
        for k, (gap, start, end, word) in enumerate(parts):
            mark = word not in _VALUE and not word[-1].isdigit()
            new = _VALUE.get(word) or ("+" if word == "plus" else "." if mark else word)
            if joined:
                edits.append((m.start() + (gap if k else start), m.start() + end, new))
            elif mark or marked or word in _VALUE:
                near = k and (marked or (mark and word != "plus"))
                edits.append((m.start() + (gap if near else start), m.start() + end, new))
            marked = mark
    return Rewrite(text, edits)


#: (least, joined) of the readings of spelled digits; a span of an earlier one wins.
_READINGS = ((SPELLED, True), (1, False), (1, True))


_BOXED = re.compile(rf"{_OPEN}(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.){_CLOSE}", re.I)
_BARE = re.compile(rf"[\s_](?:{_DOT_WORDS})[\s_]", re.I)
_BARE_AT = re.compile(rf"\s(?:{_AT_WORDS})\s[A-Za-z0-9-]+\.[A-Za-z0-9]|[A-Za-z0-9](?:_(?:{_AT_WORDS})_|\(a\))[A-Za-z0-9]", re.I)
_RUN_WORDS = frozenset([*_VALUE, "plus", *_DOT_WORDS.split("|")])


#: Letters and digits stay, all else that ``_FOREIGN`` leaves stands between words.
_APART = {c: " " for c in range(0x250) if not chr(c).isalnum()}


def _has_run(small: str) -> bool:
    """Whether some words in a row, numerals among them, hold a spelled digit and the four digits
    that any number has."""
    words = small.translate(_APART).split()
    if _VALUE.keys().isdisjoint(words):
        return False
    spelled, digits = False, 0
    for word in words:
        if word in _VALUE:
            spelled, digits = True, digits + 1
        elif word.isdigit():
            digits += len(word)
        elif word not in _RUN_WORDS:
            spelled, digits = False, 0
        if spelled and digits >= 4:
            return True
    return False


def disguised(text: str) -> bool:
    """Whether the text holds any trace of a disguise; never false where a transducer would edit
    what a detector then finds."""
    if not text.isascii() and _FOREIGN.search(text):
        return True
    if _BOXED.search(text) or _BARE_AT.search(text):
        return True
    small = text.lower()
    if any(word in small for word in _DOT_WORDS.split("|")) and _BARE.search(text):
        return True
    return _has_run(small)


def scan(text: str) -> list[Span]:
    """Every span by kind and start: the plain ones, and disguised ones that meet no plain one of
    their kind. Offsets count code points, ends are exclusive."""
    base = detect(text)
    spans = {kind: [Span(kind, *at, False) for at in base[kind]] for kind in KINDS}
    if not disguised(text):
        return [s for kind in KINDS for s in spans[kind]]
    steps, current = [], text

    def look(steps: list[Rewrite]) -> None:
        found = detect(steps[-1].text)
        for kind in KINDS:
            taken, new = spans[kind], []
            ends, done = [s.end for s in taken], 0  # both in order, as spans of a kind don't meet
            for start, end in found[kind]:
                for step in reversed(steps):
                    start, end = step.back(start, end)
                k = bisect.bisect_right(ends, start)
                free = start >= done and not (k < len(taken) and taken[k].start < end)
                if free and re.search("[A-Za-z0-9]|[^\x00-\x7f]", text[start:end]):
                    new.append(Span(kind, start, end, True))
                    done = end
            if new:
                spans[kind] = sorted(taken + new, key=lambda s: s.start)

    for transducer in (homoglyphs, at_and_dot):
        step = transducer(current)
        if step.edits:
            steps.append(step)
            current = step.text
            look(steps)
    for least, joined in _READINGS:
        step = spelled_digits(current, least, joined)
        if step.edits:
            look([*steps, step])
    return [s for kind in KINDS for s in spans[kind]]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of ``kind, start, end,
    disguised, value`` by kind and start.

    A null text counts as empty; a text without findings has an empty array. Rows are independent:
    repeated rows repeat their result, an empty table gives an empty one, other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    entry = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_()), ("value", pa.string())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [[{**s._asdict(), "value": t[s.start : s.end]} for s in scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(entry))], ["doc_id", "spans"])

    return rows.mapInArrow(batches, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,disguised:boolean,value:string>>")
