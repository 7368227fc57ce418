r"""Personal data behind disguises, found with offsets into the source.

Base detectors run on the source text. Then a chain of transducers rewrites it: look-alike characters and digits of
other scripts become ASCII, characters without width vanish, at/dot disguises become ``@`` and ``.``, and runs of
spelled digits, dots in words between numbers among them, become digits. A transducer is a rule and a rewriting; next to
each character of its output it keeps the span of the source that the character came from. The detectors run again on the last output, and what they find
is mapped back. A span is added unless a base span of its kind covers it.

Every step is linear in the text: runs start where a run of their characters starts, and addresses are sought from
their ``@``. Texts without a trigger skip the rewriting. Rows are independent; nothing is shuffled.

Cases: a null text counts as empty and has no spans; repeated rows are scanned alike; very long texts are scanned
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from claritable.llm.common import documents, query
from claritable.llm.spans import Span, scan_spans

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(x) for x in digits[-1::-2])
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and not _NOT_LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at:
            found.append((start, m.end()))
            last = m.end()
    return found


def detect(text: str) -> list[Span]:
    """Base spans, leftmost and without overlap for each kind; matches that fail the rule are dropped."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                  if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                      if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return spans


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", "․": ".", "。": ".", "﹫": "@",
}
# Names of the digits from 0 to 9 in English, German, French and Spanish.
DIGIT_NAMES = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
# Last labels that make a host written in plain words an address.
TOP_LABELS = ("com org net edu gov info biz io co dev app example test invalid eu de fr es uk us ca au ch at nl it").split()
_VALUE = {name: str(k) for k, names in enumerate(DIGIT_NAMES) for name in names}
#: Digits, spelled or written, that a run of numbers must have before it is rewritten.
LEAST_DIGITS = 4

_NAME = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_DOT_WORD = "(?:dot|point|punkt|punto)"
_RUN = re.compile(
    rf"\b(?:plus[\s-]+)?(?:{_NAME}|[0-9]+)\b"
    rf"(?:(?:[\s,-]{{1,3}}|[\s,-]*\b{_DOT_WORD}[\s,-]+)(?:{_NAME}|[0-9]+)\b)+", re.I)
_PART = re.compile(rf"(plus)|({_NAME}\b)|([0-9]+)|({_DOT_WORD})", re.I)
_OPEN, _SHUT = r"\s{0,3}[\[({<] ?", r" ?[\])}>]\s{0,3}"
_BETWEEN = rf"(?:\s{{1,3}}{_DOT_WORD}\s{{1,3}}|{_OPEN}(?:{_DOT_WORD}|\.){_SHUT})"
_KNOWN_LABEL = rf"(?:{'|'.join(TOP_LABELS)})\b"
_AT = re.compile(
    rf"{_OPEN}(?:at|ät|arroba|arobase|@){_SHUT}|(?<=[A-Za-z0-9])\s{{1,3}}(?:at|arroba|arobase)\s{{1,3}}"
    rf"(?=[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_BETWEEN})[A-Za-z0-9-]{{1,63}}){{0,4}}{_BETWEEN}{_KNOWN_LABEL})", re.I)
_BRACKET_DOT = re.compile(rf"{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}", re.I)
_WORD_DOT = re.compile(rf"\s{{1,3}}{_DOT_WORD}\s{{1,3}}", re.I)
#: After an at sign: any last label if all dots are words; a known one if the host is an address without the words.
_HOST_DOT = re.compile(
    rf"(?<=@)[A-Za-z0-9-]{{1,63}}(?:(?:{_WORD_DOT.pattern}[A-Za-z0-9-]{{1,63}}){{0,4}}{_WORD_DOT.pattern}[A-Za-z]{{2,24}}\b"
    rf"|(?:(?:\.|{_WORD_DOT.pattern})[A-Za-z0-9-]{{1,63}}){{0,4}}?{_WORD_DOT.pattern}{_KNOWN_LABEL})", re.I)
_LOCAL_DOT = re.compile(
    rf"(?:[A-Za-z0-9_%+-]{{1,64}}{_WORD_DOT.pattern}){{1,4}}(?=[A-Za-z0-9._%+-]{{1,64}}@)", re.I)
_WIDTHLESS = re.compile("[​‌‍⁠﻿­]+")
#: One of these is in every text that has an at/dot disguise in words; plain searches are quick.
_HINTS = ("dot", "punkt", "point", "punto", "at]", "at)", "at}", "at>", "at ]", "at )", "at }", "at >", "arroba]",
          "arroba)", "arobase]", "arobase)", "ät]", "ät)")
#: And these in all others that are rewritten; for text in lower case.
_BRACKETED = re.compile(r"[\[({<] ?[@.] ?[\])}>]")
_SPELLED = re.compile(rf"\b{_NAME}[\s,-]{{1,3}}{_NAME}\b")


class _Ascii(dict):
    """Character map: look-alikes by table, full-width forms and digits of other scripts by rule."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        if code < 128:
            out = code
        elif char in LOOKALIKES:
            out = ord(LOOKALIKES[char])
        elif 0xFF01 <= code <= 0xFF5E:
            out = code - 0xFEE0
        else:
            value = unicodedata.decimal(char, None)
            out = code if value is None else ord("0") + value
        self[code] = out
        return out


_ascii = _Ascii()


@dataclass
class Tape:
    """Text with the source span of each character."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text) + 1)
        return cls(text, at[:-1], at[1:])

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> Tape:
        """Each range of the text becomes what its edit says, which spans all of the range; ranges ascend."""
        text, starts, ends, last = [], [], [], 0
        for a, b, out in edits:
            text += [self.text[last:a], out]
            starts += [self.start[last:a], np.full(len(out), self.start[a])]
            ends += [self.end[last:a], np.full(len(out), self.end[b - 1])]
            last = b
        if not text:
            return self
        return Tape("".join([*text, self.text[last:]]), np.concatenate([*starts, self.start[last:]]),
                    np.concatenate([*ends, self.end[last:]]))

    def rewrite(self, rule: re.Pattern, out: str) -> Tape:
        return self.edit((*m.span(), out) for m in rule.finditer(self.text))

    def dotted(self, rule: re.Pattern) -> Tape:
        """The dot words in what ``rule`` matches become dots."""
        return self.edit((*w.span(), ".") for m in rule.finditer(self.text) for w in _WORD_DOT.finditer(self.text, *m.span()))


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn runs of numbers into digits: runs in which two spelled digits meet or a dot is a word."""
    for m in _RUN.finditer(text):
        parts = list(_PART.finditer(text, *m.span()))
        pairs = list(zip(parts, parts[1:], strict=False))
        if not any(p[4] or p[2] and q[2] for p, q in pairs):
            continue
        if sum(1 if p[2] else len(p[3] or "") for p in parts) < LEAST_DIGITS:
            continue
        for p, q in zip(parts, [*parts[1:], None], strict=True):
            if not p[3]:
                yield *p.span(), "+" if p[1] else _VALUE[p[2].lower()] if p[2] else "."
            if q and p.end() < q.start():
                yield p.end(), q.start(), "" if p[1] or p[4] or q[4] or p[2] and q[2] else " "


def normalise(text: str) -> Tape | None:
    """The tape after all transducers; None if none of them changes the text."""
    plain = text if text.isascii() else text.translate(_ascii)
    low = plain.lower()
    widthless = not text.isascii() and bool(_WIDTHLESS.search(text))
    if not (widthless or plain is not text and plain != text or any(x in low for x in _HINTS)
            or _BRACKETED.search(low) or _SPELLED.search(low)):
        return None
    tape = Tape.of(plain)
    tape = tape.rewrite(_WIDTHLESS, "") if widthless else tape
    # Numbers go first, since a dot within them belongs to their run.
    tape = tape.edit(_digits(tape.text)).rewrite(_AT, "@").rewrite(_BRACKET_DOT, ".")
    return tape.dotted(_HOST_DOT).dotted(_LOCAL_DOT) if "@" in tape.text else tape


def find_pii(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that only the normalised text shows."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, []
    by_kind = {k: sorted((a, b) for a, kind, b in base if kind == k) for k in range(len(KINDS))}
    more = set()
    for a, kind, b in detect(tape.text):
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        own = by_kind[kind]
        place = bisect_right(own, (start, len(text) + 1)) - 1
        if place < 0 or own[place][1] < end:
            more.add((start, kind, end))
    return base, sorted(more)


def scan_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: counts of base spans by kind, their digest, all spans."""
    return scan_spans(docs, find_pii, KINDS, KINDS, id_column, text_column)


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(documents(spark, sf_dir))
