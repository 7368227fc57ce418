r"""Secret scans: patterns, and a test of token efficiency.

Base detectors find assignments, access keys and hex strings. Then every run of key characters that is long enough, has a
letter and is no known digest or UUID is encoded with a tiktoken vocabulary; of names, only the long parts. Text that people write
takes few tokens for its characters; a random string takes many. Runs with fewer characters for a token than the
limit are added as kind ``random``, unless they lie within a base span.

Rows are independent; nothing is shuffled. All rules are linear in the text.

Cases: a null text counts as empty; repeated rows are scanned alike; very long texts are scanned whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from claritable.llm.common import documents, query
from claritable.llm.spans import Span, scan_spans
from claritable.llm.tokens import vocabulary_path

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a run, and the characters for a token below which it counts as random.
LEAST = 20
RATIO = 2.2
#: Characters from which a part of a name is tested by itself.
LONG_PART = 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
#: Parts of names, versions and dates: letters with a number, or digits with a mark.
_NAME_PART = re.compile(r"[A-Za-z]*[0-9]{0,8}|[0-9]{1,8}[A-Za-z]?(?:[0-9]{1,8}[A-Za-z]?)?")
# Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex digits.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


def detect(text: str) -> list[Span]:
    """Base spans, leftmost and without overlap for each kind; matches that fail the rule are dropped."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


_encodings: dict = {}


def _encoding(path: str):
    """The vocabulary, read once in each Python worker."""
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                             special_tokens={})
    return _encodings[path]


def known(run: str) -> bool:
    """Digests of usual lengths, UUIDs, and runs without a letter."""
    if _HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run):
        return True
    return not any(x.isalpha() for x in run)


def characters_per_token(run: str, path: str) -> float:
    return len(run) / len(_encoding(path).encode_ordinary(run))


def efficient(run: str, path: str, ratio: float) -> bool:
    """Whether a run takes few tokens; in a name of three or more plain parts, each long part by itself."""
    parts = re.split("[-_/]", run)
    if len(parts) > 2 and all(_NAME_PART.fullmatch(x) for x in parts):
        return all(characters_per_token(x, path) >= ratio for x in parts if len(x) >= LONG_PART)
    return characters_per_token(run, path) >= ratio


def finder(path: str, ratio: float = RATIO):
    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = detect(text)
        more = []
        # Base spans by start: those that begin up to a run cover it if the farthest end among them does.
        opened, reach, starts = 0, -1, sorted((x, y) for x, _, y in base)
        for m in _RUN.finditer(text):
            run = m[0].strip("=-_/+")
            a = m.start() + m[0].index(run) if run else 0
            while opened < len(starts) and starts[opened][0] <= a:
                reach = max(reach, starts[opened][1])
                opened += 1
            if len(run) >= LEAST and not known(run) and not efficient(run, path, ratio):
                b = a + len(run)
                if reach < b:
                    more.append((a, 3, b))
        return base, more
    return find


def scan_secrets(docs: DataFrame, path: str | None = None, ratio: float = RATIO, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: counts of base spans by kind, their digest, all spans."""
    find = finder(path or vocabulary_path(VOCABULARY), ratio)
    return scan_spans(docs, find, KINDS, BASE_KINDS, id_column, text_column)


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
