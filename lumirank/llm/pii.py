"""Personal data in texts by anchor expansion.

One Aho-Corasick automaton walks over a text and stops at anchors only: at-signs, digits, scheme marks and
the words that announce an identifier. At each anchor a small parser looks left and right for the
boundaries of what the anchor belongs to and tests it: address parts, number parts, check digits.
Text between anchors is never looked at by a parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import with_columns_from

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn", "account")
BASE = KINDS[:4]

# Words that announce an identifier, in the casings they come in. Fixed values.
_CUES = {
    "iban": ("iban", "IBAN", "Iban"),
    "ssn": ("ssn", "SSN", "social security", "Social Security", "Social security"),
    "account": ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta"),
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9 ().+-]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:.#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?: number| no\.?)?[\s:.#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?: number| no\.?| nr\.?| num\.?)?\s?[:.#]\s?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    """The mod-97 rule of account numbers of the international form."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("number", 1))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("login", 3))
    for kind, cues in _CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """Expand an at-sign: the local part may start at `free` at the earliest."""
    start = at
    while start > free and _LOCAL.match(text, start - 1):
        start -= 1
    domain = start < at and _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Addresses, cards and phones inside a run of digits and their separators."""
    run = text[start:end]
    for m in _IP.finditer(run):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", start + m.start(), start + m.end()
    for m in _CARD.finditer(run):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", start + m.start(), start + m.end()
    for m in _PHONE.finditer(run):
        if 10 <= len(_digits(m[0])) <= 15:
            yield "phone", start + m.start(), start + m.end()


def _cued(kind: str, text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at `at`."""
    m = {"login": _LOGIN, "iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[kind].match(text, at)
    if not m:
        return None
    if kind == "login":
        return m.span()
    if kind == "iban":
        # What follows may look like a part of it: the longest head that holds counts.
        for end in range(m.end(1), m.start(1) + 14, -1):
            if text[end - 1] != " " and iban_holds(text[m.start(1) : end]):
                return m.start(1), end
        return None
    return m.span(1)


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of everything found, in code points, by start and kind."""
    spans: list[tuple[int, int, int]] = []
    free = {"email": 0, **{k: 0 for k in _CUES}, "login": 0}
    run_end = 0
    for last, (what, _) in automaton.iter(text):
        if what == "number":
            if last < run_end:
                continue
            start = last
            while start > run_end and _NUMERIC.fullmatch(text, start - 1, start):
                start -= 1
            run_end = _NUMERIC.match(text, last).end()
            spans.extend((s, KINDS.index(k), e) for k, s, e in _numbers(text, start, run_end))
        elif what == "email":
            if found := _email(text, last, free["email"]):
                free["email"] = found[1]
                spans.append((found[0], 0, found[1]))
        elif last + 1 >= free[what]:
            if found := _cued(what, text, last + 1):
                free[what] = found[1]
                spans.append((found[0], KINDS.index(what), found[1]))
    return sorted(set(spans))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FIELDS = [
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts per kind (`n_email` ...), `base_spans` and `spans` (kind:start:end, comma-joined).

    Whole texts are searched; positions count code points, ends are exclusive. Base kinds follow their
    patterns from left to right without overlap within a kind, and a match that fails its test (parts over
    255, number of digits, check digit) is dropped without another try. The other kinds are found after
    their cue only. A null or empty text has no spans; rows are independent of each other; columns with the
    names that are added are replaced, others stay; an empty table gives an empty table.
    """

    def make() -> Callable:
        automaton = _automaton()

        def find(texts) -> list:
            found = [find_spans(t, automaton) if t else [] for t in texts.to_pylist()]
            counts = [pa.array([sum(1 for s in f if s[1] == k) for f in found], pa.int64()) for k in range(len(KINDS))]
            base = [spans_text([s for s in f if s[1] < len(BASE)]) for f in found]
            return [*counts, pa.array(base, pa.string()), pa.array([spans_text(f) for f in found], pa.string())]

        return find

    return with_columns_from(docs, [text], _FIELDS, make)


def masked(docs: DataFrame, text: str = "text", mark: str = "*") -> DataFrame:
    """Replace `text` with the same text whose personal data is overwritten by `mark`; nulls stay null."""

    def make() -> Callable:
        automaton = _automaton()

        def clean(value: str | None) -> str | None:
            if not value:
                return value
            out, at = [], 0
            for start, _, end in find_spans(value, automaton):
                if end > at:
                    out += [value[at : max(start, at)], mark * (end - max(start, at))]
                    at = end
            return "".join([*out, value[at:]])

        return lambda texts: [pa.array([clean(t) for t in texts.to_pylist()], pa.string())]

    found = with_columns_from(docs, [text], [T.StructField(text, T.StringType())], make)
    return found.select(*docs.columns)


def private_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    found = personal_data(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )
