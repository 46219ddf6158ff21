"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and reports short anchors: at-signs, scheme
marks, plus signs before a digit, digits joined by a dot, adjoining digits and account cues. Around each
anchor a deterministic parser expands to the boundaries of one kind of span and validates it. The parsers
give exactly the leftmost non-overlapping matches of the base patterns, since each anchor lies in exactly
one maximal run of its kind.

Defined results: a null text counts as empty and has no spans; rows are independent, so repeated rows and
ties get equal results; an empty table gives an empty table; only the id and text columns are read, so other
columns can have any names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed order of kinds; the first four are the base kinds, the others are added by the method.
KINDS = ("email", "ip", "card", "phone", "login", "iban")
BASE = 4
EMAIL, IP, CARD, PHONE, LOGIN, IBAN = range(6)

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGIT_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+")
_LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)")

_automaton = None


def automaton():
    """The anchors, built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", (EMAIL, 1))
        a.add_word("://", (LOGIN, 3))
        for cue in ("IBAN", "Iban", "iban"):
            a.add_word(cue, (IBAN, 4))
        for x in _DIGITS:
            a.add_word("+" + x, (PHONE, 2))
            for y in _DIGITS:
                a.add_word(f"{x}.{y}", (IP, 3))
                a.add_word(x + y, (CARD, 2))
                a.add_word(f"{x} {y}", (CARD, 3))
                a.add_word(f"{x}-{y}", (CARD, 3))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order; offsets in code points, ends exclusive."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where the next match of a kind may begin
    for at, (kind, width) in automaton().iter(text):
        start = at - width + 1
        if start < done[kind]:
            continue
        if kind == EMAIL:
            domain = _DOMAIN.match(text, start + 1)
            if domain:
                lo, least = start, done[EMAIL]
                while lo > least and text[lo - 1] in _LOCAL:
                    lo -= 1
                if lo < start:
                    out.append((lo, EMAIL, domain.end()))
                    done[EMAIL] = domain.end()
        elif kind == CARD:
            run = _DIGIT_RUN.match(text, start)
            done[CARD] = run.end()
            digits = run.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((start, CARD, run.end()))
        elif kind == IP:
            lo, least = start, done[IP]
            while lo > least and text[lo - 1] in _DIGITS:
                lo -= 1
            run = _DOTTED.match(text, lo)
            done[IP] = run.end()
            parts = run.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = lo + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append((lo, IP, end))
                lo = end + 1
        elif kind == PHONE:
            run = _PHONE_RUN.match(text, start)
            if run:
                body = run.group().rstrip(" ().-")
                if len(body) >= 4:
                    done[PHONE] = start + len(body)
                    if 10 <= sum(c in _DIGITS for c in body) <= 15:
                        out.append((start, PHONE, start + len(body)))
        elif kind == LOGIN:
            rest = _LOGIN.match(text, start)
            lo = start
            while lo > 0 and lo > start - 12 and text[lo - 1].isascii() and text[lo - 1].isalpha():
                lo -= 1
            if rest and lo < start:
                out.append((lo, LOGIN, rest.end()))
                done[LOGIN] = rest.end()
        else:
            code = _IBAN.match(text, at + 1)
            if code and iban_valid(code.group(1)):
                out.append((code.start(1), IBAN, code.end(1)))
                done[IBAN] = code.end()
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    spans = find_spans(text) if text else []
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join(out) + text[at:]


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, digest of the base spans, all spans."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [find_spans(t) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in r if s[1] < BASE] for r in rows]
            counts = [pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in range(BASE)]
            digests = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digests, pa.array(map(joined, rows), pa.string())],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {_SCHEMA}")


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All columns of df, the spans of the text masked and its length column brought up to date."""
    names = df.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            columns = batch.columns
            old = columns[at].to_pylist()
            new = [redact(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                kept = columns[length_at].to_pylist()
                columns[length_at] = pa.array(
                    [n if a == b or b is None else len(b) for n, a, b in zip(kept, old, new)], columns[length_at].type
                )
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
