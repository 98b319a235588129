"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, schemes, plus signs, digits and cues of
identifiers. At each anchor a local parser expands to the left and to the right, validates what it
has found, and reports the boundary. Only the surroundings of anchors are ever parsed.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Addresses with a user part, and identifiers that follow their cue.
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_NUMBER = re.compile(r"""(?:\x20?(?:number|no\.?|id|#))?["']?\x20?[:=#]?\x20?["']?([A-Za-z]{0,2}[0-9])""", re.I | re.A)
_IBAN = re.compile(r"""(?:\x20?(?:number|no\.?|id|#))?["']?\x20?[:=#]?\x20?["']?([A-Za-z]{2}[0-9]{2})""", re.I | re.A)
_GROUP = re.compile(r"[ -]?([A-Za-z0-9]{1,35})")
#: The longest IBAN.
IBAN_CHARS = 34
#: A part of an account number: its first, or a further one, which is digits and at most a letter and no date, decimal or time.
_FIRST = re.compile(r"[A-Za-z]{0,2}[0-9][A-Za-z0-9]{0,34}(?![A-Za-z0-9])")
_FURTHER = re.compile(r"([ -])(?!(?<= )[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]))([0-9]{1,18}[A-Za-z]?)(?![A-Za-z0-9]|[.,:/][0-9])")
#: Cues of identifiers, in lower case, with the least and the greatest number of digits that follow.
CUES = {"iban": (10, 34), "account": (6, 18), "acct": (6, 18), "passport": (6, 9), "ssn": (9, 9), "social security": (9, 9), "tax id": (8, 13)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """The check digits of ISO 13616: rearranged and read as a number, the rest by 97 is 1."""
    s = re.sub(r"[ -]", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """The furthest end of a group at which what starts there is a valid IBAN, or 0. Groups of letters only have four
    at most, in the case of the country; nothing beyond the longest IBAN is looked at."""
    upper, ends, total, at = text[start : start + 2].isupper(), [], 0, start
    while m := _GROUP.match(text, at):
        group, at = m[1], m.end()
        total += len(group)
        if total > IBAN_CHARS or (group.isalpha() and (len(group) > 4 or group.isupper() != upper)):
            break
        ends.append(at)
    return next((e for e in reversed(ends) if iban_valid(text[start:e])), 0)


def number_end(text: str, start: int, least: int, most: int) -> int:
    """The end of the number that starts here, if it has from `least` to `most` digits, or 0.

    Parts behind hyphens belong to it, up to `most` digits. Parts behind spaces do while digits are
    lacking; beyond that only those as long as the first, so that dates and counts that follow stay.
    """
    m = _FIRST.match(text, start)
    if not m:
        return 0
    first, digits, end = len(m[0]), sum("0" <= c <= "9" for c in m[0]), m.end()
    while m := _FURTHER.match(text, end):
        more = digits + sum("0" <= c <= "9" for c in m[2])
        if more > most or (m[1] == " " and digits >= least and len(m[2]) != first):
            break
        digits, end = more, m.end()
    return end if least <= digits <= most else 0


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, "digit")
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(word, kind)
    for cue in CUES:
        found.add_word(cue, cue)
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that validates; each kind's spans don't overlap. Time grows with the text only:
    anchors within what was parsed already are skipped."""
    out = []
    email_end = ip_end = card_end = url_end = account_end = 0
    for at, kind in anchors.iter(lowered(text)):
        if kind == "digit":
            if at >= ip_end:
                # a digit run starts here, or goes on where the last address ended
                if at == ip_end or not ("0" <= text[at - 1] <= "9"):
                    m = _IP.match(text, at)
                    if m:
                        ip_end = m.end()
                        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                            out.append((at, ip_end, "ip"))
            if at >= card_end:
                m = _CARD.match(text, at)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, card_end, "card"))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                m = _EMAIL.match(text, start)
                if m:
                    email_end = m.end()
                    out.append((start, email_end, "email"))
        elif kind == "plus":
            m = _PHONE.match(text, at)
            if m and 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((at, m.end(), "phone"))
        elif kind == "scheme":
            start = at - 2
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at - 2 and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            m = _URL.match(text, start)
            if m:
                url_end = m.end()
                out.append((start, url_end, "url"))
        elif at + 1 >= account_end:
            m = (_IBAN if kind == "iban" else _NUMBER).match(text, at + 1)
            if m:
                start, (least, most) = m.start(1), CUES[kind]
                end = iban_end(text, start) if kind == "iban" else number_end(text, start, least, most)
                if sum("0" <= c <= "9" for c in text[start:end]) >= least:
                    account_end = end
                    out.append((start, end, "account"))
    return out


_RANK = {k: i for i, k in enumerate(KINDS)}


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1])))


def redact(text: str, anchors: ahocorasick.Automaton) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, done = [], 0
    for a, b, kind in sorted(spans_of(text, anchors), key=lambda s: (s[0], _RANK[s[2]])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _rows(batches):
    anchors = automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    for batch in batches:
        got = []
        for text in batch.column(1).to_pylist():
            spans = spans_of(text, anchors)
            base = [s for s in spans if s[2] in BASE]
            count = [s[2] for s in base]
            got.append((*(count.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*got, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base spans, their digest, and all spans.

    Offsets are code points, ends exclusive. A null text counts as empty and has no spans. Ids may
    repeat or be null; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    return texts(docs, id_col, text_col).mapInArrow(_rows, _SCHEMA)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows of `docs`, repeated ones and those without an id too, with personal data replaced in `text_col`.

    Null texts stay null, empty ones empty; `chars_col`, if there, follows the text (0 for a null).
    Other columns, of any name, are left as they are; an empty table gives no rows.
    """
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        anchors = automaton()
        for batch in batches:
            out = [None if x is None else redact(x, anchors) for x in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if chars is not None:
                field = batch.schema.field(chars)
                batch = batch.set_column(chars, field, pa.array([len(x or "") for x in out], field.type))
            yield batch

    return mapped(docs, run)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
