"""Secret scan: fixed shapes, and a sliding-window entropy per character class.

Candidate strings are maximal runs of key-like characters. A window slides over each run; its
character counts change by one character in and one out, and the sum of c*log2(c) is kept along
with them, so each step costs two table look-ups. Runs whose best window passes the threshold of
its alphabet become spans; windows that touch something on the allow list don't count.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What ASSIGN can start with; a text without any of these is not scanned for it.
_CUES = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits per character that a window of hex digits must reach, and how many standard deviations
#: below the mean of random strings other alphabets may stay.
HEX_BITS, SPREAD = 3.0, 2.5
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
_WORDY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/=+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
_RUNS = re.compile(r"abcdefgh|ABCDEFGH|12345678|01234567|qwertyui|(.)\1{5,}", re.S)
#: Strings of documentation that look like secrets.
ALLOWED = ("example", "changeme", "placeholder", "your_key", "dummy", "xxxxxx")
_ALLOWED = re.compile("|".join(ALLOWED), re.I | re.A)
_BASE32 = re.compile(r"(?:[A-Z2-7]+|[a-z2-7]+)=*")

_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_LOG_WINDOW = math.log2(WINDOW)


def char_class(run: str) -> str:
    if _HEX_ONLY.fullmatch(run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


@functools.cache
def random_bits(size: int) -> float:
    """What nearly all random windows over an alphabet of `size` characters reach: the mean less SPREAD standard deviations, exactly."""
    n, p, f = WINDOW, 1 / size, _CLOG
    one = [math.comb(n, c) * p**c * (1 - p) ** (n - c) for c in range(n + 1)]
    mean = sum(w * x for w, x in zip(one, f, strict=True))
    square = sum(w * x * x for w, x in zip(one, f, strict=True))
    both = sum(math.comb(n, a) * math.comb(n - a, b) * p ** (a + b) * (1 - 2 * p) ** (n - a - b) * f[a] * f[b] for a in range(n + 1) for b in range(n - a + 1))
    variance = size * square + size * (size - 1) * both - (size * mean) ** 2
    return _LOG_WINDOW - (size * mean + SPREAD * math.sqrt(max(variance, 0.0))) / n


def threshold(part: str) -> float:
    """Bits per character that a window of `part` must reach, by the smallest usual alphabet that holds it."""
    if _HEX_ONLY.fullmatch(part):
        return HEX_BITS
    if _BASE32.fullmatch(part):
        return random_bits(32)
    lower, upper, digit = part.upper() != part, part.lower() != part, any(c.isdigit() for c in part)
    return random_bits(26 * lower + 26 * upper + 10 * digit + 2 * (not part.rstrip("=").isalnum()))


def best_entropy(run: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy, in bits per character, of any window of the run, by incremental counts."""
    clog = _CLOG if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for ch in run[:window]:
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += clog[c + 1] - clog[c]
    least = total
    for i in range(window, len(run)):
        new, old = run[i], run[i - window]
        if new == old:
            continue
        c = counts[old]
        counts[old] = c - 1
        total += clog[c - 1] - clog[c]
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += clog[c + 1] - clog[c]
        if total < least:
            least = total
    return math.log2(window) - least / window


def free_parts(run: str) -> list[str]:
    """What the allow list leaves of a run, in pieces of a window at least: the list knows identifiers, counters,
    documentation strings, and plain words joined by separators."""
    if _WORDY.fullmatch(run):
        return []
    out, at = [], 0
    hits = sorted(m.span() for known in (_UUID, _RUNS, _ALLOWED) for m in known.finditer(run))
    for a, b in [*hits, (len(run), len(run))]:
        if a - at >= WINDOW and not (hits and _WORDY.fullmatch(run[at:a].strip("-_/=+"))):
            out.append(run[at:a])
        at = max(at, b)
    return out


def allowed(run: str) -> bool:
    """Whether the allow list leaves no window of a run."""
    return not free_parts(run)


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidate runs with a window over its alphabet's threshold; runs need letters and digits."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if run.isalpha() or run.isdigit() or not any(c.isdigit() for c in run):
            continue
        if any(best_entropy(part) >= threshold(part) for part in free_parts(run)):
            out.append((m.start(), m.end(), f"entropy_{char_class(run)}"))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three fixed shapes, leftmost and non-overlapping per kind; failing matches are dropped."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


#: Runs of HEX are maximal, so those of 24 and more can be sought at once.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RANK = {k: i for i, k in enumerate(KINDS)}


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1])))


def scan(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    kinds = [k for _, _, k in base]
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + entropy_spans(text))


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _rows(batches):
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    for batch in batches:
        got = [scan(x) for x in batch.column(1).to_pylist()]
        cols = list(zip(*got, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base spans, their digest, and all spans.

    Offsets are code points, ends exclusive. A null text counts as empty and has no spans. Ids may
    repeat or be null; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    return texts(docs, id_col, text_col).mapInArrow(_rows, _SCHEMA)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
