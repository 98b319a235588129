"""Quality rules: base figures of the whole text, then line-first cleaning.

Each line is judged alone by punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses more than half of its words is rejected.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, mapped, texts

#: Phrases of page furniture, by language, in lower case; they count in any case within a line of at most 40 words.
PHRASES = {
    "en": (
        "all rights reserved", "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies", "accept all cookies", "terms of use", "terms of service", "enable javascript",
        "subscribe to our", "sign up for our", "click here to", "follow us on", "skip to content", "skip to main content", "back to top", "share this article", "share this page",
    ),
    "de": (
        "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "verwendet cookies", "verwenden cookies", "cookies akzeptieren", "cookies zulassen", "nutzungsbedingungen",
        "aktivieren sie javascript", "newsletter abonnieren", "klicken sie hier", "folgen sie uns", "zum inhalt springen", "zum hauptinhalt springen", "zurück nach oben", "diesen artikel teilen",
    ),
    "fr": (
        "tous droits réservés", "politique de confidentialité", "politique de cookies", "utilise des cookies", "utilisons des cookies", "accepter les cookies", "accepter tous les cookies",
        "conditions d'utilisation", "conditions générales d'utilisation", "activer javascript", "abonnez-vous à", "cliquez ici", "suivez-nous sur", "aller au contenu", "haut de page", "partager cet article",
    ),
    "es": (
        "todos los derechos reservados", "política de privacidad", "política de cookies", "utiliza cookies", "utilizamos cookies", "aceptar cookies", "aceptar todas las cookies", "términos de uso",
        "condiciones de uso", "habilite javascript", "suscríbete a", "haga clic aquí", "síguenos en", "saltar al contenido", "volver arriba", "compartir este artículo",
    ),
}
_SEPARATORS = (b"|", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2")
_ENDS = re.compile(rb"[.!?;:]|\xe2\x80\xa6|\xe3\x80\x82|\xd8\x9f|\xef\xbc\x81|\xef\xbc\x9f")
_SYMBOLS = b"#*$%&|<>"
_DROP_SYMBOLS = bytes(_SYMBOLS)
#: A line of so many words needs a mark that ends a sentence.
LONG_LINE = 30
WINDOW = 5


@cache
def _phrases() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases in PHRASES.values():
        for phrase in phrases:
            found.add_word(phrase, phrase)
    found.make_automaton()
    return found


def has_furniture(text: bytes) -> bool:
    """Whether a phrase of page furniture is in the text, in any case."""
    return next(_phrases().iter(text.decode("utf-8", "replace").lower()), None) is not None


def line_fails(line: bytes, furniture: bool = True) -> bool:
    """Whether one line is navigation, boilerplate or lacks the punctuation of prose; a blank line never fails.

    Without `furniture` the text around it is known to have no phrase of it.
    """
    words = line.split()
    if not words:
        return False
    n = len(words)
    if sum(map(words.count, _SEPARATORS)) >= max(2, n // 5):
        return True
    if furniture and n <= 40 and has_furniture(line):
        return True
    symbols = len(line) - len(line.translate(None, _DROP_SYMBOLS))
    return symbols * 5 > len(line) or (n >= LONG_LINE and not _ENDS.search(line))


def clean_lines(text: bytes) -> tuple[bytes, int, int]:
    """The text without failing lines, the number of those lines and of their words."""
    lines = text.split(b"\n")
    furniture = has_furniture(text)
    failed = [line_fails(x, furniture) for x in lines]
    if not any(failed):
        return text, 0, 0
    gone = [x for x, f in zip(lines, failed, strict=True) if f]
    return b"\n".join(x for x, f in zip(lines, failed, strict=True) if not f), len(gone), sum(len(x.split()) for x in gone)


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]


def repeat_words(ids: np.ndarray) -> int:
    """Words, given by their numbers, in windows found twice or more: windows are numbered by the numbers of their parts."""
    if len(ids) <= WINDOW:
        return 0
    two = _ranked(ids[:-1], ids[1:])
    if two.max() + 1 == len(two):
        return 0
    five = _ranked(_ranked(two[:-2], two[2:])[:-1], ids[4:])
    starts = np.flatnonzero(np.bincount(five)[five] > 1)
    return int(np.minimum(np.diff(starts, append=len(ids)), WINDOW).sum())


def figures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, n_words_removed."""
    seen: dict[bytes, int] = {}
    lines = text.split(b"\n")
    ids = np.fromiter((seen.setdefault(w, len(seen)) for x in lines for w in x.split()), np.int64)
    n = len(ids)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in SPACE)
    symbols = len(text) - len(text.translate(None, _DROP_SYMBOLS))
    lines = [x for x in lines if x.strip()]
    repeats = repeat_words(ids)
    failed = n < 10 or 100 * repeats > 20 * n
    _, n_lines, lost = clean_lines(text)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, not failed and 2 * lost <= n, n_lines, lost


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"


def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            got = [figures(x) for x in part.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base figures, base_failed, kept and what the line rules remove.

    A null or empty text has no words and fails. Ids may repeat or be null; other columns are
    ignored. An empty table gives no rows. No shuffle: every text is judged on its own.
    """
    return texts(docs, id_col, text_col, binary=True).mapInArrow(_rows, _SCHEMA)


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` that the rules keep, all columns; texts lose their failing lines, `chars_col`, if there, follows.

    Null and empty texts have no words and go. Repeated rows and rows without an id are judged like
    any other; other columns may have any names. An empty table gives no rows.
    """
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            keep, out = [], []
            for x in batch.column(at).to_pylist():
                raw = (x or "").encode()
                good = figures(raw)[6]
                keep.append(good)
                if good:
                    out.append(clean_lines(raw)[0].decode())
            left = batch.filter(pa.array(keep, pa.bool_()))
            left = left.set_column(at, left.schema.field(at), pa.array(out, left.schema.field(at).type))
            if chars is not None:
                field = left.schema.field(chars)
                left = left.set_column(chars, field, pa.array([len(x) for x in out], field.type))
            yield left

    return mapped(docs, run)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
