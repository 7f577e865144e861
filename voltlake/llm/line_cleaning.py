"""Line-first quality rules: judge every line, take failing lines out, then reject texts that lost too much.

A line fails by its punctuation (too many words with symbols, or a long line without any sentence mark), as
navigation (a menu: separators between entries, or nothing but a link's caption) or as boilerplate (licence and
cookie notices, hints about scripts). What stays is the cleaned text. Blank lines are never judged. A document
is kept if it passes the base measures (length, repetition) and lost at most LOSS of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import unused

BLANKS = b" \t\n\x0b\f\r"
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: A line fails with symbols in more than one of so many words.
SYMBOL_WORDS = 10
#: A line of so many words needs a sentence mark somewhere.
LONG_LINE = 8
#: A line with so many separators that make up a quarter of its words is a menu.
SEPARATORS_LEAST = 3
#: Shares in percent: words a document may lose, words that may stand in repeated windows. Fewest words.
LOSS, REPEATED, FEWEST = 30, 50, 50

# Sentence marks, menu separators, captions of links, phrases of notices.
MARKS = ".!?:;…。！？；：।؟۔"
SEPARATORS = ("|", "/", "-", "–", "—", ">", ">>", "»", "›", "·", "•", "::")
CAPTIONS = (
    "home", "menu", "main menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous",
    "next page", "previous page", "back", "back to top", "read more", "learn more", "more", "share", "share this",
    "skip to content", "contact", "contact us", "about", "about us", "sitemap",
)
NOTICES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "uses cookies", "accept cookies", "enable javascript", "requires javascript", "licensed under", "released under the",
    "powered by", "lorem ipsum", "subscribe to our", "click here",
)
_MARK = re.compile("|".join(re.escape(mark) for mark in MARKS).encode())
_NOTICE = re.compile("|".join(NOTICES).encode())
_SEPARATORS = frozenset(mark.encode() for mark in SEPARATORS)
_CAPTIONS = frozenset(caption.encode() for caption in CAPTIONS)
_SYMBOL_BYTES = frozenset(SYMBOLS)


def fault(line: bytes, words: list[bytes]) -> str | None:
    """Why a line of at least one word has to go: punctuation, navigation, boilerplate; None if it may stay.

    Letters A-Z compare as a-z. The first reason in the order navigation, boilerplate, punctuation is named.
    """
    separators = sum(word in _SEPARATORS for word in words)
    plain = b" ".join(words).lower()
    if separators >= SEPARATORS_LEAST and 4 * separators >= len(words) or plain.strip(b".!: ") in _CAPTIONS:
        return "navigation"
    if _NOTICE.search(plain):
        return "boilerplate"
    if len(line.translate(None, SYMBOLS)) < len(line):
        marked = sum(not _SYMBOL_BYTES.isdisjoint(word) for word in words)
        if SYMBOL_WORDS * marked > len(words):
            return "punctuation"
    if len(words) >= LONG_LINE and not _MARK.search(line):
        return "punctuation"
    return None


def repeated(ids: np.ndarray) -> int:
    """How many words stand in three-word windows that the text holds twice or more, the first included."""
    if len(ids) < 3:
        return 0
    base = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)
    _, place, counts = np.unique(pairs * base + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        inside[shift:len(ids) - 2 + shift] |= twice
    return int(inside.sum())


@dataclass(frozen=True)
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_navigation: int
    n_boilerplate: int
    n_punctuation: int
    n_lost_words: int
    base_failed: bool
    kept: bool
    clean_text: str


def cleaned_text(text: str | None) -> Verdict:
    """Measures, removed lines by reason, verdict and cleaned text of one document; null has no word and no text.

    Time and memory are linear in the text (n log n for the repeated windows). A text that loses no line comes
    out as it went in.
    """
    text = text or ""
    data = text.encode()
    known: dict[bytes, int] = {}
    ids, seen, stay = [], set(), []
    gone = {"navigation": 0, "boilerplate": 0, "punctuation": 0}
    again = lost = total = 0
    for line in data.split(b"\n"):
        words = line.split()  # of bytes: at the six ASCII blanks only
        if not words:
            stay.append(line)
            continue
        ids.append(np.fromiter((known.setdefault(word, len(known)) for word in words), dtype=np.int64, count=len(words)))
        total += len(words)
        again += line in seen
        seen.add(line)
        reason = fault(line, words)
        if reason is None:
            stay.append(line)
        else:
            gone[reason] += 1
            lost += len(words)
    repeats = repeated(np.concatenate(ids)) if ids else 0
    base_failed = total < FEWEST or 100 * repeats > REPEATED * total
    return Verdict(
        total, len(text) - (len(data) - len(data.translate(None, BLANKS))), len(data) - len(data.translate(None, SYMBOLS)),
        again, repeats, gone["navigation"], gone["boilerplate"], gone["punctuation"], lost, base_failed,
        not base_failed and 100 * lost <= LOSS * total, b"\n".join(stay).decode())


_ARROW = {"int": pa.int64(), "bool": pa.bool_(), "str": pa.string()}
_SPARK = {"int": "long", "bool": "boolean", "str": "string"}
_FIELDS = {name: field.type for name, field in Verdict.__dataclass_fields__.items()}


def judged(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, the measures, lines removed by reason, the verdict; its cleaned text if asked.

    Null text counts as empty: no word, base failed, not kept. Rows that repeat are judged each; an empty table
    gives no rows. Each document is judged alone, so nothing is shuffled.
    """
    names = [name for name in _FIELDS if with_text or name != "clean_text"]
    layout = pa.schema([("doc_id", pa.int64())] + [(name, _ARROW[_FIELDS[name]]) for name in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cleaned_text(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([getattr(v, name) for v in found], layout.field(name).type) for name in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], schema=layout)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, ", ".join(["doc_id long", *(f"{name} {_SPARK[_FIELDS[name]]}" for name in names)]))


def filtered(docs: DataFrame) -> DataFrame:
    """The kept rows of `docs` with all their columns, `text` cleaned."""
    verdict = unused(docs, "_verdict")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cleaned_text(text.as_py()) for text in batch.column("text")]
            at = batch.schema.get_field_index("text")
            whole = batch.set_column(at, "text", pa.array([v.clean_text for v in found], pa.string()))
            yield whole.append_column(verdict, pa.array([v.kept for v in found]))

    layout = docs.withColumn(verdict, F.lit(True)).schema
    return docs.mapInArrow(work, layout).where(verdict).drop(verdict)
