"""Line-first quality rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardline.llm.batches import BYTE_CODE, LOWER, Words, mix, prefix_sums, slices, span_hashes
from wardline.llm.repeats import covered

_U = np.uint64


def _table(letters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(letters)] = True
    return out


SYMBOL = _table(b"#*$%&|<>")
SEPARATOR = _table(b"|>/*-\\")
CLOSING = _table(b".!?:;\"')]}")
UPPER = _table(bytes(range(0x41, 0x5B)))
LETTER = UPPER | _table(bytes(range(0x61, 0x7B)))
#: last bytes of the ellipsis, closing quotes and ideographic stops
WIDE_CLOSING = tuple(c.encode() for c in "…”’»。！？")
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "copyright (c)",
    "permission is hereby granted",
    "without warranty",
    "enable javascript",
    "click here",
    "sign up",
    "log in",
    "subscribe to",
    "lorem ipsum",
)


@dataclass
class Lines:
    """Lines of the texts of a slice that hold a word."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray  # first word of the line
    words: np.ndarray
    repeated: np.ndarray  # equal to an earlier line of the text


def lines_of(words: Words) -> Lines:
    data, offsets = words.data, words.offsets
    cuts = np.flatnonzero(data == 10) + 1
    start = np.unique(np.concatenate([offsets[:-1], cuts]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data)).astype(np.int64)[: len(start)]
    end = end - ((end > start) & (data[end - 1] == 10)) if len(start) else end
    word = np.searchsorted(words.start, start)
    count = np.searchsorted(words.start, end) - word
    some = count > 0
    start, end, word, count = start[some], end[some], word[some], count[some]
    text = np.searchsorted(offsets, start, "right") - 1
    h = span_hashes(prefix_sums(BYTE_CODE[data]), start, end)
    order = np.lexsort((start, h, text))
    repeated = np.zeros(len(start), dtype=bool)
    repeated[order[1:]] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return Lines(text, start, end, word, count, repeated)


def repeated_words(words: Words, size: int = 5) -> np.ndarray:
    """Marks the words inside windows of ``size`` words that a text holds twice or more."""
    marks = np.zeros(len(words.start), dtype=bool)
    n = np.maximum(words.count - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    if not len(text):
        return marks
    begin = np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(text))
    h = span_hashes(prefix_sums(words.hashes()), begin, begin + size)
    key = mix(h + mix(text.astype(_U) + _U(1)))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return marks
    at = np.minimum(np.searchsorted(again, key), len(again) - 1)
    marks[begin[again[at] == key]] = True
    return covered(marks, size)


def _count(mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return total[end] - total[start]


def _phrases(data: np.ndarray, lines: Lines) -> np.ndarray:
    """Lines that hold a boilerplate phrase."""
    text, found = LOWER[data].tobytes(), np.zeros(len(lines.start), dtype=bool)
    for phrase in BOILERPLATE:
        at = text.find(phrase.encode())
        while at >= 0:
            i = int(np.searchsorted(lines.start, at, "right")) - 1
            if i >= 0 and at + len(phrase) <= lines.end[i]:
                found[i] = True
            at = text.find(phrase.encode(), at + 1)
    return found


def _closed(words: Words, lines: Lines) -> np.ndarray:
    """Lines whose last word ends with terminal punctuation."""
    last = words.end[lines.word + lines.words - 1]
    out = CLOSING[words.data[last - 1]]
    for mark in WIDE_CLOSING:
        same = np.ones(len(last), dtype=bool)
        for k, byte in enumerate(reversed(mark)):
            same &= words.data[np.maximum(last - 1 - k, 0)] == byte
        out |= same
    return out


class Judged:
    """Measures of the texts of a column, and the lines that fail a rule."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column)
        self.lines = lines = lines_of(words)
        data, n = words.data, len(words.count)
        letter = np.zeros(len(data) + 1, dtype=bool)
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[words.start] += 1
        inside[words.end] -= 1
        letter[:-1] = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
        letter = letter[:-1]
        lo, hi = words.offsets[:-1], words.offsets[1:]
        self.word_chars = _count(letter, lo, hi)
        self.n_symbols = _count(SYMBOL[data], lo, hi)
        self.n_dup_lines = np.bincount(lines.text[lines.repeated], minlength=n).astype(np.int64)
        self.n_repeat_words = _count(repeated_words(words), words.first[:-1], words.first[1:])
        chars = _count(letter, lines.start, lines.end)
        symbols = _count(SYMBOL[data], lines.start, lines.end)
        upper, letters = (_count(t[data], lines.start, lines.end) for t in (UPPER, LETTER))
        single = (words.end - words.start == 1) & SEPARATOR[data[words.start]] if len(words.start) else np.zeros(0, dtype=bool)
        bars = _count(single, lines.word, lines.word + lines.words)
        self.closed = _closed(words, lines) if len(lines.start) else np.zeros(0, dtype=bool)
        last = np.ones(len(lines.text), dtype=bool)
        last[:-1] = lines.text[1:] != lines.text[:-1]
        self.failed = (
            lines.repeated
            | ((bars >= 3) & (5 * bars >= lines.words))  # navigation
            | (10 * symbols > chars)
            | ((lines.words >= 5) & (letters >= 20) & (2 * upper > letters))  # shouting
            | ((lines.words <= 60) & _phrases(data, lines))
            # a short line without terminal punctuation; a text may break off in its last line
            | (~self.closed & ~last & (lines.words <= 15))
        )
        self.kept_chars = np.bincount(lines.text, weights=np.where(self.failed, 0, chars), minlength=n).astype(np.int64)
        self.base_failed = (words.count < 10) | (100 * self.n_repeat_words > 20 * words.count)


_ADDED = [(n, T.LongType(), pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines")]
_ADDED += [(n, T.BooleanType(), pa.bool_()) for n in ("base_failed", "kept")]


def clean_lines(docs: DataFrame, most_lost: float = 0.5, text_col: str = "text", cleaned_col: str | None = "cleaned") -> DataFrame:
    """``docs`` with the measures of each text, its lines that pass, and the verdict.

    Each line with a word is judged first: repeated in its text, navigation
    (separators between words), symbols, shouting, boilerplate phrases, or short
    without terminal punctuation. Failed lines are left out of ``cleaned_col`` (None:
    not returned). A text is rejected if it fails the base rules (fewer than
    10 words, over 20 % of words in repeated 5-word windows) or if more than
    ``most_lost`` of its word characters are in failed lines.

    Null texts stay null in ``cleaned_col``; like empty ones they have no
    words and fail the base rules. Rows with null or repeated ids are judged
    like others; a column named like an added one is replaced; an empty table
    gives an empty result.
    """
    added = _ADDED + ([(cleaned_col, T.StringType(), pa.string())] if cleaned_col else [])
    names = {n for n, _, _ in added}
    own = [f for f in docs.schema if f.name not in names]
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t, _ in added)])
    # the text is read even where its column is replaced
    source = docs.select(*[f.name for f in own], docs[text_col].cast("string").alias("_judged"))

    def run(batches):
        for batch in slices(batches, "_judged"):
            j = Judged(batch.column("_judged"))
            n = batch.num_rows
            columns = {
                "n_words": j.words.count,
                "word_chars": j.word_chars,
                "n_symbols": j.n_symbols,
                "n_dup_lines": j.n_dup_lines,
                "n_repeat_words": j.n_repeat_words,
                "n_failed_lines": np.bincount(j.lines.text[j.failed], minlength=n),
                "base_failed": j.base_failed,
                "kept": ~j.base_failed & (j.kept_chars >= (1 - most_lost) * j.word_chars),
            }
            if cleaned_col:
                data = j.words.data.tobytes()
                texts = [None if t is None else [] for t in batch.column("_judged").to_pylist()]
                for i, s, e in zip(j.lines.text[~j.failed], j.lines.start[~j.failed], j.lines.end[~j.failed], strict=True):
                    texts[i].append(data[s:e].decode())
                columns[cleaned_col] = [None if t is None else "\n".join(t) for t in texts]
            values = [pa.array(columns[name], type=kind) for name, _, kind in added]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], *values], names=schema.names)

    return source.mapInArrow(run, schema)
