"""Removal of long repeated passages: by words and by bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardline.llm.batches import BYTE_CODE, Words, prefix_sums, raw, span_hashes
from wardline.llm.repeats import CROWD, Search, Units, covered, search_repeats

LAST = np.iinfo(np.int64).max


def _ids(rows: pa.RecordBatch, id_col: str) -> np.ndarray:
    return rows.column(id_col).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _word_units(rows: pa.RecordBatch, text_col: str, id_col: str) -> Units:
    words = Words(rows.column(text_col))
    h = words.hashes()
    return Units(h, words.first, _ids(rows, id_col), h)


def _byte_units(rows: pa.RecordBatch, text_col: str, id_col: str) -> Units:
    data, offsets = raw(rows.column(text_col))
    return Units(BYTE_CODE[data], offsets, _ids(rows, id_col), data)


def relative_factors(length: int):
    """Matcher for the words of pieces with equal anchors: no relative Lempel-Ziv parse, window hashes replace it.

    All windows of ``length`` words are sorted by their hash, and one is found
    if a smaller document holds the hash. Removal only asks this of each window,
    so no factors are built; windows over the bounds of what would be factors
    are looked up like all others.
    """

    def match(codes, key, start, doc, where):
        h = span_hashes(prefix_sums(codes), start, start + length)
        order = np.lexsort((doc, h, key))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
        low = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
        found = np.empty(len(order), dtype=bool)
        found[order] = low < doc[order]
        return found

    return match


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def previous_factors(length: int):
    """Matcher for bytes: does the string of ``length`` bytes at each start also start earlier?

    No longest-previous-factor array is built. The strings of the starts are
    sorted by their bytes, and one is found if its run of equal strings has a
    smaller place. Starts whose string is not repeated at all are taken out
    before by its hash.
    """
    width = -(-length // 8)

    def match(codes, key, start, doc, where):
        h = span_hashes(prefix_sums(BYTE_CODE[codes]), start, start + length)
        by_hash = np.sort(h)
        again = by_hash[1:][by_hash[1:] == by_hash[:-1]]
        out = np.zeros(len(start), dtype=bool)
        if not len(again):
            return out
        at = np.searchsorted(again, h)
        some = np.flatnonzero(again[np.minimum(at, len(again) - 1)] == h)
        table = np.zeros((len(some), width * 8), dtype=np.uint8)
        table[:, :length] = np.lib.stride_tricks.sliding_window_view(codes, length)[start[some]]
        keys = table.view(">u8")
        place = _ranks(doc[some], where[some])
        order = np.lexsort((place, *(keys[:, i] for i in reversed(range(width)))))
        ordered, place = keys[order], place[order]
        run = np.ones(len(order), dtype=bool)
        run[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)  # the common prefix ends before ``length``
        smallest = np.minimum.reduceat(place, np.flatnonzero(run))[np.cumsum(run) - 1]
        out[some[order]] = smallest < place
        return out

    return match


def _result(rows: pa.RecordBatch, text_col: str, texts: list, new: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    columns = {**dict(zip(rows.schema.names, rows.columns, strict=True)), text_col: pa.array(texts, type=rows.column(text_col).type), **new}
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _schema(docs: DataFrame, *added: T.StructField) -> T.StructType:
    """The columns of ``docs``, then the added ones; an added name replaces a column of ``docs``."""
    names = {f.name for f in added}
    return T.StructType([*(f for f in docs.schema if f.name not in names), *added])


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeated_words(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """The documents without the passages that also occur in a document with a smaller id.

    A word is a run of bytes other than space and \\t..\\r. Each word covered
    by a window of ``length`` words whose sequence also starts in a document
    with a smaller id is removed; windows are judged on the input. Returns all
    columns of ``docs``; in the text the removed words and the white space after
    them are gone. Added are n_words, n_removed, spans (start and end word of
    each removed run) and kept_sha256 (of the kept words joined by one space).

    Null texts stay null and count no words; empty and short texts are kept as
    they are. Rows with equal ids are equally early, so neither loses words to
    the other; a null id counts as the largest. A column named like an added
    one is replaced. An empty table gives an empty result.
    """
    schema = _schema(
        docs,
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept_sha256", T.StringType()),
    )
    names = schema.names
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(rows: pa.RecordBatch, units: Units, marks: np.ndarray) -> pa.RecordBatch:
        gone = covered(marks, length)
        words = Words(rows.column(text_col))
        data = words.data.tobytes()
        plain = rows.column(text_col).to_pylist()
        texts, removed, spans, digests = [], [], [], []
        for i in range(rows.num_rows):
            lo, hi = words.first[i], words.first[i + 1]
            text = data[words.offsets[i] : words.offsets[i + 1]]
            starts, ends = _runs(gone[lo:hi])
            kept = text.split()
            if len(starts):
                at = words.start[lo:hi] - words.offsets[i]
                parts, spot = [], 0
                for s, e in zip(starts, ends, strict=True):
                    parts.append(text[spot : at[s]])
                    spot = at[e] if e < hi - lo else len(text)
                text = b"".join([*parts, text[spot:]])
                kept = text.split()
                plain[i] = text.decode()
            texts.append(plain[i])
            removed.append(int((ends - starts).sum()))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends, strict=True)])
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        new = {"n_words": pa.array(words.count.astype(np.int64)), "n_removed": pa.array(removed, type=pa.int64()), "spans": pa.array(spans, type=span_type), "kept_sha256": pa.array(digests, type=pa.string())}
        return _result(rows, text_col, texts, new, names)

    search = Search(_word_units, relative_factors(length), np.uint64, length, max(1, length // 3), same_text=False, crowd=crowd)
    return search_repeats(docs, search, finish, schema, text_col, id_col)


def remove_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """The documents without the byte strings that occur earlier; the first copy stays.

    Texts are UTF-8 bytes. Each byte covered by a string of ``length`` bytes
    that also starts earlier (in a document with a smaller id, or further left
    in the same one) is removed; strings are judged on the input and don't
    cross documents. Returns all columns of ``docs``; the text holds the
    remaining bytes (without the rests of characters cut in two). Added are
    n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256 (of
    the remaining bytes).

    Null texts stay null and count as empty. Rows with equal ids are equally
    early at equal starts; a null id counts as the largest. A column named
    like an added one is replaced. An empty table gives an empty result.
    """
    schema = _schema(
        docs,
        *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()),
    )
    names = schema.names

    def finish(rows: pa.RecordBatch, units: Units, marks: np.ndarray) -> pa.RecordBatch:
        gone = covered(marks, length)
        texts = rows.column(text_col).to_pylist()
        data, bounds = units.plain, units.bounds
        removed, runs, digests = [], [], []
        for i in range(rows.num_rows):
            own, away = data[bounds[i] : bounds[i + 1]], gone[bounds[i] : bounds[i + 1]]
            starts, ends = _runs(away)
            kept = own[~away].tobytes() if len(starts) else own.tobytes()
            if len(starts):
                texts[i] = kept.decode(errors="ignore")
            removed.append(int((ends - starts).sum()))
            runs.append(len(starts))
            digests.append(hashlib.sha256(kept).hexdigest())
        new = {"n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(removed, type=pa.int64()), "n_spans": pa.array(runs, type=pa.int64()), "kept_sha256": pa.array(digests, type=pa.string())}
        return _result(rows, text_col, texts, new, names)

    search = Search(_byte_units, previous_factors(length), np.uint8, length, max(1, length // 4), same_text=True, crowd=crowd)
    return search_repeats(docs, search, finish, schema, text_col, id_col)
