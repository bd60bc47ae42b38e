"""Packing of tokenized documents into sequences of a fixed size by exact complements, then best fit.

Only the number of pieces of each length decides a packing, so the plan is
made from at most ``size`` counts on the driver. The pieces themselves find
their place by their rank among the pieces of their length; ranks come from
bucket counts, so no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.batches import slices
from wardline.llm.pretokens import Cutter, byte_letters, read_vocabulary
from wardline.llm.tokens import LONGEST, MEMORY
from wardline.session import cut_lineage

BUCKET_ROWS = 100_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder(dict):
    """Ids of pre-tokens as little-endian bytes, found when they are first asked for; long ones are not kept."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.model, self.letters = Tokenizer.from_str(spec).model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize("".join([self.letters[b] for b in word.encode()]))
        ids = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(spec: str) -> _Encoder:
    """One encoder per Python worker, kept from task to task."""
    return _Encoder(spec)


def pieces_of(docs: DataFrame, path: str, size: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a closing id, cut at ``size``.

    Pre-tokens are encoded by the model of the ``tokenizers`` library, each
    one once per Python worker while it is remembered.
    """
    vocabulary = read_vocabulary(path)
    with open(path, encoding="utf-8") as file:
        spec = file.read()

    def run(batches):
        known, cutter = _encoder(spec), Cutter(vocabulary)
        special = {i: np.uint32(i).astype("<u4").tobytes() for i in cutter.special.values()}
        end = np.uint32(closing).astype("<u4").tobytes()
        for batch in slices(batches, "text"):
            if len(known) > MEMORY:
                known.clear()
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = [special[s] if s is not None else b"".join(map(known.__getitem__, words)) for s, words in cutter.cut(text or "")]
                data = b"".join([*ids, end])
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, times)]: the sequences that hold ``counts[length]`` pieces of each length.

    Longest lengths first, gaps are filled exactly by one piece, then those
    left by two whose sum is indexed, then by three, as often as all of them
    are available. What can't be filled exactly goes into the tightest gap
    that is left.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> int:
        """Uses a combination as often as it is there."""
        times = min(int(left[x]) // k for x, k in Counter(lengths).items())
        if times:
            for x in lengths:
                left[x] -= times
            out.append((lengths, times))
        return times

    def pair(total: int, most: np.ndarray) -> tuple[int, int] | None:
        """Two lengths that are there and add up, the larger as long as it can be."""
        if total < 2:
            return None
        x = np.arange(total - 1, (total - 1) // 2, -1)
        fits = np.flatnonzero((most[x] > 0) & (most[total - x] > 0) & ((x != total - x) | (most[x] > 1)))
        return (int(x[fits[0]]), int(total - x[fits[0]])) if fits.size else None

    def combination(a: int, others: int) -> tuple[int, ...] | None:
        """``a`` with up to ``others`` more that fill the gap exactly."""
        gap, most = size - a, left.copy()
        most[a] -= 1
        if gap == 0:
            return (a,)
        if most[gap] > 0:
            return (a, gap)
        if others > 1 and (found := pair(gap, most)):
            return (a, *found)
        if others < 3:
            return None
        there = (most[: gap + 1] > 0).astype(np.float32)
        sums = np.rint(np.fft.irfft(np.fft.rfft(there, 2 * size + 2) ** 2, 2 * size + 2))  # how many pairs have a sum
        for x in np.flatnonzero(there)[::-1]:
            if x < gap and sums[gap - x] > 0:
                rest = most.copy()
                rest[x] -= 1
                if found := pair(int(gap - x), rest):
                    return (a, int(x), *found)
        return None

    for others in (1, 2, 3):
        for a in range(size, 0, -1):
            while left[a] and (lengths := combination(a, others)) and take(lengths):
                pass
    # best fit of the rest: sequences with equal contents are one entry under their gap
    gaps: dict[int, Counter] = {}
    for a in range(size, 0, -1):
        n = int(left[a])
        while n:
            gap = min((g for g, c in gaps.items() if g >= a and c), default=None)
            if gap is None:
                fill, m = (), -(-n // (size // a))
                for _ in range(min(n, size // a)):
                    fill = (*fill, a)
                full = n // len(fill)
                if full:
                    gaps.setdefault(size - a * len(fill), Counter())[fill] += full
                if rest := n - full * len(fill):
                    gaps.setdefault(size - a * rest, Counter())[(a,) * rest] += 1
                n = 0
            else:
                fill, m = next(iter(gaps[gap].items()))
                m = min(m, n)
                gaps[gap][fill] -= m
                if not gaps[gap][fill]:
                    del gaps[gap][fill]
                gaps.setdefault(gap - a, Counter())[(*fill, a)] += m
                n -= m
        gaps = {g: c for g, c in gaps.items() if c}
    return out + [(fill, m) for c in gaps.values() for fill, m in c.items()]


def _slots(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    used: Counter = Counter()
    rows, base = [], 0
    for lengths, times in sequences:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], base, offset))
            used[x] += times
            offset += x
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (length and any other columns) with sequence_id and offset.

    Needs 0 < length <= size. Offsets are gapless from 0 in each sequence. An
    empty table gives an empty result.
    """
    rows = pieces.select(*[F.col(c) for c in pieces.columns if c not in ("sequence_id", "offset")])
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``size`` rows at most
    slots = _slots(plan(counts, size))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    names = rows.columns
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    share = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = share.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*names)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(share, ["length", "_bucket"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    keys = (slots[:, 0] << 48) | slots[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            sequence, offset = slots[at, 2] + rank - slots[at, 1], slots[at, 3]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.select(*names).schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of ``size`` tokens.

    Documents of up to ``size`` tokens, the closing id included, stay whole;
    only longer ones are cut. Null and empty texts are one piece with the
    closing id. Repeated rows are packed each; a null id stays null. An empty
    table gives an empty result; further columns are ignored.
    """
    return pack(cut_lineage(pieces_of(docs, path, size, closing, id_col, text_col)), size)
