"""Fill-in-the-middle training texts: documents cut in three and put in another order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import SLICE_BYTES, raw, slices

#: marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
OUT = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    docs: DataFrame,
    percent: int = 90,
    spm_percent: int = 20,
    seed: str = "1",
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    The numbers that decide come from the sha256 of ``seed:id``, so a row gets
    the same output in every run and every partitioning. Two of them, modulo
    n + 1, are the ends of prefix and middle in code points; ``percent`` of
    the texts are cut, ``spm_percent`` of these have the suffix first. A text
    that is empty or holds one of the ``marks`` stays plain, so that every
    output can be read back, see ``restored``. No mark may begin with
    the ending of another or hold another.

    A null text counts as empty; a null id counts as the empty string under
    the hash; rows that repeat an id are cut alike; an empty table gives an
    empty result; further columns are ignored, whatever their names. Texts of
    any length go through in blocks of about 1 MB.
    """
    overlap = any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b)))
    if overlap or not all(marks) or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
        raise ValueError("marks overlap")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    plain = F.length(text) == 0
    for mark in marks:
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))

    def run(batches):
        for batch in slices(batches, "text"):
            yield _cut_batch(batch, marks)

    return rows.mapInArrow(run, OUT).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before it was cut, from an output and its form."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    back = F.when(form == "plain", output)
    for name, places in order.items():
        back = back.when(form == name, F.concat(*(F.get(parts, F.lit(k)) for k in places)))
    return back


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _cut_batch(batch: pa.RecordBatch, marks: tuple[str, str, str]) -> pa.RecordBatch:
    text, form = batch.column("text"), batch.column("form")
    n = pc.utf8_length(text).cast(pa.int64())
    one = pc.add(n, 1)
    ends = _modulo(batch.column("h1"), one), _modulo(batch.column("h2"), one)
    low, high = pc.min_element_wise(*ends), pc.max_element_wise(*ends)
    prefix, middle, suffix = _pieces(text, low, high)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    none = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    plain = pc.equal(form, "plain")
    out = pc.if_else(plain, text.cast(pa.large_string()), pc.if_else(pc.equal(form, "spm"), spm, psm))
    absent = pa.scalar(None, pa.int64())
    sizes = (pc.if_else(plain, absent, x) for x in (low, pc.subtract(high, low)))
    columns = [batch.column("id"), n, form, *sizes, out.cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _pieces(text: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, cut at code points ``low`` and ``high``.

    A slice holds several short texts, cut together, or one text of any
    length, cut block by block.
    """
    data, offsets = raw(text)
    if len(text) > 1:
        return _roles(data, offsets, low, high)
    blocks, base, at = [], 0, 0
    while at < len(data) or not blocks:
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # a block ends before the first byte of a code point
            end += 1
        part = data[at:end]
        points = int(np.count_nonzero(part & 0xC0 != 0x80))
        inside = [pa.array([min(max(x[0].as_py() - base, 0), points)]) for x in (low, high)]
        blocks.append(_roles(part, np.array([0, len(part)]), *inside))
        at, base = end, base + points
    joined = (pa.LargeListArray.from_arrays(np.array([0, len(blocks)]), pa.concat_arrays(role)) for role in zip(*blocks, strict=True))
    return [pc.binary_join(role, pa.scalar("", pa.large_string())) for role in joined]


def _roles(data: np.ndarray, offsets: np.ndarray, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    starts = np.flatnonzero(data & 0xC0 != 0x80)
    bounds = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    points = pa.Array.from_buffers(pa.large_string(), len(starts), bounds)
    first = pa.array(np.searchsorted(starts, offsets))
    lists = pa.LargeListArray.from_arrays(first, points)
    parent = pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(starts))), pc.take(first, parent))
    count = pc.list_value_length(lists).cast(pa.int64())
    past = [pc.greater_equal(ordinal, pc.take(x, parent)).cast(pa.int8()) for x in (low, high)]
    role = pc.add(*past)
    sizes = low, pc.subtract(high, low), pc.subtract(count, high)
    out = []
    for number, size in enumerate(sizes):
        kept = pc.filter(pc.list_flatten(lists), pc.equal(role, number))
        again = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(size.to_numpy())), kept)
        out.append(pc.binary_join(again, pa.scalar("", pa.large_string())))
    return out
