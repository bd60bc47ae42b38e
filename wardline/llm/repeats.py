"""Search for strings of a fixed number of units (words or bytes) that occur earlier.

The search behind the two substring operators. ``length`` units make a window;
the question for each window is whether its string also starts earlier.

* Documents are written once as compressed blocks of about a megabyte.
* Each window has an anchor: the leftmost of its k-grams with the smallest
  hash. Equal windows have equal anchors, so only windows with equal anchors
  need to meet. Neighbouring windows with the same anchor form a segment.
* Each block sends every distinct (anchor, segment) once, with its first
  place, to the anchor's bucket. There equal segments find their first place;
  anchors with one segment are settled. A frequent passage sends one entry per
  block, however many documents hold it.
* Where an anchor has several different segments (the edges of repeated
  passages), the first copy of each (from each block, where rows share its id)
  sends its units to the anchor's bucket, where a matcher compares their
  windows. Anchors with more than ``CROWD`` such pieces send the distinct
  windows of each block by window hash instead, so no crowd of pieces meets in
  one task.
* Answers go back to the blocks, which then know every repeated window.

Everything that grows with the input is a shuffled table: buckets are as many
as the input asks for, and the driver sees one sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.batches import mix, prefix_sums, raw, slices, span_hashes
from wardline.session import cut_lineage

BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
CROWD = 512
MATCH_WINDOWS = 200_000
_U = np.uint64
_PLACE = _U((1 << 30) - 1)
_ZSTD = pa.Codec("zstd", compression_level=1)
_PACKED = "bucket int, block long, kind int, payload binary"
_ANSWER = "block long, kind int, payload binary"
FIRST, PIECES, WINDOWS = 0, 1, 2  # kinds of packets
SETTLED, SEND_PIECE, SEND_WINDOWS = 0, 1, 2


def pack(**columns: np.ndarray) -> bytes:
    """Named arrays as one compressed Arrow message."""
    batch = pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(payload) if isinstance(payload, bytes) else payload) as stream:
        return stream.read_next_batch()


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


@dataclass
class Units:
    """The units of a block: codes of all texts in a row, bounds and ids of the texts.

    ``plain`` is what pieces send and matchers compare.
    """

    codes: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    plain: np.ndarray


@dataclass
class Search:
    """What to look for. ``same_text``: earlier starts in the same text count too."""

    units: Callable[[pa.RecordBatch, str, str], Units]
    match: Callable[..., np.ndarray]
    unit: type
    length: int
    gram: int
    same_text: bool
    crowd: int = CROWD


def blocks_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(block, bytes, payload): the rows of ``docs`` as compressed blocks, stored."""

    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, text_col, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k]), pa.array([part.nbytes]), pa.array([pack(**dict(zip(part.schema.names, part.columns, strict=True)))], type=pa.binary())],
                names=["block", "bytes", "payload"],
            )
            k += 1

    return cut_lineage(docs.mapInArrow(run, "block long, bytes long, payload binary"))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each ``width`` neighbours."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=_U)
    padded[: len(keys)] = keys
    table = padded.reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


@dataclass
class Segments:
    """Segments of a block and the table of its distinct ones (``which`` maps to it)."""

    start: np.ndarray
    windows: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    body: np.ndarray
    which: np.ndarray
    first: np.ndarray
    sums: np.ndarray


def segments(units: Units, search: Search) -> Segments:
    none = np.zeros(0, dtype=np.int64)
    n, length = len(units.codes), search.length
    sums = prefix_sums(units.codes)
    if n < length:
        return Segments(none, none, none, none.view(_U), none.view(_U), none, none, sums)
    places = np.arange(n - search.gram + 1)
    grams = span_hashes(sums, places, places + search.gram)
    low = (_smallest((grams & ~_PLACE) | places.astype(_U), length - search.gram + 1) & _PLACE).astype(np.int64)
    starts = np.arange(n - length + 1)
    text = np.searchsorted(units.bounds, starts, "right") - 1
    whole = starts + length <= units.bounds[text + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(new)
    windows = np.add.reduceat(whole.astype(np.int64), start) if len(start) else none
    # smallest hashes crowd near zero; mixed again, anchors spread evenly over the buckets
    anchor, body = mix(grams[low[start]]), span_hashes(sums, start, start + windows - 1 + length)
    where = start - units.bounds[text[start]]
    order = np.lexsort((where, units.ids[text[start]], body, anchor))
    a, b = anchor[order], body[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(head) - 1
    return Segments(start, windows, text[start], anchor, body, which, order[head], sums)


def _to_buckets(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)


def _packets(block: int, kind: int, buckets: int, key: np.ndarray, columns: dict, at: np.ndarray | None = None):
    """One row per bucket; ``key`` ascends, entries carry their index in the block."""
    bucket = _to_buckets(key, buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = [0, *cuts, len(key)]
    columns = {"at": (np.arange(len(key)) if at is None else at).astype(np.int32), "key": key} | columns
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            yield int(bucket[lo]), block, kind, pack(**{c: v[lo : hi] for c, v in columns.items()})


def _rows(found: list[tuple], names: str) -> pa.Table:
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in names.split(", ")])
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)] if found else [[]] * len(schema), schema=schema)


def _firsts(rows, crowd: int | None, same_text: bool):
    """Answers to distinct (key, body) entries: the first place of each body, and what to send.

    Entries of other blocks as early as the first (rows may share an id) send what it sends: no other
    answer judges their windows.
    """
    blocks = [r[0] for r in rows]
    parts = [unpack(r[1]) for r in rows]
    source = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
    at, key, body, doc, where = (np.concatenate([_column(p, c) for p in parts]) for c in ("at", "key", "body", "id", "where"))
    order = np.lexsort((where, doc, body, key))
    key, body, doc, where, at, source = (x[order] for x in (key, body, doc, where, at, source))
    group = np.ones(len(key), dtype=bool)
    group[1:] = key[1:] != key[:-1]
    head = group.copy()
    head[1:] |= body[1:] != body[:-1]
    rep = np.flatnonzero(head)[np.cumsum(head) - 1]
    group_no = np.cumsum(group) - 1
    todo = np.zeros(len(key), dtype=np.int8)
    if crowd is not None:
        early = doc == doc[rep]
        if same_text:
            early &= where == where[rep]
        bodies, pieces = (np.bincount(group_no, weights=x).astype(np.int64)[group_no] for x in (head, early))
        todo[early & (bodies > 1)] = SEND_PIECE
        todo[early & (bodies > 1) & (pieces > crowd)] = SEND_WINDOWS
    told = np.flatnonzero((todo > 0) | ~head)
    told = told[np.argsort(source[told], kind="stable")]
    cuts = np.searchsorted(source[told], np.arange(len(parts) + 1))
    for i, b in enumerate(blocks):
        if (mine := told[cuts[i] : cuts[i + 1]]).size:
            yield b, pack(at=at[mine], id=doc[rep[mine]], where=where[rep[mine]], todo=todo[mine])


def _matched(rows, search: Search):
    """Answers to pieces: which of their windows also start earlier in a piece of their anchor."""
    parts = [unpack(p) for _, p in rows]
    source = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
    at, key, doc, where, windows = (np.concatenate([_column(p, c) for p in parts]) for c in ("at", "key", "id", "where", "windows"))
    unit = search.unit
    codes = np.concatenate([raw(p.column("units"))[0] for p in parts]).view(unit)
    begin = np.concatenate([[0], np.cumsum(windows + search.length - 1)[:-1]]).astype(np.int64)
    order = np.lexsort((where, doc, key))
    bounds = np.concatenate([[0], np.cumsum(windows)]).astype(np.int64)
    hits = np.zeros(bounds[-1], dtype=bool)
    sizes = np.cumsum(windows[order])
    lo = 0
    while lo < len(order):  # whole groups, some at a time
        hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + MATCH_WINDOWS)) + 1
        while hi < len(order) and key[order[hi]] == key[order[hi - 1]]:
            hi += 1
        mine = order[lo:hi]
        n = windows[mine]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.concatenate([codes[b : b + m] for b, m in zip(begin[mine], n + search.length - 1, strict=True)])
        start = np.repeat(np.cumsum(n + search.length - 1) - (n + search.length - 1), n) + within
        flags = search.match(own, np.repeat(key[mine], n), start, np.repeat(doc[mine], n), np.repeat(where[mine], n) + within)
        hits[np.repeat(bounds[mine], n) + within] = flags
        lo = hi
    some = np.flatnonzero(np.add.reduceat(hits, bounds[:-1]) > 0)
    cuts = np.searchsorted(source[some], np.arange(len(parts) + 1))
    for i, (block, _) in enumerate(rows):
        if (mine := some[cuts[i] : cuts[i + 1]]).size:
            yield block, pack(at=at[mine], hits=pa.array([hits[bounds[j] : bounds[j + 1]].tobytes() for j in mine], type=pa.binary()))


def _answers(search: Search):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        found = []
        for kind in np.unique(kinds):
            part = table.filter(pa.array(kinds == kind))
            rows = list(zip(part.column("block").to_pylist(), part.column("payload").to_pylist(), strict=True))
            found += [(b, int(kind), p) for b, p in (_matched(rows, search) if kind == PIECES else _firsts(rows, None if kind == WINDOWS else search.crowd, search.same_text))]
        return _rows(found, _ANSWER)

    return run


def _first_packets(search: Search, buckets: int, text_col: str, id_col: str):
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                units = search.units(unpack(payload.as_buffer()), text_col, id_col)
                seg = segments(units, search)
                first = seg.first
                columns = {"body": seg.body[first], "id": units.ids[seg.text[first]], "where": seg.start[first] - units.bounds[seg.text[first]]}
                yield from _rows(list(_packets(block, FIRST, buckets, seg.anchor[first], columns)), _PACKED).to_batches()

    return run


@dataclass
class Told:
    """What the answers say about the distinct segments of a block."""

    id: np.ndarray
    where: np.ndarray
    todo: np.ndarray


def _told(units: Units, seg: Segments, answers: list[pa.RecordBatch]) -> Told:
    first = seg.first
    told = Told(units.ids[seg.text[first]].copy(), seg.start[first] - units.bounds[seg.text[first]], np.zeros(len(first), dtype=np.int8))
    for a in answers:
        at = _column(a, "at")
        told.id[at], told.where[at], told.todo[at] = _column(a, "id"), _column(a, "where"), _column(a, "todo")
    return told


def _crowded(units: Units, seg: Segments, told: Told, search: Search):
    """Windows of the segments to be sent window by window: start, hash, and the distinct ones by hash."""
    rep = seg.first[told.todo == SEND_WINDOWS]
    n = seg.windows[rep]
    start = np.repeat(seg.start[rep], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(seg.text[rep], n)
    h = span_hashes(seg.sums, start, start + search.length)
    order = np.lexsort((start - units.bounds[text], units.ids[text], h))
    head = np.ones(len(order), dtype=bool)
    head[1:] = h[order][1:] != h[order][:-1]
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(head) - 1
    return start, text, h, which, order[head]


def _split(table: pa.Table):
    """The block's rows and its answers by kind."""
    answers = {FIRST: [], PIECES: [], WINDOWS: []}
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        answers[kind].append(unpack(payload))
    return answers


def _second_packets(search: Search, buckets: int, text_col: str, id_col: str):
    def run(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        rows = []
        answers = _split(answer_rows)
        if block_rows.num_rows and answers[FIRST]:
            block = block_rows.column("block")[0].as_py()
            units = search.units(unpack(block_rows.column("payload")[0].as_buffer()), text_col, id_col)
            seg = segments(units, search)
            told = _told(units, seg, answers[FIRST])
            rep = np.flatnonzero(told.todo == SEND_PIECE)
            if rep.size:
                s = seg.first[rep]
                size = seg.windows[s] + search.length - 1
                index = np.repeat(seg.start[s], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                data = np.ascontiguousarray(units.plain[index])
                offsets = np.concatenate([[0], np.cumsum(size) * data.itemsize]).astype(np.int64)
                pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                columns = {"id": units.ids[seg.text[s]], "where": seg.start[s] - units.bounds[seg.text[s]], "windows": seg.windows[s], "units": pieces}
                rows += _packets(block, PIECES, buckets, seg.anchor[s], columns, rep)
            start, text, h, _, head = _crowded(units, seg, told, search)
            if head.size:
                columns = {"body": h[head], "id": units.ids[text[head]], "where": start[head] - units.bounds[text[head]]}
                rows += _packets(block, WINDOWS, buckets, h[head], columns)
        return _rows(rows, _PACKED)

    return run


def repeated_windows(units: Units, search: Search, answers: dict) -> np.ndarray:
    """Marks the starts of the windows of a block whose string also starts earlier."""
    seg = segments(units, search)
    marks = np.zeros(len(units.codes), dtype=bool)
    if not len(seg.start):
        return marks
    told = _told(units, seg, answers[FIRST])
    doc, where = units.ids[seg.text], seg.start - units.bounds[seg.text]
    first_doc, first_where = told.id[seg.which], told.where[seg.which]
    earlier = first_doc < doc
    if search.same_text:
        earlier |= (first_doc == doc) & (first_where < where)
    edge = np.zeros(len(units.codes) + 1, dtype=np.int32)
    np.add.at(edge, seg.start[earlier], 1)
    np.add.at(edge, (seg.start + seg.windows)[earlier], -1)
    marks |= np.cumsum(edge[:-1]) > 0
    # windows of a segment's first place, and of its other places in the same text
    masks = {}
    for a in answers[PIECES]:
        masks |= {int(i): np.frombuffer(m, dtype=bool) for i, m in zip(_column(a, "at"), a.column("hits").to_pylist(), strict=True)}
    if told.todo.any():
        start, text, _, which, head = _crowded(units, seg, told, search)
        if head.size:
            low_doc, low_where = units.ids[text[head]].copy(), start[head] - units.bounds[text[head]]
            for a in answers[WINDOWS]:
                at = _column(a, "at")
                low_doc[at], low_where[at] = _column(a, "id"), _column(a, "where")
            hit = low_doc[which] < units.ids[text]
            if search.same_text:
                hit |= (low_doc[which] == units.ids[text]) & (low_where[which] < start - units.bounds[text])
            rep = np.flatnonzero(told.todo == SEND_WINDOWS)
            n = seg.windows[seg.first[rep]]
            for i, m in zip(rep, np.split(hit, np.cumsum(n)[:-1]), strict=True):
                masks[int(i)] = m
    if masks:
        for j in np.flatnonzero(~earlier & np.isin(seg.which, np.fromiter(masks, dtype=np.int64))):
            marks[seg.start[j] : seg.start[j] + seg.windows[j]] |= masks[int(seg.which[j])]
    return marks


def covered(marks: np.ndarray, length: int) -> np.ndarray:
    """Marks the units covered by marked windows."""
    edge = np.zeros(len(marks) + length + 1, dtype=np.int32)
    at = np.flatnonzero(marks)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge)[: len(marks)] > 0


def search_repeats(docs: DataFrame, search: Search, finish: Callable, schema: T.StructType, text_col: str, id_col: str) -> DataFrame:
    """``finish(rows, units, marks) -> RecordBatch`` of ``schema`` for each block, given its repeated windows."""
    blocks = blocks_of(docs, text_col)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    first = blocks.select("block", "payload").mapInArrow(_first_packets(search, buckets, text_col, id_col), _PACKED)
    one = cut_lineage(first.groupBy("bucket").applyInArrow(_answers(search), _ANSWER))
    texts = blocks.select("block", "payload").groupBy("block")
    second = texts.cogroup(one.groupBy("block")).applyInArrow(_second_packets(search, buckets, text_col, id_col), _PACKED)
    two = cut_lineage(second.groupBy("bucket").applyInArrow(_answers(search), _ANSWER))

    def final(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        rows = unpack(block_rows.column("payload")[0].as_buffer())
        units = search.units(rows, text_col, id_col)
        return pa.Table.from_batches([finish(rows, units, repeated_windows(units, search, _split(answer_rows)))])

    return texts.cogroup(one.unionByName(two).groupBy("block")).applyInArrow(final, schema)
