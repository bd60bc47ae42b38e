"""WARC archives: a deterministic sharded writer and its reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import slices
from wardline.session import cut_lineage

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
DATE = "2000-01-01T00:00:00Z"

#: payloads known to be hot, at most; a row of theirs is broadcast
MOST_HOT = 20_000
VISIBLE = "".join(map(chr, range(0x21, 0x7F)))
FLUSH = 1 << 22

FILES = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = (
    "file string, record_id string, record_type string, page_id long, target_uri string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary, intact boolean"
)


@dataclass(frozen=True)
class Layout:
    """Sizes of the archives.

    ``shard_bytes``: payload of a shard, about; ``least_shards``: shards of a
    small input; ``file_bytes``: compressed size at which a file is closed;
    ``least_bytes``: smallest payload that is stored once only; ``hot_copies``:
    copies beyond which the revisits of a payload are spread over the shards.
    """

    shard_bytes: int = 1 << 30
    least_shards: int = 64
    file_bytes: int = 1 << 30
    least_bytes: int = 0
    hot_copies: int = 10_000
    level: int = 6


def write_warc(
    pages: DataFrame,
    path: str,
    layout: Layout = Layout(),
    date: str = DATE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Writes a record per row to ``path/shard-roll.warc.gz``, each a gzip member of its own.

    Records are sorted by (sha-256 of the payload, id, url). A shard is a
    fixed range of these digests, so no bounds are sampled, and the files hold
    the same bytes however the input is ordered and partitioned: headers,
    record ids and digests are made anew from the rows, ``date`` and the
    layout alone. Of equal payloads of at least ``least_bytes`` the smallest
    (id, url) is a response; the others are revisits, which refer to it and
    carry the HTTP headers only. Rows of a payload with very many copies are
    not shuffled: its response is picked and its revisits are counted before.

    A task writes files under temporary names of its own. Spark commits the
    list of the files of successful tasks; these are then renamed, and the
    manifest ``path/manifest`` names them with their records, bytes and
    sha-256. Nothing outside the manifest is read. ``path`` must be new, name
    its scheme, and be reachable by all executors and ``pyarrow.fs``.

    A null payload counts as empty; a null id comes after all others, its
    record bears none; a null url becomes ``urn:page:<id>``. Repeated rows
    are records of their own, at most one of them the response. An empty table
    gives an empty manifest; further columns are ignored, whatever their
    names. One record at a time is held in memory, whatever its length.
    """
    body = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.select(F.isnull("id").alias("none"), "id", "url", F.unhex(F.sha2("body", 256)).alias("sha"), F.length("body").cast("long").alias("size"), "body")
    head = F.min(F.struct("none", "id", "url")).alias("head")
    counts = cut_lineage(rows.groupBy("sha", "size").agg(F.count("*").alias("n"), head))
    n, total = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    if not n:
        counts.sparkSession.createDataFrame([], FILES).write.parquet(f"{path}/manifest")
        return
    shards = max(layout.least_shards, -(-total // layout.shard_bytes))
    hot = counts.where((F.col("size") >= layout.least_bytes) & (F.col("n") > max(layout.hot_copies, n // MOST_HOT)))
    records = _records(rows, hot.select("sha", "head"), shards, layout.least_bytes)
    in_order = records.repartition("shard").sortWithinPartitions("shard", "sha", "none", "id", "url", "copy")
    written = cut_lineage(in_order.mapInArrow(_writer(path, layout, date), f"temporary string, {FILES}"))
    named = _spread_files(written).mapInArrow(_renamer(path), FILES)
    named.write.parquet(f"{path}/manifest")
    files, root = _open(path)
    if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:  # what lost tasks left
        files.delete_dir(f"{root}/_temporary")


def _records(rows: DataFrame, hot: DataFrame, shards: int, least_bytes: int) -> DataFrame:
    """The rows with their shard, those of hot payloads as one response and counted revisits."""
    digest_shard = F.shiftright(F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long") * shards, 32)
    row_shard = F.pmod(F.xxhash64("id", "url", "sha", "copy"), F.lit(shards))

    def shaped(df, shard, known):
        head = (F.lit(None).cast(t).alias(c) for c, t in (("head_id", "long"), ("head_url", "string"))) if not known else ("head_id", "head_url")
        sha1 = "sha1" if known else F.lit(None).cast("string").alias("sha1")
        body = F.lit(None).cast("binary").alias("body") if known else "body"
        return df.select(shard.cast("int").alias("shard"), "sha", "none", "id", "url", "copy", "size", sha1, body, *head, F.lit(known).alias("known"))

    small = F.col("size") < least_bytes
    uncounted = rows.withColumn("copy", F.lit(0).cast("long"))
    shard = F.when(small, row_shard).otherwise(digest_shard)
    if hot.isEmpty():
        return shaped(uncounted, shard, False)
    hot = F.broadcast(hot.select("sha", F.col("head.id").alias("head_id"), F.col("head.url").alias("head_url")))
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(F.col("head_url"))
    theirs = rows.join(hot, "sha")
    picked = theirs.where(is_head).groupBy("sha", "none", "id", "url", "size").agg(F.first("body").alias("body"))
    counted = theirs.withColumn("sha1", F.sha1("body")).groupBy("sha", "none", "id", "url", "size", "sha1", "head_id", "head_url").agg(F.count("*").alias("n"))
    block = 10_000  # numbers of copies are made in blocks, so that none is a long array
    blocks = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + block, F.col("n")) - 1)))
    others = copies.where(~(is_head & (F.col("copy") == 0)))
    cold = uncounted.join(hot, "sha", "left_anti")
    heads = picked.withColumn("copy", F.lit(0).cast("long"))
    return shaped(cold, shard, False).union(shaped(heads, digest_shard, False)).union(shaped(others, row_shard, True))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path))
    if re.match(r"^[a-z0-9]+:", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


def _spread_files(listed: DataFrame) -> DataFrame:
    """One row per file, dealt over tasks; the number of tasks is bounded, that of files is not."""
    return listed.repartition(max(1, min(10_000, listed.count())), "file")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(*key: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(key).encode()).digest()[:16], version=5)}>"


def _record(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """A record as one gzip member."""
    named = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", len(block))] if v is not None)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join(packer.compress(x) for x in (VERSION, named.encode(), b"\r\n", block, b"\r\n\r\n")) + packer.flush()


def _uri(page: int | None, url: str | None) -> str:
    return quote(url, safe=VISIBLE) if url is not None else f"urn:page:{'' if page is None else page}"


class _Archive:
    """The open file of a shard."""

    def __init__(self, path: str, shard: int, roll: int, layout: Layout, date: str):
        self.file, self.shard, self.layout = f"{shard:08d}-{roll:05d}.warc.gz", shard, layout
        self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.file}"
        files, root = _open(path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        self.out = files.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.records, self.bytes, self.sum = 0, 0, hashlib.sha256()
        info = b"software: wardline\r\nformat: WARC File Format 1.1\r\n"
        kind = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.file)), ("WARC-Date", date), ("WARC-Filename", self.file)]
        self.put(_record([*kind, ("Content-Type", "application/warc-fields")], info, layout.level))
        self.records = 0

    def put(self, record: bytes) -> None:
        self.out.write(record)
        self.sum.update(record)
        self.records += 1
        self.bytes += len(record)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = {"temporary": self.temporary, "file": self.file, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}
        types = {"shard": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([v], types.get(k)) for k, v in row.items()], names=list(row))


def _page_record(row: dict, head: tuple | None, date: str, level: int) -> bytes:
    """``head`` is (id, url) of the response that a revisit refers to."""
    sha1 = base64.b32encode(bytes.fromhex(row["sha1"])).decode() if row["sha1"] else _digest(row["body"])
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if head else "response"),
        ("WARC-Target-URI", _uri(row["id"], row["url"])),
        ("WARC-Date", date),
        ("WARC-Record-ID", _record_id(row["id"], row["url"], row["sha"], row["copy"])),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("Page-Id", row["id"]),
        ("Content-Type", HTTP),
    ]
    if head is None:
        return _record(fields, block + row["body"], level)
    refers = [
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", _record_id(*head, row["sha"], 0)),
        ("WARC-Refers-To-Target-URI", _uri(*head)),
        ("WARC-Refers-To-Date", date),
        ("Refers-To-Page-Id", head[0]),
    ]
    return _record(fields + refers, block, level)


def _writer(path: str, layout: Layout, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, roll, last, head = None, 0, None, None
        for part in slices(batches, "body"):
            for row in part.to_pylist():
                if archive is None or row["shard"] != archive.shard or archive.bytes >= layout.file_bytes:
                    roll = roll + 1 if archive is not None and row["shard"] == archive.shard else 0
                    if archive is not None:
                        yield archive.close()
                    archive = _Archive(path, row["shard"], roll, layout, date)
                key = (row["sha"], row["id"], row["url"])
                if row["known"]:
                    refers = (row["head_id"], row["head_url"])
                else:
                    if last is not None and key == last[0]:  # a repeated row
                        row["copy"] = last[1] + 1
                    if head is None or head[0] != row["sha"]:
                        head = key
                        first = True
                    else:
                        first = row["size"] < layout.least_bytes
                    refers = None if first else head[1:]
                    last = key, row["copy"]
                archive.put(_page_record(row, refers, date, layout.level))
        if archive is not None:
            yield archive.close()

    return run


def _renamer(path: str):
    """Temporary to last names; done again it finds the last name in place."""

    def run(batches):
        files, root = _open(path)
        for batch in batches:
            for row in batch.to_pylist():
                temporary, last = f"{root}/{row['temporary']}", f"{root}/{row['file']}"
                if files.get_file_info(temporary).type == fs.FileType.File:
                    files.move(temporary, last)
                elif files.get_file_info(last).size != row["bytes"]:
                    raise OSError(f"{row['file']} is lost")
            yield batch.select([name for name in batch.schema.names if name != "temporary"])

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per response and revisit of the archives that the manifest of ``path`` names.

    (file, record_id, record_type, page_id, target_uri, payload_bytes,
    payload_digest, refers_to, payload, intact). Files are read as streams,
    one record at a time. ``payload`` is null for revisits, and for all
    without ``payload``; ``intact`` says whether length and digests of block
    and payload are those of the headers.
    """
    listed = spark.read.schema(FILES).parquet(f"{path}/manifest")

    def run(batches):
        files, root = _open(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None, buffer_size=FLUSH) as stream:
                    yield from _batches(name, stream, payload)

    return _spread_files(listed).mapInArrow(run, RECORDS)


def _batches(name: str, stream, payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for c in RECORDS.split(", ")])
    rows, held = [], 0
    for fields, block in read_records(stream):
        if fields["WARC-Type"] == "warcinfo":
            continue
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        intact = fields["WARC-Block-Digest"] == f"sha1:{_digest(block)}"
        if fields["WARC-Type"] == "response":
            intact &= size == len(body) and digest == _digest(body)
        page, refers = (int(fields[k]) if k in fields else None for k in ("Page-Id", "Refers-To-Page-Id"))
        said = body if payload and fields["WARC-Type"] == "response" else None
        rows.append((name, fields["WARC-Record-ID"], fields["WARC-Type"], page, fields["WARC-Target-URI"], size, digest, refers, said, intact))
        held += len(said or b"") + 400
        if held > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a gzip stream of any number of members."""
    unpacked = gzip.GzipFile(fileobj=stream)
    while line := unpacked.readline():
        if line != VERSION:
            raise ValueError("a record does not begin where it should")
        fields = {}
        while (line := unpacked.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            fields[key] = value.strip()
        block = unpacked.read(int(fields["Content-Length"]))
        if unpacked.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block
