"""WARC archives as seekable Zstandard bundles.

Each bundle is a sequence of independent zstd frames, each holding whole WARC records, closed by a seek table in a
skippable frame (the public "seekable format": magic 0x184D2A5E, one pair of sizes for each frame, footer magic
0x8F92EAB1).  ``write`` returns the index: for each record its identifier, bundle, frame and the offset inside the
decompressed frame, so ``fetch`` reads one frame for one record.

Equal payloads: the record with the smallest id is the response; the others are revisits that refer to it and carry the
digest and length of the full payload but no body.  Groups are formed by a partial aggregation over digests.  A payload with
more than ``rows / (4 x shuffle partitions)`` rows is *heavy*; there are fewer than ``4 x shuffle partitions`` of them
whatever the input, so their list is broadcast, and their rows are dealt over the tasks of the join by their page.

A bundle's name carries a random part and the index only lists bundles of tasks that ended well, so retried or
speculative tasks do no harm.  Files go to the shared folder through pyarrow's file systems.

Record identifiers are made of page ids; rows that repeat an id, or have none, get random ones, and no record refers to those
by identifier (by page it does).

Defined results: null html is an empty payload; a null url leaves the target out; repeated rows of the first id are all
responses; null ids never are the first of a group; an empty table writes no bundle; other columns are not looked at.  Ids
are integers (or strings of digits): others are refused by the cast to bigint.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, shuffle_partitions

#: A frame is closed at this many raw bytes or records, a bundle at this many compressed bytes.
FRAME_BYTES, FRAME_RECORDS, BUNDLE_BYTES = 1 << 20, 256, 64 << 20
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX_SCHEMA = "page_id bigint, record_id string, bundle string, frame bigint, frame_start bigint, frame_size bigint, offset bigint, length bigint"
READ_SCHEMA = "page_id bigint, record_id string, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """The identifier of a page's record; a random one for None."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(identifier: str, page_id: int | None, url: str | None, payload: bytes, sha: str, size: int, first: int | None, date: str, refers: bool = True) -> bytes:
    """One WARC/1.1 record.  ``first``: the id that a revisit refers to; ``refers``: its record is known by that id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE_IN_URI)}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *([f"WARC-Refers-To: {record_id(first)}"] if refers else []), f"X-Refers-To-Page: {first}"]
    body = http + payload if first is None else http
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}", f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


#: What a target URI keeps as it is; white space, controls, "%" and non-ASCII are percent-encoded, so reading undoes it.
SAFE_IN_URI = "!\"#$&'()*+,/:;<=>?@[\\]^`{|}~"


def parse_records(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a decompressed frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        yield at, end + 8 + size - at, head, raw[end + 4 : end + 4 + size]
        at = end + 8 + size


class Bundle:
    """A bundle while it is written."""

    def __init__(self, store: fs.FileSystem, path: str, uri: str):
        self.uri, self.out = uri, store.open_output_stream(path, compression=None)
        self.zip, self.sizes, self.raw, self.waiting, self.at, self.rows = zstandard.ZstdCompressor(level=3), [], bytearray(), [], 0, []

    def add(self, page_id: int | None, identifier: str, record: bytes) -> None:
        self.waiting.append((page_id, identifier, len(self.raw), len(record)))
        self.raw += record
        if len(self.raw) >= FRAME_BYTES or len(self.waiting) >= FRAME_RECORDS:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        packed = self.zip.compress(bytes(self.raw))
        self.out.write(packed)
        self.rows += [(p, i, self.uri, len(self.sizes), self.at, len(packed), o, n) for p, i, o, n in self.waiting]
        self.sizes.append((len(packed), len(self.raw)))
        self.at += len(packed)
        self.raw, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.rows


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the footer of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    raw, out, at = f.read(8 * n), [], 0
    for c, d in struct.iter_unpack("<II", raw):
        out.append((at, c, d))
        at += c
    return out


def record_types(df: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, sha, size and first (the id that a revisit refers to, else null)."""
    rows = df.select(df[id_col].cast("bigint").alias("page_id"), df[url_col].alias("url"), F.coalesce(df[html_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    light = rows.select("sha", "size", "page_id").where(F.col("size") >= min_bytes)
    again = light.groupBy("sha", "size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    again = cut(again)
    most = max(64, df.count() // (4 * shuffle_partitions(df.sparkSession)))
    heavy = again.where(F.col("_n") > most).select("sha", "size", F.col("_first").alias("_heavy"))
    placed = rows.join(F.broadcast(heavy), ["sha", "size"], "left")
    key = F.when(F.col("_heavy").isNull(), F.col("sha")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rest = again.where(F.col("_n") <= most).select(F.col("sha").alias("_key"), "size", "_first")
    joined = placed.withColumn("_key", key).join(rest, ["_key", "size"], "left").withColumn("_first", F.coalesce("_heavy", "_first"))
    return joined.select("page_id", "url", "payload", "sha", "size", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("first"))


def _alone(typed: DataFrame, ids: DataFrame) -> DataFrame:
    """typed with ``alone`` (no other row has the page_id, which is not null) and ``refers`` (the same of ``first``)."""
    repeated = cut(ids.groupBy("_r").agg(F.count("*").alias("_n")).where("_n > 1 and _r is not null").select("_r"))
    if not repeated.take(1):
        return typed.withColumn("alone", F.col("page_id").isNotNull()).withColumn("refers", F.lit(True))
    own = typed.join(repeated, F.col("page_id") == F.col("_r"), "left").withColumn("alone", F.col("page_id").isNotNull() & F.col("_r").isNull()).drop("_r")
    return own.join(repeated, F.col("first") == F.col("_r"), "left").withColumn("refers", F.col("_r").isNull()).drop("_r")


def write(df: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", **columns) -> DataFrame:
    """Write the bundles and return their index (cut from its lineage: the files are written once)."""
    ship(df.sparkSession)
    typed = _alone(record_types(df, **columns), df.select(df[columns.get("id_col", "page_id")].cast("bigint").alias("_r")))

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        bundle = None
        names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]

        def done(b):
            rows = b.close()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.string() if n in ("record_id", "bundle") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            cols = [batch.column(i) for i in range(8)]
            for i in range(batch.num_rows):
                page_id, url, payload, _, size, first, alone, refers = (c[i].as_py() for c in cols)
                identifier = record_id(page_id if alone else None)
                if bundle is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store, f"{root}/{name}", f"{folder}/{name}")
                bundle.add(page_id, identifier, make_record(identifier, page_id, url, payload, digest(payload), size, first, date, refers))
                if bundle.at >= BUNDLE_BYTES:
                    yield done(bundle)
                    bundle = None
        if bundle is not None:
            yield done(bundle)

    return cut(typed.mapInArrow(run, INDEX_SCHEMA))


def _row(head: dict[str, str], block: bytes) -> tuple:
    from urllib.parse import unquote

    kind, size, sha = head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    url, to = head.get("WARC-Target-URI"), head.get("X-Refers-To-Page")
    return (int(head["X-Page"]) if head["X-Page"] else None, head["WARC-Record-ID"], None if url is None else unquote(url), kind, int(to) if to else None, size, sha, payload if kind == "response" else None)


def _batch(rows: list[tuple], wanted: list[str]):
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kinds[t]) for i, (n, t) in enumerate(fields) if n in wanted], names=[n for n, _ in fields if n in wanted])


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read every bundle of the index from its own seek table, frame by frame; payloads are checked by their digest."""
    ship(index.sparkSession)
    wanted = [x.split()[0] for x in READ_SCHEMA.split(", ") if payloads or not x.startswith("payload binary")]
    schema = ", ".join(x for x in READ_SCHEMA.split(", ") if x.split()[0] in wanted)

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    for start, packed, raw in seek_table(f):
                        f.seek(start)
                        frame = unzip.decompress(f.read(packed), max_output_size=raw)
                        yield _batch([_row(h, b) for _, _, h, b in parse_records(frame)], wanted)

    # as many tasks as the session's shuffles have: a bundle is much work behind a short row.  The expression keeps the optimiser
    # from taking the exchange of distinct(), which adaptive execution would merge, for this one.
    bundles = index.select("bundle").distinct().repartition(shuffle_partitions(index.sparkSession), F.xxhash64("bundle"))
    return bundles.mapInArrow(run, schema)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given page ids, each by one range read of its frame."""
    ship(index.sparkSession)
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for uri, start, packed, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    f.seek(start)
                    raw = unzip.stream_reader(f.read(packed)).read()[offset : offset + length]
                rows += [_row(h, b) for _, _, h, b in parse_records(raw)]
            yield _batch(rows, names)

    hits = index.join(ids.select("page_id"), "page_id", "left_semi").sortWithinPartitions("bundle", "frame_start")
    return hits.select("bundle", "frame_start", "frame_size", "offset", "length").mapInArrow(run, READ_SCHEMA)


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
