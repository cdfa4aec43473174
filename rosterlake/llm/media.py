"""Media columns: texts kept as 8-bit images in archives, read through a Spark data source of our own.

Writing: each task streams its rows into archive files in the shared folder, one PNG member for a row. An archive
is: members one after another, each behind a fixed header (magic, sizes, row key, checksum of its bytes), then a
directory of the members' offsets and a footer that tells where it starts. A task's archive counts only once its name
stands in the committed manifest, so what lost or repeated attempts leave behind is never read.

Reading: the data source plans byte ranges over the archives from their sizes alone, never from a list of members, so
planning does not grow with the rows, and beyond `max_ranges` ranges grow instead of their number. A task reads the
archive's directory, takes the members that begin inside its range, reads them in one pass over one open file, decodes
them and streams their payloads as Arrow batches of bounded size; features are columns over the payload column. Each
member is retried on its own, by its offset, with the file opened anew; one that stays unreadable fails the task rather
than vanish.

Defined cases: null and empty texts are 64 zero bytes with n_bytes 0; the payload is padded with 0 to 63 zero bytes;
equal texts give equal values; a null id has a flag of its own, so any number may be an id; repeated rows give a row
each; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import as_uri, map_texts, prepare, shared_dir, table

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEAD = ">4s?qqqI"  # magic, has the row a key, the key, bytes unpadded, bytes of the member, their checksum
_FOOT = ">qqI4s"  # start of the directory, its members, its checksum, magic
_MAGIC, _END = b"MEDI", b"MEND"
_COLUMNS = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary"


def padded(data: bytes) -> bytes:
    """Filled with bytes 0 to whole rows, one at least; what fills its rows stays as it is."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of 64 samples a row."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote; every chunk's checksum is held against its bytes."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG member")
    at, packed, height = 8, [], 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean and standard deviation of the samples, and their share of each eighth of the range."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"h={len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};bins=" + ",".join(f"{b / len(x):.4f}" for b in bins)


def write_archives(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", archive_bytes: int = 256 << 20) -> str:
    """Stores every text as a PNG member; returns the path of the committed manifest (archive, bytes, members)."""
    prepare(docs.sparkSession)
    root = f"{folder}/media-{uuid.uuid4().hex}"
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, index, at, done = None, "", [], 0, []

        def close():
            directory = struct.pack(f">{len(index)}q", *index)
            out.write(directory + struct.pack(_FOOT, at, len(index), zlib.crc32(directory), _END))
            out.close()
            done.append((name, at + len(directory) + struct.calcsize(_FOOT), len(index)))

        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    name, index, at = f"{base}/{uuid.uuid4().hex}.arc", [], 0
                    out = store.open_output_stream(name)
                raw = data.as_py() or b""
                member = to_png(padded(raw))
                index.append(at)
                out.write(struct.pack(_HEAD, _MAGIC, key.is_valid, key.as_py() or 0, len(raw), len(member), zlib.crc32(member)) + member)
                at += struct.calcsize(_HEAD) + len(member)
                if at >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        for row in done:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["archive", "bytes", "members"])

    manifest = f"{root}/manifest"
    given.mapInArrow(run, "archive string, bytes long, members long").write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


class Archive:
    """One archive, read forward through one open file and a buffer; what fails is read anew from its offset."""

    def __init__(self, store: fs.FileSystem, path: str, tries: int, buffer: int = 1 << 20):
        self.store, self.path, self.tries, self.buffer = store, path, tries, buffer
        self.file, self.begin, self.data = None, 0, b""

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file, self.data = None, b""

    def bytes_at(self, at: int, size: int) -> bytes:
        if not (self.begin <= at and at + size <= self.begin + len(self.data)):
            if self.file is None:
                self.file = self.store.open_input_file(self.path)
            self.file.seek(at)
            self.begin, self.data = at, self.file.read(max(size, self.buffer))
        return self.data[at - self.begin : at - self.begin + size]

    def member(self, at: int) -> tuple[int | None, int, bytes, bytes]:
        """Key, unpadded size, stored bytes and payload of the member at this offset; tried anew by itself."""
        for left in range(self.tries - 1, -1, -1):
            try:
                magic, known, key, n, size, crc = struct.unpack(_HEAD, self.bytes_at(at, struct.calcsize(_HEAD)))
                data = self.bytes_at(at + struct.calcsize(_HEAD), size) if magic == _MAGIC else b""
                if magic != _MAGIC or len(data) != size or zlib.crc32(data) != crc:
                    raise OSError(f"the member at {at} of {self.path} is damaged")
                return key if known else None, n, data, from_png(data)
            except (OSError, ValueError, struct.error, zlib.error):
                self.close()
                if not left:
                    raise
                time.sleep(0.05 * (self.tries - left))
        raise AssertionError

    def offsets(self, start: int, end: int) -> list[int]:
        """Offsets of the members that begin from start to end, from the directory behind the members."""
        size, foot = self.store.get_file_info(self.path).size, struct.calcsize(_FOOT)
        where, n, crc, magic = struct.unpack(_FOOT, self.bytes_at(size - foot, foot))
        directory = self.bytes_at(where, 8 * n)
        if magic != _END or zlib.crc32(directory) != crc:
            raise OSError(f"the directory of {self.path} is damaged")
        all_of = np.frombuffer(directory, dtype=">i8")
        return all_of[(all_of >= start) & (all_of < end)].tolist()


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["manifest"]
        self.range_bytes, self.tries = int(options.get("range_bytes", 16 << 20)), int(options.get("tries", 4))
        self.max_ranges, self.batch_bytes, self.batch_rows = int(options.get("max_ranges", 20_000)), int(options.get("batch_bytes", 4 << 20)), int(options.get("batch_rows", 512))

    def partitions(self) -> list[ByteRange]:
        """Ranges over every committed archive, of range_bytes or so much more that there are about max_ranges."""
        store, base = fs.FileSystem.from_uri(self.manifest)
        parts = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")]
        sizes: list[tuple[str, int]] = []
        for p in parts:
            got = pq.read_table(store.open_input_file(p), columns=["archive", "bytes"])
            sizes += zip(got["archive"].to_pylist(), got["bytes"].to_pylist(), strict=True)
        step = max(self.range_bytes, -(-sum(s for _, s in sizes) // self.max_ranges))
        return [ByteRange(name, a, min(size, a + step)) for name, size in sizes for a in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        archive = Archive(fs.FileSystem.from_uri(self.manifest)[0], part.archive, self.tries)
        rows, held = [], 0
        for at in archive.offsets(part.start, part.end):
            key, n, data, payload = archive.member(at)
            rows.append((key, n, len(data), hashlib.sha256(data).hexdigest(), payload))
            held += len(payload)
            if held >= self.batch_bytes or len(rows) == self.batch_rows:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)
        archive.close()

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _COLUMNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaSource(DataSource):
    """spark.read.format("media_archive").option("manifest", ...).load(): a row for each member, with its payload."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256 and payload (binary) of every member."""
    prepare(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("manifest", manifest).options(**options).load()


def media_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Stores the texts as images, reads their payloads back from the archives and computes features over them."""
    spark = docs.sparkSession
    members = read_archives(spark, write_archives(docs, as_uri(shared_dir(spark)), doc_id=doc_id, text=text), **options)
    payload = F.col("payload")
    of_payload = [F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -WIDTH, WIDTH)).alias("tail_crc32")]
    keep = [F.col("doc_id"), F.col("n_bytes"), *of_payload, F.col("media_bytes"), F.col("media_sha256")]
    return map_texts(members, "payload", lambda: lambda payloads: [[feature(p) for p in payloads]], "feature string", keep=keep)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
