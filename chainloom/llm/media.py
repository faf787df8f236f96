"""Media columns: archives of payloads in the shared folder, read by a Spark data source.

Texts become 8-bit grey images (64 samples a row) stored as PNG, which loses nothing. Each task packs its members into one archive,
under a name of its own, and renames it when it is whole, so a retried task leaves a whole file; where members begin stands at its end. The data
source lists archives and sizes on the driver, plans byte ranges of them, and each range streams its members through
Arrow. A member that cannot be read is tried again alone, from its own offset.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.materialize import shared_dir
from .common import as_bytes, slices

SAMPLES = 64
MAGIC = b"MEM1"
#: magic, whether there is a key, key, bytes of the text, bytes of the media, their CRC-32
HEADER = "<4sBqqqI"
HEADER_BYTES = struct.calcsize(HEADER)
#: At the end of an archive, after the places of its members and the end of the last: how many places, and a mark.
FOOTER, FOOTER_MARK = "<q4s", b"MEME"
FOOTER_BYTES = struct.calcsize(FOOTER)
RANGE_BYTES, BATCH_BYTES, TRIES = 16 << 20, 4 << 20, 4
SCHEMA = "doc_id long, n_bytes long, archive string, offset long, media binary"


def payload_of(text: bytes) -> bytes:
    """The text with bytes 0 behind it, up to a positive multiple of 64 bytes."""
    return text + bytes(SAMPLES - len(text)) if len(text) < SAMPLES else text + bytes(-len(text) % SAMPLES)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // SAMPLES, SAMPLES + 1), dtype=np.uint8)  # filter type 0 in front of each row
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SAMPLES)
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image of to_png()."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, SAMPLES + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that this format does not use")
    return rows[:, 1:].tobytes()


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _open(fs: pa.fs.FileSystem, path: str) -> pa.NativeFile:
    return fs.open_input_file(path)


def write_archives(docs: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Store the text of every row of docs as a member of an archive in `directory`; gives the number of members.

    Texts are stored whole, however long; an empty table gives no archive. Null texts are stored as empty ones; rows with null or repeated ids are members of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(directory)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        draft, n, offsets, at = f"{base}/_draft-{part:06d}-{uuid.uuid4().hex}", 0, [], 0
        with fs.open_output_stream(draft) as out:
            for b in slices(batches):
                for key, text in zip(b.column(0).cast(pa.int64()).to_pylist(), as_bytes(b.column(1)), strict=True):
                    media = to_png(payload_of(text or b""))
                    offsets.append(at)
                    at += out.write(struct.pack(HEADER, MAGIC, key is not None, key or 0, len(text or b""), len(media), zlib.crc32(media)) + media)
                    n += 1
            out.write(np.array([*offsets, at], dtype="<i8").tobytes() + struct.pack(FOOTER, n + 1, FOOTER_MARK))
        if n:
            fs.move(draft, f"{base}/part-{part:06d}.members")
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["members"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "members long").agg(F.sum("members").alias("n")).first()["n"] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def read_member(fs: pa.fs.FileSystem, path: str, offset: int, end: int) -> tuple[int | None, int, bytes]:
    """(key, bytes of the text, media) of the member at offset, with a file handle of its own."""
    with _open(fs, path) as f:
        return _parse(f.read_at(end - offset, offset), path, offset)


def _parse(raw: bytes, path: str, offset: int) -> tuple[int | None, int, bytes]:
    magic, has_key, key, n_bytes, size, crc = struct.unpack_from(HEADER, raw)
    media = raw[HEADER_BYTES:]
    if magic != MAGIC or len(media) != size or zlib.crc32(media) != crc:
        raise OSError(f"damaged member at {offset} of {path}")
    return key if has_key else None, n_bytes, media


def places(fs: pa.fs.FileSystem, path: str) -> np.ndarray:
    """Where the members of an archive begin, and where the last one ends."""
    with _open(fs, path) as f:
        n, mark = struct.unpack(FOOTER, f.read_at(FOOTER_BYTES, f.size() - FOOTER_BYTES))
        if mark != FOOTER_MARK:
            raise OSError(f"{path} is not whole")
        return np.frombuffer(f.read_at(8 * n, f.size() - FOOTER_BYTES - 8 * n), dtype="<i8")


class ArchiveReader(DataSourceReader):
    def __init__(self, directory: str, range_bytes: int):
        self.directory, self.range_bytes = directory, range_bytes

    def partitions(self) -> list[ByteRange]:
        fs, base = _file_system(self.directory)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".members"))
        cut = [ByteRange(path, at, min(size, at + self.range_bytes)) for path, size in files for at in range(0, size, self.range_bytes)]
        return cut or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """Members that begin in the range, wherever they end."""
        if not partition.path:
            return
        fs, _ = _file_system(self.directory)
        offsets = self.tried(lambda: places(fs, partition.path))
        first, last = np.searchsorted(offsets[:-1], [partition.start, partition.end])
        rows, held = [], 0
        with _open(fs, partition.path) as f:
            for a, b in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True):
                try:
                    key, n_bytes, media = _parse(f.read_at(b - a, a), partition.path, a)
                except OSError:
                    key, n_bytes, media = self.again(fs, partition.path, a, b)
                rows.append((key, n_bytes, partition.path, a, media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def again(self, fs: pa.fs.FileSystem, path: str, a: int, b: int) -> tuple[int | None, int, bytes]:
        return self.tried(lambda: read_member(fs, path, a, b))

    @staticmethod
    def tried(read):
        for k in range(TRIES):
            try:
                return read()
            except OSError:
                if k == TRIES - 1:
                    raise
                time.sleep(0.1 * 2**k)
        raise AssertionError

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "archive", "offset", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("member_archive").option("path", directory): one row per member."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, directory: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("member_archive").option("path", directory).option("rangebytes", range_bytes).load()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation, mean step between neighbouring samples and share of bytes 0 of an image."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    step = int(np.abs(np.diff(x)).sum())
    spread = max(0, n * squares - total * total) ** 0.5 / n
    return f"rows={n // SAMPLES};mean={total / n:.4f};dev={spread:.4f};step={step / (n - 1):.4f};zero={int((x == 0).sum()) / n:.4f}"


def media_features(members: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored members, decoded again.

    One row per member, null and repeated ids too; equal payloads have equal values. No members give no rows.
    """
    import hashlib

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text=2):
            media = b.column(2).to_pylist()
            read = [from_png(m) for m in media]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            cols = [[len(p) for p in read], [sha(p) for p in read], [zlib.crc32(p[-SAMPLES:]) for p in read], [len(m) for m in media], [sha(m) for m in media], [feature(p) for p in read]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [c.split()[0] for c in schema.split(", ")])

    return members.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts of docs to archives in the shared folder, and give the data source over them."""
    spark = docs.sparkSession
    directory = f"{shared_dir(spark)}/chainloom-media-{uuid.uuid4().hex}"
    write_archives(docs, directory, id_col, text_col)
    return read_archives(spark, directory)
