"""Media columns: payloads as images in archive directories, behind a Spark data source.

A payload (bytes, a positive multiple of 64) is stored losslessly as a grey
8-bit PNG, 64 samples a row. Images are members of uncompressed ZIP archives.

``media_archive`` is a Spark data source in Python. Its writer makes archives of
bounded size per task and commits a manifest, so what a lost or repeated
task left behind is never read. Its reader plans partitions as byte ranges over
the archives of a directory; a partition owns the members whose local header
starts in its range, streams them in Arrow batches of bounded size, and reads
each member on its own by offset, with retries, so a failed read repeats one
member. Writer and reader both stream Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallyhall.llm.common import fresh_dir, open_fs, tuned

WIDTH = 64
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """Append zero bytes up to a positive multiple of width."""
    return data + bytes(-len(data) % width if data else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image whose samples are the payload, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; every chunk's checksum is verified."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, width, packed = 8, 0, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class _Archive:
    """An uncompressed ZIP archive that is being written."""

    def __init__(self, fs, root: str) -> None:
        self.name = f"archive-{uuid.uuid4().hex}.zip"
        self.out, self.at, self.directory, self.n = fs.open_output_stream(f"{root}/{self.name}"), 0, [], 0

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        shared = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(name), 0)
        self.out.write(_LOCAL + shared + name + data)
        self.directory.append(_CENTRAL + struct.pack("<H", 20) + shared + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + name)
        self.at += 30 + len(name) + len(data)
        self.n += 1

    def close(self) -> tuple[str, int]:
        listed = b"".join(self.directory)
        n = min(self.n, 0xFFFF)
        self.out.write(listed + _END + struct.pack("<HHHHIIH", 0, 0, n, n, len(listed), self.at, 0))
        self.out.close()
        return self.name, self.at


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        done, now, k = [], None, 0
        for batch in iterator:
            for doc, n, media in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
                now = now or _Archive(fs, root)
                now.add(json.dumps([k, doc, n], separators=(",", ":")).encode(), media.as_py())
                k += 1
                if now.at >= self.limit or now.n >= 60_000:  # the format counts members in 16 bits
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                fs.delete_file(f"{root}/{name}")


@dataclass
class _Range(InputPartition):
    archive: str
    lo: int
    hi: int


class MediaReader(DataSourceReader):
    def __init__(self, path: str, step: int) -> None:
        self.path, self.step = path, step

    def partitions(self) -> list[InputPartition]:
        """Byte ranges from the archives' names and sizes alone; members are listed by the tasks."""
        fs, root = open_fs(self.path)
        with fs.open_input_file(f"{root}/_manifest.json") as f:
            listed = json.loads(f.read())
        return [_Range(name, lo, min(lo + self.step, size)) for name, size in listed for lo in range(0, size, self.step)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once even if there is no range
            return
        fs, root = open_fs(self.path)
        path = f"{root}/{partition.archive}"
        rows, held = [], 0
        with fs.open_input_file(path) as f:
            for name, offset, size, crc in self._members(fs, path, partition.lo, partition.hi):
                rows.append((*json.loads(name)[1:], self._payload(fs, path, offset + 30 + len(name), size, crc, f)))
                held += size
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "media"])

    @staticmethod
    def _members(fs, path: str, lo: int, hi: int) -> list[tuple[bytes, int, int, int]]:
        """(name, offset, size, checksum) of members that start in the range, from the archive's directory."""
        with fs.open_input_file(path) as f:
            f.seek(f.size() - 22)
            size, start = struct.unpack_from("<II", f.read(22), 12)
            f.seek(start)
            listed = f.read(size)
        out, at = [], 0
        while at < len(listed):
            crc, _, n, k = struct.unpack_from("<IIIH", listed, at + 16)
            offset = struct.unpack_from("<I", listed, at + 42)[0]
            if lo <= offset < hi:
                out.append((listed[at + 46 : at + 46 + k], offset, n, crc))
            at += 46 + k
        return out

    @staticmethod
    def _payload(fs, path: str, at: int, size: int, crc: int, opened=None) -> bytes:
        """One member's bytes; a failed or damaged read is repeated alone, from a file opened anew."""
        for attempt in range(RETRIES):
            try:
                with nullcontext(opened) if opened and not attempt else fs.open_input_file(path) as f:
                    f.seek(at)
                    data = f.read(size)
                if zlib.crc32(data) == crc:
                    return data
                why = ValueError(f"{path} at {at}: checksum differs")
            except OSError as e:
                why = e
            time.sleep(0.1 * 2**attempt)
        raise why


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(dir)``: ``doc_id, n_bytes, media``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MediaWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)))


def feature(payload: bytes) -> str:
    """Mean, standard deviation and a 64-bit average hash of an image's samples."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    cols = a.mean(0)
    bits = sum(1 << int(k) for k in np.flatnonzero(cols > a.mean()))
    return f"h{len(a)}m{a.mean():.4f}s{a.std():.4f}a{bits:016x}"


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch[2].to_pylist():
            p = from_png(media)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch[0], batch[1], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in _FEATURES.split(", ")])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch[1].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch[0], pa.array([len(b) for b in raw], pa.int64()), pa.array([to_png(pad(b)) for b in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def store(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row's text (null: empty) as an image into archives under a directory."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src.mapInArrow(_images, "doc_id long, n_bytes long, media binary").write.format("media_archive").mode("append").save(path)


def media_features(df: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text as an image, read the archives back and describe each member.

    Null texts are empty and give 64 zero samples; equal texts give equal
    values; repeated rows and null ids are members of their own; an empty table
    gives a directory with an empty manifest.
    """
    spark = tuned(df.sparkSession)
    register(spark)
    path = path or fresh_dir(spark, "media")
    store(df, path)
    return spark.read.format("media_archive").load(path).mapInArrow(_features, _FEATURES)
