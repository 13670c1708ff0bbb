"""Media columns in archives: a Spark data source with byte-range partitions.

``oxbow_archive`` writes rows (name, content) as ZIP archives of bounded size and
reads them back.  A read is planned from archive names and sizes alone: each
archive is cut into byte ranges, and a task takes the members whose header begins
inside its range.  Members are fetched by offset and checked; one that fails is
fetched again on its own.  Payloads stream out in Arrow batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from oxbow.llm.common import stage_path

FORMAT = "oxbow_archive"
MANIFEST = "_archives"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
WIDTH = 64

# Record signatures and sizes of the ZIP format.
_LOCAL, _ENTRY, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_LOCAL_SIZE, _ENTRY_SIZE, _END_SIZE = 30, 46, 22

_SCHEMA = "name string, offset long, content binary"


class MemberError(OSError):
    """A member could not be read whole in any attempt."""


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ArchiveFile:
    """Sequential writer of one archive; members are stored as they are."""

    def __init__(self, out):
        self.out, self.at, self.directory, self.n = out, 0, io.BytesIO(), 0

    def add(self, name: bytes, content: bytes) -> None:
        crc, size = zlib.crc32(content), len(content)
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, crc, size, size, len(name), 0)
        self.directory.write(_ENTRY + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + name)
        head = _LOCAL + common + name
        self.out.write(head)
        self.out.write(content)
        self.at += len(head) + size
        self.n += 1

    def close(self) -> int:
        directory = self.directory.getvalue()
        self.out.write(directory)
        self.out.write(_END + struct.pack("<HHHHIIH", 0, 0, min(self.n, 0xFFFF), min(self.n, 0xFFFF), len(directory), self.at, 0))
        self.out.close()
        return self.at + len(directory) + _END_SIZE

    @property
    def full(self) -> bool:
        return self.at >= ARCHIVE_BYTES or self.n >= 0xFFFE


def directory_of(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, offset, stored size, checksum) of every member, from an archive's tail."""
    f.seek(size - _END_SIZE)
    end = f.read(_END_SIZE)
    if len(end) < _END_SIZE or end[:4] != _END:
        raise MemberError("no archive directory at the end of the file")
    n, n_bytes, at = struct.unpack_from("<HII", end, 10)
    f.seek(at)
    raw, out, k = f.read(n_bytes), [], 0
    while k < len(raw):
        if len(raw) < k + _ENTRY_SIZE or raw[k : k + 4] != _ENTRY:
            raise MemberError(f"bad directory entry at {at + k}")
        crc, stored, _, name_len, extra, comment = struct.unpack_from("<IIIHHH", raw, k + 16)
        (offset,) = struct.unpack_from("<I", raw, k + 42)
        out.append((raw[k + _ENTRY_SIZE : k + _ENTRY_SIZE + name_len].decode(), offset, stored, crc))
        k += _ENTRY_SIZE + name_len + extra + comment
    if k != n_bytes or len(out) != n:
        raise MemberError("the archive directory is not whole")
    return out


def read_member(fs: pafs.FileSystem, path: str, offset: int, stored: int, crc: int, held: list, attempts: int = ATTEMPTS) -> bytes:
    """One member's bytes by offset, retried alone with a file opened anew."""
    why: Exception | None = None
    for attempt in range(attempts):
        try:
            if not held:
                held.append(fs.open_input_file(path))
            f = held[0]
            f.seek(offset)
            head = f.read(_LOCAL_SIZE)
            if len(head) < _LOCAL_SIZE or head[:4] != _LOCAL:
                raise MemberError(f"no member at {offset} of {path}")
            skip = sum(struct.unpack_from("<HH", head, 26))
            f.seek(offset + _LOCAL_SIZE + skip)
            content = f.read(stored)
            if len(content) != stored or zlib.crc32(content) != crc:
                raise MemberError(f"member at {offset} of {path} is damaged")
            return content
        except OSError as e:
            why = e
            for f in held:
                f.close()
            held.clear()
            time.sleep(0.05 * attempt)
    raise MemberError(f"{path}, offset {offset}: {why}") from why


@dataclass
class ByteRange(InputPartition):
    file: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        fs, root = _filesystem(self.path)
        files = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=False)):
            if info.base_name.startswith(MANIFEST):
                with fs.open_input_file(info.path) as f:
                    files += json.loads(f.read())
        return [
            ByteRange(f"{root}/{name}", size, a, min(a + self.range_bytes, size))
            for name, size in sorted(files)
            for a in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            members = [m for m in directory_of(f, partition.size) if partition.start <= m[1] < partition.end]
        held: list = []
        rows: list[tuple] = []
        n_bytes = 0
        for name, offset, stored, crc in members:
            content = read_member(fs, partition.file, offset, stored, crc, held)
            rows.append((name, offset, content))
            n_bytes += stored
            if n_bytes >= BATCH_BYTES:
                yield _batch(rows)
                rows, n_bytes = [], 0
        for f in held:
            f.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    name, offset, content = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(offset, pa.int64()), pa.array(content, pa.binary())], names=["name", "offset", "content"])


class ArchiveWriter(DataSourceArrowWriter):
    """Attempt-unique archive files; only those of committed tasks reach the manifest."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, now = [], None
        for part in iterator:
            names, contents = part.column("name"), part.column("content")
            for name, content in zip(names, contents):
                if now is None:
                    file = f"media-{uuid.uuid4().hex}.zip"
                    now = ArchiveFile(fs.open_output_stream(f"{root}/{file}"))
                now.add((name.as_py() or "").encode(), content.as_py() or b"")
                if now.full:
                    files.append((file, now.close()))
                    now = None
        if now is not None:
            files.append((file, now.close()))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class ArchiveSource(DataSource):
    """Options: path; range_bytes, the bytes of an archive that a task takes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


# The signature of the PNG format.
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_image(text: bytes) -> bytes:
    """Lossless 8-bit grey image, 64 samples a row, of ``text`` filled with zeros to a
    positive multiple of 64; the unpadded length stands in a text chunk."""
    rows = max(1, -(-len(text) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    whole = np.zeros(rows * WIDTH, np.uint8)
    whole[: len(text)] = np.frombuffer(text, np.uint8)
    lines[:, 1:] = whole.reshape(rows, WIDTH)
    return b"".join((
        _PNG, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"Length\0%d" % len(text)), _chunk(b"IDAT", zlib.compress(lines, 2)), _chunk(b"IEND", b""),
    ))


def decode_image(image: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows by 64) and the unpadded length; damage raises ValueError."""
    if image[:8] != _PNG:
        raise ValueError("not an image of this kind")
    at, data, length, rows = 8, [], None, 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", body)[1]
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return lines[:, 1:], length


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean and variance in thousandths, and a 64-bit difference hash of block means."""
    rows = len(samples)
    n, total = samples.size, int(samples.sum(dtype=np.int64))
    squares = int((samples.astype(np.int64) ** 2).sum())
    edges = np.arange(9) * rows // 8
    column = np.add.reduceat(samples, np.arange(9) * 7, axis=1, dtype=np.int64)  # eight blocks of 7 columns, then the last 8
    sums = np.vstack([column[a:b].sum(axis=0) if b > a else column[min(a, rows - 1)] for a, b in zip(edges[:-1], edges[1:])])
    sums = sums * np.array([8] * 8 + [7])  # equal weights
    bits = np.packbits((sums[:, 1:] > sums[:, :-1]).ravel()).tobytes().hex()
    return f"{rows}:{total * 1000 // n}:{(squares * n - total * total) * 1000 // (n * n)}:{bits}"


def pack_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each row's text as an image in archives under ``path``.

    A member is named by the id, or ``null``; null text is empty.  Repeated ids and
    rows get a member each.
    """
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("binary").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names, contents, n_bytes = [], [], 0
            for key, text in zip(part.column(0), part.column(1)):
                names.append("null" if not key.is_valid else f"id:{key.as_py()}")
                contents.append(encode_image(text.as_py() or b""))
                n_bytes += len(contents[-1])
                if n_bytes >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
                    names, contents, n_bytes = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    docs.sparkSession.dataSource.register(ArchiveSource)
    rows.mapInArrow(run, "name string, content binary").write.format(FORMAT).mode("append").save(path)


def read_media(spark, path: str, **options) -> DataFrame:
    """name, offset, content of every member under ``path``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def media_features(members: DataFrame, id_type: str = "long") -> DataFrame:
    """The id, sizes, digests and feature of each stored image, from the bytes read back."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[] for _ in range(8)]
            for name, content in zip(part.column(0), part.column(1)):
                name, image = name.as_py(), content.as_py()
                samples, length = decode_image(image)
                payload = samples.tobytes()
                row = (name[3:] if name.startswith("id:") else None, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples))
                for held, x in zip(out, row):
                    held.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = members.select("name", "content").mapInArrow(run, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.select(F.col("id").cast(id_type).alias("doc_id"), *[c for c in found.columns if c != "id"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pack every text of ``docs``, read the archives back and describe each member.

    Empty and null texts are one row of zero samples; an empty table gives no rows.
    Only the two named columns are read.
    """
    spark = docs.sparkSession
    path = path or stage_path(spark, "media")
    id_type = docs.select(docs[id_col]).schema[0].dataType.simpleString()
    pack_media(docs, path, id_col, text_col)
    return media_features(read_media(spark, path), id_type)
