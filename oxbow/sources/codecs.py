"""Compressed byte streams: bytes in, bytes out, every member or frame of a stream."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class StreamError(ValueError):
    """The stream is damaged, cut short or of an unsupported kind."""


def _members(data: bytes, make: Callable, name: str) -> Iterator[bytes]:
    """Whole members one after the other; each decoder stops at its own end."""
    if not data:
        raise StreamError(f"{name}: empty stream")
    while data:
        decoder = make()
        try:
            out = decoder.decompress(data)
            if hasattr(decoder, "flush"):
                out += decoder.flush()
        except (zlib.error, lzma.LZMAError, OSError, ValueError, EOFError) as e:
            raise StreamError(f"{name}: {e}") from e
        if not decoder.eof:
            raise StreamError(f"{name}: the stream ends too early")
        yield out
        data = decoder.unused_data


def gzip_members(data: bytes) -> Iterator[bytes]:
    return _members(data, lambda: zlib.decompressobj(31), "gzip")


def gunzip(data: bytes) -> bytes:
    return b"".join(gzip_members(data))


def inflate(data: bytes) -> bytes:
    return b"".join(_members(data, lambda: zlib.decompressobj(-15), "deflate"))


def bunzip2(data: bytes) -> bytes:
    return b"".join(_members(data, bz2.BZ2Decompressor, "bzip2"))


def unxz(data: bytes) -> bytes:
    out = []
    while data:
        stripped = data.lstrip(b"\0")  # stream padding comes in fours
        if out and (len(data) - len(stripped)) % 4 == 0 and not stripped:
            break
        d = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        try:
            out.append(d.decompress(stripped if out else data))
        except lzma.LZMAError as e:
            raise StreamError(f"xz: {e}") from e
        if not d.eof:
            raise StreamError("xz: the stream ends too early")
        data = d.unused_data
    if not out:
        raise StreamError("xz: empty stream")
    return b"".join(out)


def unzstd(data: bytes) -> bytes:
    out, at = [], 0
    if not data:
        raise StreamError("zstd: empty stream")
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # skippable frame
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at > len(data):
                raise StreamError("zstd: the stream ends too early")
            continue
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            out.append(d.decompress(data[at:]))
        except zstandard.ZstdError as e:
            raise StreamError(f"zstd: {e}") from e
        if not d.eof:
            raise StreamError("zstd: the stream ends too early")
        at = len(data) - len(d.unused_data)
    return b"".join(out)


def unlz4(data: bytes) -> bytes:
    """Frames of independent blocks; linked blocks are refused."""
    if data[:4] != b"\x04\x22\x4d\x18" or len(data) < 7:
        raise StreamError("lz4: not a frame")
    if not data[4] & 0x20:
        raise StreamError("lz4: linked blocks are not supported")
    try:
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    except (OSError, pa.ArrowException) as e:
        raise StreamError(f"lz4: {e}") from e


def pack_lz4(data: bytes, block: int = 64 << 10) -> bytes:
    """One frame of independent 64 KiB blocks with a content checksum."""
    head = bytes([0x64, 0x40])
    out = [b"\x04\x22\x4d\x18", head, bytes([xxhash.xxh32_intdigest(head) >> 8 & 0xFF])]
    codec = pa.Codec("lz4_raw")
    for k in range(0, len(data), block):
        raw = data[k : k + block]
        small = codec.compress(raw, asbytes=True)
        if len(small) < len(raw):
            out += [len(small).to_bytes(4, "little"), small]
        else:
            out += [(len(raw) | 1 << 31).to_bytes(4, "little"), raw]
    return b"".join([*out, bytes(4), xxhash.xxh32_intdigest(data).to_bytes(4, "little")])


DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "identity": bytes, "gzip": gunzip, "deflate": inflate, "bzip2": bunzip2, "xz": unxz, "zstd": unzstd, "lz4": unlz4,
}


def register_codec(name: str, decode: Callable[[bytes], bytes]) -> None:
    DECODERS[name] = decode


def decode_stream(fmt: Column, content: Column) -> Column:
    """struct(content, error): each stream decoded by its own format.  Damage is an error, not a failure."""

    known = dict(DECODERS)

    def run(f: pa.Array, c: pa.Array) -> pa.Array:
        out, errors = [], []
        for name, data in zip(f.to_pylist(), c.to_pylist()):
            got = error = None
            if data is not None:
                try:
                    if name not in known:
                        raise StreamError(f"no decoder for {name}")
                    got = known[name](data)
                except StreamError as e:
                    error = str(e)
            out.append(got)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["content", "error"])

    return F.arrow_udf(run, "content binary, error string")(fmt, content)


def split_members(blobs: DataFrame) -> DataFrame:
    """source_id, member, content: gzip members as rows, so that later work spreads over them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for source, data in zip(part.column(0), part.column(1)):
                members = list(gzip_members(data.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(members), part.schema.field(0).type), pa.array(range(len(members)), pa.int64()), pa.array(members, pa.binary())], ["source_id", "member", "content"])

    kind = blobs.schema["source_id"].dataType.simpleString()
    return blobs.select("source_id", "content").mapInArrow(run, f"source_id {kind}, member long, content binary")
