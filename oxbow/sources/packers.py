"""Writers of small archives, for tests and round-trip queries."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from oxbow.functions import aes
from oxbow.functions.hashing import sevenz_key
from oxbow.sources.codecs import pack_lz4

Entry = tuple[str, bytes]


def tar_header(name: bytes, size: int, kind: bytes = b"0", link: bytes = b"") -> bytes:
    head = name[:100].ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + b"%011o\0" % size + b"00000000000\0" + b" " * 8 + kind + link[:100].ljust(100, b"\0") + b"ustar\00000"
    head = head.ljust(512, b"\0")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def pack_tar(entries: Iterable[Entry]) -> bytes:
    out = []
    for name, body in entries:
        raw = name.encode()
        if len(raw) > 100:
            out += [tar_header(b"././@LongLink", len(raw) + 1, b"L"), raw + b"\0" + b"\0" * (-(len(raw) + 1) % 512)]
        out += [tar_header(raw, len(body)), body, b"\0" * (-len(body) % 512)]
    return b"".join([*out, b"\0" * 1024])


def pack_zip(entries: Iterable[Entry], method: str = "deflate", password: str | None = None, strength: int = 3) -> bytes:
    """With a password, entries are sealed by AES and carry no checksum (version 2)."""
    code = {"stored": 0, "deflate": 8, "zstd": 93}[method]
    out, directory, at, n = [], [], 0, 0
    for name, body in entries:
        if method == "deflate":
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = c.compress(body) + c.flush()
        else:
            packed = zstandard.compress(body) if method == "zstd" else body
        raw, extra, flags, crc, kind = name.encode(), b"", 0x800, zlib.crc32(body), code
        if password is not None:
            packed = aes.zip_aes_encrypt(packed, password.encode(), strength, aes.digest_salt(name, 4 + 4 * strength))
            extra, flags, crc, kind = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", strength, code), 0x801, 0, 99
        common = struct.pack("<HHHHHIIIHH", 20, flags, kind, 0, 0x21, crc, len(packed), len(body), len(raw), len(extra))
        directory.append(b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw + extra)
        out += [b"PK\x03\x04" + common + raw + extra, packed]
        at += 30 + len(raw) + len(extra) + len(packed)
        n += 1
    cd = b"".join(directory)
    return b"".join([*out, cd, b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, n, n, len(cd), at, 0)])


def _number(n: int) -> bytes:
    for k in range(8):
        if n < 1 << (7 * (k + 1)):
            first = (0xFF << (8 - k) & 0xFF) | n >> (8 * k)
            return bytes([first]) + (n & ((1 << 8 * k) - 1)).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


def lay_7z(entries: list[Entry], coder: str = "LZMA2", password: str | None = None) -> tuple[bytes, bytes, bytes, bytes | None, bytes | None]:
    """(start, packed, head, key, initial vector) of an archive; with a password, ``packed`` is
    whole blocks that have still to be sealed, else key and vector are null."""
    body = b"".join(b for _, b in entries)
    if coder == "LZMA2":
        packed, props, code = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]), bytes([18]), b"\x21"
    elif coder == "Deflate":
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed, props, code = c.compress(body) + c.flush(), b"", b"\x04\x01\x08"
    else:
        packed, props, code = body, b"", b"\0"
    full = [e for e in entries if e[1]]
    coders, sizes, key, iv = [(code, props)], [len(body)], None, None
    if password is not None:
        salt, iv, size = aes.digest_salt("7z", 8), aes.digest_salt(str(len(body)), 16), len(packed)
        key, packed = sevenz_key(password, salt, 6), packed + bytes(-len(packed) % 16)
        coders, sizes = [*coders, (b"\x06\xf1\x07\x01", bytes([0xC6, 0x7F]) + salt + iv)], [*sizes, size]
    chain = b"".join(bytes([len(c) | (0x20 if p else 0)]) + c + (_number(len(p)) + p if p else b"") for c, p in coders)
    streams = b"\x06" + _number(0) + _number(1) + b"\x09" + _number(len(packed)) + b"\0"
    streams += b"\x07\x0b" + _number(1) + b"\0" + _number(len(coders)) + chain + (_number(0) + _number(1)) * (len(coders) - 1) + b"\x0c" + b"".join(map(_number, sizes)) + b"\0"
    streams += b"\x08\x0d" + _number(len(full)) + (b"\x09" + b"".join(_number(len(b)) for _, b in full[:-1]) if len(full) > 1 else b"")
    streams += (b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(b)) for _, b in full) if full else b"") + b"\0\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in entries)
    files = _number(len(entries))
    empty = [not b for _, b in entries]
    if any(empty):
        bits = bytearray((len(empty) + 7) // 8)
        for k, e in enumerate(empty):
            bits[k // 8] |= e << (7 - k % 8)
        all_ = bytearray((sum(empty) + 7) // 8)
        for k in range(sum(empty)):
            all_[k // 8] |= 1 << (7 - k % 8)
        files += b"\x0e" + _number(len(bits)) + bytes(bits) + b"\x0f" + _number(len(all_)) + bytes(all_)
    files += b"\x11" + _number(len(names)) + names + b"\0"
    head = b"\x01\x04" + streams + b"\x05" + files + b"\0"
    start = struct.pack("<QQI", len(packed), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\x04" + struct.pack("<I", zlib.crc32(start)) + start, packed, head, key, iv


def pack_7z(entries: list[Entry], coder: str = "LZMA2", password: str | None = None) -> bytes:
    """All entries in one folder, sealed by AES if there is a password."""
    start, packed, head, key, iv = lay_7z(entries, coder, password)
    return start + (packed if key is None else aes.cbc_encrypt(key, iv, packed)) + head


def _leb(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _rar_block(body: bytes) -> bytes:
    body = _leb(len(body)) + body
    return struct.pack("<I", zlib.crc32(body)) + body


def pack_rar5(entries: Iterable[Entry]) -> bytes:
    out = [b"Rar!\x1a\x07\x01\x00", _rar_block(_leb(1) + _leb(0) + _leb(0))]
    for name, body in entries:
        raw = name.encode()
        out += [_rar_block(_leb(2) + _leb(2) + _leb(len(body)) + _leb(4) + _leb(len(body)) + _leb(0) + struct.pack("<I", zlib.crc32(body)) + _leb(0) + _leb(1) + _leb(len(raw)) + raw), body]
    return b"".join([*out, _rar_block(_leb(5) + _leb(0) + _leb(0))])


WRAPPERS: dict[str, Callable[[bytes], bytes]] = {
    "": bytes, ".gz": lambda b: gzip.compress(b[: len(b) // 2], 6, mtime=0) + gzip.compress(b[len(b) // 2 :], 6, mtime=0), ".bz2": bz2.compress, ".xz": lzma.compress, ".zst": zstandard.compress, ".lz4": pack_lz4,
}
PACKERS: dict[str, Callable[[list[Entry]], bytes]] = {"tar": pack_tar, "zip": pack_zip, "7z": pack_7z, "rar": pack_rar5}


def pack_documents(docs: DataFrame, container: str, wrapper: str = "", **options) -> DataFrame:
    """source_id, name, content: one archive for each source and 64 documents at most of it.

    A block of a 7z archive needs the one before, so its folder is sealed by Spark's own AES,
    whose padding (one block more, as the folder is whole blocks) and leading vector are cut off.
    """
    native = container == "7z" and not wrapper and options.get("password") is not None

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        entries = sorted((f"{s}/{i}.txt", t.encode()) for s, i, t in zip(frame["source"], frame["doc_id"], frame["text"]))
        named = {"source_id": [f"{key[0]}-{key[1]}"], "name": [f"{key[0]}.{container}{wrapper}"]}
        if native:
            return pd.DataFrame(named | {n: [part] for n, part in zip(("start", "packed", "head", "key", "iv"), lay_7z(entries, **options))})
        return pd.DataFrame(named | {"content": [WRAPPERS[wrapper](PACKERS[container](entries, **options))]})

    keyed = docs.selectExpr("source", "doc_id div 1280 as part", "doc_id", "text")
    parts = "start binary, packed binary, head binary, key binary, iv binary" if native else "content binary"
    packed = keyed.groupBy("source", "part").applyInPandas(run, f"source_id string, name string, {parts}")
    if not native:
        return packed
    sealed = "substring(aes_encrypt(packed, key, 'CBC', 'PKCS', iv), 17, octet_length(packed))"
    return packed.selectExpr("source_id", "name", f"concat(start, {sealed}, head) AS content")


def chunked(data: bytes, n: int) -> Iterator[bytes]:
    for k in range(0, len(data), n):
        yield data[k : k + n]
