"""Archives as tables: tar, ZIP, 7z and stored RAR5 members from bytes.

Parsers are strict: what they do not support is an error row, never a guess.
"""

from __future__ import annotations

import hashlib
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.functions import aes, hashing
from oxbow.sources import codecs


class ArchiveError(ValueError):
    pass


@dataclass
class Member:
    path: str
    type: str = "file"
    size: int = 0
    packed_size: int = 0
    method: str = "stored"
    crc32: int | None = None
    data_offset: int | None = None
    link_target: str | None = None
    content: bytes | None = None
    error: str | None = None


# ---- tar ----

_TAR_TYPES = {b"0": "file", b"\0": "file", b"7": "file", b"5": "dir", b"2": "symlink", b"1": "hardlink"}


def tar_number(field: bytes) -> int:
    """Octal text or the base-256 form; blank is zero; negative or malformed is an error."""
    if field[0] & 0x80:
        if field[0] & 0x40:
            raise ArchiveError("negative number")
        return int.from_bytes(bytes([field[0] & 0x3F]) + field[1:], "big")
    text = field.split(b"\0")[0].strip(b" ")
    try:
        return int(text, 8) if text else 0
    except ValueError as e:
        raise ArchiveError("malformed number") from e


def _tar_text(raw: bytes) -> str:
    try:
        return raw.split(b"\0")[0].decode()
    except UnicodeDecodeError as e:
        raise ArchiveError("name is not UTF-8") from e


def _decimal(text: str) -> int:
    if not text.isascii() or not text.isdigit() or len(text) > 18:
        raise ArchiveError("malformed number")
    return int(text)


def pax_records(body: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(body):
        space = body.find(b" ", at)
        if space < 0 or not body[at:space].isdigit():
            raise ArchiveError("malformed extended header")
        end = at + int(body[at:space])
        record = body[space + 1 : end]
        if end > len(body) or end <= space + 1 or record[-1:] != b"\n" or b"=" not in record:
            raise ArchiveError("malformed extended header")
        key, _, value = record[:-1].partition(b"=")
        out[key.decode()] = value.decode()
        at = end
    return out


def tar_members(data: bytes) -> Iterator[Member]:
    """Members of a ustar or old-GNU archive.  Two zero blocks end it; one at the very end will do."""
    at, zeros = 0, 0
    long_name = long_link = None
    pax: dict[str, str] = {}
    while at < len(data):
        head = data[at : at + 512]
        if len(head) < 512:
            raise ArchiveError("unexpected end")
        at += 512
        if not head.strip(b"\0"):
            zeros += 1
            if zeros == 2:
                if data[at:].strip(b"\0"):
                    raise ArchiveError("trailing data")
                return
            continue
        if zeros:
            raise ArchiveError("trailing data")
        if tar_number(head[148:156]) != sum(head[:148]) + 256 + sum(head[156:]):
            raise ArchiveError("bad header checksum")
        if head[257:263] not in (b"ustar\0", b"ustar "):
            raise ArchiveError("bad magic")
        size, kind = tar_number(head[124:136]), head[156:157]
        if "size" in pax and kind in (b"0", b"\0", b"7"):
            size = _decimal(pax["size"])
        body = data[at : at + size]
        if len(body) < size:
            raise ArchiveError("unexpected end")
        start, at = at, at + size + (-size % 512)
        if at > len(data):
            raise ArchiveError("unexpected end")
        if kind == b"x":
            pax = pax_records(body)
        elif kind == b"L":
            long_name = _tar_text(body)
        elif kind == b"K":
            long_link = _tar_text(body)
        elif kind in _TAR_TYPES:
            prefix = _tar_text(head[345:500]) if head[257:263] == b"ustar\0" else ""
            name = pax.get("path") or long_name or (f"{prefix}/" if prefix else "") + _tar_text(head[:100])
            link = pax.get("linkpath") or long_link or _tar_text(head[157:257]) or None
            what = _TAR_TYPES[kind]
            is_file = what == "file"
            yield Member(name, what, size if is_file else 0, size if is_file else 0, data_offset=start, link_target=link, content=body if is_file else None)
            long_name = long_link = None
            pax = {}
        else:
            raise ArchiveError(f"unsupported entry type {kind!r}")
    if not zeros:
        raise ArchiveError("unexpected end")


# ---- ZIP ----


_ZIP_METHODS = {0: "stored", 8: "deflate", 93: "zstd"}


def _aes_extra(extra: bytes) -> tuple[int, int, int] | None:
    """(version, strength, method) of the extra field that an AES entry has."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 0x9901 and n >= 7 and at + 11 <= len(extra):
            version, _, strength, method = struct.unpack_from("<HHBH", extra, at + 4)
            return version, strength, method
        at += 4 + n
    return None


def zip_directory(data: bytes) -> list[tuple[Member, int, int, tuple | None]]:
    """(member, header offset, flags, AES parameters) of the central directory, in offset order."""
    for at in range(len(data) - 22, max(-1, len(data) - 22 - 0xFFFF - 1), -1):
        if data[at : at + 4] == b"PK\x05\x06" and struct.unpack_from("<H", data, at + 20)[0] == len(data) - at - 22:
            break
    else:
        raise ArchiveError("no end of central directory")
    disk, cd_disk, here, total, size, start = struct.unpack_from("<HHHHII", data, at + 4)
    if 0xFFFF in (here, total) or 0xFFFFFFFF in (size, start):
        raise ArchiveError("Zip64 is not supported")
    if disk or cd_disk or here != total or start + size > at:
        raise ArchiveError("bad end of central directory")
    out, k = [], start
    for _ in range(total):
        if data[k : k + 4] != b"PK\x01\x02":
            raise ArchiveError("bad central directory")
        flags, method = struct.unpack_from("<HH", data, k + 8)
        crc, packed, size_, n, extra, comment, disk = struct.unpack_from("<IIIHHHH", data, k + 16)
        (offset,) = struct.unpack_from("<I", data, k + 42)
        if 0xFFFFFFFF in (packed, size_, offset):
            raise ArchiveError("Zip64 is not supported")
        if disk:
            raise ArchiveError("spanned archives are not supported")
        name = data[k + 46 : k + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        sealed = _aes_extra(data[k + 46 + n : k + 46 + n + extra]) if method == 99 else None
        method = sealed[2] if sealed else method
        label = _ZIP_METHODS.get(method, str(method))
        m = Member(name, "dir" if name.endswith("/") else "file", size_, packed, label, crc)
        if flags & 0x40:
            m.error = "strong encryption is not supported"
        elif label.isdigit():
            m.error = f"unsupported method {method}"
        out.append((m, offset, flags, sealed))
        k += 46 + n + extra + comment
    return sorted(out, key=lambda x: x[1])


def _unsealed(raw: bytes, m: Member, flags: int, time: int, sealed: tuple | None, password: str | None) -> bytes:
    if password is None:
        raise ArchiveError("encrypted")
    if sealed:
        return aes.zip_aes_decrypt(raw, password.encode(), sealed[1])
    # the last byte of the header repeats the checksum's top byte, or the time's where sizes follow the data
    return hashing.zipcrypto(raw, password.encode(), time >> 8 if flags & 8 else m.crc32 >> 24)


def zip_members(data: bytes, password: str | None = None) -> Iterator[Member]:
    """Entries with their contents; encrypted ones need the password (AES or traditional)."""
    for m, offset, flags, sealed in zip_directory(data):
        head = data[offset : offset + 30]
        if head[:4] != b"PK\x03\x04" or len(head) < 30:
            m.error = m.error or "bad local header"
        else:
            lflags, lmethod, time = struct.unpack_from("<HHH", head, 6)
            crc, packed, size, n, extra = struct.unpack_from("<IIIHH", head, 14)
            m.data_offset = offset + 30 + n + extra
            name = data[offset + 30 : offset + 30 + n].decode("utf-8" if lflags & 0x800 else "cp437")
            lsealed = _aes_extra(data[offset + 30 + n : m.data_offset]) if lmethod == 99 else None
            label = _ZIP_METHODS.get(lsealed[2] if lsealed else lmethod, str(lmethod))
            sizes_differ = not flags & 8 and (crc, packed, size) != (m.crc32, m.packed_size, m.size)
            if name != m.path or label != m.method or (lflags ^ flags) & 1 or sizes_differ or lsealed != sealed:
                m.error = m.error or "local header differs from the directory"
        if m.type == "file" and not m.error:
            raw = data[m.data_offset : m.data_offset + m.packed_size]
            try:
                if flags & 1:
                    raw = _unsealed(raw, m, flags, time, sealed, password)
                m.content = {"stored": bytes, "deflate": codecs.inflate, "zstd": codecs.unzstd}[m.method](raw) if m.size or raw else b""
                unsummed = sealed is not None and sealed[0] == 2  # its code of authentication stands for the checksum
                if len(m.content) != m.size or not (unsummed or zlib.crc32(m.content) == m.crc32):
                    m.content, m.error = None, "checksum mismatch"
            except (ValueError, codecs.StreamError) as e:
                m.content, m.error = None, str(e)
        yield m


# ---- 7z ----


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ArchiveError("7z header ends too early")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Leading one bits of the first byte tell how many little-endian bytes follow."""
        first = self.byte()
        n = 8 - (first ^ 0xFF).bit_length()
        low = int.from_bytes(self.take(n), "little")
        return low | (first & (0x7F >> n)) << (8 * n) if n < 8 else low

    def count(self) -> int:
        """A number of things of which the header has at least a bit each."""
        n = self.number()
        if n > 8 * len(self.data):
            raise ArchiveError("7z header counts more than it holds")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] >> (7 - k % 8) & 1) for k in range(n)]

    def digests(self, n: int) -> list[int | None]:
        known = [True] * n if self.byte() else self.bits(n)
        return [int.from_bytes(self.take(4), "little") if k else None for k in known]


@dataclass
class _Folder:
    coders: list
    sizes: list
    crc: int | None = None
    files: list | None = None


_CODERS = {b"\0": "Copy", b"\x03\x01\x01": "LZMA", b"\x21": "LZMA2", b"\x04\x01\x08": "Deflate", b"\x06\xf1\x07\x01": "AES"}


def _streams_info(r: _Reader) -> tuple[int, list[int], list[_Folder]]:
    pack_at, packed, folders = 0, [], []
    while (kind := r.byte()) != 0:
        if kind == 6:
            pack_at, n = r.number(), r.number()
            while (k := r.byte()) != 0:
                if k == 9:
                    packed = [r.number() for _ in range(n)]
                elif k == 10:
                    r.digests(n)
                else:
                    raise ArchiveError("unexpected pack property")
        elif kind == 7:
            if r.byte() != 11:
                raise ArchiveError("folder list expected")
            n = r.number()
            if r.byte():
                raise ArchiveError("external folders are not supported")
            for _ in range(n):
                coders = []
                for _ in range(r.number()):
                    flag = r.byte()
                    name = r.take(flag & 15)
                    if flag & 0x10:
                        raise ArchiveError("coders of many streams are not supported")
                    coders.append((name, r.take(r.number()) if flag & 0x20 else b""))
                for _ in range(len(coders) - 1):
                    if (r.number(), r.number()) is None:
                        raise ArchiveError("bad bind pair")
                folders.append(_Folder(coders, []))
            if r.byte() != 12:
                raise ArchiveError("unpack sizes expected")
            for f in folders:
                f.sizes = [r.number() for _ in f.coders]
            while (k := r.byte()) != 0:
                if k != 10:
                    raise ArchiveError("unexpected folder property")
                for f, crc in zip(folders, r.digests(len(folders))):
                    f.crc = crc
        elif kind == 8:
            counts = [1] * len(folders)
            k = r.byte()
            if k == 13:
                counts = [r.count() for _ in folders]
                k = r.byte()
            for f, n in zip(folders, counts):
                sizes = [r.number() for _ in range(n - 1)] if k == 9 else [0] * max(0, n - 1)
                f.files = [[s, None] for s in sizes] + ([[f.sizes[0] - sum(sizes), None]] if n else [])
            if k == 9:
                k = r.byte()
            if k == 10:
                open_ = [x for f in folders for x in f.files if not (len(f.files) == 1 and f.crc is not None)]
                for x, crc in zip(open_, r.digests(len(open_))):
                    x[1] = crc
                k = r.byte()
            if k:
                raise ArchiveError("unexpected substream property")
        else:
            raise ArchiveError("unexpected stream property")
    for f in folders:
        f.files = [[f.sizes[0], f.crc]] if f.files is None else f.files
        if len(f.files) == 1 and f.files[0][1] is None:
            f.files[0][1] = f.crc
    return pack_at, packed, folders


def _unfold(folder: _Folder, raw: bytes, password: str | None = None) -> bytes:
    for (name, props), size in zip(reversed(folder.coders), reversed(folder.sizes)) if len(folder.coders) > 1 else zip(folder.coders, folder.sizes):
        kind = _CODERS.get(name)
        try:
            if kind == "Copy":
                pass
            elif kind == "LZMA":
                lc_lp_pb, size_ = props[0], int.from_bytes(props[1:5], "little")
                spec = {"id": lzma.FILTER_LZMA1, "lc": lc_lp_pb % 9, "lp": lc_lp_pb // 9 % 5, "pb": lc_lp_pb // 45, "dict_size": max(4096, size_)}
                raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec]).decompress(raw, size)
            elif kind == "LZMA2":
                bits = props[0]
                spec = {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)}
                raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec]).decompress(raw, size) if size else b""
            elif kind == "Deflate":
                raw = codecs.inflate(raw)
            elif kind == "AES":
                if password is None:
                    raise ArchiveError("encrypted")
                raw = aes.sevenz_aes_decrypt(raw, props, password)
            else:
                raise ArchiveError(f"unsupported coder {':'.join(f'{b:02X}' for b in name)}")
        except (lzma.LZMAError, codecs.StreamError) as e:
            raise ArchiveError(f"{kind}: {e}") from e
        raw = raw[:size]
        if len(raw) < size:
            raise ArchiveError(f"{kind}: the stream ends too early")
    if folder.crc is not None and zlib.crc32(raw) != folder.crc:
        raise ArchiveError("folder checksum mismatch")
    return raw


def sevenz_members(data: bytes, password: str | None = None) -> Iterator[Member]:
    if data[:6] != b"7z\xbc\xaf\x27\x1c" or len(data) < 32:
        raise ArchiveError("not a 7z archive")
    if data[6:8] != b"\0\x04":
        raise ArchiveError("unsupported 7z version")
    if zlib.crc32(data[12:32]) != int.from_bytes(data[8:12], "little"):
        raise ArchiveError("bad start header checksum")
    at, size, crc = struct.unpack_from("<QQI", data, 12)
    if not size:
        return
    head = data[32 + at : 32 + at + size]
    if len(head) < size or zlib.crc32(head) != crc:
        raise ArchiveError("bad header checksum")
    r = _Reader(head)
    kind = r.byte()
    while kind == 0x17:  # the header itself is a packed stream
        pack_at, packed, folders = _streams_info(r)
        r = _Reader(_unfold(folders[0], data[32 + pack_at : 32 + pack_at + packed[0]], password))
        kind = r.byte()
    if kind != 1:
        raise ArchiveError("header expected")
    pack_at, packed, folders, files = 0, [], [], []
    while (kind := r.byte()) != 0:
        if kind == 4:
            pack_at, packed, folders = _streams_info(r)
        elif kind == 5:
            files = [{} for _ in range(r.count())]
            empty: list[bool] = []
            while (k := r.number()) != 0:
                n = r.number()
                p = _Reader(r.take(n))
                if k == 14:
                    empty = p.bits(len(files))
                elif k == 15:
                    for f, x in zip([f for f, e in zip(files, empty) if e], p.bits(sum(empty))):
                        f["file"] = x
                elif k == 17:
                    if p.byte():
                        raise ArchiveError("external names are not supported")
                    names = p.data[1:].decode("utf-16-le").split("\0")
                    for f, name in zip(files, names):
                        f["name"] = name
            for k, f in enumerate(files):
                f["stream"] = not (k < len(empty) and empty[k])
        else:
            raise ArchiveError("unexpected header property")
    stream_files = iter([f for f in files if f["stream"]])
    offset = 32 + pack_at
    for folder, n in zip(folders, packed):
        error, raw = None, b""
        try:
            raw = _unfold(folder, data[offset : offset + n], password)
        except ArchiveError as e:
            error = str(e)
        at = 0
        label = "+".join(_CODERS.get(c, ":".join(f"{b:02X}" for b in c)) for c, _ in folder.coders)
        for size, crc in folder.files:
            part = raw[at : at + size]
            at += size
            bad = error or ("checksum mismatch" if crc is not None and zlib.crc32(part) != crc else None)
            yield Member(next(stream_files).get("name", ""), "file", size, n, label, crc, offset, None, None if bad else part, bad)
        offset += n
    for f in files:
        if not f["stream"]:
            is_file = f.get("file", False)
            yield Member(f.get("name", ""), "file" if is_file else "dir", content=b"" if is_file else None)


# ---- RAR5, stored ----


def _vint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    for k in range(10):
        if at >= len(data):
            break
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return out, at
    raise ArchiveError("malformed number")


def rar5_members(data: bytes) -> Iterator[Member]:
    """Entries of one RAR5 volume; only stored content is decoded."""
    if data[:8] != b"Rar!\x1a\x07\x01\x00":
        raise ArchiveError("legacy RAR is not supported" if data[:7] == b"Rar!\x1a\x07\x00" else "not a RAR archive")
    at = 8
    while at < len(data):
        crc = int.from_bytes(data[at : at + 4], "little")
        size, body = _vint(data, at + 4)
        end = body + size
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            raise ArchiveError("bad header checksum")
        kind, k = _vint(data, body)
        flags, k = _vint(data, k)
        extra = 0
        if flags & 1:
            extra, k = _vint(data, k)
        n = 0
        if flags & 2:
            n, k = _vint(data, k)
        if kind == 4:
            raise ArchiveError("encrypted headers are not supported")
        if kind == 2:
            fflags, k = _vint(data, k)
            unpacked, k = _vint(data, k)
            _, k = _vint(data, k)
            if fflags & 2:
                k += 4
            want = None
            if fflags & 4:
                want = int.from_bytes(data[k : k + 4], "little")
                k += 4
            info, k = _vint(data, k)
            _, k = _vint(data, k)
            length, k = _vint(data, k)
            m = Member(data[k : k + length].decode(), "dir" if fflags & 1 else "file", unpacked, n, "stored" if not info >> 7 & 7 else f"lz{info >> 7 & 7}", want, end)
            if m.type == "file":
                raw = data[end : end + n]
                if flags & 0x18:
                    m.error = "split entry"
                elif m.method != "stored":
                    m.error = "compressed entry"
                elif len(raw) < n or (want is not None and zlib.crc32(raw) != want):
                    m.error = "checksum mismatch"
                else:
                    m.content = raw
            yield m
        at = end + n
        if kind == 5:
            return
    raise ArchiveError("unexpected end")


PARSERS: dict[str, Callable[..., Iterator[Member]]] = {"tar": tar_members, "zip": zip_members, "7z": sevenz_members, "rar": rar5_members}
#: Containers whose entries may be encrypted.
SEALED = {"zip", "7z"}


def members(container: str | None, data: bytes | None, password: str | None = None) -> Iterator[Member]:
    """The members of an archive.  Whatever bytes it has, the only error is ArchiveError."""
    if container not in PARSERS:
        raise ArchiveError(f"no parser for {container}")
    found = PARSERS[container](data or b"", password) if container in SEALED else PARSERS[container](data or b"")
    while True:
        try:
            m = next(found)
        except StopIteration:
            return
        except ArchiveError:
            raise
        except (ValueError, LookupError, ArithmeticError, struct.error, zlib.error, lzma.LZMAError, MemoryError, RuntimeError, codecs.StreamError) as e:
            raise ArchiveError(f"damaged {container} archive: {e}") from e
        yield m

_COLUMNS = {
    "entry_idx": pa.int64(), "path": pa.string(), "type": pa.string(), "size": pa.int64(), "packed_size": pa.int64(), "method": pa.string(),
    "crc32": pa.int64(), "data_offset": pa.int64(), "link_target": pa.string(), "sha256": pa.string(), "content": pa.binary(), "error": pa.string(),
}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def read_entries(blobs: DataFrame, content: bool = False, fail_fast: bool = False, password: str | None = None) -> DataFrame:
    """A row for each entry of ``blobs`` (source_id, container, content).

    A damaged archive gives the entries before the damage and one row with an error,
    or raises with ``fail_fast``.  Contents come out only where ``content`` is set;
    their digest always does.  ``password`` opens encrypted ZIP and 7z entries; it travels
    with the tasks' code, not in the plan.
    """
    names = [c for c in _COLUMNS if content or c != "content"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for source, container, data in zip(*(part.column(k).to_pylist() for k in range(3))):
                rows = []
                try:
                    for m in members(container, data, password):
                        rows.append(m)
                except ArchiveError as e:
                    if fail_fast:
                        raise
                    rows.append(Member("", "error", error=str(e)))
                cols = {n: [getattr(m, n, None) for m in rows] for n in names if n not in ("entry_idx", "sha256")}
                cols["entry_idx"] = list(range(len(rows)))
                cols["sha256"] = [None if m.content is None else hashlib.sha256(m.content).hexdigest() for m in rows]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(rows), part.schema.field(0).type), *[pa.array(cols[n], _COLUMNS[n]) for n in names]], ["source_id", *names])

    kind = blobs.schema["source_id"].dataType.simpleString()
    schema = f"source_id {kind}, " + ", ".join(f"{n} {_SQL[_COLUMNS[n]]}" for n in names)
    return blobs.select("source_id", "container", "content").mapInArrow(run, schema)


def zip_content(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contents of the ``wanted`` ZIP entries alone: cut out by offset, then decoded by method."""
    raw = wanted.join(blobs.select("source_id", F.col("content").alias("blob")), "source_id").select(
        "source_id", "entry_idx", "path", "method", F.expr("substring(blob, cast(data_offset + 1 as int), cast(packed_size as int))").alias("raw")
    )
    name = F.when(F.col("method") == "stored", "identity").otherwise(F.col("method"))
    return raw.select("source_id", "entry_idx", "path", codecs.decode_stream(name, F.col("raw")).alias("d")).select("source_id", "entry_idx", "path", "d.content", "d.error")


def register_udtfs(spark) -> None:
    """``archive_entries(container, content)`` for SQL, to be used with LATERAL."""

    class Entries:
        def eval(self, container: str, content: bytes):
            try:
                for k, m in enumerate(members(container, content)):
                    yield k, m.path, m.type, m.size, m.method, m.content, m.error
            except ArchiveError as e:
                yield -1, "", "error", 0, "", None, str(e)

    spark.udtf.register("archive_entries", F.udtf(Entries, returnType="entry_idx long, path string, type string, size long, method string, content binary, error string"))
