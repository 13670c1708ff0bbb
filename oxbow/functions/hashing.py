"""Checksums and keys that Spark has no function for, in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def _reflected_table(poly: int, kind: type) -> np.ndarray:
    table = np.arange(256, dtype=kind)
    for _ in range(8):
        table = np.where(table & kind(1), table >> kind(1) ^ kind(poly), table >> kind(1))
    return table


# Reflected polynomials of CRC-32C and CRC-64/XZ, and that of CRC-32/bzip2.
_CRC32C = _reflected_table(0x82F63B78, np.uint32).tolist()
_CRC64 = _reflected_table(0xC96C5795D7870F42, np.uint64).tolist()
_BZIP2_POLY = 0x04C11DB7


def _forward_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ _BZIP2_POLY if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_BZIP2 = _forward_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC32C[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def crc64_xz(data: bytes) -> int:
    c = 0xFFFFFFFFFFFFFFFF
    for b in data:
        c = _CRC64[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFFFFFFFFFF


def crc32_bzip2(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _BZIP2[(c >> 24 ^ b) & 0xFF] ^ (c << 8 & 0xFFFFFFFF)
    return c ^ 0xFFFFFFFF


def combine_bzip2(blocks: list[int]) -> int:
    """The stream checksum: each block turns the sum left by one bit and is added to it."""
    out = 0
    for b in blocks:
        out = (out << 1 | out >> 31) & 0xFFFFFFFF ^ b
    return out


def blake2sp(data: bytes) -> bytes:
    """Eight interleaved BLAKE2s lanes under one root."""
    lanes = [hashlib.blake2s(fanout=8, depth=2, node_offset=k, node_depth=0, inner_size=32, last_node=k == 7) for k in range(8)]
    for k in range(0, len(data), 64):
        lanes[k // 64 % 8].update(data[k : k + 64])
    root = hashlib.blake2s(fanout=8, depth=2, node_offset=0, node_depth=1, inner_size=32, last_node=True)
    for lane in lanes:
        root.update(lane.digest())
    return root.digest()


def sevenz_key(password: str, salt: bytes, power: int) -> bytes:
    """AES key of a 7z archive: SHA-256 over 2^power rounds of salt, password and counter."""
    h, text = hashlib.sha256(), password.encode("utf-16-le")
    for k in range(1 << power):
        h.update(salt + text + k.to_bytes(8, "little"))
    return h.digest()


def zip_aes_keys(password: bytes, salt: bytes, key_bytes: int) -> tuple[bytes, bytes, bytes]:
    """(encryption key, authentication key, verifier) of a WinZip AES entry."""
    out = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * key_bytes + 2)
    return out[:key_bytes], out[key_bytes : 2 * key_bytes], out[2 * key_bytes :]


def rar5_keys(password: str, salt: bytes, power: int) -> tuple[bytes, bytes]:
    """(encryption key, eight check bytes) of a RAR5 archive of 2^power iterations."""
    text, n = password.encode(), 1 << power
    check = hashlib.pbkdf2_hmac("sha256", text, salt, n + 32)
    return hashlib.pbkdf2_hmac("sha256", text, salt, n), fold_check(check)


def fold_check(digest: bytes) -> bytes:
    out = bytearray(8)
    for k, b in enumerate(digest):
        out[k % 8] ^= b
    return bytes(out)


def zipcrypto(data: bytes, password: bytes, check: int) -> bytes:
    """Decrypt a traditionally encrypted ZIP entry; ``check`` is the byte its header must end in."""
    import zlib

    def crc(c: int, b: int) -> int:
        return zlib.crc32(bytes([b]), c ^ 0xFFFFFFFF) ^ 0xFFFFFFFF

    a, b, c = 0x12345678, 0x23456789, 0x34567890

    def turn(plain: int) -> None:
        nonlocal a, b, c
        a = crc(a, plain)
        b = ((b + (a & 0xFF)) * 134775813 + 1) & 0xFFFFFFFF
        c = crc(c, b >> 24)

    for p in password:
        turn(p)
    out = bytearray()
    for x in data:
        t = c | 2
        plain = x ^ (t * (t ^ 1) >> 8 & 0xFF)
        turn(plain)
        out.append(plain)
    if len(out) < 12 or out[11] != check:
        raise ValueError("wrong password")
    return bytes(out[12:])


def hmac_digest(key: bytes, data: bytes, kind: str = "sha256") -> bytes:
    return hmac.new(key, data, kind).digest()


def _column(f: Callable[[bytes], object], kind: pa.DataType, sql: str) -> Callable[[Column], Column]:
    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in c.to_pylist()], kind)

    return lambda content: F.arrow_udf(run, sql)(content.cast("binary"))


#: Columns over bytes: unsigned 32-bit sums are long, 64-bit ones lower-case hex.
crc32c_of = _column(crc32c, pa.int64(), "long")
crc32_bzip2_of = _column(crc32_bzip2, pa.int64(), "long")
crc64_of = _column(lambda x: f"{crc64_xz(x):016x}", pa.string(), "string")
xxh64_of = _column(lambda x: xxhash.xxh64_hexdigest(x, 0), pa.string(), "string")
blake2sp_of = _column(lambda x: blake2sp(x).hex(), pa.string(), "string")


def crc16_rar(content: Column) -> Column:
    """The checksum of legacy RAR headers: the low half of CRC-32."""
    return F.crc32(content.cast("binary")).bitwiseAND(F.lit(65535).cast("long"))
