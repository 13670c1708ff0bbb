"""AES against published vectors and Spark's own; any bytes give rows or an ArchiveError."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oxbow.functions import aes
from oxbow.sources import containers as C
from oxbow.sources import packers

ENTRIES = [("a/one.txt", b"first " * 40), ("b.txt", b"second"), ("c/empty", b"")]


@pytest.mark.parametrize(
    "key, sealed",
    [
        ("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"),
        ("000102030405060708090a0b0c0d0e0f1011121314151617", "dda97ca4864cdfe06eaf70a0ec0d7191"),
        ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089"),
    ],
)
def test_published_vectors(key, sealed):
    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    cipher = aes.Aes(bytes.fromhex(key))
    assert cipher.encrypt(plain).tobytes().hex() == sealed
    assert (cipher.decrypt(cipher.encrypt(plain)) == plain).all()


def test_blocks_equal_spark(spark):
    plain = random.Random(1).randbytes(160)
    row = spark.createDataFrame([(bytearray(plain), bytearray(b"k" * 32), bytearray(b"i" * 16))], "p binary, k binary, i binary")
    got = row.selectExpr("aes_encrypt(p, k, 'CBC', 'PKCS', i) AS x").first()["x"]
    assert bytes(got)[16:176] == aes.cbc_encrypt(b"k" * 32, b"i" * 16, plain)
    assert aes.cbc_decrypt(b"k" * 32, b"i" * 16, bytes(got)[16:176]) == plain


@pytest.mark.parametrize("container, options", [("zip", {}), ("zip", {"method": "stored", "strength": 1}), ("zip", {"strength": 2}), ("7z", {}), ("7z", {"coder": "Copy"})])
def test_sealed_entries(container, options):
    data = packers.PACKERS[container](ENTRIES, password="pässword", **options)
    got = {m.path: m.content for m in C.members(container, data, "pässword")}
    assert got == dict(ENTRIES)
    for wrong in (None, "other"):
        assert any(m.error for m in C.members(container, data, wrong))
        assert not any(m.content for m in C.members(container, data, wrong))


PACKED = {k: f(ENTRIES) for k, f in packers.PACKERS.items()}


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(PACKED)), st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 255)), max_size=6), st.integers(0, 10_000))
def test_any_bytes_give_members_or_one_kind_of_error(container, changes, cut):
    data = bytearray(PACKED[container])
    for at, b in changes:
        data[at % len(data)] = b
    data = data[: cut % len(data)] if cut % 3 == 0 else data
    try:
        for m in C.members(container, bytes(data)):
            assert isinstance(m.path, str)
    except C.ArchiveError:
        pass


def test_bad_numbers_and_names_are_error_rows(spark):
    def pax(record):
        body = record + b"\n"
        n = len(body) + 3
        body = b"%d " % n + body
        return packers.tar_header(b"x", len(body), b"x") + body.ljust(512, b"\0") + packers.pack_tar([("f", b"1")])

    name = packers.pack_zip([("name", b"1")]).replace(b"name", b"n\xff\xfee")
    blobs = [(1, "tar", pax(b"size=abcd")), (2, "tar", pax(b"path=\xff\xfe")), (3, "zip", name), (4, "7z", PACKED["7z"][:40]), (5, None, b"")]
    rows = C.read_entries(spark.createDataFrame(blobs, "source_id long, container string, content binary")).collect()
    assert {r["source_id"] for r in rows if r["error"]} == {1, 2, 3, 4, 5}
