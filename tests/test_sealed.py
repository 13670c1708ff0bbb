"""7z folders sealed by Spark's own AES are those of the packer, byte by byte."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxbow.functions import aes
from oxbow.plans import q_containers
from oxbow.sources import containers, packers


@pytest.mark.parametrize("coder", ["LZMA2", "Copy"])
def test_folders_sealed_in_the_plan_equal_those_of_the_packer(spark, coder):
    texts = {("a", 1): "first " * 40, ("a", 2): "", ("a", 3): "é" * 8, ("a", 1280): "y" * 33, ("b", 5): ""}
    docs = spark.createDataFrame([(s, k, t) for (s, k), t in texts.items()], "source string, doc_id long, text string")
    blobs = packers.pack_documents(docs, "7z", password="pässword", coder=coder)
    assert "aesEncrypt" in blobs._jdf.queryExecution().optimizedPlan().toString()
    groups = {}
    for (s, k), t in sorted(texts.items()):
        groups.setdefault((s, k // 1280), []).append((f"{s}/{k}.txt", t.encode()))
    want = {f"{s}-{p}": packers.pack_7z(sorted(e), coder, "pässword") for (s, p), e in groups.items()}
    assert {r["source_id"]: bytes(r["content"]) for r in blobs.collect()} == want
    got = containers.read_entries(q_containers.open_blobs(blobs), password="pässword").select("path", "sha256", "error")
    listed = docs.select(F.format_string("%s/%d.txt", "source", "doc_id"), F.sha2("text", 256), F.lit(None))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))


@pytest.mark.parametrize("size", [16, 24, 32])
def test_blocks_beyond_one_batch_open(size):
    key = random.Random(size).randbytes(size)
    plain = np.frombuffer(random.Random(1).randbytes(16 * (2 * aes._AT_ONCE + 3)), np.uint8).reshape(-1, 16)
    cipher = aes.Aes(key)
    assert (cipher.decrypt(cipher.encrypt(plain)) == plain).all()
    assert cipher.decrypt(plain[:0]).shape == (0, 16)
