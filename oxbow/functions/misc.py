"""Small conversions: labels, exit codes, packed numbers, times, alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_label(raw: Column) -> Column:
    """Bytes as upper-case pairs joined by colons."""
    return F.regexp_replace(F.hex(raw), "(..)(?=.)", "$1:")


def exit_code(kind: Column, signal: Column) -> Column:
    """0 done, 2 usage, 4 cannot resume, 128 + n stopped by signal n, else 1."""
    return F.when(kind == "ok", 0).when(kind == "usage", 2).when(kind == "resume", 4).when(kind == "signal", 128 + signal).otherwise(1).cast("long")


def vint_bytes(n: Column) -> Column:
    """Seven bits a byte, low first, as hex pairs in an array."""
    count = F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: (F.floor(n / F.pow(F.lit(128.0), k)) % 128 + F.when(k < count - 1, 128).otherwise(0)).cast("int"))


def vint_value(raw: Column) -> Column:
    """The number of at most ten such bytes; null if the last byte announces another."""
    value = F.aggregate(F.reverse(raw), F.lit(0).cast("long"), lambda a, b: a * 128 + b % 128)
    return F.when((F.size(raw) <= 10) & (F.element_at(raw, -1) < 128), value)


def filetime_timestamp(ticks: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp."""
    return F.timestamp_micros(((ticks - ticks % 10) / 10).cast("long") - 11644473600000000)


def align_down(n: Column, block: int) -> Column:
    return n - n % block


def align_up(n: Column, block: int) -> Column:
    return n + (block - n % block) % block
