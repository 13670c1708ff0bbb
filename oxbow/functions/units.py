"""Byte counts, rates and durations as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the 1024-based units.
UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]

# Multipliers of the unit prefixes, lower-cased.
PREFIXES = {
    "": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12,
    "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40,
}


def format_bytes(n: Column) -> Column:
    """``n B`` below 1024, else one decimal (half to even) of the largest unit that fits.

    Doubles divide by powers of 1024 without loss; quotients of decimals end after six places.
    """
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k in range(1, len(UNITS)):
        value = F.rint(n.cast("double") / F.lit(float(1024**k)) * 10) / 10
        out = F.when(n >= 1024**k, F.concat(value.cast("decimal(20,1)").cast("string"), F.lit(" " + UNITS[k]))).otherwise(out)
    return out


def format_rate(rate: Column) -> Column:
    bad = rate.isNull() | F.isnan(rate) | (rate < 0) | (rate == float("inf"))
    return F.when(bad, "—").otherwise(F.concat(format_bytes(F.floor(rate + 0.5).cast("long")), F.lit("/s")))


def format_eta(seconds: Column) -> Column:
    """``2d4h32m``, ``23h15m9s``, ``43m56s``, ``42s`` or ``--``."""
    t = F.floor(seconds).cast("long")
    d, h, m, s = F.floor(t / 86400), F.floor(t % 86400 / 3600), F.floor(t % 3600 / 60), t % 60

    def said(*parts: tuple[Column, str]) -> Column:
        return F.concat(*[x for c, unit in parts for x in (c.cast("long").cast("string"), F.lit(unit))])

    return (
        F.when(seconds.isNull(), "--")
        .when(d >= 1, said((d, "d"), (h, "h"), (m, "m")))
        .when(h >= 1, said((h, "h"), (m, "m"), (s, "s")))
        .when(m >= 1, said((m, "m"), (s, "s")))
        .otherwise(said((t, "s")))
    )


def parse_bandwidth(text: Column) -> Column:
    """Bytes per second of ``10``, ``1.5M``, ``64KiB/s``; null where malformed, zero or unknown."""
    core = F.regexp_replace(F.trim(text), r"(?i)/s$", "")
    number = F.regexp_extract(core, r"^([0-9.]+)", 1)
    unit = F.lower(F.trim(F.regexp_replace(F.trim(F.substring(core, F.length(number) + 1, F.length(core))), r"(?i)b$", "")))
    times = F.lit(None).cast("double")
    for name, factor in PREFIXES.items():
        times = F.when(unit == name, float(factor)).otherwise(times)
    good = number.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    value = F.when(good, F.floor(number.try_cast("double") * times + 0.5).cast("long"))
    return F.when(value > 0, value)


def parse_disk_buffer(text: Column) -> Column:
    """struct(ok, cap): a byte count, or no cap for ``none``, ``off``, ``disabled`` and ``0``."""
    none = F.lower(F.trim(text)).isin("none", "off", "disabled", "0")
    cap = parse_bandwidth(text)
    return F.struct((none | cap.isNotNull()).alias("ok"), F.when(~none, cap).alias("cap"))
