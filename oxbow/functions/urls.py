"""URL parsing, joining and header values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oxbow.functions import let

_HTTP = r"^(http|https)://"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_url(url: Column) -> Column:
    """struct(error, scheme, host, port, path) of an http or https URL.

    The fragment is dropped; user information, hosts with anything but letters, digits,
    ``.``, ``-`` and ``_``, and ports past 65535 are errors.  The path includes the query.
    """
    rest = F.regexp_extract(url, r"^https?://([^#]*)", 1)
    return let(F.named_struct(F.lit("rest"), rest, F.lit("authority"), F.regexp_extract(rest, r"^([^/?]*)", 1)), lambda x: _parsed(url, x["rest"], x["authority"]))


def _parsed(url: Column, rest: Column, authority: Column) -> Column:
    scheme = F.regexp_extract(url, _HTTP, 1)
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    host = F.regexp_replace(authority, r":[^:]*$", "")
    port_text = F.when(authority.contains(":"), F.regexp_extract(authority, r":([^:]*)$", 1))
    digits = F.regexp_replace(port_text, r"^\+", "")
    port_ok = port_text.isNull() | (port_text.rlike(r"^\+?[0-9]{1,9}$") & (digits.try_cast("long") <= 65535))
    error = (
        F.when(~url.rlike(_HTTP), "unsupported scheme")
        .when(authority.contains("@"), "userinfo")
        .when(host == "", "missing host")
        .when(~host.rlike(r"^[A-Za-z0-9._-]+$"), "unsupported host")
        .when(~port_ok, "invalid port")
    )
    port = F.coalesce(digits.try_cast("int"), F.when(scheme == "https", 443).otherwise(80)).cast("int")
    path = F.when(tail == "", "/").when(F.left(tail, F.lit(1)) == "?", F.concat(F.lit("/"), tail)).otherwise(tail)

    def shown(e: Column) -> Column:
        fine = e.isNull() & url.isNotNull()
        return F.named_struct(
            F.lit("error"), e,
            F.lit("scheme"), F.when(fine, scheme),
            F.lit("host"), F.when(fine, F.lower(host)),
            F.lit("port"), F.when(fine, port),
            F.lit("path"), F.when(fine, path),
        )

    return let(error, shown)


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", 443).when(scheme == "http", 80)


def host_header(u: Column) -> Column:
    """``host`` or ``host:port`` where the port is not the scheme's own."""
    return F.when(u["port"] == default_port(u["scheme"]), u["host"]).otherwise(F.concat_ws(":", u["host"], u["port"].cast("string")))


def show_url(u: Column) -> Column:
    return F.when(u["host"].isNotNull(), F.concat(u["scheme"], F.lit("://"), host_header(u), u["path"]))


def join_path(base_path: Column, location: Column) -> Column:
    """The path that a relative redirect leads to; dot segments are kept as they are."""
    to = F.regexp_replace(location, r"#.*$", "")
    path = (
        F.when(to.startswith("/"), to)
        .when(to.startswith("?"), F.concat(F.regexp_extract(base_path, r"^([^?]*)", 1), to))
        .otherwise(F.concat(F.regexp_extract(base_path, r"^(.*/)", 1), to))
    )
    return F.when(path == "", "/").otherwise(path)


def join_url(base: Column, location: Column) -> Column:
    """A redirect target resolved against a parsed URL, shown as text."""
    moved = F.concat(base["scheme"], F.lit("://"), host_header(base), join_path(base["path"], location))
    return F.when(location.rlike(_HTTP), let(parse_url(location), show_url)).otherwise(moved)


def file_name(u: Column) -> Column:
    """Text after the last slash of the path without its query; null when empty."""
    return _or_null(F.regexp_extract(F.regexp_extract(u["path"], r"^([^?]*)", 1), r"([^/]*)$", 1))


def range_header(start: Column, end_excl: Column) -> Column:
    return F.when((start >= 0) & (end_excl > start), F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), (end_excl - 1).cast("string")))


def content_range(value: Column) -> Column:
    """struct(start, end_excl, total) of ``bytes a-b/total`` (``*`` for unknown); nulls when malformed."""
    pattern = r"^\s*bytes\s*=?\s*([0-9]{1,18})\s*-\s*([0-9]{1,18})\s*/\s*([0-9]{1,18}|\*)\s*$"
    a, b, t = (F.regexp_extract(value, pattern, k) for k in (1, 2, 3))
    start, last, total = a.try_cast("long"), b.try_cast("long"), t.try_cast("long")
    good = value.rlike(pattern) & (last >= start) & (total.isNull() | (last < total))
    return F.struct(F.when(good, start).alias("start"), F.when(good, last + 1).alias("end_excl"), F.when(good, total).alias("total"))


def etag_is_weak(etag: Column) -> Column:
    return F.coalesce(etag.rlike(r"^[Ww]/"), F.lit(False))


def fingerprints_agree(etag_a: Column, modified_a: Column, etag_b: Column, modified_b: Column) -> Column:
    """Two sources agree if neither has a fingerprint, or a strong tag or the date is equal."""
    none = etag_a.isNull() & modified_a.isNull() & etag_b.isNull() & modified_b.isNull()
    tags = (etag_a == etag_b) & ~etag_is_weak(etag_a) & ~etag_is_weak(etag_b)
    return none | F.coalesce(tags, F.lit(False)) | F.coalesce(modified_a == modified_b, F.lit(False))
