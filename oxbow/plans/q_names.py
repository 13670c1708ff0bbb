"""Queries over names, URLs and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from oxbow.functions import names, units, urls
from oxbow.plans.catalog import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("doc_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


@query("doc_sha1", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def doc_sha1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"))


@query(
    "digest_verify",
    """SELECT doc_id, CASE WHEN NOT regexp_full_match(given, '[0-9A-Fa-f]{64}') THEN 'malformed' WHEN lower(given) = sha256(text) THEN 'ok' ELSE 'mismatch' END AS verdict
    FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN upper(sha256(text)) WHEN doc_id % 5 = 1 THEN sha256(lang) WHEN doc_id % 5 = 2 THEN substr(sha256(text), 1, 63) ELSE sha256(text) END AS given FROM documents)""",
)
def digest_verify(spark, d):
    h = F.sha2(F.col("text"), 256)
    given = F.when(F.col("doc_id") % 5 == 0, F.upper(h)).when(F.col("doc_id") % 5 == 1, F.sha2(F.col("lang"), 256)).when(F.col("doc_id") % 5 == 2, F.substring(h, 1, 63)).otherwise(h)
    g = F.col("given")
    return table(spark, d, "documents").withColumn("given", given).select(
        "doc_id", F.when(~g.rlike("^[0-9A-Fa-f]{64}$"), "malformed").when(F.lower(g) == h, "ok").otherwise("mismatch").alias("verdict")
    )


_PAGE_URLS = """SELECT page_id, CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://User@') WHEN 2 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '\\1:8080') WHEN 3 THEN upper(url)
  WHEN 4 THEN regexp_replace(url, '^([a-z]+)://[^/]+', '\\1://') WHEN 5 THEN regexp_replace(url, '^([a-z]+://[^/]+).*$', '\\1?q=1') WHEN 6 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '\\1:99999')
  WHEN 7 THEN regexp_replace(url, '^([a-z]+://)', '\\1WWW.') WHEN 8 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '\\1:443') ELSE replace(url, '://', '://bad host.') END AS u FROM pages"""


def _page_urls(spark, d):
    u, k = F.col("url"), F.col("page_id") % 10
    sub = lambda p, r: F.regexp_replace(u, p, r)
    out = (
        F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("://"), F.lit("://User@"))).when(k == 2, sub("^([a-z]+://[^/]+)", "$1:8080")).when(k == 3, F.upper(u))
        .when(k == 4, sub("^([a-z]+)://[^/]+", "$1://")).when(k == 5, sub("^([a-z]+://[^/]+).*$", "$1?q=1")).when(k == 6, sub("^([a-z]+://[^/]+)", "$1:99999"))
        .when(k == 7, sub("^([a-z]+://)", "$1WWW.")).when(k == 8, sub("^([a-z]+://[^/]+)", "$1:443")).otherwise(F.replace(u, F.lit("://"), F.lit("://bad host.")))
    )
    return table(spark, d, "pages").select("page_id", out.alias("u"))


_PARSED = f"""p0 AS ({_PAGE_URLS}),
p1 AS (SELECT page_id, u, regexp_extract(u, '^(http|https)://', 1) AS scheme, regexp_extract(u, '^https?://([^#]*)', 1) AS rest FROM p0),
p2 AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS auth FROM p1),
p3 AS (SELECT *, substr(rest, length(auth) + 1) AS tail, regexp_replace(auth, ':[^:]*$', '') AS h, CASE WHEN contains(auth, ':') THEN regexp_extract(auth, ':([^:]*)$', 1) END AS pt FROM p2),
p4 AS (SELECT *, CASE WHEN scheme = '' THEN 'unsupported scheme' WHEN contains(auth, '@') THEN 'userinfo' WHEN h = '' THEN 'missing host' WHEN NOT regexp_full_match(h, '[A-Za-z0-9._-]+') THEN 'unsupported host'
  WHEN pt IS NOT NULL AND NOT (regexp_full_match(pt, '\\+?[0-9]+') AND try_cast(pt AS BIGINT) <= 65535) THEN 'invalid port' END AS error FROM p3),
parsed AS (SELECT page_id, u, error, CASE WHEN error IS NULL THEN scheme END AS scheme, CASE WHEN error IS NULL THEN lower(h) END AS host,
  CASE WHEN error IS NULL THEN coalesce(try_cast(pt AS INTEGER), CASE WHEN scheme = 'https' THEN 443 ELSE 80 END) END AS port,
  CASE WHEN error IS NULL THEN CASE WHEN tail = '' THEN '/' WHEN tail LIKE '?%' THEN '/' || tail ELSE tail END END AS path FROM p4)"""
_HOST_HEADER = "CASE WHEN host IS NULL THEN NULL WHEN port = CASE WHEN scheme = 'https' THEN 443 ELSE 80 END THEN host ELSE host || ':' || port END"


@query("url_parse", f"WITH {_PARSED} SELECT page_id, error, scheme, host, port, path FROM parsed")
def url_parse(spark, d):
    return _page_urls(spark, d).select("page_id", urls.parse_url(F.col("u")).alias("p")).select("page_id", "p.*")


@query(
    "host_header",
    f"WITH {_PARSED} SELECT page_id, {_HOST_HEADER} AS host_header, scheme || '://' || {_HOST_HEADER} || path AS shown FROM parsed",
)
def host_header(spark, d):
    p = _page_urls(spark, d).select("page_id", urls.parse_url(F.col("u")).alias("p"))
    u = F.col("p")
    return p.select("page_id", F.when(u["host"].isNotNull(), urls.host_header(u)).alias("host_header"), urls.show_url(u).alias("shown"))


@query(
    "url_basename",
    f"WITH {_PARSED} SELECT page_id, nullif(regexp_extract(regexp_extract(path, '^([^?]*)', 1), '([^/]*)$', 1), '') AS file_name FROM parsed",
)
def url_basename(spark, d):
    p = _page_urls(spark, d).select("page_id", urls.parse_url(F.col("u")).alias("p"))
    return p.select("page_id", urls.file_name(F.col("p")).alias("file_name"))


_LINKS = "SELECT page_id, url, unnest(list_distinct(list_concat(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ['?page=9', '#top', 'https://other.example.org:8443/x', 'next/one#frag']))) AS href FROM pages"


@query(
    "url_join",
    f"""WITH l AS ({_LINKS}), b AS (SELECT page_id, href, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path, regexp_replace(href, '#.*$', '') AS r FROM l)
    SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN r LIKE '/%' THEN root || r WHEN r LIKE '?%' THEN root || regexp_extract(path, '^([^?]*)', 1) || r
      ELSE root || regexp_extract(path, '^(.*/)', 1) || r END AS target FROM b""",
)
def url_join(spark, d):
    more = F.array(*[F.lit(x) for x in ("?page=9", "#top", "https://other.example.org:8443/x", "next/one#frag")])
    links = table(spark, d, "pages").select(
        "page_id", urls.parse_url(F.col("url")).alias("base"),
        F.explode(F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), more))).alias("href"),
    )
    return links.select("page_id", "href", urls.join_url(F.col("base"), F.col("href")).alias("target"))


@query(
    "content_range",
    """WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bytes ' || event_id || '-' || (event_id + 99) || '/' || (event_id + 100) WHEN 1 THEN 'bytes=' || event_id || '-' || (event_id + 9) || '/*'
      WHEN 2 THEN ' bytes  ' || event_id || ' - ' || (event_id + 5) || ' / 9999999 ' WHEN 3 THEN 'bytes */100' WHEN 4 THEN 'bytes ' || (event_id + 5) || '-' || event_id || '/*' ELSE 'bytes 0-5/5' END AS v FROM events),
    m AS (SELECT event_id, v, regexp_extract(v, '^\\s*bytes\\s*=?\\s*([0-9]+)\\s*-\\s*([0-9]+)\\s*/\\s*([0-9]+|\\*)\\s*$', ['a', 'b', 't']) AS g FROM s),
    n AS (SELECT event_id, v, try_cast(g.a AS BIGINT) AS a, try_cast(g.b AS BIGINT) AS b, try_cast(g.t AS BIGINT) AS t, g.t AS tt FROM m),
    o AS (SELECT *, tt <> '' AND b >= a AND (t IS NULL OR b < t) AS good FROM n)
    SELECT event_id, v, CASE WHEN good THEN a END AS "start", CASE WHEN good THEN b + 1 END AS end_excl, CASE WHEN good THEN t END AS total FROM o""",
)
def content_range(spark, d):
    e = F.col("event_id")
    s = lambda x: x.cast("string")
    v = (
        F.when(e % 6 == 0, F.concat(F.lit("bytes "), s(e), F.lit("-"), s(e + 99), F.lit("/"), s(e + 100)))
        .when(e % 6 == 1, F.concat(F.lit("bytes="), s(e), F.lit("-"), s(e + 9), F.lit("/*")))
        .when(e % 6 == 2, F.concat(F.lit(" bytes  "), s(e), F.lit(" - "), s(e + 5), F.lit(" / 9999999 ")))
        .when(e % 6 == 3, "bytes */100")
        .when(e % 6 == 4, F.concat(F.lit("bytes "), s(e + 5), F.lit("-"), s(e), F.lit("/*")))
        .otherwise("bytes 0-5/5")
    )
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v", urls.content_range(F.col("v")).alias("r")).select("event_id", "v", "r.*")


@query(
    "range_header",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey > 0 THEN 'bytes=' || l_suppkey || '-' || (l_suppkey + l_partkey - 1) END AS header FROM lineitem",
)
def range_header(spark, d):
    start, n = F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", urls.range_header(start, start + n).alias("header"))


@query(
    "fingerprints_agree",
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'W/"' || p_size || '"' ELSE '"' || p_size || '"' END AS e1, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS m1,
      CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '"' || (p_size + 1) || '"' WHEN 2 THEN 'W/"' || p_size || '"' ELSE '"' || p_size || '"' END AS e2, CASE WHEN p_partkey % 7 < 3 THEN p_brand END AS m2 FROM part)
    SELECT p_partkey, regexp_matches(coalesce(e1, ''), '^[Ww]/') AS weak, (e1 IS NULL AND m1 IS NULL AND e2 IS NULL AND m2 IS NULL)
      OR coalesce(e1 = e2 AND NOT regexp_matches(e1, '^[Ww]/'), false) OR coalesce(m1 = m2, false) AS agree FROM t""",
)
def fingerprints_agree(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    tag = lambda n, w="": F.concat(F.lit(w + '"'), n.cast("string"), F.lit('"'))
    t = table(spark, d, "part").select(
        "p_partkey",
        F.when(k % 4 == 0, None).when(k % 4 == 1, tag(size, "W/")).otherwise(tag(size)).alias("e1"), F.when(k % 3 == 0, F.col("p_brand")).alias("m1"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, tag(size + 1)).when(k % 5 == 2, tag(size, "W/")).otherwise(tag(size)).alias("e2"), F.when(k % 7 < 3, F.col("p_brand")).alias("m2"),
    )
    return t.select("p_partkey", urls.etag_is_weak(F.col("e1")).alias("weak"), urls.fingerprints_agree(*map(F.col, ("e1", "m1", "e2", "m2"))).alias("agree"))


_SUFFIXES = [".tar.gz", ".TAR.ZST", ".zip", ".7z", ".tgz", ".part0003.rar", ".7z.002", ".z01", ".tar.part0001", ".txt", ".tar.bz2", ".xz", ".rar", ".TBZ", ".lz4"]
_NAME = "'d' || doc_id || (" + repr(_SUFFIXES) + f")[1 + doc_id % {len(_SUFFIXES)}]"


def _names(spark, d):
    arr = F.array(*[F.lit(x) for x in _SUFFIXES])
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.get(arr, (F.col("doc_id") % len(_SUFFIXES)).cast("int"))).alias("name"))


def _suffix_case(col: str) -> str:
    pairs = sorted(((s, f.name) for f in names.FORMATS for s in f.suffixes), key=lambda x: -len(x[0]))
    return "CASE " + " ".join(f"WHEN ends_with(lower({col}), '{s}') THEN '{f}'" for s, f in pairs) + " END"


@query("format_by_suffix", f"SELECT doc_id, name, {_suffix_case('name')} AS format FROM (SELECT doc_id, {_NAME} AS name FROM documents)")
def format_by_suffix(spark, d):
    return _names(spark, d).select("doc_id", "name", names.Registry().by_suffix(F.col("name")).alias("format"))


_HEADS = ["28B52FFD00", "FD377A585A0000", "04224D1840", "1F8B08", "425A6839", "504B0304", "504B0506", "377ABCAF271C00", "526172211A070100", "526172211A0700", "00", "1F"]


def _magic_case(col: str) -> str:
    pairs = sorted(((m, f.name) for f in names.FORMATS for o, m in f.magics if o == 0), key=lambda x: -len(x[0]))
    return "CASE " + " ".join(f"WHEN starts_with({col}, '{m}') THEN '{f}'" for m, f in pairs) + " END"


_HEAD = f"({_HEADS!r})[1 + doc_id % {len(_HEADS)}]"


@query("format_by_magic", f"SELECT doc_id, {_magic_case(_HEAD)} AS format FROM documents")
def format_by_magic(spark, d):
    head = F.unhex(F.get(F.array(*[F.lit(x) for x in _HEADS]), (F.col("doc_id") % len(_HEADS)).cast("int")))
    return table(spark, d, "documents").select("doc_id", names.Registry().by_magic(head).alias("format"))


@query(
    "format_resolve",
    f"""WITH t AS (SELECT doc_id, {_suffix_case(_NAME)} AS s, {_magic_case(_HEAD)} AS m FROM documents)
    SELECT doc_id, CASE WHEN s IS NOT NULL AND m IS NOT NULL AND s <> m THEN NULL ELSE coalesce(m, s) END AS format,
      CASE WHEN s IS NOT NULL AND m IS NOT NULL AND s <> m THEN 'conflict' WHEN s IS NULL AND m IS NULL THEN 'no decoder' END AS error,
      CASE WHEN s IS NOT NULL AND m IS NOT NULL AND s <> m THEN NULL WHEN coalesce(m, s) IN ('tar', 'zip', '7z', 'rar') THEN 'tree' WHEN coalesce(m, s) IS NOT NULL THEN 'stream' END AS shape FROM t""",
)
def format_resolve(spark, d):
    r = names.Registry()
    head = F.unhex(F.get(F.array(*[F.lit(x) for x in _HEADS]), (F.col("doc_id") % len(_HEADS)).cast("int")))
    out = _names(spark, d).select("doc_id", r.resolve(F.col("name"), head).alias("r")).select("doc_id", "r.*")
    return out.withColumn("shape", r.shape(F.col("format")))


@query("magic_window", "SELECT CAST(265 AS BIGINT) AS bytes FROM region WHERE r_regionkey = 0")
def magic_window(spark, d):
    return table(spark, d, "region").where("r_regionkey = 0").select(F.lit(names.Registry().window()).cast("long").alias("bytes"))


_VOLUME = r"""SELECT doc_id, name, CASE WHEN regexp_matches(name, '(?i)^.+\.part[0-9]+\.rar$') THEN 'rar5' WHEN regexp_matches(name, '(?i)^.+\.7z\.[0-9]+$') THEN '7z' WHEN regexp_matches(name, '(?i)^.+\.(z[0-9]+|zip)$') THEN 'zip' END AS kind,
  regexp_extract(name, '(?i)^(.+)\.(part[0-9]+\.rar|7z\.[0-9]+|z[0-9]+|zip)$', 1) AS b, regexp_extract(name, '(?i)\.(?:part|7z\.|z)([0-9]+)(?:\.rar)?$', 1) AS n"""


@query(
    "volume_parse",
    f"""WITH t AS (SELECT doc_id, {_NAME} AS name FROM documents), v AS ({_VOLUME} FROM t)
    SELECT doc_id, name, kind, CASE WHEN kind IS NOT NULL THEN b END AS base, CASE WHEN kind IS NOT NULL THEN try_cast(n AS BIGINT) END AS volume, CASE WHEN kind IS NOT NULL THEN length(n) END AS width,
      CASE WHEN kind IS NULL THEN NULL WHEN kind = 'zip' AND n = '' THEN b || '.zip' WHEN kind = 'rar5' THEN b || '.part' || n || '.rar' WHEN kind = '7z' THEN b || '.7z.' || n ELSE b || '.z' || n END AS shown FROM v""",
)
def volume_parse(spark, d):
    v = _names(spark, d).select("doc_id", "name", names.parse_volume(F.col("name")).alias("v")).select("doc_id", "name", "v.*")
    return v.withColumn("shown", names.format_volume(*map(F.col, ("base", "kind", "volume", "width"))))


@query(
    "default_output",
    rf"""WITH t AS (SELECT doc_id, {_NAME} AS name FROM documents), v AS ({_VOLUME} FROM t)
    SELECT doc_id, name, regexp_replace(CASE WHEN kind IS NOT NULL THEN b ELSE regexp_replace(name, '(?i)\.part[0-9]+$', '') END, '(?i)^(.+?)(\.({'|'.join(names.STRIPPABLE)}))+$', '\1') AS output FROM v""",
)
def default_output(spark, d):
    return _names(spark, d).select("doc_id", "name", names.output_name(F.col("name")).alias("output"))


@query(
    "volume_gaps",
    """WITH v AS (SELECT s_nationkey AS base, s_suppkey AS volume FROM supplier WHERE s_suppkey % 7 <> 3),
    r AS (SELECT base, volume, row_number() OVER (PARTITION BY base ORDER BY volume) AS k, min(volume) OVER (PARTITION BY base) AS lo FROM v)
    SELECT CAST(base AS BIGINT) AS base, count(*) AS present, max(volume) AS highest, count(*) FILTER (volume = lo + k - 1) AS consecutive FROM r GROUP BY base""",
)
def volume_gaps(spark, d):
    from oxbow.operators.planning import volume_runs

    v = table(spark, d, "supplier").where("s_suppkey % 7 <> 3").select(F.col("s_nationkey").cast("long").alias("base"), F.col("s_suppkey").alias("volume"))
    return volume_runs(v)


_PATHS = ["a/b.txt", "../x", "/abs", "a//b/./c", "", "./", "dir/", "a\\b", "q?.txt", "end.", "nul.txt", "a/COM1.log", "x/../y", "C:/w", "sp ", "ok/name-1"]
_PATH = "(" + repr(_PATHS).replace("\\\\", "\\") + f")[1 + p_partkey % {len(_PATHS)}]"


def _paths(spark, d):
    arr = F.array(*[F.lit(x) for x in _PATHS])
    return table(spark, d, "part").select("p_partkey", F.get(arr, (F.col("p_partkey") % len(_PATHS)).cast("int")).alias("path"))


_TAR_REASON = r"""CASE WHEN contains(c, '\') THEN 'backslash' WHEN regexp_matches(c, '[<>:"|?*]') THEN 'reserved' WHEN regexp_matches(c, '[. ]$') THEN 'trailing'
 WHEN regexp_matches(c, '(?i)^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])(\.|$)') THEN 'device' END"""


@query(
    "path_safety_tar",
    rf"""WITH t AS (SELECT p_partkey, {_PATH} AS path FROM part), q AS (SELECT p_partkey, path, list_filter(string_split(path, '/'), lambda c: c <> '' AND c <> '.') AS parts FROM t),
    r AS (SELECT *, path = '' OR path LIKE '/%' OR list_contains(parts, '..') AS esc, list_filter(list_transform(parts, lambda c: {_TAR_REASON}), lambda r: r IS NOT NULL)[1] AS why FROM q)
    SELECT p_partkey, path, CASE WHEN esc THEN 'escape' WHEN why IS NOT NULL THEN 'unsafe' ELSE 'ok' END AS code, CASE WHEN NOT esc THEN why END AS reason,
      CASE WHEN NOT esc AND why IS NULL THEN array_to_string(parts, '/') END AS clean, ends_with(path, '/') AS is_dir FROM r""",
)
def path_safety_tar(spark, d):
    return _paths(spark, d).select("p_partkey", "path", names.safe_path(F.col("path"), "tar").alias("s")).select("p_partkey", "path", "s.*")


@query(
    "path_safety_zip",
    rf"""WITH t AS (SELECT p_partkey, {_PATH} AS path FROM part), u AS (SELECT p_partkey, path, regexp_replace(path, '/$', '') AS l FROM t),
    q AS (SELECT *, list_filter(string_split(l, '/'), lambda c: c <> '' AND c <> '.') AS parts FROM u),
    r AS (SELECT *, l = '' OR l LIKE '/%' OR list_contains(parts, '..') OR len(parts) = 0 AS esc FROM q)
    SELECT p_partkey, path, CASE WHEN esc THEN 'escape' ELSE 'ok' END AS code, CASE WHEN NOT esc THEN array_to_string(parts, '/') END AS clean, ends_with(path, '/') AS is_dir FROM r""",
)
def path_safety_zip(spark, d):
    return _paths(spark, d).select("p_partkey", "path", names.safe_path(F.col("path"), "zip").alias("s")).select("p_partkey", "path", "s.code", "s.clean", "s.is_dir")


@query(
    "format_bytes",
    """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * power(10, o_orderkey % 9)) AS BIGINT) AS n FROM orders)
    SELECT o_orderkey, n, CASE WHEN n < 1024 THEN n || ' B' ELSE """
    + "CASE " + " ".join(f"WHEN n >= {1024**k} THEN CAST(CAST(round_even(CAST(n AS DOUBLE) / {1024**k}, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' {u}'" for k, u in reversed([*enumerate(units.UNITS)][1:]))
    + " END END AS shown FROM t",
)
def format_bytes(spark, d):
    n = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 9)).cast("long")
    return table(spark, d, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", "n", units.format_bytes(F.col("n")).alias("shown"))


@query(
    "format_eta",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * power(10, event_id % 6)) AS BIGINT) END AS t FROM events)
    SELECT event_id, t AS seconds, CASE WHEN t IS NULL THEN '--' WHEN t >= 86400 THEN (t // 86400) || 'd' || (t % 86400 // 3600) || 'h' || (t % 3600 // 60) || 'm'
      WHEN t >= 3600 THEN (t // 3600) || 'h' || (t % 3600 // 60) || 'm' || (t % 60) || 's' WHEN t >= 60 THEN (t // 60) || 'm' || (t % 60) || 's' ELSE t || 's' END AS shown FROM t""",
)
def format_eta(spark, d):
    e = F.col("event_id")
    t = F.when(e % 11 == 0, None).otherwise(F.floor(F.col("value") * F.pow(F.lit(10.0), e % 6)).cast("long"))
    return table(spark, d, "events").select("event_id", t.alias("seconds")).select("event_id", "seconds", units.format_eta(F.col("seconds")).alias("shown"))


_RATES = ["10", "1.5M", "64KiB/s", "2 g", "0", "abc", "1_000", " 3MB/S ", "7 Q", ".5k", "1.2.3", "1Ti"]


@query(
    "parse_bandwidth",
    f"""WITH t AS (SELECT p_partkey, ({_RATES!r})[1 + p_partkey % {len(_RATES)}] AS s FROM part),
    u AS (SELECT *, regexp_replace(trim(s), '(?i)/s$', '') AS c FROM t), v AS (SELECT *, regexp_extract(c, '^([0-9.]+)', 1) AS n FROM u),
    w AS (SELECT *, lower(trim(regexp_replace(trim(substr(c, length(n) + 1)), '(?i)b$', ''))) AS un FROM v),
    x AS (SELECT p_partkey, s, CASE WHEN regexp_full_match(n, '([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(n AS DOUBLE) END * CASE un {' '.join(f"WHEN '{k}' THEN {float(v)}" for k, v in units.PREFIXES.items())} END AS r FROM w)
    SELECT p_partkey, s, nullif(CAST(floor(r + 0.5) AS BIGINT), 0) AS bytes_per_second FROM x""",
)
def parse_bandwidth(spark, d):
    arr = F.array(*[F.lit(x) for x in _RATES])
    s = F.get(arr, (F.col("p_partkey") % len(_RATES)).cast("int"))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s", units.parse_bandwidth(F.col("s")).alias("bytes_per_second"))
