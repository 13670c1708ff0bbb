"""Archive names: formats by suffix and magic, volumes, output names, safe paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TREE, STREAM = "tree", "stream"


@dataclass(frozen=True)
class Format:
    name: str
    shape: str
    suffixes: tuple[str, ...]
    magics: tuple[tuple[int, str], ...]  # offset, hex


# The formats, their suffixes and signatures.
FORMATS = [
    Format("zstd", STREAM, (".zst", ".zstd", ".tar.zst", ".tar.zstd"), ((0, "28B52FFD"),)),
    Format("tar", TREE, (".tar",), ((257, "757374617200"), (257, "7573746172202000"))),
    Format("xz", STREAM, (".xz", ".tar.xz"), ((0, "FD377A585A00"),)),
    Format("lz4", STREAM, (".lz4", ".tar.lz4"), ((0, "04224D18"),)),
    Format("gzip", STREAM, (".gz", ".tar.gz"), ((0, "1F8B"),)),
    Format("bzip2", STREAM, (".bz2", ".tar.bz2", ".tbz2", ".tbz"), ((0, "425A68"),)),
    Format("zip", TREE, (".zip",), ((0, "504B0304"), (0, "504B0506"))),
    Format("7z", TREE, (".7z", ".tar.7z"), ((0, "377ABCAF271C"),)),
    Format("rar", TREE, (".rar",), ((0, "526172211A070100"), (0, "526172211A0700"))),
]

# Extensions that an output name loses.
STRIPPABLE = ["tar", "tgz", "tzst", "txz", "tlz4", "tbz2", "tbz", "gz", "zst", "zstd", "xz", "lz4", "bz2", "zip", "7z", "rar"]


class Registry:
    """Formats known to an engine; users may add their own."""

    def __init__(self, formats: list[Format] | None = None):
        self.formats = list(FORMATS if formats is None else formats)

    def register(self, fmt: Format) -> None:
        self.formats.append(fmt)

    def by_suffix(self, name: Column) -> Column:
        """The format with the longest suffix of the name, in any case."""
        low, out = F.lower(name), F.lit(None).cast("string")
        for suffix, fmt in sorted(((s, f.name) for f in self.formats for s in f.suffixes), key=lambda x: len(x[0])):
            out = F.when(low.endswith(suffix), fmt).otherwise(out)
        return out

    def by_magic(self, head: Column) -> Column:
        """The format with the longest signature at its place in the first bytes."""
        out = F.lit(None).cast("string")
        for offset, magic, fmt in sorted(((o, m, f.name) for f in self.formats for o, m in f.magics), key=lambda x: len(x[1])):
            out = F.when(F.hex(F.substring(head, offset + 1, len(magic) // 2)) == magic, fmt).otherwise(out)
        return out

    def by_name(self, name: Column) -> Column:
        low, out = F.lower(name), F.lit(None).cast("string")
        for f in self.formats:
            out = F.when(low == f.name, f.name).otherwise(out)
        return out

    def shape(self, fmt: Column) -> Column:
        out = F.lit(None).cast("string")
        for f in self.formats:
            out = F.when(fmt == f.name, f.shape).otherwise(out)
        return out

    def window(self) -> int:
        """Bytes that detection by signature needs."""
        return max(o + len(m) // 2 for f in self.formats for o, m in f.magics)

    def resolve(self, name: Column, head: Column, forced: Column | None = None, force_magic: bool = False) -> Column:
        """struct(format, error): a forced name, else suffix and signature, which must not disagree."""
        wanted = F.lit(None).cast("string") if forced is None else forced
        named, s, m = self.by_name(wanted), self.by_suffix(name), self.by_magic(head)
        conflict = s.isNotNull() & m.isNotNull() & (s != m) & F.lit(not force_magic)
        error = F.when(wanted.isNotNull(), F.when(named.isNull(), "unknown format")).when(conflict, "conflict").when(s.isNull() & m.isNull(), "no decoder")
        return F.struct(F.when(error.isNull(), F.coalesce(named, m, s)).alias("format"), error.alias("error"))


# Volume conventions: kind, pattern of (base, number), whether the number is given.
_VOLUMES = [("rar5", r"(?i)^(.+)\.part([0-9]{1,9})\.rar$"), ("7z", r"(?i)^(.+)\.7z\.([0-9]{1,9})$"), ("zip", r"(?i)^(.+)\.z([0-9]{1,9})$")]
_ZIP_LAST = r"(?i)^(.+)\.zip$"


def parse_volume(name: Column) -> Column:
    """struct(base, kind, volume, width) of a volume's file name; nulls for other names."""
    base, kind, number = (F.lit(None).cast("string") for _ in range(3))
    base, kind = F.when(name.rlike(_ZIP_LAST), F.regexp_extract(name, _ZIP_LAST, 1)).otherwise(base), F.when(name.rlike(_ZIP_LAST), "zip").otherwise(kind)
    for k, pattern in reversed(_VOLUMES):
        hit = name.rlike(pattern)
        base = F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(base)
        number = F.when(hit, F.regexp_extract(name, pattern, 2)).otherwise(number)
        kind = F.when(hit, k).otherwise(kind)
    width = F.when(kind.isNotNull(), F.coalesce(F.length(number), F.lit(0)))
    return F.struct(base.alias("base"), kind.alias("kind"), number.try_cast("long").alias("volume"), width.cast("long").alias("width"))


def format_volume(base: Column, kind: Column, volume: Column, width: Column) -> Column:
    number = volume.cast("string")
    number = F.when(F.length(number) < width, F.lpad(number, width.cast("int"), F.lit("0"))).otherwise(number)
    return (
        F.when(kind == "rar5", F.concat(base, F.lit(".part"), number, F.lit(".rar")))
        .when(kind == "7z", F.concat(base, F.lit(".7z."), number))
        .when((kind == "zip") & volume.isNotNull(), F.concat(base, F.lit(".z"), number))
        .when(kind == "zip", F.concat(base, F.lit(".zip")))
    )


def strip_part(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.part[0-9]+$", "")


def output_name(name: Column) -> Column:
    """A folder name for an archive: no volume or part suffix, no archive extensions."""
    first = F.coalesce(parse_volume(name)["base"], strip_part(name))
    bare = F.regexp_replace(first, r"(?i)^(.+?)(?:\.(?:" + "|".join(STRIPPABLE) + r"))+$", "$1")
    return F.when(bare != "", bare)


_DOS = r"(?i)^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])(\.|$)"


def unsafe_reason(component: Column) -> Column:
    """Why a path component is refused, by the first rule in order; null if it is fine."""
    special = F.regexp_extract(component, r'([<>:"|?*\x00-\x1F])', 1)
    return (
        F.when(component.contains("\\"), "backslash")
        .when(special.rlike(r'^[<>:"|?*]'), "reserved")
        .when(special != "", "control")
        .when(component.rlike(r"[. ]$"), "trailing")
        .when(component.rlike(_DOS), "device")
    )


def _components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))


def safe_path(path: Column, kind: str = "tar") -> Column:
    """struct(code, reason, clean, is_dir) of an entry path under a container's rules.

    ``tar`` allows an entry that names the root and checks components for portability;
    ``zip`` and ``rar`` refuse paths without components; ``7z`` also splits at
    backslashes and refuses drive letters.  ``code`` is ok, escape or unsafe.
    """
    logical = F.regexp_replace(path, r"/$", "") if kind in ("zip", "rar") else path
    if kind == "7z":
        logical = F.regexp_replace(logical, r"\\", "/")
    parts = _components(logical)
    escape = (logical == "") | logical.contains("\0") | logical.startswith("/") | F.exists(parts, lambda c: c == "..")
    if kind != "tar":
        escape = escape | (F.size(parts) == 0)
    if kind == "7z":
        escape = escape | logical.rlike(r"^[A-Za-z]:") | F.exists(F.split(logical, "/"), lambda c: c == "")
    reason = F.lit(None).cast("string")
    if kind == "tar":
        reason = F.get(F.filter(F.transform(parts, unsafe_reason), lambda r: r.isNotNull()), F.lit(0))
    code = F.when(escape, "escape").when(reason.isNotNull(), "unsafe").otherwise("ok")
    return F.struct(
        code.alias("code"),
        F.when(~escape, reason).alias("reason"),
        F.when(code == "ok", F.array_join(parts, "/")).alias("clean"),
        path.endswith("/").alias("is_dir"),
    )
