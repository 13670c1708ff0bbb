"""``oxbow_entries``: archives below a folder as a table of entries.

One partition per archive; the format is found by name and signature, streams are
decoded first.  A damaged archive gives its entries before the damage and an error row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from oxbow.functions.names import FORMATS
from oxbow.sources.codecs import DECODERS, StreamError
from oxbow.sources.containers import PARSERS, ArchiveError, Member, members

_SCHEMA = "source_id string, container string, entry_idx long, path string, type string, size long, method string, sha256 string, content binary, error string"


def detect(name: str, head: bytes) -> str | None:
    """The format by the longest matching signature, else by the longest suffix."""
    magics = [(len(m), f.name) for f in FORMATS for o, m in f.magics if head[o : o + len(m) // 2].hex().upper() == m]
    suffixes = [(len(s), f.name) for f in FORMATS for s in f.suffixes if name.lower().endswith(s)]
    return max(magics or suffixes, default=(0, None))[1]


@dataclass
class ArchivePartition(InputPartition):
    path: str


class EntriesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _filesystem(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[ArchivePartition]:
        fs, root = self._filesystem()
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [ArchivePartition(p) for p in files] or [ArchivePartition("")]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = self._filesystem()
        with fs.open_input_file(partition.path) as f:
            data = f.read()
        kind = detect(partition.path, data[:300])
        try:
            if kind in DECODERS:
                data = DECODERS[kind](data)
                kind = detect("", data[:300])
            if kind not in PARSERS:
                raise ArchiveError("no decoder")
            for k, m in enumerate(members(kind, data)):
                yield self._row(partition.path, kind, k, m)
        except (ArchiveError, StreamError) as e:
            yield self._row(partition.path, kind, -1, Member("", "error", error=str(e)))

    @staticmethod
    def _row(source: str, kind: str | None, k: int, m: Member) -> tuple:
        digest = None if m.content is None else hashlib.sha256(m.content).hexdigest()
        return (source, kind, k, m.path, m.type, m.size, m.method, digest, m.content, m.error)


class EntriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oxbow_entries"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> EntriesReader:
        return EntriesReader(self.options["path"])


def read_archives(spark, path: str):
    spark.dataSource.register(EntriesSource)
    return spark.read.format("oxbow_entries").load(path)


