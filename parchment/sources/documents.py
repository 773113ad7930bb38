"""A data source of the documents in a folder and its archives: `spark.read.format("documents").load(folder)`.

Partitions are planned from names alone: those of files, and the members that archives list at their end. A
filter on `name` (=, IN) is pushed down, so that of what is not chosen no byte is read; of an archive only the
chosen members are. `option("content", "false")` gives names without content and reads none.

Paths are those that Arrow's file systems know; `files.directory` reads any that Spark knows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from . import files

#: What a partition reads at most, if no document is larger.
PART = 64 << 20


class _Counted:
    """An open file that counts the bytes read from it."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(None if size is None or size < 0 else size)
        self.n += len(data)
        return data

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as e:  # before the beginning; other files say so by an OSError
            raise OSError(str(e)) from e

    def __getattr__(self, name: str):
        return getattr(self.file, name)


@dataclass
class _Part(InputPartition):
    entries: list[tuple[str, str, str | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                names = set(f.value)
            else:
                yield f
                continue
            self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[_Part]:
        there, base = fs.FileSystem.from_uri(self.folder)
        listed = sorted((x for x in there.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File), key=lambda x: x.base_name)
        found = {x.base_name: (x.path, None, x.size) for x in listed if x.extension.lower() in files.PRIORITY}
        for x in (x for x in listed if x.extension.lower() == "zip"):
            with there.open_input_file(x.path) as archive:
                for name, member in files.members(_Counted(archive), x.base_name):
                    found.setdefault(name, (x.path, member, x.size))
        parts, size = [_Part([])], 0
        for name, (path, member, n) in sorted(found.items(), key=lambda x: (x[1][0], x[0])):
            if self.wanted is None or name in self.wanted:
                if size and size + n > PART:
                    parts.append(_Part([]))
                    size = 0
                parts[-1].entries.append((name, path, member))
                size += n
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        there, _ = fs.FileSystem.from_uri(self.folder)
        for name, path, member in partition.entries:
            if not self.content:
                yield name, path, member, 0, None
                continue
            with there.open_input_file(path) as f:
                counted = _Counted(f)
                if member is None:
                    content = counted.read()
                else:
                    try:
                        with zipfile.ZipFile(counted) as z:
                            content = z.read(member)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                        content = b""  # the parser tells why there is no text
            yield name, path, member, counted.n, content


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, path string, member string, bytes_read long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
