"""A data source that writes one file for each row, at the row's own relative path below a folder."""

from __future__ import annotations

import dataclasses
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclasses.dataclass
class Staged(WriterCommitMessage):
    """What an attempt of a task has written: its folder below the staging folder, and its relative paths."""

    folder: str
    paths: list[str]


def safe(path: str) -> str:
    """A relative path that stays below its folder."""
    clean = posixpath.normpath(path.replace("\\", "/").lstrip("/"))
    if clean == "." or clean.split("/")[0] == "..":
        raise ValueError(f"no path below the folder: {path!r}")
    return clean


class MirrorWriter(DataSourceWriter):
    """Attempts write below a staging folder of their own; only what is committed is moved to its place, so a failed or repeated attempt leaves nothing and overwrites nothing."""

    def __init__(self, folder: str):
        self.folder, self.staging = folder, f".staging-{uuid.uuid4().hex}"

    def files(self):
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        return place, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        place, root = self.files()
        attempt, paths = uuid.uuid4().hex, []
        for row in iterator:
            path = safe(row["path"])
            target = f"{root}/{self.staging}/{attempt}/{path}"
            place.create_dir(posixpath.dirname(target), recursive=True)
            with place.open_output_stream(target) as f:
                f.write((row["text"] or "").encode())
            paths.append(path)
        return Staged(attempt, paths)

    def commit(self, messages: list[Staged]) -> None:
        place, root = self.files()
        for message in messages:
            for path in message.paths if message else []:
                place.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                place.move(f"{root}/{self.staging}/{message.folder}/{path}", f"{root}/{path}")
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        place, root = self.files()
        if place.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            place.delete_dir(f"{root}/{self.staging}")


class Mirror(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirror"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> MirrorWriter:
        return MirrorWriter(self.options["path"])


def write_mirror(texts: DataFrame, folder: str) -> None:
    """Each row's text (path, text) as a file at its path below ``folder``, which driver and executors must share. Files that are there already are replaced; repeated paths are an error."""
    spark: SparkSession = texts.sparkSession
    rows = texts.select("path", "text")
    twice = rows.groupBy("path").count().filter("count > 1 OR path IS NULL").head()
    if twice:
        raise ValueError(f"no file of its own: {twice['path']!r}")
    spark.dataSource.register(Mirror)
    rows.write.format("mirror").mode("append").save(folder)
