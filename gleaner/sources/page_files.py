"""Pages as files: a data source whose tasks write each page to a file of its own, and whose commit puts all of them in place or none."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from gleaner.errors import GleanerError

ABORT_CHECKS = 20


@dataclass
class PagesWritten(WriterCommitMessage):
    pages: int


class PageWriter(DataSourceWriter):
    """Rows (path, value), those of a path next to each other, in one task and in order: their values one after another are the file.

    Tasks write beside the target and rename a page once it is whole, so a task that fails or is run twice leaves no half page. The commit
    renames the folders at the top, a few, however many pages there are; where a folder is there already, ``overwrite`` replaces it
    and ``append`` moves the pages into it. An abort deletes what the tasks have written and leaves the target as it was.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = self._files()
        draft, staged = f"{root}/{self.job}/drafts/{uuid.uuid4().hex}", f"{root}/{self.job}/pages"
        files.create_dir(posixpath.dirname(draft), recursive=True)
        current, out, pages, made = None, None, 0, set()

        def finish() -> None:
            out.close()
            target = f"{staged}/{current}"
            if (folder := posixpath.dirname(target)) not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            files.move(draft, target)

        for path, value in iterator:
            if path != current:
                if out:
                    finish()
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise GleanerError("validation", f"no path of a page: {path!r}")
                current, out, pages = path, files.open_output_stream(draft), pages + 1
            out.write((value or "").encode())
        if out:
            finish()
        return PagesWritten(pages)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._files()
        staged = f"{root}/{self.job}/pages"
        if files.get_file_info(staged).type == fs.FileType.Directory:
            for top in files.get_file_info(fs.FileSelector(staged)):
                self._place(files, top, f"{root}/{top.base_name}")
        self._discard()

    def _place(self, files: fs.FileSystem, new: fs.FileInfo, target: str) -> None:
        there = files.get_file_info(target).type
        if there == fs.FileType.Directory and new.type == fs.FileType.Directory:
            if not self.overwrite:
                for own in files.get_file_info(fs.FileSelector(new.path)):
                    self._place(files, own, f"{target}/{own.base_name}")
                return
            files.delete_dir(target)
        files.move(new.path, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for _ in range(ABORT_CHECKS):  # tasks that are being killed may write for a moment yet
            self._discard()
            time.sleep(0.1)
        self._discard()

    def _discard(self) -> None:
        files, root = self._files()
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class PageFiles(DataSource):
    """``df.write.format("gleaner_pages").mode("overwrite").save(root)`` for rows (path, value); ``root`` is a folder or URI that pyarrow opens on all machines."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_pages"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [(f.name, f.dataType) for f in schema.fields] != [("path", StringType()), ("value", StringType())]:
            raise GleanerError("validation", "pages have the columns path and value")
        return PageWriter(self.options["path"].rstrip("/"), overwrite)


def write_pages(pages: DataFrame, root: str, *order: str, mode: str = "overwrite") -> None:
    """``pages``: path, value and the columns ``order`` of several rows of one page. A page is written by one task, row by row."""
    pages.sparkSession.dataSource.register(PageFiles)
    dealt = pages.where("path IS NOT NULL").repartition("path").sortWithinPartitions("path", *order)
    dealt.select("path", "value").write.format("gleaner_pages").mode(mode).save(root)


def read_pages(spark, root: str, pattern: str = "*/*.md") -> DataFrame:
    """path, relative to ``root``, and value of the files."""
    files = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True)
    depth = pattern.count("/") + 1
    return files.selectExpr(f"substring_index(_metadata.file_path, '/', -{depth}) AS path", "value")
