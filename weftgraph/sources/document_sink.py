"""Texts of lines into files of given names: a Python data source that writes, and a step that gives the files their places.

Tasks write below a staging folder, each attempt into one of its own, and say which. Only
what committed tasks have written is moved into place, by tasks again; then the staging
folder goes. A task or a job that fails leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_FORMAT = "weftgraph_files"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> _Written:
        """Rows (file, text), those of one file together and in order; a file is open at a time."""
        store, top = _place(self.path)
        folder, name, out, count = f"{top}/{uuid.uuid4().hex}", None, None, 0
        try:
            for file, text in rows:
                if file != name:
                    if out is not None:
                        out.close()
                    target = f"{folder}/{file}"
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    name, out, count = file, store.open_output_stream(target), count + 1
                out.write(text.encode("utf-8", "surrogatepass"))
        except BaseException:
            if count:
                store.delete_dir(folder)
            raise
        finally:
            if out is not None:
                out.close()
        return _Written(folder.rsplit("/", 1)[1] if count else "", count)

    def commit(self, messages: list) -> None:
        """A list of the folders, one for each task that wrote, beside them."""
        store, top = _place(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/committed.txt") as out:
            out.write("\n".join(m.folder for m in messages if m is not None and m.folder).encode())

    def abort(self, messages: list) -> None:
        store, top = _place(self.path)
        if store.get_file_info(top).type != fs.FileType.NotFound:
            store.delete_dir(top)


class FilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def _moved(staging: str, path: str):
    """(folder) to (file): each file of a folder moves to its name below the path, in place of one that is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, top), (_, end) = _place(staging), _place(path)
        for batch in batches:
            names = []
            for folder in batch.column(0).to_pylist():
                for info in store.get_file_info(fs.FileSelector(f"{top}/{folder}", recursive=True)):
                    name = info.path.split(f"/{folder}/", 1)[1]
                    if info.type == fs.FileType.File:
                        store.create_dir(f"{end}/{name}".rsplit("/", 1)[0], recursive=True)
                        store.move(info.path, f"{end}/{name}")
                        names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    return run


def write_files(lines: DataFrame, path: str) -> int:
    """Write lines(file, place, text): each file's texts end to end, in the order of place; the number of files.

    All lines of a file go through one task, sorted and written as they come. The path is
    one that all executors share.
    """
    spark = lines.sparkSession
    spark.dataSource.register(FilesDataSource)
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    dealt = lines.repartition("file").sortWithinPartitions("file", "place").select("file", "text")
    dealt.write.format(_FORMAT).mode("append").option("path", staging).save()
    folders = spark.read.text(f"{staging}/committed.txt").where("value <> ''")
    try:
        moved = folders.repartition(max(1, folders.count()), F.col("value")).mapInArrow(_moved(staging, path), "file string")
        return moved.agg(F.count("*")).first()[0]
    finally:
        store, top = _place(staging)
        store.delete_dir(top)
