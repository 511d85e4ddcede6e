"""YAML documents as a data source for batches and streams: spark.read.format("weftgraph_yaml"), after `register`.

Options: path, a .yaml file or a folder whose *.yaml files are read at any depth; strict,
whether an empty document is an error (true); partitionBytes, what a task reads at most,
unless a single file is larger (2 MiB: parsing takes about a second a MB); for a stream, log, a folder that keeps which
files belong to which offset.

Rows are those of `yaml_source.SPEC`: one for each top-level schema, or one with the
document's header and no schema, or one with an error for a document that cannot be read.
An empty folder gives none. A path that is not there is an error, as is one that is
neither folder nor .yaml. A document goes by the name of its file; in a batch, where
several files have that name, by its path.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .yaml_source import SPEC, decoded

FORMAT = "weftgraph_yaml"
_NAMES = [x.strip().split(" ")[0] for x in SPEC.split(",")]


@dataclass
class _Files(InputPartition):
    """(path in its store, whether its path is its name) of the files of one task."""

    files: list[tuple[str, bool]]


def _store(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path, the path in it, and what stands before such paths in rows."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    scheme, rest = uri.split("://", 1)
    return store, path, "file:" if scheme == "file" else f"{scheme}://{rest.split('/', 1)[0]}/" if not path.startswith("/") else f"{scheme}://{rest.split('/', 1)[0]}"


def _listed(store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the documents of a path, in order."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} does not exist")
    if info.type == fs.FileType.File:
        if not path.endswith(".yaml"):
            raise ValueError(f"{path} is neither a .yaml file nor a folder")
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".yaml"))


def _packed(files: list[tuple[str, int]], most: int, shared: set[str]) -> list[_Files]:
    """Files in order, in partitions of at most so many bytes, or of a single file."""
    out: list[_Files] = []
    held = 0
    for path, size in files:
        if not out or held + size > most:
            out.append(_Files([]))
            held = 0
        out[-1].files.append((path, path.rsplit("/", 1)[-1] in shared))
        held += size
    return out


class _Rows:
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("the format needs a path")
        self.uri = options["path"]
        self.strict = options.get("strict", "true").lower() != "false"
        self.most = int(options.get("partitionBytes", 2 << 20))

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        """A file is held at a time. Without any file, Spark reads a partition that is None."""
        store, _, before = _store(self.uri)
        for path, whole in partition.files if partition else ():
            with store.open_input_stream(path) as f:
                content = f.read()
            for row in decoded(before + path, content, self.strict, whole):
                yield tuple(row.get(n) for n in _NAMES)


class _Batch(_Rows, DataSourceReader):
    def partitions(self) -> list[_Files]:
        store, path, _ = _store(self.uri)
        files = _listed(store, path)
        count = Counter(p.rsplit("/", 1)[-1] for p, _ in files)
        return _packed(files, self.most, {n for n, k in count.items() if k > 1})


class _Stream(_Rows, DataSourceStreamReader):
    """Offset n stands for the files of the log's entries 1 to n.

    An entry is written before its offset is given out and never changed, so a batch that
    runs again reads the same files, and a query that starts again goes on behind its last
    one. A file is read once, by its path; what is written over it later is not seen.
    """

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        if not options.get("log"):
            raise ValueError("a stream needs a folder for its log")
        self.log = options["log"]
        self.seen: set[str] | None = None
        self.last = 0

    def _entry(self, number: int) -> str:
        return f"{_store(self.log)[1].rstrip('/')}/{number:09d}.json"

    def _read(self, number: int) -> list[tuple[str, int]]:
        with _store(self.log)[0].open_input_stream(self._entry(number)) as f:
            return [(p, n) for p, n in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        log, folder, _ = _store(self.log)
        if self.seen is None:
            log.create_dir(folder, recursive=True)
            written = [f.base_name for f in log.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".json")]
            self.last = max((int(n.removesuffix(".json")) for n in written), default=0)
            self.seen = {p for i in range(1, self.last + 1) for p, _ in self._read(i)}
        store, path, _ = _store(self.uri)
        new = [(p, n) for p, n in _listed(store, path) if p not in self.seen]
        if new:
            target = self._entry(self.last + 1)
            with log.open_output_stream(target + ".part") as f:
                f.write(json.dumps(new).encode())
            log.move(target + ".part", target)
            self.seen.update(p for p, _ in new)
            self.last += 1
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return _packed([f for i in range(start["entry"] + 1, end["entry"] + 1) for f in self._read(i)], self.most, set())

    def commit(self, end: dict) -> None:
        """Entries stay: they say which files have been read."""


class YamlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SPEC

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(YamlDataSource)
