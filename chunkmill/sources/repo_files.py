"""A Spark data source over a repository's working tree.

The built-in file source skips names that start with "_" or ".", so package markers would be lost; this one lists every file that
may be indexed. The driver lists the top level alone; a task walks each directory in it. Filters on path and language (equality,
lists, starts of paths) reach the source, which then walks only directories that can hold such paths. Contents are read
afterwards by tasks among which the listed files are dealt evenly, however they lie in the tree.

Options: path, changed (JSON list of relative paths). Column skipped says why a file isn't read: unsupported, too_large, unreadable
or binary; it is null for files to index.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from chunkmill.plans.schema import BINARY_SNIFF_BYTES, FILE, IGNORED_DIRS, LANGUAGES, LISTED, MAX_FILE_BYTES


def ignored(relative: str) -> bool:
    """Whether a directory on the way is never indexed."""
    return any(p in IGNORED_DIRS or p.startswith(".") for p in PurePosixPath(relative).parts[:-1])


def _walked(name: str) -> bool:
    return name not in IGNORED_DIRS and not name.startswith(".")


def walk(root: str, below: str = "", may_hold=lambda folder: True) -> Iterator[str]:
    """Paths relative to root, of files below a folder, pruned by directory; files that start with a dot stay."""
    for folder, folders, names in os.walk(os.path.join(root, below)):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if at == "." else at + "/"
        folders[:] = sorted(d for d in folders if _walked(d) and may_hold(f"{at}{d}/"))
        for name in sorted(names):
            yield at + name


def language_of(path: str) -> str | None:
    name = path.lower()
    return LANGUAGES.get(name[name.rindex(".") :]) if "." in name else None


def list_file(root: str, path: str) -> tuple[str, int | None, str | None, str | None] | None:
    """path, size, language, skipped, without a look inside; None where there is no such file."""
    full, language = os.path.join(root, path), language_of(path)
    if language is None:
        return path, None, None, "unsupported"
    if not os.path.isfile(full):
        return None
    try:
        size = os.path.getsize(full)
    except OSError:
        return path, None, language, "unreadable"
    return path, size, language, "too_large" if size > MAX_FILE_BYTES else None


def read_file(root: str, path: str) -> tuple[str, int | None, bytes | None, str | None] | None:
    """path, size, content, skipped: cheap tests first; None where there is no such file."""
    listed = list_file(root, path)
    if listed is None or listed[3] is not None:
        return listed and (path, listed[1], None, listed[3])
    try:
        with open(os.path.join(root, path), "rb") as source:
            content = source.read()
    except OSError:
        return path, None, None, "unreadable"
    if b"\0" in content[:BINARY_SNIFF_BYTES]:
        return path, listed[1], None, "binary"
    return path, listed[1], content, None


class _Wanted:
    """What pushed filters leave: exact paths, starts of paths, languages."""

    def __init__(self):
        self.paths: set[str] | None = None
        self.starts: list[str] = []
        self.languages: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is one of those that are applied here."""
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if isinstance(f, IsNotNull):
            values = set(LANGUAGES.values())
            return f.attribute == ("path",) or (f.attribute == ("language",) and self._languages(values))
        if f.attribute == ("path",) and values is not None:
            self.paths = values if self.paths is None else self.paths & values
        elif f.attribute == ("path",) and isinstance(f, StringStartsWith):
            self.starts.append(f.value)
        elif f.attribute == ("language",) and values is not None:
            return self._languages(values)
        else:
            return False
        return True

    def _languages(self, values: set[str]) -> bool:
        self.languages = values if self.languages is None else self.languages & values
        return True

    def folder(self, at: str) -> bool:
        """Whether a folder, with "/" at its end, can hold wanted paths."""
        return all(at.startswith(s) or s.startswith(at) for s in self.starts) and (self.paths is None or any(p.startswith(at) for p in self.paths))

    def file(self, path: str) -> bool:
        return all(path.startswith(s) for s in self.starts) and (self.paths is None or path in self.paths) and (self.languages is None or language_of(path) in self.languages)


class _Part(InputPartition):
    """A top-level directory, or paths."""

    def __init__(self, folder: str | None, paths: list[str]):
        self.folder, self.paths = folder, paths


class _Reader(DataSourceReader):
    #: Given paths in a partition.
    EACH = 1000

    def __init__(self, options: dict):
        self.root = options["path"]
        self.changed = json.loads(options["changed"]) if options.get("changed") is not None else None
        self.wanted = _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[InputPartition]:
        if self.changed is not None:
            paths = sorted({p for p in (x.strip() for x in self.changed) if p and not ignored(p) and self.wanted.file(p)})
            return [_Part(None, paths[k : k + self.EACH]) for k in range(0, len(paths), self.EACH)] or [_Part(None, [])]
        try:
            top = sorted(os.scandir(self.root), key=lambda e: e.name)
        except FileNotFoundError:
            top = []
        files = [e.name for e in top if not e.is_dir() and self.wanted.file(e.name)]
        # links to directories aren't followed, as in the directories themselves
        folders = [e.name for e in top if e.is_dir(follow_symlinks=False) and _walked(e.name) and self.wanted.folder(f"{e.name}/")]
        return [_Part(None, files), *(_Part(f, []) for f in folders)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        paths = partition.paths if partition.folder is None else walk(self.root, partition.folder, self.wanted.folder)
        for path in paths:
            row = list_file(self.root, path) if self.wanted.file(path) else None
            if row is not None:
                yield row


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self):
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listed_files(spark: SparkSession, root: str, changed: list[str] | None = None) -> DataFrame:
    """(path, size, language, skipped) of the tree's files, or of the changed ones that are there; contents aren't looked at."""
    spark.dataSource.register(RepoFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("repo_files").option("path", root)
    if changed is not None:
        reader = reader.option("changed", json.dumps(changed))
    return reader.load()


def repo_files(spark: SparkSession, root: str, changed: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(path, size, content, skipped) of the listed files that meet where (on path, size, language, skipped), read in tasks of even size."""
    listed = listed_files(spark, root, changed)
    if where is not None:
        listed = listed.where(where)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        for batch in batches:
            for k in range(0, batch.num_rows, 50):  # a file has at most MAX_FILE_BYTES
                rows = [r for r in (read_file(root, p) for p in batch.column("path").slice(k, 50).to_pylist()) if r is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=FILE.fieldNames())

    dealt = listed.where("skipped is null").select("path").repartition(F.col("path")).mapInArrow(read, FILE)
    left = listed.where("skipped is not null").select("path", "size", F.lit(None).cast("binary").alias("content"), "skipped")
    return dealt.unionByName(left)
