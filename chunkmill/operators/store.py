"""Chunk and registry tables that are merged when they are read.

A part of a table (a repository's chunks, or the registry) lies in <root>/<table>/repo_id=<part>. Its data are immutable Parquet
folders: a base, and deltas that hold new rows and, as a deletion vector, the paths that they replace. Manifest n lists the
folders that make version n. A version counts once its manifest has its name, which only one writer can give (an atomic link or
rename that fails where the name is taken): a writer that loses lists its folders after the winner's and tries again, and a
reader sees a whole version or the one before. A delta costs what it holds, not what the part holds; compact() folds deltas
into a new base, and vacuum() deletes what no recent version lists, so readers of a running job keep their files.

The name is given by a hard link on a local file system and by rename elsewhere, which must fail on existing files (HDFS does).
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chunkmill.plans.schema import POINT, REGISTRY
from chunkmill.sources.files import Files


def delete_by_paths(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of other paths than the changed ones (repo_id, path)."""
    return chunks.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """A row for each key, that with the largest batch number where there are such."""
    order = F.col("batch").desc() if "batch" in rows.columns else F.lit(0)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n", "batch")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old and new; of equal keys the newest, and within new the one with the largest batch number, if it has one."""
    new = latest(new, key)
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def incremental(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The table after the changed paths were read again: their old chunks go, whether or not new ones came."""
    return upsert(delete_by_paths(old, changed), new)


class Snapshots(Protocol):
    """What the facade needs of a chunk or registry table; one that also has merge() gets deltas, others whole repositories."""

    def repos(self) -> list[str]: ...
    def read(self, repo_id: str) -> DataFrame: ...
    def read_all(self) -> DataFrame: ...
    def replace(self, repo_id: str, rows: DataFrame) -> int: ...
    def reachable(self) -> bool: ...


class Conflict(RuntimeError):
    """Other writers were faster every time."""


class Table:
    #: Deltas of a part beyond which a merge folds them, and tries of a commit.
    MOST_DELTAS, TRIES = 16, 100

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, key: str = "id", by: str | None = "path", options: dict[str, str] | None = None):
        """key names rows, of which the newest counts; by is the column of the deletion vectors."""
        self.spark, self.home, self.schema, self.files = spark, root, schema, Files(spark)
        self.root, self.key, self.by, self.options = f"{root.rstrip('/')}/{name}", key, by, options or {}

    def reachable(self) -> bool:
        return self.files.exists(self.home)

    def _at(self, part: str, *below: str) -> str:
        return "/".join([f"{self.root}/repo_id={part}", *below])

    # Versions

    def versions(self, part: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self._at(part, "manifests")) if n.endswith(".json") and n[0].isdigit())

    def version(self, part: str) -> int:
        """The latest version, 0 where there is none."""
        return max(self.versions(part), default=0)

    def manifest(self, part: str, version: int | None = None) -> dict:
        """Of a version: entries {seq, data, gone}, oldest first, where seq is the version that wrote the rows and data and gone are folders; and the last batch of each stream that it holds."""
        version = self.version(part) if version is None else version
        return json.loads(self.files.read(self._at(part, "manifests", f"{version:012d}.json"))) if version else {"entries": [], "batches": {}}

    def entries(self, part: str, version: int | None = None) -> list[dict]:
        return self.manifest(part, version)["entries"]

    def holds(self, part: str, batch: tuple[str, int]) -> bool:
        """Whether a batch (stream, number) of a stream has been merged."""
        return self.manifest(part)["batches"].get(batch[0], -1) >= batch[1]

    def _commit(self, part: str, change: Callable[[list[dict], int], list[dict] | None], batch: tuple[str, int] | None = None) -> int:
        """Give the next version's name to what change(entries, version) makes of the latest entries; it is asked again after a lost race.

        None: nothing is to be done. Nor is where the version holds the batch already, which is noted in the same manifest as its entry.
        """
        for _ in range(self.TRIES):
            latest = self.version(part)
            told = self.manifest(part, latest)
            entries = change(told["entries"], latest + 1)
            if entries is None or (batch and told["batches"].get(batch[0], -1) >= batch[1]):
                return latest
            batches = told["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self.files.publish(self._at(part, "manifests", f"{latest + 1:012d}.json"), json.dumps({"entries": entries, "batches": batches})):
                return latest + 1
            time.sleep(random.uniform(0, 0.05))
        raise Conflict(f"{self.root}: no version of {part} could be committed")

    # Reading

    def repos(self) -> list[str]:
        found = [n.removeprefix("repo_id=") for n in self.files.names(self.root) if n.startswith("repo_id=")]
        return sorted(r for r in found if self.version(r))

    def read(self, part: str, version: int | None = None) -> DataFrame:
        """A version's rows, the latest one's without a number; none where there is none."""
        return self._merged(part, self.entries(part, version))

    def read_all(self) -> DataFrame:
        out = self._none()
        for part in self.repos():
            out = out.unionByName(self.read(part))
        return out

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _merged(self, part: str, entries: list[dict]) -> DataFrame:
        """Rows of all folders without those that a later one replaces, by path or by key. What is joined is of the size of the deltas."""
        found = lambda e: self.spark.read.schema(self.schema).parquet(self._at(part, e["data"])) if e["data"] else self._none()
        load = lambda e: found(e).withColumn("_seq", F.lit(e["seq"]))
        frames = [load(e) for e in entries]
        if not frames:
            return self._none()
        if len(frames) == 1:
            return frames[0].drop("_seq")
        rows = frames[0]
        for more in frames[1:]:
            rows = rows.unionByName(more)
        newer = lambda some, name, to: some.groupBy(name).agg(F.max("_seq").alias(to))
        keys = frames[1].select(self.key, "_seq")
        for more in frames[2:]:
            keys = keys.unionByName(more.select(self.key, "_seq"))
        rows = rows.join(newer(keys, self.key, "_key_seq"), self.key, "left").where("_seq >= coalesce(_key_seq, 0)")
        gone = [self.spark.read.parquet(self._at(part, e["gone"])).withColumn("_seq", F.lit(e["seq"])) for e in entries[1:] if e["gone"]]
        if gone:
            paths = gone[0]
            for more in gone[1:]:
                paths = paths.unionByName(more)
            rows = rows.join(newer(paths, self.by, "_path_seq"), self.by, "left").where("_seq >= coalesce(_path_seq, 0)")
        return rows.select(*self.schema.fieldNames())

    # Writing

    def _write(self, part: str, rows: DataFrame, kind: str = "data") -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.options(**self.options).parquet(self._at(part, name))
        return name

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])

    def replace(self, part: str, rows: DataFrame) -> int:
        """A new base: all rows that were there go."""
        data = self._write(part, self._shaped(rows))
        return self._commit(part, lambda _, n: [{"seq": n, "data": data, "gone": None}])

    def merge(self, part: str, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Add rows in place of those with equal keys and of those whose path is in gone (a column named as by); both are written as they are, and nothing else is."""
        data = self._write(part, self._shaped(latest(rows, self.key)))
        paths = None if gone is None else self._write(part, gone.select(self.by).distinct(), "gone")
        version = self._commit(part, lambda entries, n: [*entries, {"seq": n, "data": data, "gone": paths}])
        if len(self.entries(part, version)) > self.MOST_DELTAS:
            return self.compact(part)
        return version

    def merge_parts(self, rows: DataFrame, gone: DataFrame, batch: tuple[str, int] | None = None) -> list[str]:
        """merge() for many parts at once, which the column repo_id names: one job writes all rows and one all paths, then each part's version is committed. The parts that changed.

        A batch of a stream that comes again changes nothing: a part that holds it is passed over.
        """
        parts = [r[0] for r in gone.select("repo_id").distinct().collect()]  # repositories, not paths
        parts = sorted(p for p in parts if not (batch and self.holds(p, batch)))
        if not parts:
            return []
        folder, own = f"batch-{uuid.uuid4().hex}", F.col("repo_id").isin(parts)
        write = lambda df, name: df.write.partitionBy("_part").options(**self.options).parquet(f"{self.root}/_batches/{folder}/{name}")
        write(self._shaped(latest(rows.where(own), self.key)).withColumn("_part", F.col("repo_id")), "data")
        write(gone.where(own).select(F.col("repo_id").alias("_part"), self.by).distinct(), "gone")
        filled = {n.removeprefix("_part=") for n in self.files.names(f"{self.root}/_batches/{folder}/data")}
        for part in parts:
            at = lambda name, part=part: f"../_batches/{folder}/{name}/_part={part}"
            data = at("data") if part in filled else None
            self._commit(part, lambda entries, n, at=at, data=data: [*entries, {"seq": n, "data": data, "gone": at("gone")}], batch)
            if len(self.entries(part)) > self.MOST_DELTAS:
                self.compact(part)
        return parts

    def compact(self, part: str) -> int:
        """Fold what the latest version lists into one folder. Deltas that arrive meanwhile stay behind it; after a new base there is nothing to do."""
        old = self.entries(part)
        if len(old) < 2:
            return self.version(part)
        data = self._write(part, self._merged(part, old))
        folded = {"seq": old[-1]["seq"], "data": data, "gone": None}
        return self._commit(part, lambda entries, _: [folded, *entries[len(old) :]] if entries[: len(old)] == old else None)

    def vacuum(self, part: str, older_than: float = 7 * 86400.0) -> int:
        """Delete versions but the latest, and folders that no remaining version lists, that are older than so many seconds; how many went."""
        now, latest_version, went = time.time(), self.version(part), 0
        for name, changed in self.files.changed(self._at(part, "manifests")):
            if name != f"{latest_version:012d}.json" and now - changed > older_than:
                self.files.delete(self._at(part, "manifests", name))
                went += 1
        listed = {e[k] for v in self.versions(part) for e in self.entries(part, v) for k in ("data", "gone")}
        for folder, changed in self.files.changed(f"{self.root}/_batches"):
            for kind in ("data", "gone"):
                name = f"../_batches/{folder}/{kind}/_part={part}"
                if name not in listed and now - changed > older_than and self.files.exists(self._at(part, name)):
                    self.files.delete(self._at(part, name))
                    went += 1
        for name, changed in self.files.changed(self._at(part)):
            if name.startswith(("data-", "gone-")) and name not in listed and now - changed > older_than:
                self.files.delete(self._at(part, name))
                went += 1
        return went


def merge_into(table: Snapshots, repo_id: str, rows: DataFrame, gone: DataFrame) -> int:
    """A delta where the table takes them, else the whole repository anew."""
    return table.merge(repo_id, rows, gone) if hasattr(table, "merge") else table.replace(repo_id, incremental(table.read(repo_id), rows, gone))


class Registry:
    """A row for each repository in one table, found by a filter that reaches the Parquet files and their Bloom filters."""

    PART = "registry"

    def __init__(self, spark: SparkSession, root: str):
        self.table = Table(spark, root, "registry", REGISTRY, key="repo_id", by=None, options={"parquet.bloom.filter.enabled#repo_id": "true"})

    def reachable(self) -> bool:
        return self.table.reachable()

    def repos(self) -> list[str]:
        return [r[0] for r in self.read_all().select("repo_id").orderBy("repo_id").collect()]

    def read(self, repo_id: str) -> DataFrame:
        return self.read_all().where(F.col("repo_id") == repo_id)

    def read_all(self) -> DataFrame:
        return self.table.read(self.PART)

    def put(self, rows: DataFrame) -> int:
        """Rows of any repositories, in place of those they had."""
        return self.table.merge(self.PART, rows)

    def replace(self, repo_id: str, rows: DataFrame) -> int:
        return self.put(rows)


def chunk_table(spark: SparkSession, root: str) -> Table:
    return Table(spark, root, "chunks", POINT)


def registry_table(spark: SparkSession, root: str) -> Registry:
    return Registry(spark, root)
