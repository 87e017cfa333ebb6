"""A store of reference tables: Parquet folders listed by versioned manifests.

A table's state is its newest manifest, a small file <root>/<table>/manifests/<number>.json that lists folders of Parquet files. An import writes a new
folder first and then a manifest with the next number, by a rename that fails if that number is there already. So an import is seen whole
or not at all: a task that is lost is run again, a driver that is lost leaves a folder that no manifest lists, and of two imports at once the second
looks at the first one's state and tries again. Versions stay readable; vacuum() removes what no manifest of the kept versions lists.

The root must be a folder that driver and executors share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another import took the version meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str, tries: int = 5) -> None:
        self.spark, self.root, self.tries = spark, root.rstrip("/"), tries
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self, table: str) -> list[int]:
        """Numbers of a table's manifests, in order."""
        at = self._path(f"{table}/manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, table: str, version: int | None = None) -> dict:
        """The newest state, or that of a version: {"version", "folders", "rows"}."""
        known = self.versions(table)
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "folders": [], "rows": 0}
        line = self.spark.read.option("wholetext", True).text(f"{self.root}/{table}/manifests/{version:012d}.json").first()
        return json.loads(line.value)

    def _commit(self, table: str, state: dict) -> None:
        name = f"{table}/manifests/{state['version']:012d}.json"
        waiting = self._path(f"{table}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(waiting, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._path(name)
        # A rename onto a file that is there fails on shared file systems; on a local one it is looked up first.
        if self._fs.exists(target) or not self._fs.rename(waiting, target):
            self._fs.delete(waiting, False)
            raise Conflict(name)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table's newest or given version."""
        folders = self.manifest(table, version)["folders"]
        if not folders:
            raise LookupError(f"{table} is empty")
        return self.spark.read.parquet(*(f"{self.root}/{table}/{f}" for f in folders))

    def insert(self, table: str, rows: DataFrame, *keys: str, partition: str | None = None) -> int:
        """Insert rows whose keys the table does not have yet, of equal keys in `rows` the first in order of all columns; returns how many. Rows with a
        null among the keys are left out. The whole import is one new version."""
        rest = [c for c in rows.columns if c not in keys]
        known = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
        one = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else known.select(*keys).distinct()
        for _ in range(self.tries):
            state = self.manifest(table)
            new = one.join(self.read(table).select(*keys), list(keys), "left_anti") if state["folders"] else one
            folder = f"data-{uuid.uuid4().hex}"
            writer = new.select(*rows.columns).write
            (writer.partitionBy(partition) if partition else writer).parquet(f"{self.root}/{table}/{folder}")
            count = self.spark.read.parquet(f"{self.root}/{table}/{folder}").count()
            try:
                self._commit(table, {"version": state["version"] + 1, "folders": [*state["folders"], folder], "rows": state["rows"] + count})
                return count
            except Conflict:
                self._fs.delete(self._path(f"{table}/{folder}"), True)
        raise Conflict(f"{table}: {self.tries} tries")

    def compact(self, table: str) -> None:
        """All folders of a table as one, as a new version."""
        state = self.manifest(table)
        folder = f"data-{uuid.uuid4().hex}"
        self.read(table).write.parquet(f"{self.root}/{table}/{folder}")
        self._commit(table, {"version": state["version"] + 1, "folders": [folder], "rows": state["rows"]})

    def vacuum(self, table: str, keep: int = 1) -> int:
        """Remove older versions than the newest `keep`, and folders that none of those lists; returns how many folders. No import may be under way."""
        known = self.versions(table)
        kept = {f for v in known[-keep:] for f in self.manifest(table, v)["folders"]}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{table}/manifests/{v:012d}.json"), False)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(table)) if s.getPath().getName().startswith("data-")]
        gone = [f for f in found if f not in kept]
        for f in gone:
            self._fs.delete(self._path(f"{table}/{f}"), True)
        return len(gone)

    def assembly(self, sample: str) -> dict | None:
        """The record of a sample in the table of assemblies."""
        if not self.versions("assemblies"):
            return None
        row = self.read("assemblies").where(F.col("sample_name") == sample).first()
        return row.asDict() if row else None
