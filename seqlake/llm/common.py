"""What the operators share on the Spark side: the shared folder, cut lineage, size-checked broadcasts, code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels

#: Bytes of a batch that goes to Python at once, unless the session sets its own: what an executor holds twice for each task.
BATCH_BYTES = 2 << 20
#: A side is broadcast only if its written size is at most this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        kept = sc._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqlake-")
        sc.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers whatever their PYTHONPATH."""
    sc, key = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (str(64 << 20), f"{64 << 20}b", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))
    if getattr(sc, "_seqlake_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="seqlake-code-")), f"{top.name}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(to)
    sc._seqlake_shipped = True


#: Parquet's row groups of tables of long binary values: a reader holds the values of a group, whatever their number.
BLOB_GROUP = 1 << 20


def cut(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, a lost executor loses nothing. group: bytes of a row group."""
    spark = df.sparkSession
    to = scratch(spark, name)
    (df.write.option("parquet.block.size", group) if group else df.write).parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it any more."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            remove_path(df.sparkSession, f.rsplit("/", 1)[0])


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that cut() wrote."""
    spark = df.sparkSession
    jvm, total = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = df.inputFiles()
    if files:
        p = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        total = p.getFileSystem(conf).getContentSummary(p).getLength()
    return int(total)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its size was checked to be within the limit, else as it is."""
    return F.broadcast(df) if written_bytes(df) <= limit else df


def arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches, the package shipped first."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        kernels.give_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
