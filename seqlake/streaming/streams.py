"""Structured Streaming forms of the batch operators. Files are read as they come; `available` runs until all that is there is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import qc


def read(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of a Parquet table's files, a bounded number in each batch: the source's backpressure."""
    # A pattern that only this path matches: the source then takes a single file as well as a folder.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def quality(stream: DataFrame, preset: str = "standard") -> DataFrame:
    """The cascade is stateless: the same transformation for batch and stream."""
    return stream.transform(lambda r: qc.cascade(r, preset))


def kmer_counts(stream: DataFrame, k: int) -> DataFrame:
    """Running counts, for update or complete mode; state is a row for each k-mer and belongs in RocksDB."""
    return stream.select(F.explode(S.clean_kmers(F.col("seq"), k)).alias("mer")).groupBy("mer").agg(F.count("*").alias("n"))


def distinct_sketch(stream: DataFrame, key: str, item: Column) -> DataFrame:
    """A mergeable sketch for each key: state of constant size."""
    return stream.groupBy(key).agg(F.hll_sketch_agg(item, F.lit(12)).alias("sketch"))


def windows(stream: DataFrame, width: str, late: str, ts: str = "ts") -> DataFrame:
    """Tumbling windows by event type, closed `late` after their end. An extension: the batch operators know no event time."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def available(stream: DataFrame, to: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its table. Update and complete modes keep the last row of a key by batch."""
    spark = stream.sparkSession
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        write = stream.writeStream.option("checkpointLocation", f"{to}/state").trigger(availableNow=True)
        if mode == "append":
            write.format("parquet").option("path", f"{to}/rows").outputMode("append").start().awaitTermination()
        else:
            # Each batch is its own folder, so a batch that runs again writes the same place.
            write.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{to}/rows/batch={i}")).start().awaitTermination()
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    return spark.read.parquet(f"{to}/rows")
