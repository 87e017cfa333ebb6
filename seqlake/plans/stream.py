"""Streams over the given tables, run until all that is there is done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import streams
from . import views as V
from .registry import query
from .scalars import _kmers
from .shared import folder


def _place(spark: SparkSession) -> str:
    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """SM1, SM3 and an extension: hourly windows; of each window, the row of the last batch that changed it."""
    w = streams.windows(streams.read(spark, f"{d}/events.parquet"), "1 hour", "2 hours")
    rows = streams.available(w, _place(spark), "update").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total", "batch")
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("start", "event_type", "x.*")


@query(f"WITH {V.SEQS_SQL}, c AS (SELECT mer, count(*) AS n FROM (SELECT unnest({_kmers(6)}) AS mer FROM seqs) GROUP BY 1) SELECT mer, n FROM c")
def stream_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    """SM6, GR11: running 6-mer counts; of each k-mer, the row of the last batch that changed it."""
    docs = streams.read(spark, f"{d}/documents.parquet").select(F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), V.FROM, V.TO).alias("seq"))
    rows = streams.available(streams.kmer_counts(docs, 6), _place(spark), "update")
    return rows.groupBy("mer").agg(F.max_by("n", "batch").alias("n"))


@query()
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """SM2, SM5: a sketch of distinct users for each type of event."""
    s = streams.distinct_sketch(streams.read(spark, f"{d}/events.parquet"), "event_type", F.col("user_id"))
    rows = streams.available(s, _place(spark), "update")
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("batch")))).where("r = 1")
    return last.select("event_type", F.hll_sketch_estimate("sketch").alias("users"))
