"""Files written and read back, and imports into the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..sources import fastq, fastx, sinks
from ..sources.store import Store
from . import views as V
from .registry import query
from .shared import cut, folder

_Q = "array_to_string(list_transform(q, lambda x: chr((x + 33)::INTEGER)), '')"
_GC = "round((len - length(regexp_replace(seq, '[GC]', '', 'g'))) / len, 9)"


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    to = f"{folder(spark)}/fastq-{uuid.uuid4().hex}"
    sinks.fastq(V.quality_reads(spark, d)).write.text(to)
    return fastq.scan(spark, to, cut)


@query(f"WITH {V.QUALITY_SQL} SELECT concat('read_', read_id) AS header, seq, {_Q} AS quality, NULL AS problem FROM quals")
def source_fastq(spark: SparkSession, d: str) -> DataFrame:
    """SC1, SC3: reads written as FASTQ files and read back split by split."""
    return _fastq(spark, d).select("header", "seq", "quality", "problem")


@query(f"WITH {V.QUALITY_SQL} SELECT count(*) AS reads, 0::BIGINT AS malformed, sum(length(seq))::BIGINT AS bases, round(avg(length(seq)), 6) AS mean_length, round(sum(list_sum(q)) / sum(length(seq)), 6) AS mean_quality, round(sum(length(seq) - length(regexp_replace(seq, '[GC]', '', 'g'))) / sum(length(seq)), 9) AS gc FROM quals")
def source_fastq_summary(spark: SparkSession, d: str) -> DataFrame:
    """SC6, SC3, AG28: figures of all files together."""
    return fastq.summary(_fastq(spark, d).withColumn("file", F.lit("all"))).select("reads", "malformed", "bases", F.round("mean_length", 6).alias("mean_length"), F.round("mean_quality", 6).alias("mean_quality"), F.round("gc", 9).alias("gc"))


@query(f"WITH {V.CONTIGS_SQL} SELECT md5(seq) AS sequence_hash, any_value(len) AS length, any_value({_GC}) AS gc, min(printf('contig_%d length=%d coverage=%.2f gc=%.4f', contig_id, len, coverage, (len - length(regexp_replace(seq, '[GC]', '', 'g'))) / len)) AS source FROM contigs GROUP BY seq")
def source_fasta(spark: SparkSession, d: str) -> DataFrame:
    """SC2, SC12: contigs written as FASTA files, read back and made rows of the reference store."""
    to = f"{folder(spark)}/fasta-{uuid.uuid4().hex}"
    sinks.fasta(V.contigs(spark, d)).write.text(to)
    return fastx.reference_sequences(fastx.read_fasta(spark, to)).select("sequence_hash", "length", F.round("gc", 9).alias("gc"), "source")


@query(f"WITH {V.CONTIGS_SQL} SELECT md5(seq) AS sequence_hash, any_value(len) AS length, any_value({_GC}) AS gc, coalesce(min(contig_id) FILTER (contig_id % 2 = 0), min(contig_id)) AS contig_id FROM contigs GROUP BY seq")
def store_import(spark: SparkSession, d: str) -> DataFrame:
    """SC12, SK19, JN12: sequences imported in two versions, those of even documents and then all; what is there already stays."""
    c = V.contigs(spark, d)
    rows = c.select(F.md5(F.col("seq").cast("binary")).alias("sequence_hash"), F.col("len").alias("length"), F.round(S.gc(F.col("seq")), 9).alias("gc"), "contig_id")
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
    store.insert("sequences", rows.where("contig_id % 2 = 0"), "sequence_hash")
    store.insert("sequences", rows, "sequence_hash")
    return store.read("sequences")


@query(f"WITH {V.SEQS_SQL} SELECT source AS sample_name, count(*) AS contigs, sum(length(seq))::BIGINT AS bases, max(length(seq)) AS longest FROM seqs WHERE length(seq) > 0 GROUP BY 1")
def store_assemblies(spark: SparkSession, d: str) -> DataFrame:
    """SC17, SK19: one record for each sample; Store.assembly() looks one up."""
    s = V.sequences(spark, d).where("length(seq) > 0")
    rows = s.groupBy(F.col("source").alias("sample_name")).agg(F.count("*").alias("contigs"), F.sum(F.char_length("seq")).alias("bases"), F.max(F.char_length("seq").cast("long")).alias("longest"))
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
    store.insert("assemblies", rows, "sample_name")
    return store.read("assemblies")
