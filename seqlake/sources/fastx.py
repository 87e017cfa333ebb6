"""FASTQ, FASTA and taxonomy files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from . import fastq

FASTQ, FASTA = (".fastq", ".fq"), (".fasta", ".fa", ".fna")


def kind(path: str) -> str:
    """'fastq' or 'fasta' by the extension before .gz; names that start with a dash and other extensions are errors."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.startswith("-"):
        raise ValueError(f"not a file name: {path}")
    inner = name.removesuffix(".gz")
    for label, ends in (("fastq", FASTQ), ("fasta", FASTA)):
        if inner.endswith(ends):
            return label
    raise ValueError(f"unknown sequence format: {path}")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block, place, value in the files' order; a carriage return at the end is dropped."""
    raw = spark.read.text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.rtrim("value").alias("value"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds line, from 0 in each file: a running count over the splits' sizes plus the place in the split, so a file's lines do
    not meet in one window."""
    split = ["file", "block"]
    sizes = lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(F.broadcast(sizes.withColumn("before", before).select(*split, "first", "before")), split).select("file", (F.col("before") + F.col("place") - F.col("first")).alias("line"), "value")


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, read_id (from 0 in each file), header, seq, quality of four-line records, read split by split (see fastq.py); malformed and
    incomplete records are left out here, fastq.scan() reports them. gzip is decoded by the codec."""
    from ..plans.shared import cut

    return fastq.scan(spark, paths, cut).where("problem is null").drop("problem")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, header, seq: lines of a record joined. Records are split by the reader at '>' after a line's end, so long files
    stay splittable and a header may hold that sign."""
    raw = spark.read.option("lineSep", "\n>").text(paths).where("value <> ''")
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    head = F.split("value", "\n", 2)
    return raw.select("file", F.rtrim(F.regexp_replace(head[0], "\\r$", "")).alias("header"), F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), "\\s", "").alias("seq"))


def reference_sequences(fasta: DataFrame) -> DataFrame:
    """Sequences of the reference store: content hash, length, GC, source; one row a hash, of equal sequences the first header."""
    h = F.md5(F.col("seq").cast("binary"))
    return fasta.select(h.alias("sequence_hash"), "seq", F.char_length("seq").cast("long").alias("length"), S.gc(F.col("seq")).alias("gc"), F.col("header").alias("source")).groupBy("sequence_hash").agg(F.first("seq").alias("seq"), F.first("length").alias("length"), F.first("gc").alias("gc"), F.min("source").alias("source"))


def mate(header: Column) -> Column:
    """struct(pair_id, orientation) of a header: ' 1', '/1' or '.1' and the same with 2; else the whole first word and R1."""
    side = F.regexp_extract(header, r"^\S+?(?:/|\.| )([12])(?:[\s:].*)?$", 1)
    name = F.regexp_replace(header, r"(?:(?:/|\.)[12](?:\s.*)?|\s.*)$", "")
    return F.struct(name.alias("pair_id"), F.when(side == "2", "R2").otherwise("R1").alias("orientation"))


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """id, name, lineage, rank of an accession and lineage TSV: species in the order of their first line."""
    rows = _numbered(_lines(spark, path)).select("line", F.split("value", "\t").alias("c")).where("size(c) >= 2")
    last = F.element_at(F.split(F.col("c")[1], ";"), -1)
    sp = rows.select("line", F.col("c")[1].alias("lineage"), F.trim(last).alias("last")).where("last like 's\\\\_\\\\_%' and length(last) > 3")
    first = sp.groupBy(F.substring("last", 4, 1 << 30).alias("name")).agg(F.min_by("lineage", "line").alias("lineage"), F.min("line").alias("line"))
    return first.select(F.row_number().over(Window.orderBy("line")).alias("id"), "name", "lineage", F.lit("species").alias("rank"))


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """id, name, lineage, rank, parent_id of a five-column TSV with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="id long, name string, lineage string, rank string, parent_id long")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Lineages if the first line starts with RS_ or GB_, else five columns."""
    first = spark.read.text(path).limit(1).collect()
    lineages = bool(first) and first[0].value.startswith(("RS_", "GB_"))
    return read_lineages(spark, path) if lineages else read_taxa(spark, path)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """contig, bin of a binner's TSV; unbinned contigs left out."""
    return spark.read.csv(path, sep="\t", header=True, schema="contig string, bin string").where("bin is not null and lower(bin) <> 'unbinned'")
