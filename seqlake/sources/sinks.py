"""Text forms of results, one column `record` (or `line`) each; `write.text` of it makes the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S


def fastq(reads: DataFrame) -> DataFrame:
    """Four-line records of (read_id, seq, q)."""
    letters = F.array_join(F.transform("q", lambda x: F.char((x + 33).cast("long"))), "")
    return reads.select(F.concat(F.lit("@read_"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), letters).alias("record"))


def wrapped(s: Column, width: int = 80) -> Column:
    return F.rtrim(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def fasta(contigs: DataFrame, width: int | None = 80) -> DataFrame:
    """Records of (contig_id, seq, len, coverage) with length, coverage and GC in the header."""
    head = F.format_string(">contig_%d length=%d coverage=%s gc=%s\n", "contig_id", "len", S.fixed(F.col("coverage"), 2), S.fixed(S.gc(F.col("seq")), 4))
    return contigs.select(F.concat(head, wrapped(F.col("seq"), width) if width else F.col("seq")).alias("record"))


def gfa(contigs: DataFrame, links: DataFrame, overlap: int) -> DataFrame:
    """GFA 1: header, segments, and links (src, dst) of the overlap that they have."""
    rc = (F.col("coverage") * F.col("len")).cast("long")
    head = contigs.sparkSession.range(1, numPartitions=1).select(F.lit("H\tVN:Z:1.0").alias("line"))
    seg = contigs.select(F.concat_ws("\t", F.lit("S"), F.col("contig_id").cast("string"), "seq", F.concat(F.lit("LN:i:"), F.col("len").cast("string")), F.concat(F.lit("RC:i:"), rc.cast("string"))).alias("line"))
    link = links.select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), F.lit("+"), F.col("dst").cast("string"), F.lit("+"), F.lit(f"{overlap}M")).alias("line"))
    return head.unionByName(seg).unionByName(link)


def classification_tsv(c: DataFrame) -> DataFrame:
    """contig, taxon id, name, confidence with four digits, lineage."""
    return c.select(F.concat_ws("\t", F.col("contig_id").cast("string"), F.col("taxonomy_id").cast("string"), "taxonomy_name", S.fixed(F.col("confidence"), 4), "lineage").alias("line"))


def kraken(c: DataFrame) -> DataFrame:
    """Percent, count, count, rank letter, name, of each taxon."""
    n = c.groupBy("taxonomy_name").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    pct = S.fixed(100.0 * F.col("n") / F.col("total"), 2)
    return n.crossJoin(F.broadcast(total)).select(F.concat_ws("\t", pct, F.col("n").cast("string"), F.col("n").cast("string"), F.lit("S"), "taxonomy_name").alias("line"))


def krona(c: DataFrame) -> DataFrame:
    """Count and the ranks of each lineage."""
    return c.groupBy("lineage").agg(F.count("*").alias("n")).select(F.concat_ws("\t", F.col("n").cast("string"), F.array_join(F.split("lineage", "[;|]"), "\t")).alias("line"))


def length_histogram(contigs: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n): lengths in equal bins up to the longest."""
    most = contigs.agg(F.max("len").alias("most"))
    place = F.least(F.floor(F.col("len") * bins / (F.col("most") + 1)), F.lit(bins - 1)).cast("long")
    return contigs.crossJoin(F.broadcast(most)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def sketch_tsv(counts: DataFrame, top: int | None = None) -> DataFrame:
    """(rank, line) of k-mer abundances, most abundant first; top: a report of so many."""
    rows = counts.orderBy(F.desc("n"), "mer").limit(top) if top else counts
    return rows.select(F.concat_ws("\t", "mer", F.col("n").cast("string")).alias("line"))


def consecutive(contigs: DataFrame, cut) -> DataFrame:
    """(src, dst) of contigs that follow each other by id. Ids are dealt by range and ordered within a range; only the least id of each range
    meets the others, to follow the last one of the range before. cut: writes a table and reads it back, so the ranges stay."""
    ids = cut(contigs.select(F.col("contig_id").alias("src")).repartitionByRange("src").withColumn("part", F.spark_partition_id()))
    heads = ids.groupBy("part").agg(F.min("src").alias("head"))
    after = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("next"))  # a row for each range
    inner = ids.withColumn("dst", F.lead("src").over(Window.partitionBy("part").orderBy("src")))
    return inner.join(F.broadcast(after), "part").select("src", F.coalesce("dst", "next").alias("dst")).where("dst is not null")
