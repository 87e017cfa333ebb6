"""Text reports and run figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import graph, misassembly
from ..sources import sinks
from . import taxa
from . import views as V
from .assembly import _NX
from .registry import query
from .taxa import _BC, _CLS, _cnt

_GC_SUM = "sum(len - length(regexp_replace(seq, '[GC]', '', 'g')))"
_HIST = "h AS (SELECT least(len * 10 // (most + 1), 9) AS bin, count(*) AS n FROM contigs, (SELECT max(len) AS most FROM contigs) GROUP BY 1)"


@query(
    f"WITH {V.CONTIGS_SQL}, a AS (SELECT count(*) AS n, sum(len)::BIGINT AS bases, round(avg(len), 2) AS mean, min(len) AS least, max(len) AS most, {_NX.format(0.5)} AS n50, {_NX.format(0.9)} AS n90, {_GC_SUM} / sum(len) AS gc, avg(coverage) AS cov FROM contigs), {_HIST}"
    " SELECT unnest([concat_ws(chr(9), 'contigs', n), concat_ws(chr(9), 'total_length', bases), concat_ws(chr(9), 'mean_length', printf('%.2f', mean)), concat_ws(chr(9), 'shortest', least), concat_ws(chr(9), 'longest', most), concat_ws(chr(9), 'n50', n50), concat_ws(chr(9), 'n90', n90), concat_ws(chr(9), 'gc', printf('%.4f', gc)), concat_ws(chr(9), 'mean_coverage', printf('%.2f', cov))]) AS line FROM a UNION ALL SELECT concat_ws(chr(9), 'length_bin', bin, n) FROM h"
)
def sink_assembly_statistics(spark: SparkSession, d: str) -> DataFrame:
    """SK4, AG10: figures of an assembly and its histogram of lengths, a line each."""
    c = V.contigs(spark, d)
    one = c.agg(F.count("*").alias("n"), F.sum("len").alias("bases"), F.round(F.avg("len"), 2).alias("mean"), F.min("len").alias("least"), F.max("len").alias("most"), (F.sum(S.count_of(F.col("seq"), "[GC]")) / F.sum("len")).alias("gc"), F.avg("coverage").alias("cov"))
    one = one.crossJoin(graph.nx(c, 0.5).withColumnRenamed("nx", "n50")).crossJoin(graph.nx(c, 0.9).withColumnRenamed("nx", "n90"))
    text = lambda name, v: F.concat_ws("\t", F.lit(name), v)
    whole = [text(a, F.col(b).cast("string")) for a, b in (("contigs", "n"), ("total_length", "bases"), ("shortest", "least"), ("longest", "most"), ("n50", "n50"), ("n90", "n90"))]
    parts = [text(a, S.fixed(F.col(b), digits)) for a, digits, b in (("mean_length", 2, "mean"), ("gc", 4, "gc"), ("mean_coverage", 2, "cov"))]
    bins = sinks.length_histogram(c).select(F.concat_ws("\t", F.lit("length_bin"), F.col("bin").cast("string"), F.col("n").cast("string")).alias("line"))
    return one.select(F.explode(F.array(*whole, *parts)).alias("line")).unionByName(bins)


_METHOD = "'4-mer cosine'"


@query(f"WITH {_CLS}, k AS (SELECT 'taxon' AS part, taxon AS name FROM cls WHERE confidence >= 0.6 UNION ALL SELECT 'method', {_METHOD} FROM cls WHERE confidence >= 0.6) SELECT concat_ws(chr(9), part, name, count(*), printf('%.2f', 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY part))) AS line FROM k GROUP BY part, name")
def sink_classification_summary(spark: SparkSession, d: str) -> DataFrame:
    """SK8, ST3: sequences and shares by taxon and by method."""
    c = taxa._classified(spark, d)
    n = c.groupBy("taxon").agg(F.count("*").alias("n"))
    rows = n.select(F.lit("taxon").alias("part"), F.col("taxon").alias("name"), "n").unionByName(n.agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("method").alias("part"), F.expr(_METHOD).alias("name"), "n"))
    total = n.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(F.concat_ws("\t", "part", "name", F.col("n").cast("string"), S.fixed(100.0 * F.col("n") / F.col("total"), 2)).alias("line"))


@query(f"WITH {_CLS}, t AS (SELECT taxon, count(*) AS n, avg(coverage) AS cov FROM cls JOIN contigs USING (contig_id) WHERE confidence >= 0.6 GROUP BY 1) SELECT concat_ws(chr(9), taxon, n, printf('%.4f', 100.0 * n / sum(n) OVER ()), printf('%.2f', cov)) AS line FROM t")
def sink_abundance(spark: SparkSession, d: str) -> DataFrame:
    """SK10, AG18: taxon, sequences, percent, and the mean coverage of its contigs."""
    covers = V.long_contigs(spark, d).select("contig_id", "coverage")
    t = taxa._classified(spark, d).join(covers, "contig_id").groupBy("taxon").agg(F.count("*").alias("n"), F.avg("coverage").alias("cov"))
    total = t.agg(F.sum("n").alias("total"))
    return t.crossJoin(F.broadcast(total)).select(F.concat_ws("\t", "taxon", F.col("n").cast("string"), S.fixed(100.0 * F.col("n") / F.col("total"), 4), S.fixed(F.col("cov"), 2)).alias("line"))


@query(f"WITH {_CLS} SELECT count(*) AS classified, round(avg(contains(taxon, 'Bact')::INTEGER), 9) AS share FROM cls WHERE confidence >= 0.6")
def taxa_share(spark: SparkSession, d: str) -> DataFrame:
    """ML16: the share of classified sequences whose taxon's name holds a word part."""
    return taxa._classified(spark, d).agg(F.count("*").alias("classified"), F.round(F.avg(F.col("taxon").contains("Bact").cast("int")), 9).alias("share"))


@query(f"WITH {_BC}, e AS (SELECT bin, count(*) AS n, sum(len)::BIGINT AS bases, avg(coverage) AS cov FROM b GROUP BY 1) SELECT count(*) AS bins, sum(n)::BIGINT AS contigs, sum(bases)::BIGINT AS bases, round(avg(n), 6) AS contigs_per_bin, max(n) AS most_contigs, max(bases) AS most_bases, round(sum(cov * n) / sum(n), 6) AS coverage FROM e")
def bin_overall(spark: SparkSession, d: str) -> DataFrame:
    """AG12: one row over all bins of a run."""
    e = taxa._binned(spark, d).groupBy("bin").agg(F.count("*").alias("n"), F.sum("len").alias("bases"), F.avg("coverage").alias("cov"))
    return e.agg(F.count("*").alias("bins"), F.sum("n").alias("contigs"), F.sum("bases").alias("bases"), F.round(F.avg("n"), 6).alias("contigs_per_bin"), F.max("n").alias("most_contigs"), F.max("bases").alias("most_bases"), F.round(F.sum(F.col("cov") * F.col("n")) / F.sum("n"), 6).alias("coverage"))


_H4 = " + ".join(f"CASE WHEN contains(seq, '{b}') THEN ({_cnt(b)} / n.n) * log2({_cnt(b)} / n.n) ELSE 0 END" for b in "ACGT")


@query(f"WITH {V.QUALITY_SQL} SELECT read_id, length(seq) AS len, round(list_sum(q) / len(q), 6) AS mean_quality, round({_cnt('[GC]')}::DOUBLE / length(seq), 6) AS gc, round(0.0 - ({_H4}) / 2, 6) AS complexity FROM quals, (SELECT length(quals.seq)::DOUBLE AS n) n")
def read_info(spark: SparkSession, d: str) -> DataFrame:
    """SF36: each read's length, mean quality, share of G and C, and complexity."""
    s = F.col("seq")
    return V.quality_reads(spark, d).select("read_id", F.char_length(s).alias("len"), F.round(S.mean_of(F.col("q")), 6).alias("mean_quality"), F.round(S.gc(s), 6).alias("gc"), F.round(S.entropy(s), 6).alias("complexity"))


@query(f"WITH {V.READS_SQL}, parts AS (SELECT source AS file, seq FROM reads WHERE doc_id % 2 = 0 UNION ALL SELECT source, seq FROM reads WHERE doc_id % 2 = 1) SELECT file, count(*) AS reads, sum(length(seq))::BIGINT AS bases, sum({_cnt('[GC]')})::BIGINT AS gc FROM parts GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(length(seq))::BIGINT, sum({_cnt('[GC]')})::BIGINT FROM parts")
def reads_merged(spark: SparkSession, d: str) -> DataFrame:
    """SC3, SE1: reads of several inputs as one, with the figures of each file and of all together."""
    r = V.reads(spark, d).select(F.col("source").alias("file"), "seq", "doc_id")
    both = r.where("doc_id % 2 = 0").unionByName(r.where("doc_id % 2 = 1"))
    each = both.groupBy("file").agg(F.count("*").alias("reads"), F.sum(F.char_length("seq")).alias("bases"), F.sum(S.count_of(F.col("seq"), "[GC]")).alias("gc"))
    return each.unionByName(each.agg(F.lit("all").alias("file"), F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), F.sum("gc").alias("gc")))


_ANCHOR, _SLACK = 31, 20
_PLACED = f"SELECT {{key}}, i AS place, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS word, m <= reverse(translate(m, 'ACGT', 'TGCA')) AS forward FROM (SELECT {{key}}, i, substring(seq, i + 1, {_ANCHOR}) AS m FROM {{rows}}, unnest(range(0, length(seq) - {_ANCHOR - 1})) AS t(i))"


@query(
    f"WITH {V.CHECKED_SQL}, a AS (SELECT word, min(item_id) AS source, min(place) AS source_at, bool_and(forward) AS source_forward FROM ({_PLACED.format(key='item_id', rows='sources')}) GROUP BY word HAVING count(*) = 1)"
    f", h AS (SELECT contig_id AS contig, place, source, forward = source_forward AS same, CASE WHEN forward = source_forward THEN source_at - place ELSE source_at + place END AS diagonal FROM ({_PLACED.format(key='contig_id', rows='checked')}) JOIN a USING (word))"
    ", s AS (SELECT *, lag(source) OVER w AS source0, lag(same) OVER w AS same0, lag(diagonal) OVER w AS diagonal0 FROM h WINDOW w AS (PARTITION BY contig ORDER BY place))"
    f", k AS (SELECT contig, count(*) AS anchors, count(DISTINCT source) AS sources, count(*) FILTER (source = source0 AND same = same0 AND abs(diagonal - diagonal0) > {_SLACK}) AS relocations, count(*) FILTER (source = source0 AND same <> same0) AS inversions, count(*) FILTER (source <> source0) AS translocations FROM s GROUP BY 1)"
    " SELECT contig, anchors, sources, 1 + relocations + inversions + translocations AS blocks, relocations, inversions, translocations FROM k"
)
def contig_misassemblies(spark: SparkSession, d: str) -> DataFrame:
    """AG30: breaks of each document, and of contigs put together by rule, against the benchmark's sequences, by chains of k-mers that occur once in these."""
    return misassembly.chained(V.checked_contigs(spark, d), V.sources(spark, d), "contig_id", "item_id", _ANCHOR, _SLACK)


@query(
    f"WITH {V.CONTIGS_SQL}, r AS (SELECT sum(length(seq)) AS bases FROM seqs), c AS (SELECT count(*) AS contigs, sum(len)::BIGINT AS bases, count(*) FILTER (len < 100) AS short_contigs, avg(len) AS mean, stddev_pop(len) AS spread, avg(coverage) AS cov, sum(len - length(regexp_replace(seq, '[Nn]', '', 'g'))) AS gaps FROM contigs)"
    ", e AS (SELECT *, CASE WHEN contigs < 2 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - spread / mean) END AS evenness, least(100.0, 100.0 * bases / (SELECT bases FROM r)) AS completeness FROM c), f AS (SELECT *, 50 * least(1.0, cov / 10) + 50 * evenness AS accuracy FROM e)"
    " SELECT contigs, bases, short_contigs, round(evenness, 9) AS evenness, round(completeness, 9) AS completeness, round(accuracy, 9) AS accuracy, round(100 * least(1.0, mean / 1000), 9) AS structure, round(100.0 * gaps / bases, 9) AS gap_percent, round((completeness + accuracy) / 2, 9) AS score FROM f"
)
def assembly_quality(spark: SparkSession, d: str) -> DataFrame:
    """AG30, AG22: the figures by which an assembly is scored, from its contigs and the bases of its reads."""
    bases = V.reads(spark, d).agg(F.sum(F.char_length("seq")).alias("read_bases"))
    return misassembly.quality(V.contigs(spark, d), bases)
