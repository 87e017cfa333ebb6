"""Pairs of mates with qualities: validation, filters, adapters by mate, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, qc
from . import views as V
from .registry import query

_ADAPTER_LIST = list(qc.ADAPTERS.values())
#: Every third mate reads into an adapter, as mates of short inserts do.
_READ_IN = "CASE WHEN (pair_id + k + side) % 3 = 0 THEN substring([{}][((pair_id + k) % {})::BIGINT + 1], 1, (4 + pair_id % 31)::BIGINT) ELSE '' END".format(", ".join(f"'{a}'" for a in _ADAPTER_LIST), len(_ADAPTER_LIST))
_M = f"""m0 AS (SELECT conv_id AS pair_id, turn % 2 AS side, turn // 2 AS k, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{V.FROM}', '{V.TO}') AS s0 FROM conversations),
m1 AS (SELECT pair_id, side, k, s0 || {_READ_IN} AS seq FROM m0),
m AS (SELECT *, list_transform(range(1, length(seq) + 1), lambda i: ((ascii(substring(seq, i, 1)) * 7 + i * (pair_id % 97 + side)) % 41)::BIGINT) AS q FROM m1),
p AS (SELECT pair_id, k, a.seq AS r1, b.seq AS r2, a.q AS q1, b.q AS q2, coalesce(list_sum(a.q) / len(a.q), 0) AS m1, coalesce(list_sum(b.q) / len(b.q), 0) AS m2 FROM (SELECT * FROM m WHERE side = 0) a JOIN (SELECT * FROM m WHERE side = 1) b USING (pair_id, k))"""


def mates(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, side, k, seq, q of the turns of conversations."""
    c = V.table(spark, d, "conversations")
    m = c.select(F.col("conv_id").alias("pair_id"), (F.col("turn") % 2).alias("side"), F.floor(F.col("turn") / 2).alias("k"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), V.FROM, V.TO).alias("s0"))
    which = F.element_at(F.array(*(F.lit(a) for a in _ADAPTER_LIST)), ((F.col("pair_id") + F.col("k")) % len(_ADAPTER_LIST) + 1).cast("int"))
    read_in = F.when((F.col("pair_id") + F.col("k") + F.col("side")) % 3 == 0, F.left(which, (4 + F.col("pair_id") % 31).cast("int"))).otherwise(F.lit(""))
    m = m.select("pair_id", "side", "k", F.concat("s0", read_in).alias("seq"))
    bases = F.filter(F.split("seq", ""), lambda b: b != "")
    return m.withColumn("q", F.transform(bases, lambda b, i: ((F.ascii(b) * 7 + (i + 1) * (F.col("pair_id") % 97 + F.col("side"))) % 41).cast("long")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, k, r1, r2, q1, q2 and mean qualities m1, m2 of mates with a partner."""
    m = mates(spark, d)
    mean = F.coalesce(qc.mean_quality(F.col("q")), F.lit(0.0))
    a, b = (m.where(F.col("side") == i).select("pair_id", "k", F.col("seq").alias(f"r{i + 1}"), F.col("q").alias(f"q{i + 1}"), mean.alias(f"m{i + 1}")) for i in (0, 1))
    return a.join(b, ["pair_id", "k"])


@query(f"WITH {_M} SELECT pair_id, k, round(m1, 6) AS quality_r1, round(m2, 6) AS quality_r2, round((m1 + m2) / 2, 6) AS combined, round(least(m1, m2), 6) AS lo, round(greatest(m1, m2), 6) AS hi, round(m1 / greatest(m2, 1), 6) AS ratio, length(r1) >= 50 AND length(r2) >= 50 AND m1 >= 20 AND m2 >= 20 AS valid, length(r1) >= 30 AND length(r2) >= 30 AND m1 >= 18 AND m2 >= 18 AS kept FROM p")
def mates_quality(spark: SparkSession, d: str) -> DataFrame:
    """PF17, PF21, SF36, AG24: quality metrics of each pair, whether it is valid, and whether a filter of quality 18 and length 30 keeps it."""
    a, b, n1, n2 = F.col("m1"), F.col("m2"), F.char_length("r1"), F.char_length("r2")
    r = lambda x: F.round(x, 6)
    return pairs(spark, d).select(
        "pair_id", "k", r(a).alias("quality_r1"), r(b).alias("quality_r2"), r((a + b) / 2).alias("combined"), r(F.least(a, b)).alias("lo"), r(F.greatest(a, b)).alias("hi"), r(a / F.greatest(b, F.lit(1.0))).alias("ratio"),
        ((n1 >= 50) & (n2 >= 50) & (a >= 20) & (b >= 20)).alias("valid"), ((n1 >= 30) & (n2 >= 30) & (a >= 18) & (b >= 18)).alias("kept"),
    )


@query(f"WITH {_M}, x AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.side = 1 - m.side AND b.pair_id = m.pair_id AND b.k = m.k)) SELECT pair_id, k, side, length(seq) AS len, round(coalesce(list_sum(q) / len(q), 0), 6) AS quality FROM x WHERE length(seq) >= 30 AND list_sum(q) / len(q) >= 18")
def mates_single_kept(spark: SparkSession, d: str) -> DataFrame:
    """PF17: mates without a partner that the filter keeps."""
    m = mates(spark, d)
    other = m.select("pair_id", "k", (1 - F.col("side")).alias("side"))
    mean = qc.mean_quality(F.col("q"))
    left = m.join(other, ["pair_id", "k", "side"], "left_anti").where((F.char_length("seq") >= 30) & (mean >= 18))
    return left.select("pair_id", "k", "side", F.char_length("seq").cast("long").alias("len"), F.round(mean, 6).alias("quality"))


_SIZES = "greatest(length(r1) + length(r2) + 200, 300)"


@query(f"WITH {_M}, s AS (SELECT {_SIZES} AS s, m1, m2 FROM p) SELECT count(*) AS pairs, round(avg(s), 6) AS mean_size, list_sort(list(s))[count(*) // 2 + 1] AS median_size, round(stddev_pop(s), 6) AS std_size, min(s) AS least_size, max(s) AS most_size, round(avg(m1), 6) AS quality_r1, round(avg(m2), 6) AS quality_r2, count(*) FILTER (WHERE m1 < 15 OR m2 < 15) AS low_quality FROM s")
def mates_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG23: insert sizes and qualities of all pairs; no read carries corrections here, so these are not counted."""
    s = pairs(spark, d).select(F.greatest(F.char_length("r1") + F.char_length("r2") + 200, F.lit(300)).cast("long").alias("len"), "m1", "m2")
    a = s.agg(
        F.count("*").alias("pairs"), F.round(F.avg("len"), 6).alias("mean_size"), F.round(F.stddev_pop("len"), 6).alias("std_size"), F.min("len").alias("least_size"), F.max("len").alias("most_size"),
        F.round(F.avg("m1"), 6).alias("quality_r1"), F.round(F.avg("m2"), 6).alias("quality_r2"), F.count_if((F.col("m1") < 15) | (F.col("m2") < 15)).alias("low_quality"),
    )
    return a.crossJoin(graph.upper_median(s, "len").withColumnRenamed("median", "median_size"))


@query(f"WITH {_M} SELECT v AS quality, count(*) AS n FROM (SELECT unnest(list_concat(q1, q2)) AS v FROM p) GROUP BY 1")
def mates_quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG23, AG24: how many bases of pairs have each score."""
    return pairs(spark, d).select(F.explode(F.concat("q1", "q2")).alias("quality")).groupBy("quality").agg(F.count("*").alias("n"))


_CUT = "coalesce(" + ", ".join(x for a in _ADAPTER_LIST for x in (f"CASE WHEN instr(seq, '{a}') > 0 THEN instr(seq, '{a}') - 1 END", *(f"CASE WHEN instr(seq, '{a[:n]}') > 0 AND instr(seq, '{a[:n]}') + {n - 1} = length(seq) THEN length(seq) - {n} END" for n in range(len(a) - 1, 6, -1)))) + ")"


@query(f"WITH {_M}, c AS (SELECT pair_id, k, side, seq, {_CUT} AS place FROM m) SELECT pair_id, k, side, place, length(seq) - place AS trimmed, substring(seq, 1, place) AS kept FROM c WHERE place IS NOT NULL")
def mates_adapters(spark: SparkSession, d: str) -> DataFrame:
    """PF20: mates cut at an exact adapter, or at the longest prefix of one at their end."""
    m = mates(spark, d).withColumn("place", qc.exact_adapter(F.col("seq")).cast("long")).where("place is not null")
    return m.select("pair_id", "k", "side", "place", (F.char_length("seq") - F.col("place")).alias("trimmed"), F.left("seq", F.col("place").cast("int")).alias("kept"))


_COVER = f"""{V.LONG_CONTIGS_SQL}, med AS (SELECT list_sort(list(coverage))[count(*) // 2 + 1] AS m FROM contigs),
outs AS (SELECT list(struct_pack(c := c, i := i) ORDER BY i) AS l FROM (SELECT coverage AS c, min(contig_id) AS i FROM contigs, med WHERE coverage NOT BETWEEN 0.5 * m AND 1.5 * m GROUP BY 1)),
grown AS (SELECT 0 AS n, []::DOUBLE[] AS bins UNION ALL SELECT n + 1, list_append(bins, list_filter(l, lambda x: len(list_filter(bins, lambda b: x.c / b BETWEEN 0.7 AND 1.3)) = 0)[1].c) FROM grown, outs WHERE len(list_filter(l, lambda x: len(list_filter(bins, lambda b: x.c / b BETWEEN 0.7 AND 1.3)) = 0)) > 0),
final AS (SELECT bins FROM grown ORDER BY n DESC LIMIT 1)"""


@query(f"WITH RECURSIVE {_COVER} SELECT contig_id, CASE WHEN coverage BETWEEN 0.5 * m AND 1.5 * m THEN 0 ELSE list_position(list_transform(bins, lambda b: coverage / b BETWEEN 0.7 AND 1.3), true) END::INTEGER AS bin FROM contigs, med, final")
def bin_coverage(spark: SparkSession, d: str) -> DataFrame:
    """JN15: bin 0 within half of the upper median coverage; the others go to the first bin whose first member's coverage is near theirs."""
    return graph.coverage_bins(V.long_contigs(spark, d))
