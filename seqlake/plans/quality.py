"""Quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import qc
from . import views as V
from .registry import query

_MEAN = "list_sum(q) / len(q)"


@query(f"WITH {V.QUALITY_SQL} SELECT read_id, length(seq) AS len, round({_MEAN}, 9) AS mean_q, {_MEAN} >= 18 AS by_quality, length(seq) >= 50 AS by_length FROM quals")
def qc_filters(spark: SparkSession, d: str) -> DataFrame:
    """PF1, PF2, PF19."""
    m = qc.mean_quality(F.col("q"))
    return V.quality_reads(spark, d).select("read_id", F.char_length("seq").cast("long").alias("len"), F.round(m, 9).alias("mean_q"), (m >= 18).alias("by_quality"), (F.char_length("seq") >= 50).alias("by_length"))


_TRIM = f"""{V.QUALITY_SQL}, sums AS (SELECT *, list_transform(range(1, greatest(len(q) - 2, 1)), lambda i: q[i] + q[i+1] + q[i+2] + q[i+3] >= 60) AS good FROM quals),
found AS (SELECT *, coalesce(list_position(good, true), 0) AS f, coalesce(list_position(list_reverse(good), true), 0) AS l FROM sums),
bounds AS (SELECT *, CASE WHEN f > 0 THEN f - 1 ELSE 0 END AS s, CASE WHEN f > 0 THEN len(q) - l + 1 ELSE len(q) END AS e FROM found)"""


@query(f"WITH {_TRIM} SELECT read_id, s AS start, e AS \"end\", substring(seq, s + 1, e - s) AS trimmed FROM bounds")
def qc_window_trim(spark: SparkSession, d: str) -> DataFrame:
    """PF3, PF4, WN6."""
    r = V.quality_reads(spark, d).withColumn("b", qc.trim_bounds(F.col("q"), 4, 15))
    return r.select("read_id", "b.start", "b.end", F.substring("seq", (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int")).alias("trimmed"))


_A = ", ".join(f"({i}, '{a}')" for i, a in enumerate(qc.ADAPTERS.values()))


def _adapter_sql(source: str, column: str) -> str:
    """Best match by exhaustive comparison. Reads are first joined with places at which the eight first bases differ little enough."""
    return f"""ad(a, ad) AS (VALUES {_A}), places AS (SELECT read_id, {column} AS s, unnest(range(greatest(length({column}) - {qc.TAIL}, 0), greatest(length({column}) - {qc.OVERLAP} + 1, 0))) AS p FROM {source}),
cand AS (SELECT read_id, a, p, unnest(range({qc.OVERLAP}, least(length(ad), length(s) - p) + 1)) AS o, s, ad FROM places, ad WHERE hamming(substring(s, p + 1, {qc.OVERLAP}), substring(ad, 1, {qc.OVERLAP})) <= 3),
hits AS (SELECT read_id, a, p, o, hamming(substring(s, p + 1, o), substring(ad, 1, o)) AS m FROM cand),
best AS (SELECT read_id, arg_min(struct_pack(a := a, p := p, o := o, m := m), a * 100000 + (100 - o) * 1000 + p) AS h FROM hits WHERE m * 10 <= o GROUP BY 1)"""


@query(f"WITH {V.READS_SQL}, {_adapter_sql('reads', 'seq')} SELECT read_id, h.a AS adapter, h.p AS place, h.o AS overlap, h.m AS mismatches, substring(seq, 1, h.p) AS trimmed FROM best JOIN reads USING (read_id)")
def qc_adapters(spark: SparkSession, d: str) -> DataFrame:
    """PF5, PF6, JN13: the first adapter match of each read that has one, and the read before it."""
    r = V.reads(spark, d).select("read_id", "seq", qc.adapters(F.col("seq")).alias("h")).where("h.place is not null")
    return r.select("read_id", *(F.col(f"h.{c}").cast("long").alias(c) for c in ("adapter", "place", "overlap", "mismatches")), F.left("seq", F.col("h.place")).alias("trimmed"))


@query()
def qc_all_adapters(spark: SparkSession, d: str) -> DataFrame:
    """PF7."""
    return V.reads(spark, d).select("read_id", F.explode(qc.all_adapters(F.col("seq"))).alias("h")).select("read_id", "h.*")


_CASCADE = f"""{_TRIM}, cutoff AS (SELECT *, substring(seq, s + 1, e - s) AS trimmed FROM bounds), {_adapter_sql('cutoff', 'trimmed')},
done AS (SELECT c.*, b.h.p AS place, b.h.a AS adapter, CASE WHEN b.h.p IS NOT NULL THEN substring(trimmed, 1, b.h.p) ELSE trimmed END AS final FROM cutoff c LEFT JOIN best b USING (read_id)),
cascade AS (SELECT *, {_MEAN} AS mean_q, CASE WHEN {_MEAN} < 18 THEN 'failed_quality' WHEN length(seq) < 50 THEN 'failed_length' WHEN e <= s OR length(trimmed) < 50 THEN 'failed_trim' WHEN length(final) < 50 THEN 'failed_adapter' ELSE 'pass' END AS status FROM done)"""


@query(f"WITH {_CASCADE} SELECT read_id, status, length(final) AS final_len FROM cascade")
def qc_cascade(spark: SparkSession, d: str) -> DataFrame:
    """PF8, PF9, SM4: each read's status under the standard preset."""
    return qc.cascade(V.quality_reads(spark, d)).select("read_id", "status", F.char_length("final").cast("long").alias("final_len"))


@query(f"WITH {_CASCADE} SELECT status, count(*) AS reads, sum(length(seq))::BIGINT AS bases, count(adapter) AS with_adapter, round(avg(mean_q), 6) AS mean_q, round(avg(100.0 * len(list_filter(q, lambda x: x >= 20)) / len(q)), 6) AS q20, round(avg(100.0 * len(list_filter(q, lambda x: x >= 30)) / len(q)), 6) AS q30, round(avg(length(seq)), 6) AS mean_len FROM cascade GROUP BY 1")
def qc_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG1, SC3, SK5, SK25: counters and means of the cascade."""
    r = qc.cascade(V.quality_reads(spark, d))
    n = F.char_length("seq")
    rows = r.select("status", n.alias("n"), F.col("hit.adapter").alias("a"), "mean_q", qc.share_at_least(F.col("q"), 20).alias("q20"), qc.share_at_least(F.col("q"), 30).alias("q30"))
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("status").agg(F.count("*").alias("reads"), F.sum("n").alias("bases"), F.count("a").alias("with_adapter"), mean("mean_q").alias("mean_q"), mean("q20").alias("q20"), mean("q30").alias("q30"), mean("n").alias("mean_len"))


@query(f"WITH {V.QUALITY_SQL} SELECT read_id, list_min(q) AS lo, list_max(q) AS hi, round(list_median(q), 6) AS median, round(100.0 * len(list_filter(q, lambda x: x >= 20)) / len(q), 6) AS q20 FROM quals")
def qc_read_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG2."""
    q = F.col("q")
    return V.quality_reads(spark, d).select("read_id", F.array_min(q).alias("lo"), F.array_max(q).alias("hi"), F.round(qc.median(q), 6).alias("median"), F.round(qc.share_at_least(q, 20), 6).alias("q20"))


_ENT = "round(-(" + " + ".join(f"CASE WHEN c{b} > 0 THEN c{b} / n * log2(c{b} / n) ELSE 0 END" for b in "ACGT") + ") / 2, 9)"


@query(f"WITH {V.QUALITY_SQL}, c AS (SELECT *, length(seq)::DOUBLE AS n, {', '.join(f'(length(seq) - length(replace(seq, {chr(39)}{b}{chr(39)}, {chr(39)}{chr(39)}))) AS c{b}' for b in 'ACGT')} FROM quals), w AS (SELECT unnest(list_filter([CASE WHEN n < 50 THEN 'short' END, CASE WHEN (cG + cC) / n < 0.2 OR (cG + cC) / n > 0.8 THEN 'gc' END, CASE WHEN {_MEAN} < 20 THEN 'quality' END, CASE WHEN regexp_matches(seq, 'A{{21}}|C{{21}}|G{{21}}|T{{21}}') THEN 'homopolymer' END, CASE WHEN {_ENT} < 0.5 THEN 'complexity' END], lambda x: x IS NOT NULL)) AS code FROM c) SELECT code, count(*) AS reads FROM w GROUP BY 1")
def qc_validation(spark: SparkSession, d: str) -> DataFrame:
    """PF10, PF11, AG28: how many reads have each error or warning."""
    v = qc.validate(V.quality_reads(spark, d))
    return v.select(F.explode(F.concat("errors", "warnings")).alias("code")).groupBy("code").agg(F.count("*").alias("reads"))


_MASK = "list_filter(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN q[i] >= 20 THEN substring(seq, i, 1) END), lambda b: b IS NOT NULL)"


@query(f"WITH {V.QUALITY_SQL} SELECT read_id, array_to_string({_MASK}, '') AS kept FROM quals")
def qc_base_mask(spark: SparkSession, d: str) -> DataFrame:
    """PF18: bases of quality 20 and more."""
    kept = F.transform(F.filter(F.arrays_zip(F.split("seq", "").alias("b"), F.col("q").alias("q")), lambda x: x["q"] >= 20), lambda x: x["b"])
    return V.quality_reads(spark, d).select("read_id", F.array_join(kept, "").alias("kept"))


@query(f"WITH {V.QUALITY_SQL} SELECT concat('@read_', read_id, chr(10), seq, chr(10), '+', chr(10), array_to_string(list_transform(q, lambda x: chr((x + 33)::INTEGER)), '')) AS record FROM quals")
def sink_fastq(spark: SparkSession, d: str) -> DataFrame:
    """SK1: FASTQ records with the real qualities."""
    from ..sources import sinks

    return sinks.fastq(V.quality_reads(spark, d))
