"""Scalar functions over whole sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import features
from . import views as V
from .registry import query

_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"


def _cnt(pattern: str, s: str = "seq") -> str:
    return f"(length({s}) - length(regexp_replace({s}, '{pattern}', '', 'g')))"


def _kmers(k: int, s: str = "seq") -> str:
    return f"list_transform(range(1, greatest(length({s}) - {k} + 2, 1)), lambda i: substring({s}, i, {k}))"


@query(f"WITH {V.READS_SQL} SELECT read_id, {_RC} AS rc, least(seq, {_RC}) AS canon, seq <= {_RC} AS forward, regexp_matches(seq, '^[ACGTN]*$') AS dna FROM reads")
def seq_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    """SF1, SF2, PF12."""
    s = F.col("seq")
    return V.reads(spark, d).select("read_id", S.reverse_complement(s).alias("rc"), S.canonical(s).alias("canon"), (s <= S.reverse_complement(s)).alias("forward"), S.is_dna(s).alias("dna"))


@query(f"WITH {V.READS_SQL} SELECT read_id, cast('0x' || substring(md5(seq), 1, 15) AS BIGINT) AS h FROM reads")
def seq_hash(spark: SparkSession, d: str) -> DataFrame:
    """SF3, SF4."""
    return V.reads(spark, d).select("read_id", S.portable_hash(F.col("seq")).alias("h"))


@query(f"WITH {V.SEQS_SQL} SELECT doc_id, length(seq) AS len, CASE WHEN length(seq) > 0 THEN {_cnt('[GC]')} / length(seq) ELSE 0 END AS gc, CASE WHEN {_cnt('[ACGT]')} > 0 THEN 100.0::DOUBLE * {_cnt('[GC]')} / {_cnt('[ACGT]')} ELSE 0 END AS gc_pct, CASE WHEN length(seq) > 1 THEN {_cnt('CG')} / 2 / (length(seq) - 1) ELSE 0 END AS cpg FROM seqs")
def seq_gc(spark: SparkSession, d: str) -> DataFrame:
    """SF14, SF21."""
    s = F.col("seq")
    return V.sequences(spark, d).select("doc_id", F.char_length(s).cast("long").alias("len"), S.gc(s).alias("gc"), S.gc_percent(s).alias("gc_pct"), S.cpg(s).alias("cpg"))


@query(f"WITH {V.SEQS_SQL}, p AS (SELECT doc_id, unnest(['A', 'C', 'G', 'T']) AS b, seq FROM seqs), c AS (SELECT doc_id, (length(seq) - length(replace(seq, b, ''))) / nullif(length(seq), 0) AS p FROM p), h AS (SELECT doc_id, coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0) / 2 AS h FROM c GROUP BY 1) SELECT doc_id, round(h, 9) AS complexity, round(1 - h, 9) AS low_complexity FROM h")
def seq_complexity(spark: SparkSession, d: str) -> DataFrame:
    """SF15, SF22."""
    h = S.entropy(F.col("seq"))
    return V.sequences(spark, d).select("doc_id", F.round(h, 9).alias("complexity"), F.round(1 - h, 9).alias("low_complexity"))


@query(f"WITH {V.CONTIGS_SQL}, w AS (SELECT contig_id, unnest({_kmers(1)}) AS mer FROM contigs UNION ALL SELECT contig_id, unnest({_kmers(2)}) FROM contigs), c AS (SELECT contig_id, mer, count(*) AS n FROM w GROUP BY ALL) SELECT contig_id, mer, n, round(n / sum(n) OVER (PARTITION BY contig_id, length(mer)), 9) AS freq FROM c")
def seq_composition(spark: SparkSession, d: str) -> DataFrame:
    """SF16: shares of bases and of dinucleotides."""
    c = V.contigs(spark, d)
    both = features.kmer_frequencies(c, "contig_id", 1).unionByName(features.kmer_frequencies(c, "contig_id", 2))
    return both.select("contig_id", "mer", "n", F.round("freq", 9).alias("freq"))


_CODON = f"substring('{S.CODE}', (instr('TCAG', substring(mer, 1, 1)) - 1) * 16 + (instr('TCAG', substring(mer, 2, 1)) - 1) * 4 + instr('TCAG', substring(mer, 3, 1)), 1)"


@query(f"WITH {V.CONTIGS_SQL}, w AS (SELECT contig_id, unnest({_kmers(3)}) AS mer FROM contigs), c AS (SELECT contig_id, mer, {_CODON} AS aa, count(*) AS n FROM w GROUP BY ALL), syn AS (SELECT a.i AS aa, count(*) AS size FROM (SELECT unnest(string_split('{S.CODE}', '')) AS i) a GROUP BY 1) SELECT contig_id, mer, aa, n, round(n * size / sum(n) OVER (PARTITION BY contig_id, aa), 9) AS rscu FROM c JOIN syn USING (aa) WHERE aa <> '*'")
def seq_codon_usage(spark: SparkSession, d: str) -> DataFrame:
    """SF17: relative synonymous codon usage over all frames, 61 sense codons."""
    return features.codon_usage(V.contigs(spark, d), "contig_id").select("contig_id", "mer", "aa", "n", F.round("rscu", 9).alias("rscu"))


def _run(b: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(seq, '{b}+'), lambda r: length(r))), 0)"


@query(f"WITH {V.READS_SQL} SELECT read_id, {', '.join(f'{_run(b)} AS run_{b.lower()}' for b in 'ACGT')}, greatest({', '.join(_run(b) for b in 'ACGT')}) / length(seq) AS longest FROM reads")
def seq_homopolymers(spark: SparkSession, d: str) -> DataFrame:
    """WN9, SF23: longest run of each base, and of any by length."""
    s = F.col("seq")
    runs = {b: S.longest_run(s, b) for b in S.BASES}
    return V.reads(spark, d).select("read_id", *(r.alias(f"run_{b.lower()}") for b, r in runs.items()), (F.greatest(*runs.values()) / F.char_length(s)).alias("longest"))



@query(f"WITH {V.READS_SQL}, c AS (SELECT read_id, seq, list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i = 1 OR substring(seq, i, 1) <> substring(seq, i - 1, 1) THEN 1 WHEN i = 2 OR substring(seq, i - 1, 1) <> substring(seq, i - 2, 1) THEN 1 ELSE 0 END) AS u FROM reads) SELECT read_id, list_sum(u) / length(seq) AS cost FROM c")
def seq_run_cost(spark: SparkSession, d: str) -> DataFrame:
    """WN10."""
    return V.reads(spark, d).select("read_id", S.run_length_cost(F.col("seq")).alias("cost"))


def _lag(p: int) -> str:
    return f"CASE WHEN length(seq) > {p} THEN list_sum(list_transform(range(1, length(seq) - {p} + 1), lambda i: CASE WHEN substring(seq, i, 1) = substring(seq, i + {p}, 1) THEN 1 ELSE 0 END)) / (length(seq) - {p}) ELSE 0 END"


@query(f"WITH {V.READS_SQL} SELECT read_id, {', '.join(f'round({_lag(p)}, 9) AS lag{p}' for p in (2, 3, 4))} FROM reads")
def seq_periodicity(spark: SparkSession, d: str) -> DataFrame:
    """WN12, SF23."""
    return V.reads(spark, d).select("read_id", *(F.round(S.lag_match(F.col("seq"), p), 9).alias(f"lag{p}") for p in (2, 3, 4)))


@query(f"WITH {V.READS_SQL} SELECT read_id, {', '.join(f'CASE WHEN length(seq) >= {k} THEN round(len(list_distinct({_kmers(k)})) / len({_kmers(k)}), 9) ELSE 0 END AS diversity{k}' for k in (3, 4, 5, 6))} FROM reads")
def seq_kmer_diversity(spark: SparkSession, d: str) -> DataFrame:
    """SF24, SF44."""
    return V.reads(spark, d).select("read_id", *(F.round(S.distinct_share(F.col("seq"), k), 9).alias(f"diversity{k}") for k in (3, 4, 5, 6)))


@query(f"WITH {V.CONTIGS_SQL}, w AS (SELECT contig_id, unnest({_kmers(4)}) AS mer FROM contigs), c AS (SELECT contig_id, mer, count(*) AS n FROM w GROUP BY ALL) SELECT contig_id, least(n, 10) AS times, round(count(*) / sum(count(*)) OVER (PARTITION BY contig_id), 9) AS share FROM c GROUP BY contig_id, least(n, 10)")
def seq_frequency_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """SF26: share of distinct 4-mers seen 1 to 10 or more times."""
    return features.frequency_spectrum(V.contigs(spark, d), "contig_id", 4).select("contig_id", "times", F.round("share", 9).alias("share"))


@query(f"WITH {V.READS_SQL}, m AS (SELECT read_id, replace(seq, 'TG', 'NN') AS s FROM reads), c AS (SELECT *, length(s) - length(replace(s, 'N', '')) AS n FROM m) SELECT read_id, CASE WHEN n = 0 THEN s END AS skipped, CASE WHEN n <= 12 THEN s END AS allowed, translate(s, 'N', 'A') AS replaced, replace(s, 'N', list_max([{', '.join(f'struct_pack(c := {_cnt(b, chr(115))}, b := {chr(39)}{b}{chr(39)})' for b in 'ACGT')}]).b) AS context FROM c")
def seq_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """PF22, with every TG made ambiguous."""
    r = V.reads(spark, d).select("read_id", F.replace("seq", F.lit("TG"), F.lit("NN")).alias("s"))
    s = F.col("s")
    return r.select("read_id", S.mask_policy(s, "skip").alias("skipped"), S.mask_policy(s, "allow", 12).alias("allowed"), S.mask_policy(s, "replace").alias("replaced"), S.mask_policy(s, "context").alias("context"))


_P, _PRIME = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(mer, ''), lambda b: (instr('ACGT', b) - 1)::BIGINT)), lambda a, b: a * 4 + b)", (1 << 31) - 1


@query(f"WITH {V.CONTIGS_SQL}, w AS (SELECT DISTINCT contig_id, unnest({_kmers(9)}) AS mer FROM contigs), p AS (SELECT contig_id, {_P} AS x FROM w) SELECT contig_id, {', '.join(f'min((x * {a} + {b}) % {_PRIME})::BIGINT AS h{i}' for i, (a, b) in enumerate(features.HASHES))} FROM contigs LEFT JOIN p USING (contig_id) GROUP BY 1")
def seq_minhash(spark: SparkSession, d: str) -> DataFrame:
    """SF27: MinHash signature of 9-mers with 16 affine hashes."""
    return features.minhash(V.contigs(spark, d), "contig_id", 9)


@query()
def seq_repeats(spark: SparkSession, d: str) -> DataFrame:
    """SF18, SF19, SF20: tandem, inverted and direct repeats."""
    return features.repeats(V.contigs(spark, d), "contig_id")


@query(f"WITH {V.CONTIGS_SQL}, w AS (SELECT contig_id, unnest({_kmers(4)}) AS mer FROM contigs), c AS (SELECT contig_id, mer, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT contig_id, mer, n / sum(n) OVER (PARTITION BY contig_id) AS f FROM c), t AS (SELECT count(*) AS total FROM contigs), s AS (SELECT mer, sum(f) / any_value(total) AS mean, sqrt(greatest(sum(f * f) / any_value(total) - (sum(f) / any_value(total)) ** 2, 0)) AS std, min(f) AS lo, max(f) AS hi, count(*) AS present, any_value(total) AS total FROM f, t GROUP BY mer) SELECT mer, round(mean, 9) AS mean, round(std, 6) AS std, round(CASE WHEN present < total THEN 0 ELSE lo END, 9) AS lo, round(hi, 9) AS hi FROM s")
def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    """ML1, ML2, AG25: mean, population deviation, least and greatest of each 4-mer's share over all contigs, absent ones counted as 0."""
    return features.column_statistics(V.contigs(spark, d), "contig_id", 4).select("mer", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query()
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """SF25, SF28, SF29, SF43, SF44, ML17: the assembled feature vector of each contig, 100 values of the sequence and 64 of its k-mers."""
    return features.vectors(V.contigs(spark, d), "contig_id")
