"""Graphs, contigs and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import blocks, centrality, graph, kmers
from ..plans.shared import cut
from ..sources import sinks
from . import views as V
from .registry import query
from .scalars import _kmers

K = 15
_N = f"w AS (SELECT unnest({_kmers(K)}) AS mer FROM reads), nodes AS MATERIALIZED (SELECT mer, count(*) AS coverage FROM w GROUP BY 1 HAVING count(*) >= 2)"
_E = f"e AS (SELECT mer[1:{K}] AS src, mer[2:{K + 1}] AS dst, count(*) AS weight FROM (SELECT unnest({_kmers(K + 1)}) AS mer FROM reads) GROUP BY ALL), edges AS MATERIALIZED (SELECT e.* FROM e SEMI JOIN nodes a ON a.mer = src SEMI JOIN nodes b ON b.mer = dst)"
_G = f"{V.READS_SQL}, {_N}, {_E}"
_D = "din AS (SELECT dst AS mer, count(*) AS c FROM edges GROUP BY 1), dout AS (SELECT src AS mer, count(*) AS c FROM edges GROUP BY 1), deg AS (SELECT n.mer, n.coverage, coalesce(i.c, 0) AS indeg, coalesce(o.c, 0) AS outdeg FROM nodes n LEFT JOIN din i USING (mer) LEFT JOIN dout o USING (mer))"
_PEEL = "kept AS (SELECT mer, coverage FROM deg WHERE NOT ((indeg = 0 AND outdeg <= 1) OR (outdeg = 0 AND indeg <= 1)))"


def _graph(spark: SparkSession, d: str):
    return graph.build(V.reads(spark, d), K, cut)


def _marks(spark: SparkSession, d: str, least: int = 2) -> DataFrame:
    return graph.marks(V.reads(spark, d), K, cut, least)


@query(f"WITH {_G} SELECT mer, coverage, CASE WHEN coverage <= 2 THEN 'low' WHEN coverage <= 10 THEN 'medium' WHEN coverage <= 100 THEN 'high' ELSE 'repeat' END AS kind FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """GR2, GR10, GR21, GR24, AG5, PF14, SF38."""
    c = F.col("coverage")
    return graph.spelled(kmers.count_packed(V.reads(spark, d), K).where("n >= 2").select(F.col("packed").alias("mer"), F.col("n").alias("coverage")), K, "mer").withColumn("kind", F.when(c <= 2, "low").when(c <= 10, "medium").when(c <= 100, "high").otherwise("repeat"))


@query(f"WITH {_G} SELECT src, dst, weight FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """GR2, JN2, JN3, JN11, WN2, WN3, AG5, AG6."""
    return graph.spelled(_graph(spark, d)[1], K, "src", "dst")


@query(f"WITH {_G}, {_D} SELECT mer, coverage, indeg, outdeg, indeg = 0 OR outdeg = 0 AS tip FROM deg")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """AG7, GR8."""
    return graph.spelled(graph.degrees(*_graph(spark, d)), K, "mer").withColumn("tip", (F.col("indeg") == 0) | (F.col("outdeg") == 0))


@query(f"WITH {_G}, {_D}, {_PEEL} SELECT src, dst, weight FROM edges SEMI JOIN kept a ON a.mer = src SEMI JOIN kept b ON b.mer = dst")
def graph_peeled(spark: SparkSession, d: str) -> DataFrame:
    """GR3."""
    return graph.spelled(graph.marked_peel(_marks(spark, d), K), K, "src", "dst")


@query(f"WITH {_G}, {_D} SELECT count(*) AS nodes, sum(outdeg)::BIGINT AS edges, round(sum(outdeg) / (count(*)::DOUBLE * (count(*) - 1)), 12) AS density, round(avg(indeg + outdeg), 9) AS mean_degree, round(var_pop(indeg + outdeg), 9) AS var_degree, min(indeg + outdeg) AS min_degree, max(indeg + outdeg) AS max_degree FROM deg")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """GR13, GR14, GR15: one row of figures of the whole graph."""
    return graph.summary_of(graph.marked_degrees(_marks(spark, d))).withColumns({"density": F.round("density", 12), "mean_degree": F.round("mean_degree", 9), "var_degree": F.round("var_degree", 9)})


@query(f"WITH {_G} SELECT src, list_sort(list(dst)) AS neighbours FROM edges GROUP BY 1")
def graph_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """GR7; at most four neighbours follow a k-mer."""
    return graph.spelled(_graph(spark, d)[1], K, "src", "dst").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


_SUP = f"p AS (SELECT DISTINCT read_id, unnest({_kmers(K + 1)}) AS m FROM reads), s AS (SELECT m, count(*) AS reads FROM p GROUP BY 1)"


@query(f"WITH {V.READS_SQL}, {_SUP} SELECT m[1:{K}] AS src, m[2:{K + 1}] AS dst, reads, round(1 - 1 / (1 + reads), 9) AS confidence, CASE WHEN reads = 1 THEN 'single' WHEN reads <= 5 THEN 'low' WHEN reads <= 20 THEN 'medium' ELSE 'high' END AS kind FROM s WHERE reads >= 2")
def graph_support(spark: SparkSession, d: str) -> DataFrame:
    """AG9, SE3, SF38."""
    return graph.support(V.reads(spark, d), K).where("reads >= 2").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {V.READS_SQL}, c AS (SELECT mer, count(*) AS coverage FROM (SELECT unnest({_kmers(K)}) AS mer FROM reads) GROUP BY 1) SELECT mer, coverage FROM c WHERE coverage >= 2")
def graph_merged(spark: SparkSession, d: str) -> DataFrame:
    """JN9, GR11: nodes of the merged graphs of four parts of the reads."""
    r = V.reads(spark, d)
    parts = [kmers.count_packed(r.where(F.col("doc_id") % 4 == i), K).select(F.col("packed").alias("mer"), F.col("n").alias("coverage")) for i in range(4)]
    return graph.spelled(graph.merge_nodes(parts).where("coverage >= 2"), K, "mer")


_TRI = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), d2 AS (SELECT mer, count(*) AS d FROM (SELECT a AS mer FROM u UNION ALL SELECT b FROM u) GROUP BY 1 HAVING count(*) > 1), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), tn AS (SELECT mer, count(*) AS t FROM (SELECT a AS mer FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)"


@query(f"WITH {_G}, {_TRI} SELECT mer, round(2.0 * coalesce(t, 0) / (d * (d - 1)), 9) AS coefficient FROM d2 LEFT JOIN tn USING (mer)")
def graph_clustering(spark: SparkSession, d: str) -> DataFrame:
    """GR16, GR17: local clustering coefficients, by real triangles."""
    return graph.spelled(graph.clustering(cut(_graph(spark, d)[1]), K), K, "mer").withColumn("coefficient", F.round("coefficient", 9))


_CLEAN = "strong AS MATERIALIZED (SELECT mer, coverage FROM nodes WHERE coverage >= 3), ke AS MATERIALIZED (SELECT edges.* FROM edges SEMI JOIN strong a ON a.mer = src SEMI JOIN strong b ON b.mer = dst)"


@query(f"WITH {_G}, {_CLEAN} SELECT 'edge' AS kind, src, dst, weight AS n FROM ke UNION ALL SELECT 'node', mer, NULL, coverage FROM strong WHERE mer IN (SELECT src FROM ke UNION ALL SELECT dst FROM ke)")
def graph_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """GR12: without nodes of a coverage below 3, their edges, and nodes that no edge touches then; nodes and edges that stay."""
    marked = cut(_marks(spark, d, 3))  # its edges are those between strong nodes
    rows = graph.marked_edges(marked, K).select(F.lit("edge").alias("kind"), "src", "dst", F.col("weight").alias("n"))
    return graph.spelled(rows.unionByName(marked.where("ins <> 0 or outs <> 0").select(F.lit("node").alias("kind"), F.col("mer").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("coverage").alias("n"))), K, "src", "dst")


_ENTROPY = "0.0 - (" + " + ".join(f"CASE WHEN contains(mer, '{b}') THEN (({K} - length(replace(mer, '{b}', ''))) / {K}.0) * log2(({K} - length(replace(mer, '{b}', ''))) / {K}.0) ELSE 0 END" for b in "ACGT") + ") / 2"
_KIND = "CASE WHEN indeg = 0 OR outdeg = 0 THEN 4 WHEN coverage <= 2 THEN 2 WHEN coverage <= 10 THEN 0 WHEN coverage <= 100 THEN 3 ELSE 1 END"
_NODE = ["coverage", _ENTROPY, f"{K}", "coverage", f"({K} - length(regexp_replace(mer, '[GC]', '', 'g'))) / {K}.0", *(f"CASE WHEN {_KIND} = {i} THEN 1 ELSE 0 END" for i in range(6)), "indeg", "outdeg", "indeg + outdeg", "coalesce(2.0 * coalesce(t, 0) / (d * (d - 1)), 0)", "coalesce(t, 0)", "coalesce(nd, 0)"]
_NODE += [f"({K} - length(replace(mer, '{b}', ''))) / {K}.0" for b in "ACGT"] + [f"len(list_filter(range(1, {K}), lambda i: mer[i : i + 1] = '{a}{b}')) / {K - 1}.0" for a, b in ("AA", "AC", "AG", "AT", "CA", "CC")]


@query(f"WITH {_G}, {_D}, {_TRI}, near AS (SELECT a AS mer, b AS other FROM u UNION ALL SELECT b, a FROM u), nd AS (SELECT near.mer, avg(indeg + outdeg) AS nd FROM near JOIN deg ON deg.mer = other GROUP BY 1) SELECT mer, {', '.join(f'round(({x})::DOUBLE, 6) AS f{i}' for i, x in enumerate(_NODE))} FROM deg LEFT JOIN d2 USING (mer) LEFT JOIN tn USING (mer) LEFT JOIN nd USING (mer)")
def graph_node_vectors(spark: SparkSession, d: str) -> DataFrame:
    """GR18, GR17: coverage, complexity, size, places, GC; kind; degrees, clustering, triangles, neighbours' degree; shares of bases and pairs."""
    held = cut(blocks.near(blocks.graph(V.reads(spark, d), K), K))
    return blocks.node_vectors(held, K, blocks.triangles(held, K))


_POWER = "near AS MATERIALIZED (SELECT a AS mer, b AS other FROM u UNION ALL SELECT b, a FROM u), x0 AS (SELECT mer, 1.0::DOUBLE AS x FROM nodes)" + "".join(f", y{i} AS MATERIALIZED (SELECT mer, x + coalesce(s, 0) AS x FROM x{i} LEFT JOIN (SELECT near.mer, sum(x) AS s FROM near JOIN x{i} z ON z.mer = other GROUP BY 1) USING (mer)), x{i + 1} AS (SELECT mer, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})" for i in range(centrality.POWER_ROUNDS))


@query(f"WITH {_G}, {_TRI}, {_POWER} SELECT mer, round(x, 6) AS centrality FROM x{centrality.POWER_ROUNDS} WHERE round(x, 6) > 0")
def graph_eigenvector(spark: SparkSession, d: str) -> DataFrame:
    """GR17: eigenvector centrality by ten rounds of power iteration, where it is not 0 to six digits."""
    held = blocks.kept(blocks.near(blocks.graph(V.reads(spark, d), K, coverage=False), K).drop("coverage", "marks"))
    x = blocks.eigenvector(held, cut, centrality.POWER_ROUNDS)
    held.unpersist()
    return graph.spelled(x.select("mer", F.round("x", 6).alias("centrality")).where("centrality > 0"), K, "mer")


@query()
def graph_vector(spark: SparkSession, d: str) -> DataFrame:
    """GR20, GR17: the vector of the whole graph, its paths from every node; tests compare its parts with plain Python."""
    nodes, edges = _graph(spark, d)
    return centrality.graph_vector(nodes, cut(edges), cut, k=K).select("place", "name", F.round("value", 9).alias("value"))


_CC = "und AS MATERIALIZED (SELECT src AS mer, dst AS other FROM edges UNION SELECT dst, src FROM edges), cc(mer, component) USING KEY (mer) AS (SELECT mer, mer FROM nodes UNION SELECT u.mer, min(v.component) FROM cc v JOIN und ON und.other = v.mer JOIN recurring.cc u ON u.mer = und.mer WHERE v.component < u.component GROUP BY u.mer)"


@query(f"WITH RECURSIVE {_G}, {_CC} SELECT component, count(*) AS size FROM cc GROUP BY 1")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """GR17: connected components."""
    nodes, edges = _graph(spark, d)
    return graph.spelled(graph.component_sizes(nodes, edges, cut), K, "component")


@query()
def graph_bubbles(spark: SparkSession, d: str) -> DataFrame:
    """GR9, SE4; branches are followed to their ends."""
    held = blocks.kept(blocks.graph(V.reads(spark, d), K, coverage=False).select("block", "mers", "outs"))
    found = cut(blocks.bubbles(held, K, cut))
    held.unpersist()
    return graph.spelled(found, K, "start", "end")


_UNI = """o AS (SELECT src FROM edges GROUP BY 1 HAVING count(*) = 1), i AS (SELECT dst FROM edges GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT src, dst FROM edges SEMI JOIN o USING (src) SEMI JOIN i USING (dst) WHERE src <> dst),
walk AS (SELECT mer AS head, mer, 0 AS place FROM nodes WHERE mer NOT IN (SELECT dst FROM l) UNION ALL SELECT head, l.dst, place + 1 FROM walk JOIN l ON l.src = walk.mer),
cw AS (SELECT mer AS head, mer, 0 AS place FROM nodes WHERE mer NOT IN (SELECT mer FROM walk) UNION ALL SELECT head, l.dst, place + 1 FROM cw JOIN l ON l.src = cw.mer WHERE l.dst <> head),
every AS (SELECT * FROM walk UNION ALL SELECT * FROM cw WHERE head IN (SELECT head FROM cw GROUP BY head HAVING min(mer) = head)),
uni AS (SELECT head, any_value(head) || coalesce(string_agg(CASE WHEN place > 0 THEN right(every.mer, 1) END, '' ORDER BY place), '') AS seq, count(*) AS nodes, avg(coverage) AS coverage FROM every JOIN nodes USING (mer) GROUP BY head)"""


@query(f"WITH RECURSIVE {_G}, {_UNI} SELECT head, seq, nodes, round(coverage, 6) AS coverage FROM uni")
def contig_unitigs(spark: SparkSession, d: str) -> DataFrame:
    """GR4, GR5, GR6, GR22: unbranched paths, and pure cycles cut at their least node."""
    return graph.spelled(graph.marked_unitigs(cut(_marks(spark, d).select("mer", "coverage", "ins", "outs")), K, cut), K, "head").withColumn("coverage", F.round("coverage", 6))


_NX = "(SELECT max(len) FROM (SELECT len, sum(len) OVER (ORDER BY len DESC) AS cum, sum(len) OVER () AS total FROM contigs) WHERE cum >= floor(total * {}))"


@query(f"WITH {V.CONTIGS_SQL} SELECT count(*) AS contigs, sum(len)::BIGINT AS bases, max(len) AS longest, {_NX.format(0.5)} AS n50, {_NX.format(0.9)} AS n90, round(avg(coverage), 9) AS cov_mean, round(stddev_samp(coverage), 9) AS cov_std, round(sum(len - length(regexp_replace(seq, '[GC]', '', 'g'))) / sum(len), 9) AS gc FROM contigs")
def contig_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG10, AG22, AG30, WN1, SK4."""
    c = V.contigs(spark, d)
    a = c.agg(F.count("*").alias("contigs"), F.sum("len").alias("bases"), F.max("len").alias("longest"), F.round(F.avg("coverage"), 9).alias("cov_mean"), F.round(F.stddev_samp("coverage"), 9).alias("cov_std"), F.round(F.sum(S.count_of(F.col("seq"), "[GC]")) / F.sum("len"), 9).alias("gc"))
    return a.crossJoin(graph.nx(c, 0.5).withColumnRenamed("nx", "n50")).crossJoin(graph.nx(c, 0.9).withColumnRenamed("nx", "n90"))


@query(f"WITH {V.CONTIGS_SQL}, m AS (SELECT list_sort(list(coverage))[count(*) // 2 + 1] AS med FROM contigs) SELECT contig_id, len, coverage FROM contigs, m WHERE len >= 63 AND coverage >= 2 AND coverage BETWEEN 0.5 * med AND 1.5 * med")
def contig_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF15, PF16, ST5: near the upper median coverage, which is found by counts of values and not by a list of all."""
    from pyspark.sql import Window

    c = V.contigs(spark, d)
    by = c.groupBy("coverage").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    med = by.withColumn("cum", F.sum("n").over(w.orderBy("coverage"))).withColumn("total", F.sum("n").over(w)).where(F.col("cum") > F.floor(F.col("total") / 2)).agg(F.min("coverage").alias("med"))
    near = F.col("coverage").between(0.5 * F.col("med"), 1.5 * F.col("med"))
    return c.crossJoin(F.broadcast(med)).where((F.col("len") >= 63) & (F.col("coverage") >= 2) & near).select("contig_id", "len", "coverage")


@query(f"WITH {V.CONTIGS_SQL}, m AS (SELECT max(len) AS most FROM contigs) SELECT least(len * 10 // (most + 1), 9) AS bin, count(*) AS n FROM contigs, m GROUP BY 1")
def sink_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """SK4, SK21."""
    return sinks.length_histogram(V.contigs(spark, d))


@query(f"WITH {V.CONTIGS_SQL} SELECT rtrim(concat(printf('>contig_%d length=%d coverage=%.2f gc=%.4f', contig_id, len, coverage, (len - length(regexp_replace(seq, '[GC]', '', 'g'))) / len), chr(10), regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g')), chr(10)) AS record FROM contigs")
def sink_fasta(spark: SparkSession, d: str) -> DataFrame:
    """SK3."""
    return sinks.fasta(V.contigs(spark, d))


@query(f"WITH {V.CONTIGS_SQL} SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line UNION ALL SELECT concat_ws(chr(9), 'S', contig_id, seq, concat('LN:i:', len), concat('RC:i:', floor(coverage * len)::BIGINT)) FROM contigs UNION ALL SELECT concat_ws(chr(9), 'L', src, '+', dst, '+', '0M') FROM (SELECT contig_id AS src, lead(contig_id) OVER (ORDER BY contig_id) AS dst FROM contigs) WHERE dst IS NOT NULL")
def sink_gfa(spark: SparkSession, d: str) -> DataFrame:
    """SK2."""
    c = V.contigs(spark, d)
    return sinks.gfa(c, sinks.consecutive(c.select("contig_id"), cut), 0)


@query(f"WITH {V.SEQS_SQL} SELECT doc_id, length(seq) AS len FROM seqs ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50")
def sequence_sample(spark: SparkSession, d: str) -> DataFrame:
    """ST2, ST4: a random sample of 50 that is the same in every run."""
    s = V.sequences(spark, d)
    return s.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(50).select("doc_id", F.char_length("seq").cast("long").alias("len"))
