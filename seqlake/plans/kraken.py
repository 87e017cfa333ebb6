"""A taxonomy of documents, and every twentieth document classified by the k-mers that it shares with the others.

The ranks follow from language, source and id: language, source, then the id modulo 2, 4, 8, 16 and 32, then the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import taxonomy
from ..operators.taxonomy import RANKS
from . import views as V
from .registry import query
from .scalars import _kmers
from .shared import cut

K = 16
_PARTS = {"phylum": 2, "class": 4, "order": 8, "family": 16, "genus": 32}
_NAMES = ["lang", "source", *(f"concat('{r[0]}', doc_id % {n})" for r, n in _PARTS.items()), "concat('s', doc_id)"]
_ID = "cast('0x' || substring(md5({}), 1, 15) AS BIGINT)"
_LIN = f"lin AS MATERIALIZED (SELECT doc_id, seq, {', '.join(f'{n} AS n{i}' for i, n in enumerate(_NAMES))}, " + ", ".join(f"{_ID.format(' || chr(124) || '.join(f'({n})' for n in _NAMES[: i + 1]))} AS i{i}" for i in range(8)) + " FROM seqs)"
_TREE = "tree AS MATERIALIZED (" + " UNION ".join(f"SELECT i{i} AS taxid, '{r}' AS rank, n{i} AS name, {i + 1} AS depth, concat_ws('|', {', '.join(f'n{j}' for j in range(i + 1))}) AS lineage FROM lin" for i, r in enumerate(RANKS)) + " UNION SELECT 1, 'root', 'root', 0, '')"
_UP = "up AS MATERIALIZED (" + " UNION ".join(f"SELECT i{i} AS taxid, i{j} AS ancestor, {j + 1} AS depth FROM lin" for i in range(8) for j in range(i + 1)) + "".join(f" UNION SELECT i{i}, 1, 0 FROM lin" for i in range(8)) + " UNION SELECT 1, 1, 0)"
_SAME = " ".join(f"WHEN min(i{i}) = max(i{i}) THEN min(i{i})" for i in reversed(range(8)))
_CLS = f"""{V.SEQS_SQL}, {_LIN}, {_TREE}, {_UP}, own AS MATERIALIZED (SELECT doc_id, mer, count(*) AS n FROM (SELECT doc_id, unnest({_kmers(K)}) AS mer FROM lin WHERE doc_id % 20 = 0) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, mer FROM (SELECT doc_id, unnest({_kmers(K)}) AS mer FROM lin WHERE doc_id % 20 <> 0) WHERE mer IN (SELECT mer FROM own)),
db AS MATERIALIZED (SELECT mer, CASE {_SAME} ELSE 1 END AS taxid FROM held JOIN lin USING (doc_id) GROUP BY mer),
hits AS MATERIALIZED (SELECT doc_id, coalesce(taxid, 0) AS taxid, sum(n)::BIGINT AS n FROM own LEFT JOIN db USING (mer) GROUP BY ALL),
score AS (SELECT a.doc_id, a.taxid, sum(b.n) AS score FROM hits a JOIN up ON up.taxid = a.taxid JOIN hits b ON b.doc_id = a.doc_id AND b.taxid = up.ancestor WHERE a.taxid <> 0 GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM score QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY score DESC) = 1),
ties AS (SELECT doc_id, count(*) AS ties, any_value(score) AS score FROM best GROUP BY 1),
shared AS (SELECT best.doc_id, ancestor, max(up.depth) AS depth, count(*) AS c FROM best JOIN up USING (taxid) GROUP BY best.doc_id, ancestor),
chosen AS (SELECT doc_id, arg_max(ancestor, depth) AS taxid, any_value(ties.score) AS score FROM shared JOIN ties USING (doc_id) WHERE c = ties GROUP BY doc_id),
listed AS (SELECT doc_id, sum(n)::BIGINT AS total_kmers, coalesce(sum(n) FILTER (taxid <> 0), 0)::BIGINT AS classified_kmers, string_agg(concat(taxid, ':', n), ' ' ORDER BY taxid) AS kmers FROM hits GROUP BY 1),
cls AS MATERIALIZED (SELECT l.doc_id, length(seq) AS len, coalesce(taxid, 0) AS taxid, coalesce(score, 0)::BIGINT AS score, coalesce(total_kmers, 0) AS total_kmers, coalesce(classified_kmers, 0) AS classified_kmers, coalesce(kmers, '') AS kmers FROM lin l LEFT JOIN listed USING (doc_id) LEFT JOIN chosen USING (doc_id) WHERE l.doc_id % 20 = 0)"""


def _taxonomy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(sequences with ids, nodes)."""
    i = F.col("doc_id")
    names = {"domain": F.col("lang"), "kingdom": F.col("source"), **{r: F.concat(F.lit(r[0]), (i % n).cast("string")) for r, n in _PARTS.items()}, "species": F.concat(F.lit("s"), i.cast("string"))}
    placed = taxonomy.with_ids(V.sequences(spark, d).withColumns(names))
    return placed, taxonomy.tree(placed)


def _classified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified queries, nodes, closure)."""
    placed, nodes = _taxonomy(spark, d)
    nodes = cut(nodes)
    up = cut(taxonomy.closure(nodes))
    asked = placed.where("doc_id % 20 = 0")
    hits = cut(taxonomy.kmer_hits(asked, placed.where("doc_id % 20 <> 0"), "doc_id", K, cut))
    found = taxonomy.classify_hits(asked, hits, up, "doc_id")
    return cut(found.join(asked.select("doc_id", F.char_length("seq").cast("long").alias("len")), "doc_id")), nodes, up


@query(f"WITH {_CLS} SELECT doc_id, taxid, score, total_kmers, classified_kmers, concat_ws(chr(9), CASE WHEN taxid = 0 THEN 'U' ELSE 'C' END, doc_id, taxid, len, kmers) AS line FROM cls")
def kraken_sequences(spark: SparkSession, d: str) -> DataFrame:
    """SK13: a line for each sequence with its state, node, real length and k-mers by node."""
    c = _classified(spark, d)[0]
    line = F.concat_ws("\t", F.when(F.col("taxid") == 0, "U").otherwise("C"), F.col("doc_id").cast("string"), F.col("taxid").cast("string"), F.col("len").cast("string"), "kmers")
    return c.select("doc_id", "taxid", "score", "total_kmers", "classified_kmers", line.alias("line"))


@query(f"WITH {_CLS} SELECT count(*) AS sequences, count(*) FILTER (taxid <> 0) AS classified, count(*) FILTER (taxid = 0) AS unclassified, round(count(*) FILTER (taxid <> 0) / count(*)::DOUBLE, 9) AS rate, count(DISTINCT taxid) FILTER (taxid <> 0) AS taxa, sum(total_kmers)::BIGINT AS total_kmers, sum(classified_kmers)::BIGINT AS classified_kmers FROM cls")
def kraken_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG19."""
    hit = F.col("taxid") != 0
    n = F.count_if(hit)
    return _classified(spark, d)[0].agg(F.count("*").alias("sequences"), n.alias("classified"), F.count_if(~hit).alias("unclassified"), F.round(n / F.count("*"), 9).alias("rate"), F.countDistinct(F.when(hit, F.col("taxid"))).alias("taxa"), F.sum("total_kmers").alias("total_kmers"), F.sum("classified_kmers").alias("classified_kmers"))


_CLADE = f"{_CLS}, clade AS (SELECT ancestor AS taxid, count(*) AS clade_n, count(*) FILTER (up.taxid = ancestor) AS own_n, sum(classified_kmers)::BIGINT AS clade_kmers FROM cls JOIN up USING (taxid) GROUP BY 1)"


@query(f"WITH {_CLADE} SELECT rank, name, sum(clade_n)::BIGINT AS n FROM clade JOIN tree USING (taxid) GROUP BY ALL")
def kraken_ranks(spark: SparkSession, d: str) -> DataFrame:
    """AG21, SF37: sequences by name at all eight ranks, and at the root."""
    c, nodes, up = _classified(spark, d)
    direct = c.where("taxid <> 0").select("taxid", F.lit(1).alias("n"))
    return taxonomy.clades(direct, nodes, up, "n").groupBy("rank", "name").agg(F.sum("clade_n").alias("n"))


@query(f"WITH {_CLADE} SELECT concat_ws(chr(9), printf('%.2f', 100.0 * clade_n / (SELECT count(*) FROM cls WHERE taxid <> 0)), clade_n, own_n, clade_kmers, substring('RDKPCOFGS', depth + 1, 1), taxid, name, lineage) AS line FROM clade JOIN tree USING (taxid)")
def kraken_report(spark: SparkSession, d: str) -> DataFrame:
    """SK14, AG20, SF37: percent, sequences of the clade and of the node itself, k-mers, rank, node, name, lineage of all its ranks."""
    c, nodes, up = _classified(spark, d)
    direct = c.where("taxid <> 0").select("taxid", F.lit(1).alias("n"), F.col("classified_kmers").alias("kmers"))
    each = taxonomy.clades(direct, nodes, up, "n", "kmers").crossJoin(F.broadcast(direct.agg(F.count("*").alias("total"))))
    letter = F.element_at(F.array(*map(F.lit, ("R", *taxonomy.LETTERS))), F.col("depth") + 1)
    return each.select(F.concat_ws("\t", S.fixed(100.0 * F.col("clade_n") / F.col("total"), 2), F.col("clade_n").cast("string"), F.col("own_n").cast("string"), F.col("clade_kmers").cast("string"), letter, F.col("taxid").cast("string"), "name", "lineage").alias("line"))
