"""A taxonomy of eight ranks as a tree, sums over clades, lowest common ancestors, and classification by k-mers.

A lineage is a column of names for each rank. A node's id is a portable hash of the names from the top down to it, so ids need no numbering over the
table and are the same in every run; the root is ROOT. The closure (every node with each of its ancestors) makes sums over clades and common
ancestors one join and one aggregation each.

The common ancestor of any number of nodes is found by the least and greatest id at each rank: a rank at which both are equal
is common to all. So the ancestor of a k-mer that millions of sequences share is a few numbers that tasks reduce before they
meet, and never a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from . import superkmers

#: The ranks from the top, and the letters that reports have for them.
RANKS = ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")
LETTERS = ("D", "K", "P", "C", "O", "F", "G", "S")
ROOT = 1


def with_ids(lineages: DataFrame) -> DataFrame:
    """Adds id_<rank> of each rank that has a name; a rank without a name ends the lineage."""
    out, path, ids = lineages, None, {}
    for r in RANKS:
        path = F.col(r) if path is None else F.concat(path, F.lit("|"), F.col(r))
        ids[f"id_{r}"] = S.portable_hash(path)
    return out.withColumns(ids)


def tree(lineages: DataFrame) -> DataFrame:
    """(taxid, parent, rank, name, depth, lineage) of all nodes of lineages with ids, and the root."""
    node = lambda d, r: F.struct(
        F.col(f"id_{r}").alias("taxid"), (F.col(f"id_{RANKS[d - 1]}") if d else F.lit(ROOT).cast("long")).alias("parent"), F.lit(r).alias("rank"), F.col(r).alias("name"),
        F.lit(d + 1).alias("depth"), F.concat_ws("|", *RANKS[: d + 1]).alias("lineage"),
    )
    rows = lineages.select(F.explode(F.array(*(node(d, r) for d, r in enumerate(RANKS)))).alias("x")).select("x.*").where("taxid is not null").distinct()
    root = lineages.sparkSession.range(1, numPartitions=1).select(F.lit(ROOT).cast("long").alias("taxid"), F.lit(None).cast("long").alias("parent"), F.lit("root").alias("rank"), F.lit("root").alias("name"), F.lit(0).alias("depth"), F.lit("").alias("lineage"))
    return rows.unionByName(root)


def closure(nodes: DataFrame, most: int = len(RANKS)) -> DataFrame:
    """(taxid, ancestor, depth): every node with itself and each node above it, depth being the ancestor's; one join for each step up."""
    above = nodes.select(F.col("taxid").alias("ancestor"), "parent", "depth")
    step = nodes.select("taxid", F.col("taxid").alias("ancestor"), "parent", "depth")
    out = step
    for _ in range(most):
        step = step.where("parent is not null").select("taxid", F.col("parent").alias("ancestor")).join(above, "ancestor").select("taxid", "ancestor", "parent", "depth")
        out = out.unionByName(step)
    return out.select("taxid", "ancestor", "depth")


def common(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, taxid): the lowest common ancestor of each key's rows with ids."""
    ends = [f(f"id_{r}").alias(f"{n}_{r}") for r in RANKS for n, f in (("lo", F.min), ("hi", F.max))]
    missing = [F.max(F.col(f"id_{r}").isNull()).alias(f"no_{r}") for r in RANKS]
    one = rows.groupBy(*keys).agg(*ends, *missing)
    same = [F.when((F.col(f"lo_{r}") == F.col(f"hi_{r}")) & ~F.col(f"no_{r}"), F.col(f"lo_{r}")) for r in reversed(RANKS)]
    return one.select(*keys, F.coalesce(*same, F.lit(ROOT).cast("long")).alias("taxid"))


def kmer_ancestors(sequences: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """(mer, taxid): of each k-mer the lowest common ancestor of the sequences (seq, with ids) that hold it; only: k-mers to keep."""
    ids = [f"id_{r}" for r in RANKS]
    placed = sequences.select(*ids, F.explode(F.array_distinct(S.clean_kmers(F.col("seq"), k))).alias("mer"))
    if only is not None:
        placed = placed.join(only, "mer", "left_semi")
    return common(placed, "mer")


def kmer_hits(queries: DataFrame, known: DataFrame, key: str, k: int, cut) -> DataFrame:
    """(key, taxid, n): how many k-mers of each query have which node, the lowest common ancestor of the known sequences (seq, with ids) that
    hold it; 0 for none. key: a column of 64-bit numbers.

    Lineages in the order of their ids are the leaves of the tree from left to right, so the ancestor of any number of them is that of the first
    and the last: two numbers for each k-mer, and no k-mer as letters beside its ids."""
    ids = [f"id_{r}" for r in RANKS]
    leaf = F.coalesce(*reversed(ids), F.lit(ROOT).cast("long"))
    known = known.withColumn("__leaf", leaf)
    order = cut(known.select("__leaf", *ids).distinct().orderBy(*ids).withColumn("__place", F.monotonically_increasing_id()))
    placed = known.select("__leaf", "seq").join(order.select("__leaf", "__place"), "__leaf")
    met = cut(superkmers.meetings(queries, placed, key, "__place", k))
    side = lambda n: order.select(F.col("__place").alias(n), *(F.col(i).alias(f"{n}_{i}") for i in ids))
    both = met.select("lo", "hi").where("lo is not null").distinct().join(side("lo"), "lo").join(side("hi"), "hi")
    same = [F.when(F.col(f"lo_{i}") == F.col(f"hi_{i}"), F.col(f"lo_{i}")) for i in reversed(ids)]
    node = both.select("lo", "hi", F.coalesce(*same, F.lit(ROOT).cast("long")).alias("taxid"))
    return met.join(node, ["lo", "hi"], "left").groupBy(F.col("key").alias(key), F.coalesce("taxid", F.lit(0)).cast("long").alias("taxid")).agg(F.sum("n").alias("n"))


def classify(queries: DataFrame, ancestors: DataFrame, up: DataFrame, key: str, k: int, cut) -> DataFrame:
    """(key, taxid, score, total_kmers, classified_kmers, kmers): each query's k-mers are looked up; a node's score is the number of k-mers on its path
    to the root, the best node is the query's, of nodes with equal scores their lowest common ancestor. Without any hit the taxid is 0.
    kmers: taxid:count by taxid, 0 for k-mers without a node. A query that has no k-mers is unclassified."""
    own = queries.select(key, F.explode(S.clean_kmers(F.col("seq"), k)).alias("mer")).groupBy(key, "mer").agg(F.count("*").alias("n"))
    return classify_hits(queries, cut(own.join(ancestors, "mer", "left").groupBy(key, F.coalesce("taxid", F.lit(0)).alias("taxid")).agg(F.sum("n").alias("n"))), up, key)


def classify_hits(queries: DataFrame, hits: DataFrame, up: DataFrame, key: str) -> DataFrame:
    """classify() by written hits (key, taxid, n)."""
    real = hits.where("taxid <> 0")
    paths = real.select(key, "taxid").join(up.select("taxid", "ancestor"), "taxid")
    score = paths.join(real.select(key, F.col("taxid").alias("ancestor"), "n"), [key, "ancestor"]).groupBy(key, "taxid").agg(F.sum("n").alias("score"))
    best = score.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))).where("r = 1")
    ties = best.groupBy(key).agg(F.count("*").alias("ties"), F.first("score").alias("score"))
    shared = best.join(up, "taxid").groupBy(key, "ancestor").agg(F.count("*").alias("c"), F.max("depth").alias("depth")).join(ties, key).where("c = ties")
    chosen = shared.groupBy(key).agg(F.max_by("ancestor", "depth").alias("taxid"), F.first("score").alias("score"))
    listed = hits.groupBy(key).agg(
        F.sum("n").alias("total_kmers"), F.sum(F.when(F.col("taxid") != 0, F.col("n")).otherwise(0)).alias("classified_kmers"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("taxid", "n"))), lambda x: F.concat_ws(":", x["taxid"].cast("string"), x["n"].cast("string"))), " ").alias("kmers"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return queries.select(key).join(listed, key, "left").join(chosen, key, "left").select(key, zero("taxid"), zero("score"), zero("total_kmers"), zero("classified_kmers"), F.coalesce("kmers", F.lit("")).alias("kmers"))


def clades(direct: DataFrame, nodes: DataFrame, up: DataFrame, *sums: str) -> DataFrame:
    """(taxid, rank, name, depth, lineage, own_<sum>, clade_<sum>) of nodes with anything in their clade; direct: (taxid, sums)."""
    each = direct.groupBy("taxid").agg(*(F.sum(s).alias(s) for s in sums))
    whole = each.join(up.select("taxid", "ancestor"), "taxid").groupBy(F.col("ancestor").alias("taxid")).agg(*(F.sum(s).alias(f"clade_{s}") for s in sums), *(F.sum(F.when(F.col("taxid") == F.col("ancestor"), F.col(s)).otherwise(0)).alias(f"own_{s}") for s in sums))
    return nodes.select("taxid", "rank", "name", "depth", "lineage").join(whole, "taxid")
