"""Graphs in blocks against the tables of nodes and edges."""

import random

import pytest
from pyspark.sql import functions as F

from seqlake.operators import blocks, centrality, graph
from seqlake.plans import registry
from seqlake.plans.shared import cut


def sequences(k):
    r = random.Random(k)
    words = ["".join(r.choices("ACGT", k=20)) for _ in range(6)]
    rows = [("".join(r.choices(words, k=4)) + r.choice(["", "N", "AC"]) + "".join(r.choices(words, k=2)),) for _ in range(12)]
    return [*rows, *rows[:6], ("A" * 40,), ("A" * 40 + "C",), ("ACG" * 15,), ("AC" * 20,), ("AC" * 20,), (None,), ("",), ("ACG",), ("NNNN",)]


def of_table(path, spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("k, number", [(2, 3), (3, 7), (4, 128), (15, 5), (31, 3)])
def test_blocks_equal_tables(spark, monkeypatch, k, number):
    monkeypatch.setattr(blocks, "BLOCKS", number)
    monkeypatch.setattr(blocks, "TASKS", 2)
    reads = spark.createDataFrame(sequences(k), "seq string").repartition(3)
    nodes, edges = (cut(x) for x in graph.build(reads, k, cut))
    held = cut(blocks.near(blocks.graph(reads, k), k))
    # Powers of nodes, told in 4 bytes and in 8.
    both = cut(centrality.both_ways(edges))
    for rounds in (2, 10, 11):
        want = {r.mer: round(r.x, 12) for r in centrality.eigenvector(nodes, both, cut, rounds).collect()}
        kept = blocks.kept(held)
        assert {r.mer: round(r.x, 12) for r in blocks.eigenvector(kept, cut, rounds).collect()} == want
        kept.unpersist()
    v = centrality.node_vectors(centrality.node_figures(nodes, edges, k), graph.letters([F.col("mer")], k), k)
    want = v.select("mer", *(F.round(F.get("v", F.lit(i)), 6) for i in range(27))).collect()
    got = blocks.node_vectors(held, k, blocks.triangles(held, k)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_blocks_of_no_kmers(spark):
    held = cut(blocks.near(blocks.graph(spark.createDataFrame([("ACGT",), (None,)], "seq string"), 15), 15))
    kept = blocks.kept(held)
    assert not blocks.eigenvector(kept, cut, 10).count() and not blocks.node_vectors(held, 15, blocks.triangles(held, 15)).count()
    kept.unpersist()


@pytest.mark.parametrize("name", ["graph_eigenvector", "graph_node_vectors"])
def test_blocks_write_no_row_for_each_node(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(blocks, "BLOCKS", 4)
    monkeypatch.setattr(blocks, "TASKS", 4)
    r = random.Random(1)
    texts = ["".join(r.choices("ABCD", k=140)) for _ in range(400)]  # letters of all four bases
    of_table(tmp_path, spark, [*texts, *texts])
    before = shuffled(spark)
    # A text has 126 15-mers; rows of pieces are fewer, and messages of blocks fewer still.
    assert registry.queries()[name](spark, str(tmp_path)).count() > 400 * 125
    assert shuffled(spark) - before < 400 * 126 / 2


@pytest.mark.parametrize("k, number", [(3, 7), (4, 128), (7, 5), (15, 16)])
def test_bubbles_equal_tables(spark, monkeypatch, k, number):
    monkeypatch.setattr(blocks, "BLOCKS", number)
    monkeypatch.setattr(blocks, "TASKS", 2)
    monkeypatch.setattr(blocks, "STRIDE", 3)
    r = random.Random(k)
    left, right, other = ("".join(r.choices("ACGT", k=40)) for _ in range(3))
    # Branches of equal and of unequal length that meet after more steps than k, a ring that two branches come to, and one a start's branches end in.
    texts = [left + mid + right for mid in ("A", "C", "GGT")] + [other[:20] + b + other[21:] for b in "ACGT"] + [left[:25] + "AC" * 15, left[:25] + "CA" * 15, "G" * 40, "ACG" * 15]
    reads = spark.createDataFrame([(x,) for x in texts for _ in range(2)], "seq string").repartition(2)
    want = sorted(map(tuple, graph.bubbles(cut(graph.build(reads, k, cut)[1])).collect()))
    held = blocks.kept(blocks.graph(reads, k, coverage=False).select("block", "mers", "outs"))
    assert sorted(map(tuple, blocks.bubbles(held, k, cut).collect())) == want and (want or k < 7)
    held.unpersist()


def test_bubbles_of_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "BLOCKS", 8)
    monkeypatch.setattr(blocks, "TASKS", 2)
    r = random.Random(2)
    left, right = ("".join(r.choices("ABCD", k=40)) for _ in range(2))
    of_table(tmp_path, spark, [left + x + right for x in "ABAB"])
    # A letter that differs in two of four reads parts them for 15 k-mers.
    acgt = str.maketrans("ABCD", "ACGT")
    got = [tuple(x) for x in registry.queries()["graph_bubbles"](spark, str(tmp_path)).collect()]
    assert got == [(left[-15:].translate(acgt), right[:15].translate(acgt), 2, "simple")]
