"""K-mers within reads and distinct k-mers of sources."""

import random

import pytest
from pyspark.sql import functions as F

from seqlake.operators import kmers, superkmers
from seqlake.plans import registry

from .test_blocks import of_table, shuffled


@pytest.mark.parametrize("k", [1, 4, 33])
def test_unrepeated_equals_windows(spark, k):
    r = random.Random(k)
    texts = ["".join(r.choices("ACGTN", [9, 3, 1, 1, 1], k=r.randrange(90))) for _ in range(40)] + ["A" * 80, "AC" * 40, "AAAANAAAANCAAAA", "aÉACGTACGTAAAA", "", "ACG", "N" * 50]
    reads = spark.createDataFrame([*enumerate(texts), (99, None)], "read_id long, seq string").repartition(3)
    want = kmers.without_repeats(kmers.positions(reads, k))
    assert sorted(map(tuple, kmers.unrepeated(reads, k).collect())) == sorted(map(tuple, want.collect()))


def test_reads_are_not_shuffled(spark, tmp_path):
    of_table(tmp_path, spark, ["aaaaabcde" * 40 for _ in range(50)])
    before = shuffled(spark)
    registry.queries()["kmer_without_repeats"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    # 50 documents and their ids are dealt, and none of the reads' 17,550 k-mers.
    assert shuffled(spark) - before <= 200


def test_documents_of_one_id(spark, tmp_path):
    rows = [(1, "aabbccdd" * 30), (1, "aabbccdd" * 30), (2, "ababab"), (None, "aaaaaaaab")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["kmer_without_repeats"](spark, str(tmp_path)).collect()
    # Copies under one id are one read, as for SQL's lag().
    assert len(got) == len(set(map(tuple, got))) and {r.read_id for r in got} == {1 * 10**8, 1 * 10**8 + 1, 2 * 10**8, None}
    assert sorted((r.pos, r.mer) for r in got if r.read_id is None) == [(0, "AAAA"), (5, "AAAC")]


@pytest.mark.parametrize("k", [3, 10, 13, 16])
def test_ranges_equal_distinct(spark, monkeypatch, k):
    r = random.Random(k)
    rows = [(r.choice(["a", "b", None]), "".join(r.choices("ACGT", k=r.randrange(400))) + r.choice(["", "N", "\u00c9A"])) for _ in range(60)]
    reads = spark.createDataFrame([*rows, ("c", None), ("d", "AC")], "source string, seq string").repartition(3)
    want = kmers.distinct(reads, "source", k).select("source", superkmers.letters([F.col("packed")], k).alias("mer"))
    found = kmers.ranges(reads, "source", k)
    assert sorted(map(str, kmers.spelled(found, "source", k).collect())) == sorted(map(str, want.collect()))
    assert {x.source: x.n for x in found.groupBy("source").agg(F.sum("n").alias("n")).collect()} == {x.source: x.n for x in want.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert kmers.joint(found).agg(F.sum("n").alias("n")).first().n == want.select("mer").distinct().count()


def test_sketch_writes_no_row_for_each_kmer(spark, tmp_path):
    r = random.Random(3)
    of_table(tmp_path, spark, ["".join(r.choices("ABCD", k=140)) for _ in range(400)])
    before = shuffled(spark)
    got = {x.source: x for x in registry.queries()["sketch_distinct"](spark, str(tmp_path)).collect()}
    assert got["s"].exact == got["all"].exact > 50_000 and abs(got["s"].estimate / got["s"].exact - 1) < 0.05
    # 64 ranges of a source from each of four tasks, twice.
    assert shuffled(spark) - before < 2000
