"""The store: imports that are seen whole or not at all."""

import pytest

from seqlake.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def test_insert_or_ignore(spark, store):
    assert store.insert("taxa", table(spark, (1, "b"), (1, "a"), (2, "c"), (None, "x")), "id") == 2
    assert store.insert("taxa", table(spark, (2, "other"), (3, None)), "id") == 1
    assert {tuple(r) for r in store.read("taxa").collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert {tuple(r) for r in store.read("taxa", 1).collect()} == {(1, "a"), (2, "c")}
    assert store.insert("taxa", table(spark).limit(0), "id") == 0 and store.manifest("taxa")["rows"] == 3
    store.compact("taxa")
    assert store.vacuum("taxa") == 3 and store.versions("taxa") == [4] and store.read("taxa").count() == 3
    with pytest.raises(LookupError):
        store.read("nothing")


def test_an_import_that_dies_is_not_seen(spark, store, monkeypatch):
    store.insert("taxa", table(spark, (1, "a")), "id")
    monkeypatch.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.insert("taxa", table(spark, (2, "b")), "id")
    monkeypatch.undo()
    assert store.read("taxa").count() == 1 and store.versions("taxa") == [1]
    assert store.vacuum("taxa") == 1 and store.insert("taxa", table(spark, (2, "b")), "id") == 1


def test_a_task_that_dies_writes_nothing_seen(spark, store):
    from pyspark.sql import functions as F

    bad = table(spark, (1, "a"), (2, "b")).withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.insert("taxa", bad, "id")
    assert store.versions("taxa") == []


def test_two_imports_at_once(spark, store, monkeypatch):
    commit, calls = Store._commit, []

    def late(self, name, state):
        if not calls:
            calls.append(1)
            assert Store(spark, store.root).insert("taxa", table(spark, (2, "first")), "id") == 1
        commit(self, name, state)

    monkeypatch.setattr(Store, "_commit", late)
    assert store.insert("taxa", table(spark, (1, "a"), (2, "second")), "id") == 1
    assert {tuple(r) for r in store.read("taxa").collect()} == {(1, "a"), (2, "first")}
    monkeypatch.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(Conflict()))
    with pytest.raises(Conflict):
        store.insert("taxa", table(spark, (9, "z")), "id")


def test_assembly_by_sample(spark, store):
    assert store.assembly("s1") is None
    store.insert("assemblies", spark.createDataFrame([("s1", 5, 10.5)], "sample_name string, contigs long, n50 double"), "sample_name")
    assert store.assembly("s1") == {"sample_name": "s1", "contigs": 5, "n50": 10.5} and store.assembly("s2") is None
