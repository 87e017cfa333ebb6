"""Contigs checked against their sources: breaks made on purpose, plain Python, edges."""

import random

import pytest

from seqlake.operators import misassembly

K = 21
TURN = str.maketrans("ACGT", "TGCA")


def back(s):
    return s[::-1].translate(TURN)


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def by_contig(spark, contigs, sources, **more):
    c = spark.createDataFrame(contigs, "id long, seq string, contig string, word long")
    s = spark.createDataFrame(sources, "name string, seq string")
    return {r.contig: tuple(r)[1:] for r in misassembly.chained(c, s, "id", "name", K, **more).collect()}


@pytest.mark.parametrize("held", [misassembly.HELD, 150])
def test_breaks_of_each_kind(spark, monkeypatch, held):
    monkeypatch.setattr(misassembly, "HELD", held)
    r = random.Random(1)
    a, b, shared = bases(r, 600), bases(r, 500), bases(r, 80)
    sources = [("a", a[:300] + shared + a[300:]), ("b", shared + b), ("none", None), ("short", "ACGT"), ("", "")]
    whole = sources[0][1]
    contigs = {
        1: whole,  # the shared piece is no anchor, and no break
        2: back(whole),
        3: a[:200] + b[100:300],  # two sources
        4: a[:200] + back(a[200:300]),  # a piece turned round
        5: a[:100] + a[200:300],  # 100 bases missing
        6: a[:100] + bases(r, 5) + a[110:300],  # a small gap
        7: a[:100] + "N" * 8 + a[108:300],
        8: bases(r, 200),
        9: b[:100] + a[:100] + b[100:200],
        10: None,
        11: "",
        12: "ACGT",
    }
    got = by_contig(spark, [(i, s, "clash", 1) for i, s in contigs.items()], sources)
    want = {1: (1, 1, 0, 0, 0), 2: (1, 1, 0, 0, 0), 3: (2, 2, 0, 0, 1), 4: (1, 2, 0, 1, 0), 5: (1, 2, 1, 0, 0), 6: (1, 1, 0, 0, 0), 7: (1, 1, 0, 0, 0), 9: (2, 3, 0, 0, 2)}
    assert {i: v[1:] for i, v in got.items()} == want
    # The same by plain Python: places of the k-mers that occur once.
    seen = {}
    for n, s in sources:
        for i in range(len(s or "") - K + 1):
            seen.setdefault(min(s[i : i + K], back(s[i : i + K])), []).append((n, i))
    once = {m for m, p in seen.items() if len(p) == 1}
    plain = {c: sum(min(s[i : i + K], back(s[i : i + K])) in once for i in range(len(s) - K + 1)) for c, s in contigs.items() if s}
    assert {i: v[0] for i, v in got.items()} == {i: n for i, n in plain.items() if n}


def test_slack_and_empty_tables(spark):
    r = random.Random(2)
    a = bases(r, 400)
    contigs = [(1, a[:100] + a[130:300], "", 0)]
    assert by_contig(spark, contigs, [("a", a)])[1][2:] == (2, 1, 0, 0)
    assert by_contig(spark, contigs, [("a", a)], slack=30)[1][2:] == (1, 0, 0, 0)
    assert by_contig(spark, [], [("a", a)]) == {} and by_contig(spark, contigs, []) == {}
    with pytest.raises(ValueError):
        misassembly.placed(spark.createDataFrame([], "id long, seq string"), "id", 20, "id")


def test_quality_of_no_contigs_and_of_gaps(spark):
    reads = spark.createDataFrame([(400,)], "read_bases long")
    shape = "contig_id long, seq string, len long, coverage double"
    assert tuple(misassembly.quality(spark.createDataFrame([], shape), reads).first()) == (0, 0, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    two = spark.createDataFrame([(1, "ACGN" * 25, 100, 5.0), (2, "ACGT" * 10 + "n" * 10, 50, 5.0)], shape)
    spread = 25 / 75
    accuracy = 25 + 50 * (1 - spread)
    assert tuple(misassembly.quality(two, reads).first()) == (2, 150, 1, round(1 - spread, 9), 37.5, round(accuracy, 9), 7.5, round(3500 / 150, 9), round((37.5 + accuracy) / 2, 9))
