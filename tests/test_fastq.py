"""FASTQ over splits cut anywhere, against plain Python; malformed records."""

import random

import pytest

from seqlake.plans.shared import cut
from seqlake.sources import fastq


def plain(lines):
    work = fastq.Splitter(True)
    out = list(work.feed(lines, last=True))
    return out + ([(work.lines[0], None, None, "incomplete")] if any(work.lines) else [])


def records(rnd, n):
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 5, 40])
        seq = "".join(rnd.choice("ACGTN") for _ in range(size))
        quality = "".join(rnd.choice("@+IF#A") for _ in range(size))
        out += [f"@read {i}", seq, rnd.choice(["+", f"+read {i}"]), quality]
    return out


@pytest.mark.parametrize("size", [23, 90, 10**6])
def test_splits_cut_anywhere(spark, tmp_path, size):
    rnd = random.Random(size)
    files = {f"a{i}.fastq": records(rnd, n) for i, n in enumerate((0, 1, 9))}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = fastq.scan(spark, str(tmp_path), cut).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, lines in files.items():
        got = sorted((r.read_id, r.header, r.seq, r.quality, r.problem) for r in rows if r.file.endswith("/" + name))
        assert got == [(i, *r) for i, r in enumerate(plain(lines))] and all(r[-1] is None for r in got) and len(got) == len(lines) // 4


def test_malformed_records_are_reported(spark, tmp_path):
    lines = ["@a", "ACGT", "+", "IIII", "@b", "ACGT", "+", "III", "@c", "AC", "+", "II", "garbage", "", "@d", "AC", "x", "II", "@e", "A", "+", "@", "@f", "A"]
    (tmp_path / "x.fq").write_text("\n".join(lines))
    rows = fastq.scan(spark, str(tmp_path / "x.fq"), cut).orderBy("read_id").collect()
    assert [(r.header, r.problem) for r in rows] == [("a", None), ("@b", "lengths of sequence and quality differ"), ("c", None), ("garbage", "no header"), ("e", None), ("@f", "incomplete")]
    s = fastq.summary(fastq.scan(spark, str(tmp_path / "x.fq"), cut)).first()
    assert (s.reads, s.malformed, s.bases, round(s.mean_length, 6), round(s.gc, 6)) == (3, 3, 7, round(7 / 3, 6), round(3 / 7, 6))
    assert round(s.mean_quality, 6) == round((6 * 40 + 31) / 7, 6)
