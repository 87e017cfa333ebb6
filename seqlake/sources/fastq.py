"""FASTQ files read split by split, without a shuffle of reads.

A split of a file may begin anywhere. A task that reads one looks for the first place where a record can begin: a line that starts with '@', a line of
letters alone, and a line that starts with '+'. A quality line may start with '@', but then a header follows and no line of letters, so
the first such place is a record's begin. From there on records are four lines each and leave the task as they are.

What a split has before its first record, and the incomplete record at its end, are fragments: a few lines of each split. Fragments that follow
each other are put together by file and place, and only they are shuffled. A split in which no record begins is a fragment whole.

A record whose lines do not fit (no '+' line, letters missing, lengths of sequence and quality that differ) is reported with its problem, and the
search for a begin starts again after its first line. Blank lines between records, and blanks at lines' ends, are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[A-Za-z.*-]*\Z")
_ROW = "file string, block bigint, part int, place bigint, header string, seq string, quality string, problem string, lines array<string>"
_NAMES = ["file", "block", "part", "place", "header", "seq", "quality", "problem", "lines"]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
#: Parts of a split in the order of the file: what goes before its first record, its records, and what its last lines go on to.
HEAD, RECORDS, TAIL = 0, 1, 2
_AT_ONCE = 4096


def begins(lines: list[str], i: int) -> bool | None:
    """Whether a record begins at line i; None if the lines at hand do not tell."""
    if not lines[i].startswith("@"):
        return False
    if i + 1 >= len(lines):
        return None
    if not _LETTERS.match(lines[i + 1]):
        return False
    return None if i + 2 >= len(lines) else lines[i + 2].startswith("+")


def problem_of(lines: list[str]) -> str | None:
    """What is wrong with four lines as a record."""
    if not lines[0].startswith("@"):
        return "no header"
    if not _LETTERS.match(lines[1]):
        return "not a sequence"
    if not lines[2].startswith("+"):
        return "no plus line"
    return None if len(lines[1]) == len(lines[3]) else "lengths of sequence and quality differ"


class Splitter:
    """The automaton over the lines of one split. at_begin: the first line is known to begin a record, or to be a problem."""

    def __init__(self, at_begin: bool) -> None:
        self.lines: list[str] = []
        self.head: list[str] = []
        self.synced = at_begin

    def feed(self, lines: list[str], last: bool = False) -> Iterator[tuple[str | None, str | None, str | None, str | None]]:
        """(header, seq, quality, problem) of what is complete. After the last lines self.lines is the incomplete end."""
        held, i = self.lines + lines, 0
        while i < len(held):
            if not self.synced:
                state = begins(held, i)
                if state is None:
                    break
                if not state:
                    self.head.append(held[i])
                    i += 1
                    continue
                self.synced = True
            if not held[i]:
                i += 1
                continue
            if len(held) - i < 4:
                break
            wrong = problem_of(held[i : i + 4])
            if wrong:
                yield held[i], None, None, wrong
                i += 1
                # Lines up to the next begin belong to the broken record.
                while i < len(held) and begins(held, i) is False:
                    i += 1
                continue
            yield held[i][1:], held[i + 1], held[i + 3], None
            i += 4
        self.lines = held[i:]
        if last and not self.synced:
            self.head, self.lines = self.head + self.lines, []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _cut_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, work, place, out = None, None, 0, []

    def close() -> Iterator[tuple]:
        for r in work.feed([], last=True):
            yield (*at, RECORDS, place, *r, None)
        yield (*at, HEAD, 0, None, None, None, None, work.head)
        # A split without a begin has one fragment; its last lines do not start another.
        yield (*at, TAIL, 0, None, None, None, None if work.synced else "no begin", work.lines)

    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        edge = [0, *(i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])), len(files)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if lo == hi:
                continue
            if (files[lo], blocks[lo]) != at:
                if at is not None:
                    out += close()
                at, work, place = (files[lo], blocks[lo]), Splitter(blocks[lo] == 0), 0
            for start in range(lo, hi, _AT_ONCE):
                for r in work.feed(values[start : min(hi, start + _AT_ONCE)]):
                    out.append((*at, RECORDS, place, *r, None))
                    place += 1
                if len(out) >= _AT_ONCE:
                    yield _batch(out)
                    out = []
    if at is not None:
        out += close()
    if out:
        yield _batch(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of fragments put together: (file, block, lines), block being where their first line's record began."""
    for batch in batches:
        out = []
        for file, block, lines in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            work = Splitter(True)
            found = list(work.feed(lines, last=True))
            if work.lines and any(work.lines):
                found.append((work.lines[0], None, None, "incomplete"))
            out += [(file, block, TAIL, i, *r, None) for i, r in enumerate(found)]
        if out:
            yield _batch(out)


def scan(spark: SparkSession, paths: str | list[str], cut) -> DataFrame:
    """(file, read_id, header, seq, quality, problem): records by their order in the file; malformed ones have a problem, and their first line as header.
    cut: writes a table and reads it back."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value").alias("value"))
    parts = cut(raw.mapInArrow(_cut_splits, _ROW))
    # A run: the end of a split with a begin, the splits after it that have none, and the head of the next one that has.
    ends = parts.where("lines is not null").select("file", "block", "part", "lines", (F.col("part") == TAIL).alias("tail"), (F.col("problem").isNull()).alias("synced"))
    order = Window.partitionBy("file").orderBy("block", "part")  # two rows for each split
    run = F.sum(F.when(F.col("tail") & F.col("synced"), 1).otherwise(0)).over(order)
    runs = ends.withColumn("run", run).groupBy("file", "run").agg(F.min("block").alias("block"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "lines"))), lambda x: x["lines"])).alias("lines"))
    both = parts.where("lines is null").unionByName(runs.where("size(lines) > 0").select("file", "block", "lines").mapInArrow(_joined, _ROW))
    both = cut(both.drop("lines"))
    sizes = both.groupBy("file", "block", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = both.join(sizes.withColumn("before", before).drop("n"), ["file", "block", "part"])
    return placed.select("file", (F.col("before") + F.col("place")).alias("read_id"), "header", "seq", "quality", "problem")


def summary(records: DataFrame) -> DataFrame:
    """One row for each file: reads, malformed records, bases, mean length, mean quality and share of G and C of the reads, by partial sums."""
    ok = F.col("problem").isNull()
    bases = F.sum(F.when(ok, F.char_length("seq")))
    scores = F.aggregate(F.transform(F.split("quality", ""), lambda c: (F.ascii(c) - 33).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    gc = F.char_length("seq") - F.char_length(F.regexp_replace("seq", "[GCgc]", ""))
    return records.groupBy("file").agg(
        F.count_if(ok).alias("reads"), F.count_if(~ok).alias("malformed"), F.coalesce(bases, F.lit(0)).cast("long").alias("bases"), F.avg(F.when(ok, F.char_length("seq"))).alias("mean_length"),
        (F.sum(F.when(ok & (F.char_length("seq") > 0), scores)) / bases).alias("mean_quality"), (F.sum(F.when(ok, gc)) / bases).alias("gc"),
    )
