"""Contigs checked against the sequences that they should come from, by chains of anchors.

An anchor is a k-mer that occurs once in all source sequences, read either way, so it names one place and one strand.
Along a contig, neighbouring anchors belong to one block while they lie in the same source, on the same strand and, but
for `slack` bases of insertion or deletion, at the same distance from each other; where they do not, the contig is broken.

K-mers travel as one word of two bits a base, cut in tasks that hold HELD bases; only those that are anchors outlive the
join. A contig's anchors are ordered in one window, of at most one row for each base of that contig.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import superkmers as SK

#: Bases whose k-mers a task holds, and gives to Spark, at once.
HELD = 1 << 18


def _windows(off: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first base, base after the last) of pieces of about HELD bases; a longer row is cut, with k - 1 bases twice."""
    i, rows = 0, len(off) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + HELD, side="right")) - 1)
        if off[j] - off[i] <= HELD:
            yield i, j, int(off[i]), int(off[j])
        else:
            for lo in range(int(off[i]), max(int(off[i]) + 1, int(off[j]) - k + 1), HELD):
                yield i, j, lo, min(int(off[j]), lo + HELD + k - 1)
        i = j


def placed(sequences: DataFrame, key: str, k: int, id_name: str) -> DataFrame:
    """(id_name, at, word, forward): the canonical k-mer at each place from 0, for odd k up to 31, and whether it reads forward there.

    Null sequences, those shorter than k and places with other letters than A, C, G, T give no row."""
    if k % 2 == 0 or not 0 < k <= 31:
        raise ValueError("k is odd and at most 31: an even k-mer may equal its reverse complement, so it has no strand")

    def run(batches):
        for b in batches:
            ids, seqs = b.column(0), b.column(1).cast(pa.large_binary())
            size = np.frombuffer(seqs.buffers()[1], "<i8")[seqs.offset : seqs.offset + len(seqs) + 1]
            if not len(seqs) or size[-1] == size[0]:
                continue
            data = np.frombuffer(seqs.buffers()[2], np.uint8)
            for i, j, lo, hi in _windows(size, k):
                codes = SK._CODE[data[lo:hi]]
                if len(codes) < k:
                    continue
                ends = np.minimum(size[i + 1 : j + 1], hi) - lo
                row = np.repeat(np.arange(i, j), np.diff(np.append(0, ends)))[: len(codes) - k + 1]
                at = np.arange(len(row))
                bad = np.append(0, np.cumsum(codes > 3))
                good = np.flatnonzero((at + k <= ends[row - i]) & (bad[k:] == bad[: len(row)]))
                ahead = SK.packed(codes & 3, k)[good]
                word = np.minimum(ahead, SK.reverse_complement([ahead], k)[0])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[good])), pa.array(at[good] + lo - size[row[good]]), pa.array(word.view(np.int64)), pa.array(word == ahead)], names=[id_name, "at", "word", "forward"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.where("seq is not null").select(key, "seq").mapInArrow(run, f"`{id_name}` {kind}, at bigint, word bigint, forward boolean")


def anchors(sources: DataFrame, key: str, k: int) -> DataFrame:
    """(word, source, source_at, source_forward): k-mers that occur once in all sources."""
    p = placed(sources, key, k, "source").groupBy("word")
    return p.agg(F.count("*").alias("n"), *(F.min(c).alias(to) for c, to in (("source", "source"), ("at", "source_at"), ("forward", "source_forward")))).where("n = 1").drop("n")


def chained(contigs: DataFrame, sources: DataFrame, contig_key: str, source_key: str, k: int = 31, slack: int = 20) -> DataFrame:
    """(contig, anchors, sources, blocks, relocations, inversions, translocations): one row for each contig with an anchor.

    A break is a translocation if the source changes, else an inversion if the strand does, else a relocation if the distance
    differs by more than slack; blocks are one more than breaks. Two contigs under one key would be read as one."""
    hit = placed(contigs, contig_key, k, "contig").join(anchors(sources, source_key, k), "word")
    hit = hit.select("contig", "at", "source", (F.col("forward") == F.col("source_forward")).alias("same"), "source_at")
    hit = hit.withColumn("diagonal", F.when(F.col("same"), F.col("source_at") - F.col("at")).otherwise(F.col("source_at") + F.col("at")))
    before = F.lag(F.struct("source", "same", "diagonal")).over(Window.partitionBy("contig").orderBy("at"))
    step = hit.withColumn("before", before)
    other = F.col("before.source") != F.col("source")
    turned = ~other & (F.col("before.same") != F.col("same"))
    moved = ~other & (F.col("before.same") == F.col("same")) & (F.abs(F.col("before.diagonal") - F.col("diagonal")) > slack)
    kinds = {"relocations": moved, "inversions": turned, "translocations": other}
    out = step.groupBy("contig").agg(F.count("*").alias("anchors"), F.count_distinct("source").alias("sources"), *(F.count_if(x).alias(n) for n, x in kinds.items()))
    return out.select("contig", "anchors", "sources", (1 + sum(F.col(n) for n in kinds)).alias("blocks"), *kinds)


def quality(contigs: DataFrame, read_bases: DataFrame, short: int = 100) -> DataFrame:
    """One row of the figures by which assemblies are scored: completeness, accuracies, share of gaps, short contigs and evenness of lengths.

    read_bases has one row with the column read_bases. Without contigs counts and scores are 0 and the evenness is 1."""
    c = contigs.agg(F.count("*").alias("contigs"), F.coalesce(F.sum("len"), F.lit(0)).alias("bases"), F.avg("len").alias("mean"), F.stddev_pop("len").alias("spread"), F.avg("coverage").alias("cov"), F.coalesce(F.sum(F.char_length("seq") - F.char_length(F.regexp_replace("seq", "[Nn]", ""))), F.lit(0)).alias("gaps"), F.count_if(F.col("len") < short).alias("short_contigs"))
    even = F.when((F.col("contigs") < 2) | (F.col("mean") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("mean")))
    part = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    upto = lambda a, most: F.least(F.lit(1.0), F.coalesce(F.col(a), F.lit(0.0)) / most)
    rows = c.crossJoin(F.broadcast(read_bases)).select("contigs", "bases", "short_contigs", even.alias("evenness"), F.least(F.lit(100.0), part("bases", "read_bases")).alias("completeness"), part("gaps", "bases").alias("gap_percent"), (100 * upto("mean", 1000)).alias("structure"), (50 * upto("cov", 10)).alias("cover"))
    accuracy = F.when(F.col("contigs") > 0, F.col("cover") + 50 * F.col("evenness")).otherwise(0.0)
    return rows.select("contigs", "bases", "short_contigs", F.round("evenness", 9).alias("evenness"), F.round("completeness", 9).alias("completeness"), F.round(accuracy, 9).alias("accuracy"), F.round("structure", 9).alias("structure"), F.round("gap_percent", 9).alias("gap_percent"), F.round((F.col("completeness") + accuracy) / 2, 9).alias("score"))
