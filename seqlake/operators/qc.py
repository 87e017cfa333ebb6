"""Quality control of reads (read_id, seq, q): filters, trimming, adapters, the cascade with reason codes, and its statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S

#: Common sequencing adapters, in order of precedence.
ADAPTERS = {
    "truseq_r1": "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA",
    "truseq_r2": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "small_rna": "TGGAATTCTCGGGTGCCAAGG",
    "nextera": "CTGTCTCTTATACACATCT",
    "small_dna_1": "CTGTAGGCACCATCAATCGT",
    "small_dna_2": "CTGTCTCTTATACACATCT",
    "small_dna_3": "ATGTGTATAAGAGACA",
}
#: Fixed values: (least mean quality, least window quality, least length) of each preset; none switches filters off.
PRESETS = {"strict": (25, 20, 75), "standard": (18, 15, 50), "lenient": (12, 10, 30), "none": (0, 0, 1)}
TAIL, OVERLAP, ERRORS = 50, 8, 0.1
#: Fixed values: (adapters in order, least overlap, share of mismatches) of each preset.
ADAPTER_PRESETS = {
    "strict": (("truseq_r1", "truseq_r2", "small_rna", "small_dna_1", "small_dna_2", "small_dna_3", "nextera"), 10, 0.05),
    "standard": (tuple(ADAPTERS), OVERLAP, ERRORS),
    "lenient": (("truseq_r1", "truseq_r2", "small_dna_1", "small_dna_2", "small_dna_3"), 6, 0.15),
    "none": ((), 100, 0.0),
}


def mean_quality(q: Column) -> Column:
    return S.mean_of(q)


def window_bounds(q: pa.ListArray, w: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each list: windows of all lists are summed at once; a missing score spoils its windows."""
    n = q.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = q.flatten()
    off, sums, gaps = np.append(0, np.cumsum(n)), np.zeros(len(flat) + 1, np.int64), np.zeros(len(flat) + 1, np.int64)
    np.cumsum(flat.fill_null(0).to_numpy(zero_copy_only=False), out=sums[1:])
    np.cumsum(flat.is_null().to_numpy(zero_copy_only=False), out=gaps[1:])
    at = np.arange(max(len(flat) - w + 1, 0))
    within = at + w <= np.repeat(off[1:], n)[: len(at)]
    good = np.flatnonzero(within & (sums[at + w] - sums[at] >= w * least) & (gaps[at + w] == gaps[at]))
    lo, hi = np.searchsorted(good, off[:-1]), np.searchsorted(good, off[1:])
    start, end, found = np.zeros(len(n), np.int64), n.copy(), np.flatnonzero(hi > lo)
    start[found], end[found] = good[lo[found]] - off[found], good[hi[found] - 1] + w - off[found]
    return start, end


def trim_bounds(q: Column, w: int = 4, least: int = 15) -> Column:
    """struct(start, end), start 0-based and end exclusive: from the first window whose sum reaches w * least to the end of
    the last one. A read shorter than w, or without such a window, keeps its full extent. Arrow batches: a lambda for each window
    and score is the larger part of a read's cost."""

    @F.arrow_udf("start bigint, end bigint")
    def run(x: pa.Array) -> pa.Array:
        start, end = window_bounds(x, w, least)
        return pa.StructArray.from_arrays([pa.array(start), pa.array(end, mask=x.is_null().to_numpy(zero_copy_only=False))], names=["start", "end"])

    return run(q)


def find_adapters(seqs: list[str | None], preset: str = "standard") -> np.ndarray:
    """A row (adapter's number, place, overlap, mismatches) for each read, -1 without a match: adapters in the preset's order, longer
    overlaps first, then places from the left of the tail. Tails of all reads are compared at once, place by place."""
    names, overlap, errors = ADAPTER_PRESETS[preset]
    codes = [(list(ADAPTERS).index(x), np.frombuffer(ADAPTERS[x].encode(), np.uint8)) for x in names]
    tails = [(s or "")[-TAIL:].encode() for s in seqs]
    size = np.array([len(x) for x in tails], np.int64)
    grid = np.zeros((len(tails), TAIL), np.uint8)
    for i, x in enumerate(tails):
        grid[i, : len(x)] = np.frombuffer(x, np.uint8)
    out = np.full((len(tails), 4), -1, np.int64)
    lo = np.array([len(s or "") for s in seqs], np.int64) - size
    for number, a in codes:
        open_ = np.flatnonzero(out[:, 0] < 0)
        best = np.zeros(len(open_), np.int64)
        wrong = np.zeros(len(open_), np.int64)
        for p in range(TAIL - overlap + 1):
            w = min(len(a), TAIL - p)
            miss = np.cumsum(grid[open_, p : p + w] != a[:w], axis=1)[:, overlap - 1 :]
            if not miss.shape[1]:
                break
            o = np.arange(overlap, w + 1)
            ok = (miss <= (errors * o + 1e-9).astype(np.int64)) & (o <= (size[open_] - p)[:, None])
            longest = np.where(ok, o, 0).max(1)
            key = np.where(longest > 0, longest * 100 + 99 - p, 0)
            better = key > best
            best[better] = key[better]
            wrong[better] = miss[better, longest[better] - overlap]
        hit = best > 0
        rows = open_[hit]
        out[rows] = np.stack([np.full(len(rows), number), lo[rows] + 99 - best[hit] % 100, best[hit] // 100, wrong[hit]], 1)
    return out


def find_adapter(seq: str, preset: str = "standard") -> tuple[int, ...] | None:
    """Of one read."""
    row = tuple(find_adapters([seq], preset)[0].tolist())
    return row if row[0] >= 0 else None


def adapters(seq: Column, preset: str = "standard") -> Column:
    """struct(adapter, place, overlap, mismatches), null without a match; Arrow batches, for no built-in aligns with mismatches."""

    @F.pandas_udf("adapter int, place int, overlap int, mismatches int")
    def run(s: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(find_adapters(s.tolist(), preset), columns=["adapter", "place", "overlap", "mismatches"]).astype("Int32")
        return found.mask(found["adapter"] < 0)

    return run(seq)


def all_adapters(seq: Column) -> Column:
    """Array of all matches: after each, the search goes on behind it, for the reads that had one."""

    @F.pandas_udf("array<struct<adapter: int, place: int, overlap: int, mismatches: int>>")
    def run(s: pd.Series) -> pd.Series:
        reads, out = s.tolist(), [[] for _ in s]
        live, at = list(range(len(reads))), [0] * len(reads)
        while live:
            found = find_adapters([(reads[i] or "")[at[i] :] for i in live]).tolist()
            left = []
            for i, (number, place, overlap, wrong) in zip(live, found, strict=True):
                if number >= 0:
                    out[i].append({"adapter": number, "place": place + at[i], "overlap": overlap, "mismatches": wrong})
                    at[i] += place + overlap
                    left.append(i)
            live = left
        return pd.Series(out)

    return run(seq)


def cascade(reads: DataFrame, preset: str = "standard") -> DataFrame:
    """Adds mean_q, trimmed sequence and scores, and status: pass or the first reason to reject, in the order quality, length,
    trim, adapter, final length. Two passes over a row; no read meets another."""
    least, window, length = PRESETS[preset]
    step = reads.withColumn("mean_q", mean_quality(F.col("q"))).withColumn("bounds", trim_bounds(F.col("q"), 4, window))
    empty = F.col("bounds.end") <= F.col("bounds.start")
    cut = step.withColumn("trimmed", F.substring("seq", (F.col("bounds.start") + 1).cast("int"), (F.col("bounds.end") - F.col("bounds.start")).cast("int")))
    cut = cut.withColumn("hit", adapters(F.col("trimmed"), preset)).withColumn("final", F.when(F.col("hit.place").isNotNull(), F.left("trimmed", F.col("hit.place"))).otherwise(F.col("trimmed")))
    status = (
        F.when(F.coalesce(F.col("mean_q"), F.lit(-1.0)) < least, "failed_quality").when(F.char_length("seq") < length, "failed_length").when(empty | (F.char_length("trimmed") < length), "failed_trim")
        .when(F.char_length("final") < length, "failed_adapter").otherwise("pass")
    )
    return cut.withColumn("status", status)


def validate(reads: DataFrame) -> DataFrame:
    """Adds errors and warnings, arrays of codes."""
    s, n = F.col("seq"), F.char_length("seq")
    run = F.greatest(*(S.longest_run(s, b) for b in S.BASES))
    errors = F.array_compact(F.array(F.when(n < 50, "short"), F.when(S.ratio(S.count_of(s, "[Nn]"), n) > 0.1, "ambiguous"), F.when(~S.is_dna(s), "alphabet")))
    warnings = F.array_compact(F.array(F.when(n > 1_000_000, "long"), F.when(~S.gc(s).between(0.2, 0.8), "gc"), F.when(mean_quality(F.col("q")) < 20, "quality"), F.when(run > 20, "homopolymer"), F.when(S.entropy(s) < 0.5, "complexity")))
    return reads.withColumns({"errors": errors, "warnings": warnings})


def share_at_least(q: Column, least: int) -> Column:
    """Percent of scores of at least `least`."""
    return 100.0 * S.ratio(F.size(F.filter(q, lambda x: x >= least)), F.size(q))


def median(q: Column) -> Column:
    s, n = F.sort_array(q), F.size(q)
    half = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (half(F.floor((n + 1) / 2)) + half(F.floor(n / 2) + 1)) / 2)


def exact_adapter(seq: Column, least: int = 7) -> Column:
    """Where a mate is cut: by adapters in order, at the first exact occurrence, else where the longest prefix of at least `least` bases
    first occurs if that is at the read's end. Null without a match."""
    n = F.char_length(seq)

    def place(a: Column) -> Column:
        ends = F.filter(F.sequence(F.char_length(a) - 1, F.lit(least), F.lit(-1)), lambda k: (F.instr(seq, F.left(a, k)) > 0) & (F.instr(seq, F.left(a, k)) + k - 1 == n))
        return F.when(F.instr(seq, a) > 0, F.instr(seq, a) - 1).otherwise(n - F.get(ends, F.lit(0)))

    every = F.transform(F.array(*(F.lit(a) for a in ADAPTERS.values())), place)
    return F.get(F.filter(every, lambda x: x.isNotNull()), F.lit(0))
