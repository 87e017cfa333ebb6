"""K-mer counting, search, sketches and minimizers over (read_id, seq)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from . import superkmers

#: Shorter k-mers are so few that counts meet in each task before the shuffle; longer ones are dealt as super-k-mers.
FEW = 6
#: Hashes of k-mers of up to so many bases are kept by a task in a table, 32 MB.
TABLED = 11


def count(reads: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(mer, n): exact counts of clean k-mers of up to 255 bases."""
    if k > FEW:
        return superkmers.count(reads, k, canonical).select(superkmers.letters([F.col(f"w{j}") for j in range(superkmers.words_of(k))], k).alias("mer"), "n")
    m = F.explode(S.clean_kmers(F.col("seq"), k)).alias("mer")
    rows = reads.select(m)
    return (rows.select(S.canonical(F.col("mer")).alias("mer")) if canonical else rows).groupBy("mer").agg(F.count("*").alias("n"))


def count_packed(reads: DataFrame, k: int) -> DataFrame:
    """(packed, n): the same with two bits a base, for k up to 31."""
    return superkmers.count(reads, k).select(F.col("w0").alias("packed"), "n")


def frequent(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("n") >= least)


def spectrum(counts: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers have each count."""
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


def positions(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, mer) of clean k-mers; pos counts from 0 over all places, so a gap shows where an ambiguous base broke the chain."""
    return reads.select("read_id", F.posexplode(S.kmers(F.col("seq"), k)).alias("pos", "mer")).where(~F.col("mer").rlike("[^ACGT]"))


def diversity(counts: DataFrame) -> DataFrame:
    """(unique_kmers, total_kmers, shannon): natural logarithm; sum of n ln n in one pass."""
    n = F.col("n").cast("double")
    a = counts.agg(F.count("*").alias("unique_kmers"), F.sum("n").alias("total_kmers"), F.sum(n * F.ln(n)).alias("s"))
    return a.select("unique_kmers", "total_kmers", (F.ln("total_kmers") - F.col("s") / F.col("total_kmers")).alias("shannon"))


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(read_id, pos, mer): places that are least, by portable hash and then place, in some window of w k-mers; within the row."""
    table = np.full(4**k if k <= TABLED else 0, -1, np.int64)
    hashed = lambda m: int(hashlib.md5(m).hexdigest()[:15], 16)

    def hashes(data: np.ndarray) -> np.ndarray:
        """S.portable_hash of the k-mer at each place; a task keeps those of short clean k-mers, each other one is found once a batch."""
        codes = superkmers._CODE[data]
        if len(table) and (codes < 4).all():
            words = superkmers.packed(codes, k).astype(np.int64)
            for at in np.unique(words[table[words] < 0]).tolist():
                table[at] = hashed(bytes(b"ACGT"[at >> 2 * (k - 1 - j) & 3] for j in range(k)))
            return table[words]
        mers, back = np.unique(np.lib.stride_tricks.sliding_window_view(data, k), axis=0, return_inverse=True)
        return np.array([hashed(m.tobytes()) for m in mers], np.int64)[back.reshape(-1)]

    def picked(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the read, place in the data) of reads laid end to end, each of at least k letters."""
        h = hashes(data)
        out = []
        # Reads of fewer than w k-mers have one window of all; the others are taken together by width.
        width = np.minimum(np.diff(off) - (k - 1), w)
        for size in np.unique(width).tolist():
            best, have = np.arange(len(h)), 1
            while have < size:
                step = min(have, size - have)
                left, right = best[:-step], best[step:]
                best, have = np.where(h[right] < h[left], right, left), have + step
            of = np.flatnonzero(width == size)
            windows = np.diff(off)[of] - (k - 1) - size + 1
            start = np.repeat(off[:-1][of] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
            out.append(best[start])
        at = np.unique(np.concatenate(out))
        return np.searchsorted(off, at, side="right") - 1, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                part = part.filter(pa.array([s is not None and len(s) >= k for s in part.column(1).to_pylist()], pa.bool_()))
                if not part.num_rows:
                    continue
                texts = part.column(1).to_pylist()
                data = np.frombuffer("".join(texts).encode(), np.uint8)
                off = np.append(0, np.cumsum([len(s) for s in texts]))
                if len(data) != off[-1]:
                    raise ValueError("sequences are ASCII letters")
                row, at = picked(data, off)
                letters = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)[at])
                mers = pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(letters))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at - off[row]), mers], names=["read_id", "pos", "mer"])

    return reads.select("read_id", "seq").mapInArrow(run, f"read_id {reads.schema['read_id'].dataType.simpleString()}, pos bigint, mer string")


def without_repeats(minimizers: DataFrame) -> DataFrame:
    """Drops a minimizer whose k-mer is that of the one before."""
    before = F.lag("mer").over(Window.partitionBy("read_id").orderBy("pos"))
    return minimizers.withColumn("before", before).where(~F.col("mer").eqNullSafe(F.col("before"))).drop("before")


def unrepeated(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, mer): without_repeats(positions(reads, k)) of reads whose ids differ, each within its row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                texts = [s or "" for s in part.column(1).to_pylist()]
                data = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)
                off = np.append(0, np.cumsum([len(s) for s in texts]))
                if len(data) < k:
                    continue
                bad, windows = np.append(0, np.cumsum(superkmers._CODE[data] > 3)), np.lib.stride_tricks.sliding_window_view(data, k)
                row = np.repeat(np.arange(len(texts)), np.diff(off))[: len(windows)]
                at = np.flatnonzero((np.arange(len(windows)) + k <= off[row + 1]) & (bad[k:] == bad[: len(windows)]))
                mers, row = windows[at], row[at]
                # The k-mer before is that of the last clean place of the same read, across a gap too.
                new = np.append(True, (row[1:] != row[:-1]) | (mers[1:] != mers[:-1]).any(axis=1))[: len(at)]
                at, row, mers = at[new], row[new], np.ascontiguousarray(mers[new])
                strings = pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(mers))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at - off[row]), strings], names=["read_id", "pos", "mer"])

    return reads.select("read_id", "seq").mapInArrow(run, f"read_id {reads.schema['read_id'].dataType.simpleString()}, pos bigint, mer string")


def index(sequences: DataFrame, key: str, k: int) -> DataFrame:
    """(key, pos, mer, k): the inverted index; written with partitionBy('k') one size can be replaced alone."""
    return sequences.select(key, F.posexplode(S.clean_kmers(F.col("seq"), k)).alias("pos", "mer")).withColumn("k", F.lit(k))


def search(queries: DataFrame, indexed: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query, target, matches, score): places of the target whose k-mer is one of the query's, by the query's distinct k-mers. One row a
    query and target, counted within tasks first: all pairs that share a k-mer, about queries times targets. The best of each query are found by similar.search()."""
    q = queries.select(F.col(query_key).alias("query"), "mer").distinct()
    size = q.groupBy("query").agg(F.count("*").alias("size"))
    # Only k-mers of queries can match: the index is cut down to them before it is counted.
    hits = indexed.join(q.select("mer").distinct(), "mer", "left_semi").groupBy("mer", F.col(key).alias("target")).agg(F.count("*").alias("c"))
    found = q.join(hits, "mer").groupBy("query", "target").agg(F.sum("c").alias("matches"))
    return found.join(size, "query").withColumn("score", F.col("matches") / F.col("size")).drop("size")


def sample(counts: DataFrame, size: int) -> DataFrame:
    """The `size` k-mers of smallest hash: a mergeable bottom-k sample."""
    return counts.withColumn("h", S.portable_hash(F.col("mer"))).orderBy("h", "mer").limit(size)


def merge_samples(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """The sample of two samples' union: counts add up."""
    both = a.unionByName(b).groupBy("mer", "h").agg(F.sum("n").alias("n"))
    return both.orderBy("h", "mer").limit(size)


#: Low bits of a k-mer in a range; a range's k-mers are one row.
LOW = 20


def _own(reads: DataFrame, key: str, k: int, rows: Callable[[str | None, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows() of the distinct clean k-mers, in order, of each key that a task has met; it keeps 4 * FLUSH of them or what FLUSH letters add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = {}, {}, 0

        def merged() -> None:
            for name, texts in held.items():
                joined = "N".join(texts).encode("ascii", "replace")
                codes = superkmers._CODE[np.frombuffer(joined, np.uint8)]
                bad = np.append(0, np.cumsum(codes > 3))
                words = superkmers.packed(codes & 3, k) if len(codes) >= k else np.zeros(0, np.uint64)
                words = words[bad[k:] == bad[: len(words)]] if len(words) else words
                found[name] = np.union1d(found.get(name, np.zeros(0, np.uint64)), words)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for name, words in found.items():
                yield from rows(name, words)
            found.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for name, s in zip(batch.column(0).slice(lo, 1000).to_pylist(), batch.column(1).slice(lo, 1000).to_pylist(), strict=True):
                    if s:
                        held.setdefault(name, []).append(s)
                        size += len(s)
                if size >= superkmers.FLUSH:
                    merged()
                    size = 0
                    if sum(map(len, found.values())) >= 4 * superkmers.FLUSH:
                        yield from out()
        merged()
        yield from out()

    return reads.select(F.col(key).cast("string").alias("key"), "seq").mapInArrow(run, schema)


def distinct(reads: DataFrame, key: str, k: int) -> DataFrame:
    """(key, packed): the distinct clean k-mers of each key, k at most 31; a task keeps each of its own once before they are dealt."""

    def rows(name: str | None, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(words), 1 << 16):
            part = words[lo : lo + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part)], names=["key", "packed"])

    return _own(reads, key, k, rows, "key string, packed bigint").distinct().withColumnRenamed("key", key)


def _low(of: bytes) -> np.ndarray:
    """The low bits of a range's k-mers, which are bits themselves where a list would be larger."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(of, np.uint8), bitorder="little")) if len(of) == 1 << LOW - 3 else np.frombuffer(of, "<u4")


def _range(low: np.ndarray) -> bytes:
    if 4 * len(low) < 1 << LOW - 3:
        return low.astype("<u4").tobytes()
    on = np.zeros(1 << LOW, bool)
    on[low] = True
    return np.packbits(on, bitorder="little").tobytes()


def ranges(reads: DataFrame, key: str, k: int) -> DataFrame:
    """(key, high, low, n): distinct() for k of at most 16, the k-mers of a key that start alike in one row of at most 2^LOW bits, and their number."""
    if k > 16:
        raise ValueError("k is 1 to 16")

    def rows(name: str | None, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        high, low = (words >> np.uint64(LOW)).astype(np.int64), (words & np.uint64((1 << LOW) - 1)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, high[1:] != high[:-1])[: len(high)]), len(high)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array(high[lo : lo + 1]), pa.array([_range(low[lo:hi])], pa.binary())], names=["key", "high", "low"])

    return joint(_own(reads, key, k, rows, "key string, high bigint, low binary"), "key").withColumnRenamed("key", key)


def joint(parts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, high, low, n) of rows (*keys, high, low): those of one range together."""
    names, kinds = [*keys, "high"], [pa.string()] * len(keys) + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(len(names) + 1)), strict=True))
        for of, part in groupby(rows, key=lambda r: r[:-1]):
            on = np.zeros(1 << LOW, bool)
            for r in part:
                on[_low(r[-1])] = True
            low = np.flatnonzero(on)
            yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(of, kinds, strict=True)), pa.array([_range(low)], pa.binary()), pa.array([len(low)])], names=[*names, "low", "n"])

    dealt = parts.select(*names, "low").repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, ", ".join([*(f"{c} string" for c in keys), "high bigint", "low binary", "n bigint"]))


def spelled(found: DataFrame, key: str, k: int) -> DataFrame:
    """(key, mer) of ranges(), k-mers in letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, high, of in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                packed = _low(of).astype(np.int64) | high << LOW
                for lo in range(0, len(packed), 1 << 16):
                    part = packed[lo : lo + (1 << 16)]
                    codes = np.stack([part >> 2 * (k - 1 - j) & 3 for j in range(k)], axis=1)
                    letters = pa.py_buffer(np.frombuffer(b"ACGT", np.uint8)[codes])
                    mers = pa.StringArray.from_buffers(len(part), pa.py_buffer((np.arange(len(part) + 1) * k).astype(np.int32)), letters)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), mers], names=["key", "mer"])

    return found.select(F.col(key).cast("string").alias("key"), "high", "low").mapInArrow(run, "key string, mer string").withColumnRenamed("key", key)


def sketch(reads: DataFrame, key: str, k: int) -> DataFrame:
    """(key, sketch): HyperLogLog of the distinct k-mers; hll_union_agg merges them. A k-mer that comes again changes no sketch, so distinct ones are put in."""
    return sketch_of(distinct(reads, key, k), key, k)


def sketch_of(found: DataFrame, key: str, k: int) -> DataFrame:
    """sketch() of distinct packed k-mers."""
    return sketch_of_letters(found.select(key, superkmers.letters([F.col("packed")], k).alias("mer")), key)


def sketch_of_letters(found: DataFrame, key: str) -> DataFrame:
    """sketch() of distinct k-mers (key, mer)."""
    return found.groupBy(key).agg(F.hll_sketch_agg("mer", F.lit(12)).alias("sketch"))


def choose_k(stats: DataFrame, budget_mb: int = 2048, least: int = 15, most: int = 127) -> DataFrame:
    """Adds k, by mean_len, gc_pct and complexity, and k_in_memory, the same within a table of 4^k counters of 12 bytes and the bounds."""
    by_length = F.when(F.col("mean_len") < 50, 15).when(F.col("mean_len") < 100, 21).when(F.col("mean_len") < 200, 31).otherwise(41)
    by_gc = F.when((F.col("gc_pct") < 30) | (F.col("gc_pct") > 70), -4).otherwise(0)
    by_entropy = F.when(F.col("complexity") < 0.5, -6).when(F.col("complexity") > 0.8, 4).otherwise(0)
    fits = F.floor(F.log2(F.lit(budget_mb * 1048576.0 / 12)) / 2).cast("int")
    with_k = stats.withColumn("k", by_length + by_gc + by_entropy)
    return with_k.withColumn("k_in_memory", F.least(F.greatest(F.least("k", fits), F.lit(least)), F.lit(most)))
