"""Counting by super-k-mers: reads are cut where the minimizer changes, and pieces are dealt by minimizer.

A k-mer's minimizer is the m-mer in it of least mixed value, of an m-mer and its reverse complement the smaller; a k-mer and
its reverse complement share it. Neighbouring k-mers of one minimizer are one piece of a read (a super-k-mer), so the
shuffle carries two bits for each base of a piece, about once for each base of a read, and not k letters for each k-mer.
All copies of a k-mer meet in one bucket of minimizers, where they are counted as 64-bit words by sorting. A piece keeps the base
that follows it, so the (k+1)-mers that start in it are counted in the same pass, beside their first k-mer.

A k-mer of up to 255 bases is a row of 64-bit words w0, w1, ... of 32 bases each; the last word holds what is left, right
aligned, so up to 31 bases are one positive number in alphabetical order. Reverse complements are taken on words.

A task holds FLUSH bases while it cuts, and while it counts the distinct k-mers of one bucket and at most FLUSH bases of pieces; frequent
k-mers add no memory. Null sequences and places with letters other than A, C, G, T are left out, as are sequences shorter than k.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bases that a task holds at once.
FLUSH = 2 << 20
#: Buckets for each shuffle partition, and at least: a bucket's distinct k-mers are held at once.
SPREAD, BUCKETS = 8, 2048
#: K-mers of a piece at most.
LONGEST = 1 << 14
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def minimizer_size(k: int) -> int:
    return max(1, min(15, 2 * k // 3))


def words_of(k: int) -> int:
    return -(-k // 32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def packed(codes: np.ndarray, width: int) -> np.ndarray:
    """At each place the `width` (at most 32) codes from there as one word, by doubling; places too near the end are missing."""
    power, size = codes.astype(U64), 1
    out, done = None, 0
    while True:
        if width & size:
            # what is done stands before: the larger parts are put in front of it
            out = power if out is None else (power[: len(power) - done] << U64(2 * done)) | out[size:]
            done += size
            n = len(codes) - done + 1
            out = out[: max(n, 0)]
        size *= 2
        if size > width:
            return out
        half = size // 2
        power = (power[:-half] << U64(2 * half)) | power[half:] if len(power) > half else power[:0]


def _turn(x: np.ndarray) -> np.ndarray:
    """The 32 bases of each word in reverse order."""
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = ((x >> U64(shift)) & U64(mask)) | ((x & U64(mask)) << U64(shift))
    return x


def reverse_complement(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Reverse complements of k-mers as words."""
    n, last = len(words), k - 32 * (len(words) - 1)
    free = U64(2 * (32 - last))
    whole = [*words[:-1], words[-1] << free]
    back = [_turn(~x) for x in whole[::-1]]
    # Reversed, the free bases of the last word stand first: everything moves up by them.
    if last < 32:
        back = [(x << free) | (back[i + 1] >> (U64(64) - free) if i + 1 < n else U64(0)) for i, x in enumerate(back)]
    return [*back[:-1], back[-1] >> free]


def smaller(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Of each pair of k-mers the first in alphabetical order."""
    less, equal = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for x, y in zip(a, b, strict=True):
        less |= equal & (x < y)
        equal &= x == y
    return [np.where(less, x, y) for x, y in zip(a, b, strict=True)]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def repeated(codes: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Whether the k-mer at each place stands further left in the same sequence."""
    places = len(codes) - k + 1
    words = _words(codes & 3, np.arange(places), k)
    seq = np.repeat(np.arange(len(off) - 1), np.diff(off))[:places]
    order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])
    same = seq[order][1:] == seq[order][:-1]
    for w in words:
        same &= w[order][1:] == w[order][:-1]
    out = np.zeros(places, bool)
    out[order[1:]] = same
    return out


def cut_pieces(data: np.ndarray, off: np.ndarray, k: int, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first base, k-mers, whether a base follows, minimizer) of the pieces of sequences laid end to end; once: without the k-mers that a sequence has further left."""
    codes, m, none = _CODE[data], minimizer_size(k), np.zeros(0, np.int64)
    if len(codes) < k:
        return codes, none, none, none, none.astype(U64)
    part = packed(codes & 3, m)
    least = _least(_mix(np.minimum(part, reverse_complement([part], m)[0])), k - m + 1)
    bad = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes > 3, out=bad[1:])
    places = len(codes) - k + 1
    end = np.repeat(off[1:], np.diff(off))
    at = np.arange(places)
    good = (at + k <= end[:places]) & (bad[k:] == bad[:places])
    if once:
        good &= ~repeated(codes, off, k)
    more = np.zeros(places, bool)
    more[:-1] = good[:-1] & good[1:] & (at[:-1] + k < end[: places - 1])
    new = good.copy()
    new[1:] &= ~(more[:-1] & (least[1:] == least[:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], places)
    bound = np.flatnonzero(good & ~more) + 1  # ends of runs of good places
    if len(start):
        stop = np.minimum(stop, bound[np.searchsorted(bound, start, side="right")])
    if len(start) and int((stop - start).max()) > LONGEST:
        parts = -(-(stop - start) // LONGEST)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop = np.repeat(start, parts) + nth * LONGEST, np.minimum(np.repeat(stop, parts), np.repeat(start, parts) + (nth + 1) * LONGEST)
    return codes, start, stop - start, more[stop - 1].astype(np.int64) if len(start) else none, least[start]


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pieces(reads: DataFrame, k: int, buckets: int, seq: str = "seq", once: bool = False, key: str | None = None) -> DataFrame:
    """(bucket, spans, bases): for each bucket the pieces of a task's reads; spans have 2 * k-mers + (a base follows), bases four to a byte.
    key: a column of 64-bit numbers; keys then has that of each piece's sequence."""

    def flush(texts: list[pa.Array], own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_arrays(texts) if len(texts) > 1 else texts[0]
        off = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        codes, start, count, more, least = cut_pieces(data, off - off[0], k, once)
        if not len(start):
            return
        tag = np.concatenate(own)[np.searchsorted(off - off[0], start, side="right") - 1] if key else start
        bucket = (least % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start, count, more, bucket, tag = start[order], count[order], more[order], bucket[order], tag[order]
        size = k - 1 + count + more
        edge = np.flatnonzero(np.diff(bucket)) + 1
        lows, highs = np.append(0, edge), np.append(edge, len(bucket))
        spans, bases, keys = [], [], []
        for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True):
            c = codes[_slices(start[lo:hi], size[lo:hi])] & 3
            four = np.append(c, np.zeros(-len(c) % 4, np.uint8)).reshape(-1, 4)
            spans.append((2 * count[lo:hi] + more[lo:hi]).astype("<u2").tobytes())
            bases.append((four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes())
            if key:
                keys.append(tag[lo:hi].astype("<i8").tobytes())
        columns = {"bucket": pa.array(bucket[lows].astype(np.int32)), "spans": pa.array(spans, pa.binary()), "bases": pa.array(bases, pa.binary())} | ({"keys": pa.array(keys, pa.binary())} if key else {})
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).cast(pa.large_string()))
                own.append(batch.column(1).to_numpy(zero_copy_only=False) if key else None)
                size += batch.nbytes
            if size >= FLUSH:
                yield from flush(held, own)
                held, own, size = [], [], 0
        if held:
            yield from flush(held, own)

    rows = reads.select(F.col(seq).cast("string").alias("s"), *([F.col(key).cast("long").alias("key")] if key else [])).where("s is not null")
    return rows.mapInArrow(run, "bucket int, spans binary, bases binary" + (", keys binary" if key else ""))


def meetings(asked: DataFrame, known: DataFrame, key: str, place: str, k: int) -> DataFrame:
    """(key, lo, hi, n): of the k-mers (k at most 31) of each asked sequence, how many are held by known sequences of which the least and
    greatest place are lo and hi; null for k-mers that no known sequence holds. Both sides are dealt by minimizer and meet in a bucket, so
    what is shuffled is about the bases; a task holds the asked k-mers of one bucket, and of the known ones two numbers for each."""
    if not 1 <= k <= 31:
        raise ValueError("k is 1 to 31")
    buckets = max(BUCKETS, SPREAD * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = pieces(asked, k, buckets, key=key).withColumn("side", F.lit(0)).unionByName(pieces(known, k, buckets, key=place).withColumn("side", F.lit(1)))

    def words(rows: Iterable[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += 4 * len(row[3])
            if size >= FLUSH:
                yield from one(held)
                held, size = [], 0
        if held:
            yield from one(held)

    def one(held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = np.frombuffer(b"".join(r[4] for r in held), "<i8")
        for codes, count, more, first in joined(((r[2], r[3]) for r in held), k):
            yield _kmers(codes, count, more, k, False, first)[0], np.repeat(keys, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for _, of in groupby(rows, key=lambda r: r[0]):
            mers, keys, lo, hi = None, None, None, None
            for side, part in groupby(of, key=lambda r: r[1]):
                if side == 0:
                    got = list(words(part))
                    mers, back = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
                    keys, lo, hi = np.concatenate([x for _, x in got]), np.full(len(mers), most), np.full(len(mers), least)
                elif mers is not None:
                    for mer, place in words(part):
                        at = np.minimum(np.searchsorted(mers, mer), len(mers) - 1)
                        hit = mers[at] == mer
                        np.minimum.at(lo, at[hit], place[hit])
                        np.maximum.at(hi, at[hit], place[hit])
            if mers is None or not len(mers):
                continue
            a, b = lo[back], hi[back]
            order = np.lexsort((b, a, keys))
            x = np.stack([keys[order], a[order], b[order]])
            first = np.flatnonzero(np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0)))
            x, n = x[:, first], np.diff(np.append(first, len(order)))
            none = x[1] > x[2]
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1], mask=none), pa.array(x[2], mask=none), pa.array(n.astype(np.int64))], names=["key", "lo", "hi", "n"])

    met = sides.select("bucket", "side", "spans", "bases", "keys").repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, "key bigint, lo bigint, hi bigint, n bigint")
    return met.groupBy("key", "lo", "hi").agg(F.sum("n").alias("n"))


def _tally(words: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct k-mers in order, and their counts."""
    if len(words) == 1 and n is None:
        words, order = [np.sort(words[0])], None
    else:
        order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])
        words = [w[order] for w in words]
    new = np.ones(len(words[0]), bool)
    new[1:] = False
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    total = size if n is None else np.add.reduceat(n[order], first) if len(first) else size
    return [w[first] for w in words], total


class _Counter:
    """Counts of one bucket, merged whenever `limit` k-mers wait."""

    def __init__(self, k: int, limit: int) -> None:
        self.k, self.limit, self.waiting, self.held, self.done = k, limit, [], 0, None

    def add(self, words: list[np.ndarray]) -> None:
        self.waiting.append(words)
        self.held += len(words[0])
        if self.held >= self.limit:
            self.result()

    def result(self) -> tuple[list[np.ndarray], np.ndarray]:
        if self.waiting:
            keys, n = _tally([np.concatenate(x) for x in zip(*self.waiting, strict=True)])
            if self.done is not None:
                keys, n = _tally([np.concatenate(x) for x in zip(self.done[0], keys, strict=True)], np.concatenate([self.done[1], n]))
            self.done, self.waiting, self.held = (keys, n), [], 0
            self.limit = max(self.limit, len(n))
        return self.done or ([np.zeros(0, U64)] * words_of(self.k), np.zeros(0, np.int64))


def _words(codes: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    out = []
    for j in range(words_of(k)):
        width = min(32, k - 32 * j)
        out.append(packed(codes, width)[at + 32 * j])
    return out


def joined(rows: Iterable[tuple[bytes, bytes]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, k-mers, whether a base follows, first base) of the pieces of rows (spans, bases), about FLUSH bases at once."""

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        span = np.frombuffer(b"".join(spans), "<u2").astype(np.int64)
        raw = np.frombuffer(b"".join(bases), np.uint8)
        codes = np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1).reshape(-1)
        count, more = span >> 1, span & 1
        size = k - 1 + count + more
        # Each row's bases start at a whole byte.
        row = np.repeat(np.arange(len(spans)), [len(x) // 2 for x in spans])
        end, starts = np.cumsum(size), 4 * np.append(0, np.cumsum([len(x) for x in bases]))[:-1]
        before = np.append(0, end)[np.searchsorted(row, np.arange(len(spans)))]
        return codes, count, more, end - size - before[row] + starts[row]

    spans, bases, held = [], [], 0
    for a, b in rows:
        spans.append(a)
        bases.append(b)
        held += 4 * len(b)
        if held >= FLUSH:
            yield whole()
            spans, bases, held = [], [], 0
    if spans:
        yield whole()


def _kmers(codes: np.ndarray, count: np.ndarray, more: np.ndarray, k: int, edges: bool, first: np.ndarray) -> list[np.ndarray]:
    """Words of the k-mers of pieces, or of the (k+1)-mers that start in them."""
    at = _slices(first, count - 1 + more if edges else count)
    return _words(codes, at, k + edges)


def tallies(dealt: DataFrame, k: int, canonical: bool = False, edges: bool = False, least: int = 1) -> DataFrame:
    """(edge, w0, ..., n): k-mers that occur at least `least` times; with `edges` also (k+1)-mers of which the first k-mer does, marked by edge."""
    wide = words_of(k + edges)

    def rows(of: list[np.ndarray], n: np.ndarray, edge: bool) -> pa.RecordBatch:
        cols = [w.view(np.int64) for w in of] + [np.zeros(len(n), np.int64)] * (wide - len(of))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), edge)), *map(pa.array, cols), pa.array(n.astype(np.int64))], names=["edge", *(f"w{j}" for j in range(wide)), "n"])

    def finish(nodes: _Counter, links: _Counter) -> Iterator[pa.RecordBatch]:
        keys, n = nodes.result()
        often = n >= least
        keys, n = [w[often] for w in keys], n[often]
        yield rows(keys, n, False)
        if edges:
            found, m = links.result()
            source = found[0] >> U64(2)
            at = np.minimum(np.searchsorted(keys[0], source), max(len(keys[0]) - 1, 0))
            kept = keys[0][at] == source if len(keys[0]) else np.zeros(len(source), bool)
            yield rows([w[kept] for w in found], m[kept], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in bucketed(batches):
            nodes, links = _Counter(k, FLUSH), _Counter(k + 1, FLUSH)
            for codes, count, more, first in bucket:
                words = _kmers(codes, count, more, k, False, first)
                nodes.add(smaller(words, reverse_complement(words, k)) if canonical else words)
                if edges:
                    links.add(_kmers(codes, count, more, k, True, first))
            yield from finish(nodes, links)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[np.ndarray, ...]]]:
        rows = ((b, spans, bases) for batch in batches for b, spans, bases in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for _, of in groupby(rows, key=lambda r: r[0]):
            yield joined(((spans, bases) for _, spans, bases in of), k)

    return dealt.sortWithinPartitions("bucket").mapInArrow(run, "edge boolean, " + ", ".join(f"w{j} bigint" for j in range(wide)) + ", n bigint")


def count(reads: DataFrame, k: int, canonical: bool = False, edges: bool = False, least: int = 1, seq: str = "seq", once: bool = False) -> DataFrame:
    """(edge, w0, ..., n) of reads; edges need k of at most 31. once: a k-mer counts once a sequence, so n is a number of sequences."""
    if not 1 <= k <= 255 or edges and k > 31:
        raise ValueError("k is 1 to 255, with edges at most 31")
    if once and (edges or canonical):
        raise ValueError("once is for plain k-mers alone")
    buckets = max(BUCKETS, SPREAD * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tallies(pieces(reads, k, buckets, seq, once).repartition("bucket"), k, canonical, edges, least)


def letters(words: list[Column], k: int) -> Column:
    """The bases of a k-mer in words."""
    out = []
    for j, w in enumerate(words):
        size = min(32, k - 32 * j)
        out.append(F.translate(F.lpad(F.conv(F.hex(w), 16, 4), size, "0"), "0123", "ACGT"))
    return F.concat(*out)
