"""Features of contigs: k-mer shares, codon usage, spectra, signatures, repeats, vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S

PRIME = (1 << 31) - 1
#: (a, b) of the affine hashes, by rule.
HASHES = [((7_919 * (i + 3) * (i + 3)) % PRIME, (104_729 * (i + 1)) % PRIME) for i in range(16)]


_A, _B = (np.array(x, np.int64) for x in zip(*HASHES, strict=True))


def shares(s: str | None, k: int) -> np.ndarray:
    """Shares of all 4^k k-mers in alphabetical order; zeros without k-mers."""
    n = _packed(_codes(s or ""), k)
    return n / max(int(n.sum()), 1)


def counts(contigs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, mer, n) of clean k-mers; partial counts before the shuffle."""
    return contigs.select(key, F.explode(S.clean_kmers(F.col("seq"), k)).alias("mer")).groupBy(key, "mer").agg(F.count("*").alias("n"))


def kmer_frequencies(contigs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, mer, n, freq): counts by the sequence's total."""
    return counts(contigs, key, k).withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def codon_usage(contigs: DataFrame, key: str) -> DataFrame:
    """(key, mer, aa, n, rscu) over all frames: a codon's count by the mean count of its synonyms; stop codons left out."""
    place = lambda i: F.instr(F.lit("TCAG"), F.substring("mer", i, 1)) - 1
    aa = F.substring(F.lit(S.CODE), place(1) * 16 + place(2) * 4 + place(3) + 1, F.lit(1))
    size = F.char_length(F.lit(S.CODE)) - F.char_length(F.replace(F.lit(S.CODE), F.col("aa"), F.lit("")))
    own = counts(contigs, key, 3).withColumn("aa", aa).where("aa <> '*'")
    return own.withColumn("rscu", F.col("n") * size / F.sum("n").over(Window.partitionBy(key, "aa")))


def frequency_spectrum(contigs: DataFrame, key: str, k: int, most: int = 10) -> DataFrame:
    """(key, times, share): of the distinct k-mers, the share seen so many times."""
    n = counts(contigs, key, k).groupBy(key, F.least("n", F.lit(most)).alias("times")).agg(F.count("*").alias("c"))
    return n.select(key, "times", (F.col("c") / F.sum("c").over(Window.partitionBy(key))).alias("share"))


def minhash(contigs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, h0 .. h15): least affine hash of the packed k-mers, within the row; null without k-mers. k is at most 15, so that a product stays in 64 bits."""
    if k > 15:
        raise ValueError("k is at most 15")

    @F.pandas_udf(", ".join(f"h{i} bigint" for i in range(len(HASHES))))
    def run(seq: pd.Series) -> pd.DataFrame:
        rows = []
        for s in seq:
            v = _values(_codes(s or ""), k)
            rows.append([int(((v * a + b) % PRIME).min()) if len(v) else None for a, b in HASHES])
        return pd.DataFrame(rows, columns=[f"h{i}" for i in range(len(HASHES))]).astype("Int64")

    return contigs.select(key, run("seq").alias("h")).select(key, "h.*")


def column_statistics(contigs: DataFrame, key: str, k: int) -> DataFrame:
    """(mer, mean, std, lo, hi) of the share of each k-mer over all sequences."""
    total = contigs.agg(F.count("*").alias("total"))
    f = F.col("freq")
    s = kmer_frequencies(contigs, key, k).groupBy("mer").agg(F.sum(f).alias("s"), F.sum(f * f).alias("ss"), F.min(f).alias("least"), F.max(f).alias("hi"), F.count("*").alias("present"))
    mean = F.col("s") / F.col("total")
    return s.crossJoin(F.broadcast(total)).select("mer", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("total") - mean * mean, F.lit(0.0))).alias("std"), F.when(F.col("present") < F.col("total"), 0.0).otherwise(F.col("least")).alias("lo"), "hi")


def tandem_share(s: str) -> float:
    """Longest stretch of at least three copies of a unit of 2 to 10 bases, by length."""
    x = np.frombuffer(s.encode(), np.uint8)
    best = 0
    for p in range(2, 11):
        if len(x) < 3 * p:
            break
        same = np.concatenate([[0], (x[p:] == x[:-p]).astype(np.int8), [0]])
        d = np.flatnonzero(np.diff(same))
        run = int((d[1::2] - d[::2]).max(initial=0))
        if run >= 2 * p:
            best = max(best, (run + p) // p * p)
    return best / len(x) if len(x) else 0.0


def inverted_share(s: str) -> float:
    """Longest even palindrome of complements, by length."""
    x = np.frombuffer(s.encode(), np.uint8)
    pair = np.zeros(256, np.uint8)
    for a, b in zip(b"ACGT", b"TGCA", strict=True):
        pair[a] = b
    live, r = np.arange(1, len(x)), 0
    while len(live):
        lo, hi = live - 1 - r, live + r
        ok = (lo >= 0) & (hi < len(x))
        live, lo, hi = live[ok], lo[ok], hi[ok]
        live = live[pair[x[lo]] == x[hi]]
        r += bool(len(live))
    return 2 * r / len(x) if len(x) else 0.0


def direct_share(s: str, k: int = 12) -> float:
    """Share of places whose next k bases stand elsewhere too."""
    n = len(s) - k + 1
    if n < 1:
        return 0.0
    x = _codes(s)
    if k <= 31 and len(x) == len(s) and (x >= 0).all():
        v = np.sort(_values(x, k))
        same = v[1:] == v[:-1]
        return float((np.append(same, False) | np.append(False, same)).mean())
    _, back, many = np.unique(np.array([s[i : i + k] for i in range(n)]), return_inverse=True, return_counts=True)
    return float((many[back] > 1).mean())


def repeats(contigs: DataFrame, key: str) -> DataFrame:
    """(key, tandem, inverted, direct); no built-in expresses the scans, so Arrow batches."""

    @F.pandas_udf("tandem double, inverted double, direct double")
    def run(seq: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tandem": seq.map(tandem_share), "inverted": seq.map(inverted_share), "direct": seq.map(direct_share)})

    return contigs.select(key, run(F.coalesce("seq", F.lit(""))).alias("r")).select(key, "r.*")


def row_values(s: str) -> list[float]:
    """12 values: longest run of each base and matches at lags 2 to 4 by length, cost of a run-length code, shares of distinct k-mers for SIZES."""
    x = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    n = len(x)
    if not n:
        return [0.0] * 12
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    size = np.diff(np.append(start, n))
    runs = [int(size[x[start] == ord(b)].max(initial=0)) / n for b in S.BASES]
    lags = [int((x[p:] == x[:-p]).sum()) / (n - p) if n > p else 0.0 for p in (2, 3, 4)]
    cost = int(np.minimum(size, 2).sum()) / n
    codes, shares = _codes(s), []
    for k in SIZES:
        if len(codes) == n and (codes >= 0).all():
            kinds = int(np.count_nonzero(_packed(codes, k)))
        else:
            kinds = len({s[i : i + k] for i in range(n - k + 1)})
        shares.append(kinds / (n - k + 1) if n >= k else 0.0)
    return [*runs, *lags, cost, *shares]


#: Codons of the reference's table in its order of amino acids (F, L, S, Y, C, W), and how many each has.
CODONS, SYNONYMS = ("TTT", "TTC", "TTA", "TTG", "TCT", "TCC", "TCA", "TCG", "TAT", "TAC", "TGT", "TGC", "TGG"), (2, 2, 4, 2, 2, 1)
#: Values of the sequence part, filled up with zeros, and of the k-mer part, cut.
SEQUENCE_DIM, KMER_DIM, SIZES = 100, 64, (3, 4, 5, 6)
_EMPTY = ((1 << 64) - 1) % 10_000


def _codes(s: str) -> np.ndarray:
    """0 to 3 for the bases, -1 for other letters."""
    place = np.full(256, -1, np.int64)
    place[np.frombuffer(S.BASES.encode(), np.uint8)] = range(4)
    return place[np.frombuffer(s.encode(), np.uint8)]


def _values(x: np.ndarray, k: int) -> np.ndarray:
    """The clean k-mers' packed values, left to right."""
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    v, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        v, ok = v * 4 + x[i : i + n], ok & (x[i : i + n] >= 0)
    return v[ok]


def _packed(x: np.ndarray, k: int) -> np.ndarray:
    """Counts of the clean k-mers by their packed value."""
    return np.bincount(_values(x, k), minlength=4**k)


def count_values(s: str) -> list[float]:
    """16 shares of dinucleotides, 13 codon usages over all frames, and for k = 3 to 6 the spectrum and the signature, cut at KMER_DIM."""
    x = _codes(s)
    pairs, triples = _packed(x, 2), _packed(x, 3)
    out = list(pairs / max(pairs.sum(), 1))
    at = 0
    for size in SYNONYMS:
        own = np.array([triples[int(np.dot(_codes(c), (16, 4, 1)))] for c in CODONS[at : at + size]])
        out += list(own * size / max(own.sum(), 1))
        at += size
    kmer = []
    for k in SIZES:
        if len(kmer) >= KMER_DIM:
            break
        counts = _packed(x, k)
        seen = np.flatnonzero(counts)
        spectrum = np.bincount(np.minimum(counts[seen], 10), minlength=11)[1:]
        kmer += list(spectrum / max(spectrum.sum(), 1))
        signature = ((seen[:, None] * _A + _B) % PRIME).min(axis=0) % 10_000 if len(seen) else [_EMPTY] * len(HASHES)
        kmer += [int(v) / 10_000 for v in signature]
    return [float(v) for v in out + kmer[:KMER_DIM]]


def fractal(n: Column) -> Column:
    """log2(boxes) / log2(1 / box) of the last box size of 1, 6, .. 96 with more than one box, at most 2; 0 below two letters."""
    box = 1 + 5 * F.floor((F.least(n - 1, F.lit(100)) - 1) / 5)
    return F.when(n < 2, 0.0).when(n < 7, 2.0).otherwise(-F.log2(F.ceil(n / box).cast("double")) / F.log2(box.cast("double")))


def vectors(contigs: DataFrame, key: str) -> DataFrame:
    """(key, features): 20 values of composition, 13 of codon usage, 12 of patterns, 8 of complexity, filled up with zeros to
    SEQUENCE_DIM, then KMER_DIM of spectra and signatures. Null counts as empty."""
    s = F.coalesce("seq", F.lit(""))
    n = F.char_length(s)

    @F.pandas_udf("array<double>")
    def run(seq: pd.Series) -> pd.Series:
        return seq.map(lambda x: [tandem_share(x), inverted_share(x), direct_share(x), *count_values(x), *row_values(x)])

    # The last values of the batch's array are those of row_values(), the others are cheap as expressions.
    got = lambda i: F.element_at("__run", i - 12)
    bases, patterns = [S.ratio(S.count_of(s, b), n) for b in S.BASES], [S.cpg(s), 1 - S.entropy(s)]
    complexity = [S.entropy(s), fractal(n)]
    parts = [*bases, *patterns, *complexity]
    wide = contigs.select(key, run(s).alias("__run"), *(p.cast("double").alias(f"__f{i}") for i, p in enumerate(parts)))
    f = lambda *at: F.array(*(F.col(f"__f{i}") for i in at))
    run_part = lambda start, size: F.slice("__run", start, size)
    cost, *diversity = (got(i) for i in range(7, 12))
    pieces = [f(*range(4)), run_part(4, 16), run_part(20, 13), run_part(1, 3), f(4, 5), F.array(*map(got, range(7))), F.array(F.col("__f6"), diversity[-1], cost, *diversity, F.col("__f7"))]
    known = 4 + 16 + 13 + 3 + 9 + 8
    return wide.select(key, F.concat(*pieces, F.array_repeat(F.lit(0.0), SEQUENCE_DIM - known), run_part(33, KMER_DIM)).alias("features"))
