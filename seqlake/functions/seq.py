"""Column expressions over nucleotide strings. Null in, null out; an empty sequence gives 0 where a share is asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: The standard genetic code in the order TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(s: Column) -> Column:
    """Reverse complement of upper-case bases; other letters stay."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def pairs_of(s: Column, pair: str) -> Column:
    """Places at which two letters follow each other, overlaps counted."""
    a, b = pair
    if a != b:
        return ((F.char_length(s) - F.char_length(F.replace(s, F.lit(pair), F.lit("")))) / 2).cast("long")
    apart = s
    for _ in range(2):  # the first parts every second pair of a run, the second the others
        apart = F.replace(apart, F.lit(pair), F.lit(f"{a}-{a}"))
    return (F.char_length(apart) - F.char_length(s)).cast("long")


def canonical(s: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(s, reverse_complement(s))


def is_dna(s: Column) -> Column:
    return s.rlike("^[ACGTNacgtn]*$")


#: Finding a place in a string costs its distance from the string's start, so long sequences are cut into pieces first.
PIECE = 256


def kmers(s: Column, k: int) -> Column:
    """All windows of k letters, left to right; none if the sequence is shorter."""
    n = F.char_length(s) - (k - 1)
    last = F.ceil(n / PIECE).cast("int") - 1
    pieces = F.transform(F.sequence(F.lit(0), last), lambda j: F.substring(s, j * PIECE + 1, F.lit(PIECE + k - 1)))
    windows = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))))
    return F.when(n >= 1, windows).otherwise(F.array().cast("array<string>"))


def clean_kmers(s: Column, k: int) -> Column:
    """K-mers without ambiguous bases; they are looked for one by one only in sequences that have such bases."""
    return F.when(s.rlike("[^ACGT]"), F.filter(kmers(s, k), lambda x: ~x.rlike("[^ACGT]"))).otherwise(kmers(s, k))


def pack(s: Column) -> Column:
    """Two bits a base, right aligned, for k-mers of at most 31 clean bases."""
    codes = F.transform(F.split(s, ""), lambda b: (F.instr(F.lit(BASES), b) - 1).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a * 4 + b)


def portable_hash(s: Column) -> Column:
    """60 bits of the MD5: a hash that other engines compute alike."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 15), 16, 10).cast("long")


def count_of(s: Column, pattern: str) -> Column:
    """Letters that match: one letter, or a class of letters, is taken out without a regular expression."""
    if letters := re.fullmatch(r"\[([A-Za-z]+)\]|([A-Za-z])", pattern):
        left = s
        for x in letters[1] or letters[2]:
            left = F.replace(left, F.lit(x), F.lit(""))
        return (F.char_length(s) - F.char_length(left)).cast("long")
    return (F.char_length(s) - F.char_length(F.regexp_replace(s, pattern, ""))).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, by its exact binary value and halves to even, as printf writes it in C; Java's own rounds up halves of its shortest decimal form."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def gc(s: Column) -> Column:
    """Share of G and C, any case, of all letters."""
    return ratio(count_of(s, "[GCgc]"), F.char_length(s))


def gc_percent(s: Column) -> Column:
    """Percent of G and C of the four bases."""
    return 100 * ratio(count_of(s, "[GCgc]"), count_of(s, "[ACGTacgt]"))


def entropy(s: Column) -> Column:
    """Shannon entropy of the four bases in units of two bits: 0 for one base, 1 for equal shares."""
    total = count_of(s, "[ACGT]")
    out = F.lit(0.0)
    for b in BASES:
        p = ratio(count_of(s, b), total)
        out = out - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return out / 2


def cpg(s: Column) -> Column:
    """CpG pairs by adjacent places."""
    return ratio(count_of(s, "CG") / 2, F.char_length(s) - 1)


def longest_run(s: Column, base: str) -> Column:
    """Longest run of a base."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"({base}+)"), F.lit(1)), lambda r: F.char_length(r))), F.lit(0)).cast("long")


def run_length_cost(s: Column) -> Column:
    """Units of a run-length code, one for a single letter and two for a longer run, by letter."""
    runs = F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))
    return ratio(F.aggregate(F.transform(runs, lambda r: F.when(F.char_length(r) == 1, 1).otherwise(2)), F.lit(0), lambda a, b: a + b), F.char_length(s))


def lag_match(s: Column, lag: int) -> Column:
    """Share of places whose letter comes again `lag` places on."""
    a = F.split(s, "")
    n = F.char_length(s) - lag
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(lag + 1), n), lambda x, y: (x == y).cast("int"))
    return F.when(n > 0, F.aggregate(same, F.lit(0), lambda p, q: p + q) / n).otherwise(F.lit(0.0))


def distinct_share(s: Column, k: int) -> Column:
    """Distinct k-mers by k-mers."""
    return ratio(F.size(F.array_distinct(kmers(s, k))), F.greatest(F.char_length(s) - (k - 1), F.lit(0)))


def expect_value(m: Column, n: Column, score: Column) -> Column:
    """m * n / 2^score."""
    return m * n / F.pow(F.lit(2.0), score)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def mean_of(q: Column) -> Column:
    """Mean of an array of numbers; null if empty."""
    return F.when(F.size(q) > 0, F.aggregate(q, F.lit(0).cast("long"), lambda a, b: a + b) / F.size(q))


def phred(quality: Column) -> Column:
    """Quality letters to scores, offset 33."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33)


def mask_policy(s: Column, policy: str, most: int = 2, base: str = "A") -> Column:
    """Ambiguous bases: 'skip' rejects (null), 'allow' rejects more than `most`, 'replace' puts `base`, 'context' the commonest base, ties to the last of A, C, G, T."""
    n = count_of(s, "[Nn]")
    if policy == "skip":
        return F.when(n == 0, s)
    if policy == "allow":
        return F.when(n <= most, s)
    if policy == "replace":
        return F.translate(s, "Nn", base * 2)
    counts = F.array(*(F.struct(count_of(s, b).alias("c"), F.lit(b).alias("b")) for b in BASES))
    return F.translate(s, "Nn", "\x01\x01") if policy == "mark" else F.regexp_replace(s, F.lit("[Nn]"), F.array_max(counts)["b"])
