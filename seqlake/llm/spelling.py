"""Spelling variants: a self-join of the vocabulary's trie with active-node sets, and forms followed to their roots.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. A share of the occurrences is spoilt by rule:
where `spoil` divides the CRC-32 of `<id>:<word>`, one code point is left out. Words of a least length and count make
the vocabulary. Two are near if one inserted, deleted or replaced code point makes one of the other. A word's form is
its near word of largest count (ties: smallest in code-point order) if that count is at least `ratio` times its own.

1. Tokens, CRC and counts are array work on batches; only (word, count) of a batch is shuffled.
2. The trie is partitioned by prefix: the first 3 code points, more where a prefix has over BLOCK words, so no key of the
   data makes a large task. Blocks are prefixes none of which begins another.
3. Below a block's prefix, tasks go down the trie level by level. A node's active nodes are those within one edit of
   it: the node itself (0 edits), and with 1 edit each sibling of an ancestor-or-self (replaced) and each ancestor's parent
   (deleted), carried down through equal code points. Where both nodes of a pair at distance one end a word, it is a pair.
4. Active nodes whose edit lies within a block's prefix belong to another block. They have no edit left, so from there on
   only equal code points are followed: the pair is handed over by (place of the edit, word without what differs there), a key
   that at most one word for each letter shares.
   Each pair is met once, at the length of its longest common prefix.
5. A word's counts from both are added, the best of its near words is kept; forms lead to ever larger counts, so pointer
   doubling over the words that have one ends after log2 of log5 of the largest count.

Null texts and texts without letters give no words; null ids count as ''. Repeated rows count each. Words of any length
are whole: a level of the trie costs a step, so a word of 100,000 letters costs that many in its task. Further columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, cut, drop_written, ship, small_side

#: Words of a block beyond which its prefix grows; words that a task goes through at once.
BLOCK, AT_ONCE = 4096, 8192
#: Code points of the shortest prefix of a block.
DEPTH = 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_IN_RUN = np.array([False, True])


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32_after(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start:end], before) of each slice, byte by byte over all slices at once."""
    s, size, live = ~before.astype(np.uint32), end - start, np.arange(len(start))
    long = np.flatnonzero(size > K.LONG_WORD)
    for k in range(K.LONG_WORD):
        live = live[size[live] > k]
        if not len(live):
            break
        x = s[live]
        s[live] = _CRC[(x ^ data[start[live] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
    s = ~s
    for i in long.tolist():
        s[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return s


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices, which do not overlap, as an array of strings."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    size = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=size[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data[np.cumsum(edge[:-1], dtype=np.int8) > 0])))


def _counted(batch: pa.RecordBatch, spoil: int, least: int) -> pa.RecordBatch:
    """(word, n) of a batch of (id, text)."""
    ids = [f"{i}:".encode() for i in K.string_array(batch.column(0)).to_pylist()]
    heads = np.array([zlib.crc32(i) for i in ids], np.uint32)
    whole, spoilt = [], []
    for row, data, off in K.chunks(batch.column(1)):
        data = K.lower_ascii(data)
        lead = data == 0xC3
        run = _LETTER[data] | lead
        run[1:] |= lead[:-1]
        start, end, first = K.word_slices(run.view(np.uint8), off, _IN_RUN)
        doc = row + np.repeat(np.arange(len(off) - 1), np.diff(first))
        h = crc32_after(heads[doc], data, start, end)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        size = points[end] - points[start]
        hit = h % spoil == 0 if spoil else np.zeros(len(h), bool)
        for a, b, x, m in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist(), size[hit].tolist(), strict=True):
            if m > least:
                w, at = data[a:b].tobytes().decode(), x % m
                spoilt.append(w[:at] + w[at + 1 :])
        keep = ~hit & (size >= least)
        whole.append(strings(data, start[keep], end[keep]))
    found = pc.value_counts(pa.chunked_array([*whole, pa.array(spoilt, pa.large_string())], pa.large_string()))
    return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 199, least_points: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of all words of at least `least_points` code points that occur at least `least_count` times. spoil = 0: no occurrence is spoilt."""
    narrow = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    counted = arrow(narrow, lambda b: iter([_counted(b, spoil, least_points)]), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class _Level:
    """Nodes of one depth of a trie of sorted words: first word, parent, code point, and whether a word ends there."""

    def __init__(self, live: np.ndarray, node: np.ndarray, start: np.ndarray, parent: np.ndarray, char: np.ndarray, ends: np.ndarray):
        self.live, self.node, self.start, self.parent, self.char, self.ends = live, node, start, parent, char, ends
        self.key = parent << 21 | char

    def __len__(self) -> int:
        return len(self.start)


def _below(at: _Level, depth: int, codes: np.ndarray, off: np.ndarray, size: np.ndarray) -> _Level:
    """The level under one of the given depth."""
    on = size[at.live] > depth
    live, up = at.live[on], at.node[on]
    char = codes[off[live] + depth].astype(np.int64)
    new = np.ones(len(live), bool)
    new[1:] = (up[1:] != up[:-1]) | (char[1:] != char[:-1])
    first = np.flatnonzero(new)
    return _Level(live, np.cumsum(new) - 1, live[first], up[first], char[first], size[live[first]] == depth + 1)


def _span(of: int, below: _Level) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of each of a level's nodes."""
    edge = np.searchsorted(below.parent, np.arange(of + 1))
    return edge[:-1], np.diff(edge)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] to first[i] + count[i] - 1, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(owner)), owner


def _follow(a: np.ndarray, b: np.ndarray, under_a: _Level, span_a: tuple, under_b: _Level, not_by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children by equal code points of pairs of nodes."""
    child, of = _spread(span_a[0][a], span_a[1][a])
    if not_by is not None:
        on = under_a.char[child] != not_by[of]
        child, of = child[on], of[on]
    if not len(child) or not len(under_b):
        return child[:0], child[:0]
    key = b[of] << 21 | under_a.char[child]
    at = np.minimum(np.searchsorted(under_b.key, key), len(under_b) - 1)
    same = under_b.key[at] == key
    return child[same], at[same]


def trie_pairs(words: list[str], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs at distance one of sorted distinct words whose longest common prefix has at least `depth` code points of the first."""
    codes, size = np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.array([len(w) for w in words], np.int64)
    off = np.cumsum(size) - size
    every, none = np.arange(len(words)), np.zeros(0, np.int64)
    at = _Level(every, np.zeros(len(words), np.int64), every[:1], none, none, size[:1] == 0)
    below = _below(at, 0, codes, off, size)
    same, found, level = (none, none), [], 0
    shifted, ban = (none, none), none
    while len(below):
        deeper = _below(below, level + 1, codes, off, size)
        span, span_below = _span(len(at), below), _span(len(below), deeper)
        both = at.ends[same[0]] & at.ends[same[1]]
        found.append((at.start[same[0][both]], at.start[same[1][both]]))
        child, parent = np.arange(len(below)), below.parent
        open_ = depth[at.start][parent] <= level
        child, parent = child[open_], parent[open_]
        later, of = _spread(child + 1, (span[0] + span[1])[parent] - 1 - child)
        shifted = (np.concatenate([shifted[0], child]), np.concatenate([shifted[1], parent]))
        ban = np.concatenate([np.full(len(shifted[0]) - len(child), -1), below.char[child]])
        both = below.ends[shifted[0]] & at.ends[shifted[1]]
        found.append((below.start[shifted[0][both]], at.start[shifted[1][both]]))
        carried = _follow(*same, below, span, below)
        shifted = _follow(*shifted, deeper, span_below, below, ban)
        same = (np.concatenate([carried[0], child[of]]), np.concatenate([carried[1], later]))
        at, below, level = below, deeper, level + 1
    both = at.ends[same[0]] & at.ends[same[1]]
    found.append((at.start[same[0][both]], at.start[same[1][both]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def best_of(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted words the number of its near words, and the place of the one of largest count, the first of equals (-1: none)."""
    of, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((other, -n[other], of))
    of, other = of[order], other[order]
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    best = np.full(len(n), -1)
    best[of[first]] = other[first]
    return np.bincount(of, minlength=len(n)), best


def _blocks(words: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, depth): the prefix of each word's block; and the tables written for it."""
    spark_cols, depth, written = ["word", "n", "depth"], DEPTH, []
    out = words.withColumn("depth", F.lit(DEPTH))
    while True:
        hot = cut(out.where(F.col("depth") == depth).groupBy(F.substring("word", 1, depth).alias("head")).count().where(F.col("count") > block).select("head", F.lit(True).alias("hot")), "spelling-hot")
        written.append(hot)
        if hot.isEmpty():
            return out, written
        more = depth + 1 if depth < 12 else 2 * depth
        joined = out.withColumn("head", F.substring("word", 1, depth)).join(small_side(hot), "head", "left")
        out = cut(joined.withColumn("depth", F.when(F.col("hot") & (F.col("depth") == depth), more).otherwise(F.col("depth"))).select(*spark_cols), "spelling-blocks")
        written.append(out)
        depth = more


def _within(blocks: DataFrame, at_once: int) -> DataFrame:
    """(word, n, n_near, best) of all words, from pairs within blocks."""
    spark = blocks.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(words: list[str], n: list[int], depth: list[int]) -> pa.RecordBatch:
            count = np.array(n, np.int64)
            near, best = best_of(count, *trie_pairs(words, np.array(depth)))
            least = [None if i < 0 else {"less": -n[i], "word": words[i]} for i in best.tolist()]
            kind = pa.struct([("less", pa.int64()), ("word", pa.string())])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(count), pa.array(near, pa.int64()), pa.array(least, kind)], names=["word", "n", "n_near", "best"])

        words, n, depth = [], [], []
        for batch in batches:
            for held, column in zip((words, n, depth), batch.columns, strict=True):
                held.extend(column.to_pylist())
            while len(words) >= at_once:
                end = len(words) - 1
                while end and words[end][: depth[end]] == words[end - 1][: depth[end - 1]]:
                    end -= 1
                if not end:
                    break
                yield done(words[:end], n[:end], depth[:end])
                for held in (words, n, depth):
                    del held[:end]
        if words:
            yield done(words, n, depth)
        K.give_back()

    dealt = blocks.repartition(F.substring(F.col("word"), F.lit(1), F.col("depth"))).sortWithinPartitions("word").select("word", "n", "depth")
    return dealt.mapInArrow(run, "word string, n bigint, n_near bigint, best struct<less: bigint, word: string>")


def _between(blocks: DataFrame) -> DataFrame:
    """(word, n, n_near, best) from pairs that differ within the prefixes of their blocks; n is null."""
    place = F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.char_length("word")))).alias("i")
    at = blocks.select("word", "n", place)
    one = F.when(F.col("i") < F.char_length("word"), F.substring(F.col("word"), F.col("i") + 1, F.lit(1)))
    without = F.concat(F.substring(F.col("word"), F.lit(1), F.col("i")), F.substring(F.col("word"), F.col("i") + 2, F.char_length("word")))
    whole = F.struct(F.col("word").alias("key"), F.lit(None).cast("string").alias("c"))
    held = at.select("i", F.explode(F.array_compact(F.array(whole, F.when(one.isNotNull(), F.struct(without.alias("key"), one.alias("c")))))).alias("x"), "n").select("i", "x.key", "x.c", "n")
    members = held.groupBy("i", "key").agg(F.collect_list(F.struct("c", "n")).alias("m")).where("size(m) > 1")
    after = F.substring(F.col("key"), F.col("i") + 1, F.lit(1))
    named = lambda c: F.when(c.isNull(), F.col("key")).otherwise(F.concat(F.substring(F.col("key"), F.lit(1), F.col("i")), c, F.substring(F.col("key"), F.col("i") + 1, F.char_length("key"))))
    others = lambda x: F.filter("m", lambda o: ~o["c"].eqNullSafe(x["c"]) & ((o["c"].isNotNull() & x["c"].isNotNull()) | (F.coalesce(o["c"], x["c"]) != after)))
    near = F.transform("m", lambda x: F.struct(named(x["c"]).alias("word"), F.transform(others(x), lambda o: F.struct((-o["n"]).alias("less"), named(o["c"]).alias("word"))).alias("o")))
    return members.select(F.explode(near).alias("x")).where("size(x.o) > 0").select("x.word", F.lit(None).cast("bigint").alias("n"), F.size("x.o").cast("bigint").alias("n_near"), F.array_min("x.o").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): forms followed to the last by pointer doubling. Forms must not lead in a circle."""
    at, written = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots"), []
    while True:
        step = at.alias("a").join(at.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        nxt = cut(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "spelling-roots")
        written.append(at)
        moved, at = not nxt.where("moved").isEmpty(), nxt.drop("moved")
        drop_written(written.pop())
        if not moved:
            return at


def group(words: DataFrame, ratio: int = 5, block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a vocabulary (word, n) of distinct words."""
    words = cut(words, "spelling-words")
    blocks, written = _blocks(words, block)
    met = _within(blocks, at_once).unionByName(_between(blocks))
    near = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    out = cut(near.select("word", F.when(strong, F.col("best.word")).alias("form"), "n", "n_near", F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-near")
    drop_written(words, *written)
    followed = roots(out.where("form is not null"))
    return out.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
