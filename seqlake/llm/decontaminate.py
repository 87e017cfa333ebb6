"""Benchmark decontamination by an FM-index for each shard of the training texts.

A shard is a chunk of whole documents. Its words become symbols of the benchmark's vocabulary; words outside the
vocabulary and the borders of documents become terminators, of which a run counts once. The shard's suffix array
(packed first words, then prefix doubling of what is still tied) gives the Burrows-Wheeler transform, which a wavelet
matrix stores. Test phrases are searched backwards, all at once, with two ranks a word; a phrase is dropped as soon as
its interval is empty. What is left is located by walking back to sampled suffix positions, and the occurrences of a
document merge into removal spans. Shards need nothing from each other: no shuffle, memory bounded by the shard.

The benchmark is the stated query set. It is cut into blocks of at most BLOCK_BYTES of text; each block is broadcast
for itself and a shard is searched block by block.

Words are runs of [0-9a-z] and of all non-ASCII characters, A-Z lower-cased. A window is `n` words in a row, or a whole
item that has fewer, but not none. Null texts have no words, so nothing is hit and nothing is contaminated; an empty
benchmark hits nothing. Rows that repeat give repeated results; items that share an id count as one; a null id reads as
the empty string. Words are compared by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow

#: Benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Documents in one FM-index.
SHARD_BYTES = 4 << 20
#: Every so many suffix positions are kept.
SAMPLE = 16

WORD = K.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def words_of(data: np.ndarray, off: np.ndarray):
    """(lower-cased bytes, starts, ends, first word of each text and the end) of the words of texts laid end to end."""
    low = K.lower_ascii(data)
    s, e, first = K.word_slices(low, off, WORD)
    return low, s, e, first


class Phrases:
    """The windows of one block of items: a vocabulary, distinct windows by length, and the items that have each.

    Fingerprints find a word in the vocabulary, its bytes decide: the salt is one under which the vocabulary's own words
    are all different, and a text's word is only taken for one of them if it has the same bytes."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        data, off = K.raw(pa.array([t for _, t in items], pa.large_string()))
        low, s, e, first = words_of(data, off)
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(low[a:b].tobytes(), len(place)) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64)
        size = np.array([len(w) for w in place], np.int64)
        self.bytes = np.frombuffer(b"".join(place), np.uint8)
        start = np.cumsum(size) - size
        for self.salt in range(100):
            h = K.word_hash(self.bytes, start, start + size, self.salt)
            order = np.argsort(h)
            self.vocabulary = h[order]
            if not len(h) or (self.vocabulary[1:] != self.vocabulary[:-1]).all():
                break
        self.start, self.size = start[order], size[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        self.words = rank[which] if len(which) else np.zeros(0, np.int32)
        self.names = [name for name, _ in items]
        count = np.diff(first)
        long = np.minimum(count, n)
        #: By length of window: where each distinct window stands in `words`, and from where to where its items stand in a list.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in np.unique(long[long > 0]).tolist():
            own = np.flatnonzero(long == m)
            many = count[own] - m + 1
            item = np.repeat(own, many)
            at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            key = self.words[at].astype(np.int64)
            for j in range(1, m):
                key = np.unique(key * (len(place) + 1) + self.words[at + j], return_inverse=True)[1]
            pair, one = np.unique(key * len(items) + item, return_index=True)
            bounds = np.flatnonzero(np.append(True, pair[1:] // len(items) != pair[:-1] // len(items))) if len(pair) else np.zeros(0, np.int64)
            self.windows[m] = (at[one[bounds]], np.append(bounds, len(pair)), (pair % len(items)).astype(np.int32))

    def symbols(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary of each word; 0 outside."""
        out = np.zeros(len(s), np.int64)
        if not len(self.vocabulary) or not len(s):
            return out
        h = K.word_hash(low, s, e, self.salt)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        who = np.flatnonzero((self.vocabulary[at] == h) & (self.size[at] == e - s))
        if not len(who):
            return out
        at, n = at[who], (e - s)[who]
        mine, theirs, wrong = K.blocks8(low), K.blocks8(self.bytes), np.zeros(len(who), bool)
        live = np.arange(len(who))
        for k in range(0, int(n.max()), 8):  # eight bytes a round; only long words stay for more rounds
            live = live[n[live] > k]
            mask = K.LOW_BYTES[np.minimum(n[live] - k, 8)]
            wrong[live] |= (mine[s[who[live]] + k] & mask) != (theirs[self.start[at[live]] + k] & mask)
        out[who[~wrong]] = at[~wrong] + 1
        return out


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of s in order; every 0 is a terminator of its own, smaller the further left it stands."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    depth = max(1, min(62 // bits, 8))
    padded = np.concatenate([s, np.zeros(depth, s.dtype)]).astype(np.int64)
    key, going = np.zeros(n, np.int64), np.ones(n, bool)
    for d in range(depth):
        x = padded[d : d + n]
        going &= x > 0
        key = (key << bits) | np.where(going, x, 0)
    sa = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = (key[sa[1:]] != key[sa[:-1]]) | ~going[sa[1:]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = depth
    tied = ~fresh
    tied[:-1] |= tied[1:]
    slots = np.flatnonzero(tied)
    while len(slots):  # slots: places in sa whose group is not yet single
        pos = sa[slots]
        group, then = rank[pos], rank[np.minimum(pos + h, n - 1)]
        order = np.lexsort((then, group))
        pos, group, then = pos[order], group[order], then[order]
        sa[slots] = pos
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
        left = ~new
        left[:-1] |= left[1:]
        slots = slots[left]
        h *= 2
    return sa


class FMIndex:
    """Backward search and location over one sequence of symbols below 2^bits."""

    def __init__(self, s: np.ndarray, bits: int):
        self.n, self.bits = len(s), bits
        sa = suffix_array(s, bits)
        bwt = np.where(sa > 0, s[sa - 1], 0)
        self.bwt = bwt
        count = np.bincount(s, minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(count)])
        keep = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        self.sample = sa[keep]
        self.zeros, self.border = [], []
        symbols = np.arange(1 << bits)
        start = np.zeros(1 << bits, np.int64)
        for b in range(bits - 1, -1, -1):  # the wavelet matrix: a rank of zero bits at each level, then zeros before ones
            bit = (bwt >> b) & 1
            rank0 = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=rank0[1:])
            self.zeros.append(rank0)
            self.border.append(int(rank0[-1]))
            one = (symbols >> b) & 1
            start = np.where(one == 0, rank0[start], self.border[-1] + start - rank0[start])
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.start = start

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i symbols of the transform."""
        at = i
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            below = self.zeros[level][at]
            at = np.where((c >> b) & 1 == 0, below, self.border[level] + at - below)
        return at - self.start[c]

    def search(self, words: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the phrases words[at : at + m] occur, their interval's start, end)."""
        who = np.arange(len(at))
        c = words[at + m - 1]
        lo, hi = self.first[c], self.first[c + 1]
        for j in range(m - 2, -1, -1):
            live = hi > lo
            who, lo, hi = who[live], lo[live], hi[live]
            if not len(who):
                break
            c = words[at[who] + j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
        live = hi > lo
        return who[live], lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index, by steps back to a sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            at = self.kept[r]
            done = self.kept[r + 1] > at
            out[open_[done]] = self.sample[at[done]] + steps
            open_ = open_[~done]
            r = rows[open_]
            c = self.bwt[r]
            rows[open_] = self.first[c] + self.rank(c, r)
            steps += 1
        return out


def hits(block: Phrases, low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask of hit words, documents, items) of one shard: the pairs of a document and an item with a window that occurs in it."""
    n = len(start)
    covered = np.zeros(n + 1, np.int64)
    docs, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if n and block.windows:
        s = block.symbols(low, start, end)
        # A terminator before each document and after the last; runs of terminators count once.
        at = np.unique(first)
        seq = np.insert(s, at, 0)
        word = np.insert(np.arange(n), at, -1)
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] > 0) | (seq[:-1] > 0)
        seq, word = seq[keep], word[keep]
        index = FMIndex(seq, max(1, int(len(block.vocabulary)).bit_length()))
        for m, (place, bounds, items) in block.windows.items():
            who, lo, hi = index.search(block.words, place, m)
            size = hi - lo
            if not len(who):
                continue
            rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            where = word[index.locate(rows)]
            np.add.at(covered, where, 1)
            np.add.at(covered, where + m, -1)
            pair = np.unique((np.searchsorted(first, where, side="right") - 1) * len(place) + np.repeat(who, size))
            doc, window = pair // len(place), pair % len(place)
            many = bounds[window + 1] - bounds[window]
            docs.append(np.repeat(doc, many))
            which.append(items[np.repeat(bounds[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
    return np.cumsum(covered[:-1]) > 0, np.concatenate(docs), np.concatenate(which)


def blocks_of(benchmark: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int):
    """Broadcast blocks of the benchmark's windows; rows stream to the driver, which holds one block at a time."""
    sc, out, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t)
        if size >= block_bytes:
            out.append(sc.broadcast(Phrases(block, n)))
            block, size = [], 0
    if block or not out:
        out.append(sc.broadcast(Phrases(block, n)))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: id, the columns in `keep`, n_words, n_hit, items (sorted ids), spans (merged, in UTF-8 bytes), contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    blocks = blocks_of(benchmark, n, item_col, item_text, block_bytes)
    columns = list(dict.fromkeys([id_col, *keep]))
    chosen = docs.select(*columns, docs[text_col].alias("_text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in columns)

    def work(batch: pa.RecordBatch):
        for i, data, off in K.chunks(batch.column(len(columns)), shard_bytes):
            low, s, e, first = words_of(data, off)
            texts = len(off) - 1
            mask, found = np.zeros(len(s), bool), [set() for _ in range(texts)]
            for b in blocks:
                hit, d, w = hits(b.value, low, s, e, first)
                mask |= hit
                for x in np.unique(d * len(b.value.names) + w).tolist():
                    found[x // len(b.value.names)].add(b.value.names[x % len(b.value.names)])
                if len(blocks) > 1:
                    del b._value  # a worker holds one block at a time and reads the next from its local copy
            sums = np.concatenate([[0], np.cumsum(mask)])
            n_hit, n_words = sums[first[1:]] - sums[first[:-1]], np.diff(first)
            spans: list[list[dict]] = [[] for _ in range(texts)]
            for x in np.flatnonzero(n_hit).tolist():
                own = np.flatnonzero(mask[first[x] : first[x + 1]]) + first[x]
                cut = np.flatnonzero(np.diff(own) > 1)
                head, tail = own[np.concatenate([[0], cut + 1])], own[np.concatenate([cut, [len(own) - 1]])]
                spans[x] = [{"start": int(a - off[x]), "end": int(b - off[x])} for a, b in zip(s[head], e[tail], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, texts) for k in range(len(columns))), pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
                names=[*columns, "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    return arrow(chosen, work, f"{schema}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, contaminated boolean")

