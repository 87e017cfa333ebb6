"""Byte-level BPE: pre-tokens by an associative scan over a transition monoid, then cached pair merging.

Pre-tokenisation. Every code point has a class; a deterministic automaton over these classes knows at each
code point whether a pre-token starts there. The automaton is not run: each class is a function from states to
states, the functions that arise by composing them form a small finite monoid, and composition is one look-up in a
table. Texts are laid end to end behind a class that resets the state, cut into equal blocks, and the blocks are
scanned side by side: an associative prefix scan in numpy, without regular expressions.

Merging. Each distinct pre-token of a chunk is merged once, lowest rank first, and kept in a bounded cache; all its
occurrences gather their ids from there. Equal pre-tokens are found by 64-bit fingerprints and every text is
checked to decode to its own bytes; one that does not is encoded again pre-token by pre-token.

Texts: null counts as empty; an empty text has no ids. Repeated rows give repeated results; further columns, whatever
their names, are not touched. Ids carry their first byte's offset in the text, so any slice of ids maps back to text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import arrow

# Classes of code points.
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE, WHITE, RESET = range(8)
# States: the run that the code point just read belongs to; within a contraction, how many code points follow.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_TAIL2, S_TAIL1, S_FRESH = range(8)
#: Pre-tokens kept merged in a worker; beyond it the cache starts anew.
CACHE = 150_000

#: The white space of Unicode.
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a contraction.
_AFTER1 = "stmd"
_AFTER2 = ("re", "ve", "ll")


def _classes() -> np.ndarray:
    table = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[_WHITE] = WHITE
    table[0x20] = SPACE
    table[0x110000] = RESET
    return table


def _step(state: int, c: int) -> int:
    if c == RESET:
        return S_FRESH
    if state == S_TAIL2:
        return S_TAIL1
    if state == S_TAIL1:
        return S_FRESH
    if c == SPACE:
        return S_SPACE
    if c == WHITE:
        return S_WHITE
    if c in (APOS1, APOS2):  # a contraction only where a pre-token starts: not within a run of others, not after a space
        return S_OTHER if state in (S_OTHER, S_SPACE) else S_TAIL1 if c == APOS1 else S_TAIL2
    return {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER}[c]


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table [first, then], elements as functions of the state)."""
    base = [tuple(_step(s, c) for s in range(8)) for c in range(8)]
    found: dict[tuple, int] = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for f in base:
        if f not in found:
            found[f] = len(order)
            order.append(f)
    i = 0
    while i < len(order):
        for f in base:
            g = tuple(f[x] for x in order[i])
            if g not in found:
                found[g] = len(order)
                order.append(g)
        i += 1
    m = len(order)
    table = np.zeros((m, m), np.uint16)
    for a in range(m):
        for b in range(m):
            table[a, b] = found[tuple(order[b][x] for x in order[a])]
    return np.array([found[f] for f in base], np.uint16), table, np.array(order, np.uint8)


def states(classes: np.ndarray, width: int = 64) -> np.ndarray:
    """The automaton's state after each code point, by a blocked prefix scan of composed transition functions."""
    element, compose, maps = _tables()["monoid"]
    m = compose.shape[0]
    n = len(classes)
    rows = max(1, -(-n // width))
    grid = np.zeros(rows * width, np.uint16)  # element 0 is the identity
    grid[:n] = element[classes]
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # a column of blocks at a time
    flat = compose.reshape(-1)
    for j in range(1, width):  # the prefix within each block, all blocks at once
        grid[j] = flat[grid[j - 1].astype(np.int64) * m + grid[j]]
    carry = grid[-1].copy()  # prefixes over whole blocks: doubling steps
    step = 1
    while step < rows:
        carry[step:] = flat[carry[:-step].astype(np.int64) * m + carry[step:]]
        step *= 2
    enter = np.full(rows, S_FRESH, np.int64)
    enter[1:] = maps[carry[:-1], S_FRESH]
    return maps.reshape(-1)[grid.astype(np.int64) * 8 + enter].T.reshape(-1)[:n]


_cache: dict = {}


def _tables() -> dict:
    if "monoid" not in _cache:
        _cache["monoid"] = _monoid()
        _cache["classes"] = _classes()
    return _cache


def pretokens(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among code points; 0x110000 stands before each text, and each such mark starts one too."""
    cls = _tables()["classes"][points]
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        tail = np.concatenate([points, np.full(2, 0x110000, points.dtype)])
        one, two = tail[at + 1], tail[at + 2]
        short = np.isin(one, [ord(x) for x in _AFTER1])
        long = np.zeros(len(at), bool)
        for x, y in _AFTER2:
            long |= (one == ord(x)) & (two == ord(y))
        cls[at[short]] = APOS1
        cls[at[long]] = APOS2
    st = states(cls)
    before = np.empty(n, np.uint8)
    before[0] = S_FRESH
    before[1:] = st[:-1]
    white, was_white = (cls == SPACE) | (cls == WHITE), (before == S_SPACE) | (before == S_WHITE)
    inside = (before == S_TAIL2) | (before == S_TAIL1)
    first = np.where(white, ~was_white, st != before)  # runs
    first |= (before == S_FRESH) | (cls == RESET)
    first |= (st == S_TAIL1) & ~inside | (st == S_TAIL2)
    first[inside & (cls != RESET)] = False
    # A white run before text keeps its last code point for what follows: alone, or in front of the run if it is a space.
    last = np.empty(n, bool)
    last[-1] = False
    last[:-1] = white[:-1] & ~white[1:] & (cls[1:] != RESET)
    first |= last & was_white
    glued = ~white & (before == S_SPACE)
    first[glued & (cls != RESET)] = False
    return np.flatnonzero(first)


def load_ranks(source: str | bytes) -> dict[bytes, int]:
    """The ranks of a rank file, of its path or its contents: a base64 byte string and its rank on each line."""
    if isinstance(source, str):
        with open(source, "rb") as f:
            source = f.read()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in source.split(b"\n") if line.strip())}


def sent(spark: SparkSession, path: str):
    """A rank file's contents for the executors, which need not have the driver's files."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
    while pair:
        best = min(pair)
        if best == 1 << 30:
            break
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links, n log n for very long pre-tokens."""
    import heapq

    n = len(piece)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = nxt[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e or rank(i) != r:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (x := rank(i)) is not None:
                heapq.heappush(heap, (x, i, end[nxt[i]]))
        if prev[i] >= 0 and (x := rank(prev[i])) is not None:
            heapq.heappush(heap, (x, prev[i], end[i]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes chunks of texts with one rank file; keeps merged pre-tokens between chunks."""

    def __init__(self, source: str | bytes):
        self.ranks = load_ranks(source)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        size = max(self.bytes_of, default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for i, b in self.bytes_of.items():
            lengths[i] = len(b)
        self.length = lengths
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.seen: dict[int, list[int]] = {}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        n = self.length[ids]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.uint8)
        begin = np.cumsum(n) - n
        return self.blob[np.repeat(self.at[ids] - begin, n) + np.arange(total)]

    def encode_chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offsets of the ids in the chunk, for each text its first id's index and the end) of texts laid end to end."""
        texts = len(off) - 1
        starts = self._starts(data, off)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        keys = K.slice_hash(K.prefix_sums(data), starts, ends)
        uniq, which, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.seen) > CACHE:
            self.seen.clear()
        blob, seen, ranks, merged = data.tobytes(), self.seen, self.ranks, []
        for k, s, e in zip(uniq.tolist(), starts[which].tolist(), ends[which].tolist(), strict=True):
            got = seen.get(k)
            if got is None:
                got = seen[k] = merge(blob[s:e], ranks)
            merged.append(got)
        count = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter((x for ids in merged for x in ids), np.int64, int(count.sum()))
        first = np.cumsum(count) - count
        n = count[back]
        total = int(n.sum())
        begin = np.cumsum(n) - n
        ids = flat[np.repeat(first[back] - begin, n) + np.arange(total)]
        size = self.length[ids]
        where = np.cumsum(size) - size
        if int(size.sum()) != len(data) or not np.array_equal(self.decode(ids), data):
            return self._plainly(data, off, starts, ends)
        return ids, where, np.append(begin, total)[np.searchsorted(starts, off)]

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens start."""
        if not len(data):
            return np.zeros(0, np.int64)
        lead = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(lead)  # the byte of each code point
        inner = np.unique(off[off < len(data)])  # where texts with bytes start
        marks = np.searchsorted(at, inner)
        where = np.insert(points, marks, np.uint32(0x110000))
        starts = pretokens(where)
        starts = starts[where[starts] != 0x110000]
        shift = np.cumsum(where == 0x110000)
        return at[starts - shift[starts]]

    def _plainly(self, data, off, starts, ends):
        """Two different pre-tokens with one fingerprint: encode each for itself."""
        blob, out, begin = data.tobytes(), [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            begin.append(len(out))
            out += merge(blob[s:e], self.ranks)
        ids = np.array(out, np.int64)
        size = self.length[ids]
        return ids, np.cumsum(size) - size, np.append(begin, len(out)).astype(np.int64)[np.searchsorted(starts, off)]


_encoders: dict[str | bytes, Encoder] = {}


def encoder(source: str | bytes) -> Encoder:
    """One encoder a worker and file, of its path or its contents."""
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = Encoder(source)
    return _encoders[source]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, offsets array<long>: the byte where each id starts) of every text."""
    kind, ranks = docs.schema[id_col].dataType.simpleString(), sent(docs.sparkSession, path)

    def work(batch: pa.RecordBatch):
        enc, names = encoder(ranks.value), batch.column(0)
        for i, data, off in K.chunks(batch.column(1)):
            ids, where, first = enc.encode_chunk(data, off)
            lists = pa.array(first.astype(np.int32), pa.int32())
            shifted = where - np.repeat(off[:-1], np.diff(first))
            yield pa.RecordBatch.from_arrays([names.slice(i, len(off) - 1), pa.ListArray.from_arrays(lists, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(shifted))], names=[id_col, "ids", "offsets"])

    return arrow(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, ids array<int>, offsets array<bigint>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary) of lists of ids; a null list decodes to no bytes."""
    kind, ranks = tokens.schema[id_col].dataType.simpleString(), sent(tokens.sparkSession, path)

    def work(batch: pa.RecordBatch):
        enc = encoder(ranks.value)
        out = [enc.decode(np.asarray(x.values if x.is_valid else [], np.int64)).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return arrow(tokens.select(id_col, ids_col), work, f"`{id_col}` {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, n_bytes): each text encoded, its ids decoded again, both digested in one pass."""
    kind, ranks = docs.schema[id_col].dataType.simpleString(), sent(docs.sparkSession, path)

    def work(batch: pa.RecordBatch):
        enc, names = encoder(ranks.value), batch.column(0)
        for i, data, off in K.chunks(batch.column(1)):
            ids, _, first = enc.encode_chunk(data, off)
            packed = memoryview(ids.astype("<u4").tobytes())
            back = enc.decode(ids)
            edge = np.concatenate([[0], np.cumsum(enc.length[ids])])[first]
            view = memoryview(back.tobytes())
            a = [hashlib.sha256(packed[4 * s : 4 * e]).hexdigest() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            b = [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([names.slice(i, len(off) - 1), pa.array(np.diff(first)), pa.array(a), pa.array(b), pa.array(np.diff(edge))], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return arrow(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
