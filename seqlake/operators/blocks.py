"""De Bruijn graphs of packed k-mers (k up to 31) in blocks: nodes are dealt by minimizer as super-k-mers are, so a task that counts a block's
k-mers knows most of their neighbours, and a block is one row of arrays. What blocks tell each other goes as one row of numbers for each
pair of blocks, never as a row for each node or edge.

A task holds the arrays of one block, the frequent k-mers of a share of at least BLOCKS; blocks grow in number with the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as tables
from .superkmers import BUCKETS, FLUSH, SPREAD, U64, _Counter, _kmers, _mix, joined, minimizer_size, pieces, reverse_complement
from .superkmers import packed as words

#: Blocks of a graph at least.
BLOCKS = 128
#: Tasks at least; more blocks than tasks keep memory low, and tasks of little work few.
TASKS = 32
_GRAPH = "block int, origin int, mers binary, coverage binary, ins binary, outs binary"
_NO_WALK = pa.schema([("start", pa.int64()), ("n", pa.int32()), ("branch", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("root", pa.int64()), ("path", pa.binary()), ("going", pa.bool_())])
_NEAR = ["many", "tgt", "blocks", "slots", "sent", "send"]
_KINDS = {"mers": U64, "coverage": np.int64, "marks": np.uint8, "many": np.uint8, "around": np.uint8, "outs": np.uint8}
_MESSAGES = "block int, origin int, v binary"


def blocks_of(spark) -> tuple[int, int, int]:
    """(blocks, buckets, tasks): a bucket's k-mers are counted at once, a block is several buckets, a task meets its blocks one by one."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(BLOCKS, partitions)
    return blocks, -(-max(BUCKETS, SPREAD * partitions) // blocks) * blocks, max(TASKS, partitions)


def block_of(mers: np.ndarray, k: int, blocks: int, buckets: int) -> np.ndarray:
    """The block of each k-mer, by its minimizer as in superkmers.pieces()."""
    m = minimizer_size(k)
    back, mask, least = reverse_complement([mers], k)[0], U64((1 << 2 * m) - 1), None
    for j in range(k - m + 1):
        h = _mix(np.minimum((mers >> U64(2 * (k - m - j))) & mask, (back >> U64(2 * j)) & mask))
        least = h if least is None else np.minimum(least, h)
    return (least % U64(buckets) % U64(blocks)).astype(np.int32)


def _found(mers: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each asked k-mer in ascending ones."""
    if not len(mers):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(mers, asked), len(mers) - 1)
    return at, mers[at] == asked


def _bits(at: np.ndarray, base: np.ndarray, n: int) -> np.ndarray:
    """Bit `base` set at each place; no pair comes twice."""
    return np.bincount(at, weights=(1 << base.astype(np.int64)), minlength=n).astype(np.uint8)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.binary() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)


def _by_block(df: DataFrame, tasks: int):
    return df.repartition(tasks, "block").groupBy("block")


def graph(reads: DataFrame, k: int, least: int = 2, coverage: bool = True) -> DataFrame:
    """(block, origin, mers, coverage, ins, outs), a row for each block: its k-mers that occur at least `least` times in order, how often they
    do, and bits of the bases before and after them to which an edge leads whose other end is a node too.

    Without `coverage` how often they do is left out. Edges are (k+1)-mers, counted beside their first k-mer. That of another block's second k-mer is told to it, and it answers which are there."""
    if not 1 <= k <= 31:
        raise ValueError("k is 1 to 31")
    blocks, buckets, tasks = blocks_of(reads.sparkSession)
    mask = U64((1 << 2 * k) - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for block, of in groupby(rows, key=lambda r: r[0]):
            mers, often, edges = [], [], []
            for _, part in groupby(of, key=lambda r: r[1]):
                nodes, links = _Counter(k, FLUSH), _Counter(k + 1, FLUSH)
                for codes, count, more, first in joined(((r[2], r[3]) for r in part), k):
                    nodes.add(_kmers(codes, count, more, k, False, first))
                    links.add(_kmers(codes, count, more, k, True, first))
                (own,), n = nodes.result()
                mers.append(own[n >= least])
                often.append(n[n >= least])
                (edge, *_), _ = links.result()
                edges.append(edge[_found(mers[-1], edge >> U64(2))[1]])
            mer, edge = np.concatenate(mers), np.concatenate(edges)
            order = np.argsort(mer)
            mer, n = mer[order], np.concatenate(often)[order]
            to = block_of(edge & mask, k, blocks, buckets)
            own = edge[to == block]
            at, there = _found(mer, own & mask)
            own, at = own[there], at[there]
            ins, outs = _bits(at, own >> U64(2 * k), len(mer)), _bits(_found(mer, own >> U64(2))[0], own & U64(3), len(mer))
            out = [(block, block, mer.tobytes(), n.astype(np.int64).tobytes() if coverage else b"", ins.tobytes(), outs.tobytes())]
            order = np.argsort(to, kind="stable")
            to, edge = to[order], edge[order]
            bounds = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)]), len(to)).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if to[lo] != block:
                    out.append((int(to[lo]), block, edge[lo:hi].tobytes(), b"", b"", b""))
            yield _rows(out, _GRAPH)

    def told(key: tuple, table: pa.Table, back: bool) -> pa.Table:
        """The block's own row with the edges that others tell of, and unless they are answers themselves, answers."""
        block = key[0].as_py()
        rows = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
        own = [r for r in rows if r[1] == block]
        if not own:
            return pa.Table.from_batches([_rows([], _GRAPH)])
        mer, marks = np.frombuffer(own[0][2], U64), np.frombuffer(own[0][5 if back else 4], np.uint8)
        answers = []
        for r in rows:
            if r[1] == block:
                continue
            edge = np.frombuffer(r[2], U64)
            at, there = _found(mer, edge >> U64(2) if back else edge & mask)
            marks = marks | _bits(at[there], edge[there] & U64(3) if back else edge[there] >> U64(2 * k), len(mer))
            if not back and there.any():
                answers.append((r[1], block, edge[there].tobytes(), b"", b"", b""))
        at = 5 if back else 4
        return pa.Table.from_batches([_rows([(*own[0][:at], marks.tobytes(), *own[0][at + 1 :]), *answers], _GRAPH)])

    dealt = pieces(reads, k, buckets).select(F.expr(f"bucket % {blocks}").alias("block"), "bucket", "spans", "bases")
    rows = dealt.repartition(tasks, "block").sortWithinPartitions("block", "bucket").mapInArrow(counted, _GRAPH)
    rows = _by_block(rows, tasks).applyInArrow(lambda key, t: told(key, t, False), _GRAPH)
    return _by_block(rows, tasks).applyInArrow(lambda key, t: told(key, t, True), _GRAPH)


def _around(mer: np.ndarray, ins: np.ndarray, outs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a node, k-mer of a neighbour): each neighbour of a node once, before it or after it, itself left out."""
    mask, half = U64((1 << 2 * k) - 1), U64((1 << 2 * (k - 1)) - 1)
    at, near = [], []
    for b in range(4):
        i = np.flatnonzero(ins >> b & 1)
        before = (mer[i] >> U64(2)) | U64(b << 2 * (k - 1))
        at.append(i[before != mer[i]])
        near.append(before[before != mer[i]])
        i = np.flatnonzero(outs >> b & 1)
        after = ((mer[i] << U64(2)) & mask) | U64(b)
        twice = ((after & half) == mer[i] >> U64(2)) & (ins[i] >> (after >> U64(2 * (k - 1))).astype(np.uint8) & 1 == 1)
        new = (after != mer[i]) & ~twice
        at.append(i[new])
        near.append(after[new])
    return np.concatenate(at), np.concatenate(near)


def near(blocks_: DataFrame, k: int) -> DataFrame:
    """(block, mers, coverage, marks, many, tgt, blocks, slots, sent, send) of graph(), to be written or kept before it is used: marks are ins and
    16 * outs. The neighbours of each node, `many` of them, are nodes of the block or, from its number of nodes on, slots for nodes of others;
    slots are filled by what `blocks` tell, `slots` of each, of their nodes `send`, `sent` to each; both sides have them in the order of k-mers."""
    blocks, buckets, tasks = blocks_of(blocks_.sparkSession)
    schema = "block int, mers binary, coverage binary, marks binary, " + ", ".join(f"{c} binary" for c in _NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, mers, coverage, i, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mer, ins, outs = np.frombuffer(mers, U64), np.frombuffer(i, np.uint8), np.frombuffer(o, np.uint8)
                src, other = _around(mer, ins, outs, k)
                of = block_of(other, k, blocks, buckets)
                tgt = np.zeros(len(src), np.int32)
                own = of == block
                tgt[own] = _found(mer, other[own])[0]
                away = np.flatnonzero(~own)
                away = away[np.lexsort((other[away], of[away]))]
                new = np.append(True, (other[away][1:] != other[away][:-1]) | (of[away][1:] != of[away][:-1])) if len(away) else np.zeros(0, bool)
                tgt[away] = len(mer) + np.cumsum(new) - 1
                names, slots = np.unique(of[away][new], return_counts=True)
                pair = np.unique(of[away].astype(np.int64) * max(len(mer), 1) + src[away])
                sent = np.bincount(np.searchsorted(names, pair // max(len(mer), 1)), minlength=len(names))
                many, order = np.bincount(src, minlength=len(mer)).astype(np.uint8), np.argsort(src, kind="stable")
                arrays = (tgt[order], names, slots, sent, pair % max(len(mer), 1))
                yield _rows([(block, mers, coverage, (ins | outs << 4).astype(np.uint8).tobytes(), many.tobytes(), *(a.astype(np.int32).tobytes() for a in arrays))], schema)

    return blocks_.mapInArrow(run, schema)


def kept(held: DataFrame) -> DataFrame:
    """near() on disk, dealt once for all rounds, until it is unpersisted."""
    return held.repartition(blocks_of(held.sparkSession)[2], "block").persist(StorageLevel.DISK_ONLY)


class _Block:
    """Those columns of a row of near() that were asked for."""

    def __init__(self, block: int, **columns: bytes) -> None:
        self.block = block
        for name, x in columns.items():
            setattr(self, name, np.frombuffer(x, _KINDS.get(name, np.int32)))

    def tell(self, x: np.ndarray, itself: bool = True) -> pa.RecordBatch:
        """Messages of a value of each node to the blocks that have a neighbour of it, and to the block itself."""
        ends = np.cumsum(self.sent)
        out = [(int(b), self.block, x[self.send[e - n : e]].tobytes()) for b, n, e in zip(self.blocks, self.sent, ends, strict=True)]
        return _rows([*out, *([(self.block, self.block, x.tobytes())] if itself else [])], _MESSAGES)

    def hear(self, messages: pa.Table, kind) -> np.ndarray:
        """Values of the nodes and then of the slots."""
        got = dict(zip(messages.column("origin").to_pylist(), messages.column("v").to_pylist(), strict=True))
        return np.concatenate([np.frombuffer(got[b], kind) for b in (self.block, *self.blocks.tolist())])

    def added(self, x: np.ndarray) -> np.ndarray:
        """The sum of each node's neighbours, by values of nodes and slots."""
        out, some = np.zeros(len(self.many), x.dtype), np.flatnonzero(self.many)
        if len(some):
            out[some] = np.add.reduceat(x[self.tgt], (np.cumsum(self.many, dtype=np.int64) - self.many)[some])
        return out


def _blocks(table: pa.Table | pa.RecordBatch) -> Iterator[_Block]:
    for row in table.to_pylist():
        yield _Block(**row)


def _start(held: DataFrame, value: Callable[[_Block], np.ndarray], *columns: str) -> DataFrame:
    """The first messages of a table of near()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                yield block.tell(value(block))

    return held.select("block", "blocks", "sent", "send", *columns).mapInArrow(run, _MESSAGES)


def _met(held: DataFrame, messages: DataFrame, then: Callable[[_Block, pa.Table], pa.Table], schema: str, *columns: str) -> DataFrame:
    """Each block of near() with what it was told; blocks stay where they are, messages are shuffled."""
    asked = held.select("block", *_NEAR, *columns)
    return asked.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(lambda own, told: then(next(_blocks(own)), told), schema)


def eigenvector(held: DataFrame, cut, rounds: int) -> DataFrame:
    """centrality.eigenvector() of near()'s blocks, kept(): (mer, x); rounds are at least 2.

    Numbers of a round are whole and at most 9 to its power, so they are told in as few bytes as hold them."""
    kind = lambda i: next((t for t in (np.uint8, np.uint16, np.uint32) if 9**i <= np.iinfo(t).max), np.float64)

    def added(block: _Block, told: pa.Table, i: int) -> np.ndarray:
        x = block.hear(told, kind(i - 1)).astype(kind(i))
        return x[: len(block.many)] + block.added(x)

    def last(block: _Block, told: pa.Table) -> pa.Table:
        return pa.table({"mer": pa.array(block.mers.view(np.int64)), "x": pa.array(added(block, told, rounds).astype(np.float64))})

    # Values are 1 at first, so the first round counts a node and its neighbours.
    told = _start(held, lambda b: b.many + np.uint8(1), "many")
    for i in range(2, rounds):
        told = _met(held, told, lambda b, t, i=i: pa.Table.from_batches([b.tell(added(b, t, i))]), _MESSAGES)
    x = cut(_met(held, told, last, "mer bigint, x double", "mers"))
    size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return x.crossJoin(F.broadcast(size)).select("mer", (F.col("x") / F.col("size")).alias("x"))


def _may_close(mer: np.ndarray, k: int) -> np.ndarray:
    """graph._may_close() of an array."""
    half = (1 << 2 * (k - 1)) - 1
    run = np.array([half // 3 * base for base in range(4)], U64)
    return ((mer >> U64(6)) == (mer & U64((1 << 2 * max(k - 3, 0)) - 1))) | np.isin(mer & U64(half), run) | np.isin(mer >> U64(2), run)


def triangles(held: DataFrame, k: int) -> dict[int, int]:
    """Triangles of each k-mer on one; of k-mers of a size only a bounded number can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                at = np.flatnonzero(_may_close(block.mers, k))
                src = np.tile(block.mers[at], 4)
                dst = ((src << U64(2)) & U64((1 << 2 * k) - 1)) | np.repeat(np.arange(4).astype(U64), len(at))
                there = (np.tile(block.marks[at], 4) >> (4 + (dst & U64(3))).astype(np.uint8) & 1 == 1) & _may_close(dst, k)
                yield pa.RecordBatch.from_arrays([pa.array(src[there].view(np.int64)), pa.array(dst[there].view(np.int64))], names=["src", "dst"])

    edges = held.select("block", "mers", "marks").mapInArrow(run, "src bigint, dst bigint")
    on = tables.triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("mer")).groupBy("mer").agg(F.count("*").alias("n"))
    return {r["mer"]: r["n"] for r in on.collect()}


def _rounded(values: list[float], digits: int = 6) -> np.ndarray:
    """As round() of a column does it: half up, by the shortest decimal."""
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values])


def node_vectors(held: DataFrame, k: int, closed: dict[int, int]) -> DataFrame:
    """(mer, f0 .. f26): centrality.node_vectors() of near()'s blocks, k-mers in letters, values to six digits. held: written; closed: triangles().

    Fractions have few values: shares of k bases or their pairs, and means over at most 8 neighbours, so each is rounded once in a table."""
    tasks = blocks_of(held.sparkSession)[2]
    total = lambda marks: np.bitwise_count(marks).astype(np.uint8)
    columns = ["mers", "coverage", "marks", "many"]
    schema = "block int, " + ", ".join(f"{c} binary" for c in columns) + ", around binary"

    def summed(block: _Block, told: pa.Table) -> pa.Table:
        around = block.added(block.hear(told, np.uint8))
        return pa.Table.from_batches([_rows([(block.block, *(getattr(block, c).tobytes() for c in columns), around.tobytes())], schema)])

    def shares(n: int) -> np.ndarray:
        return _rounded([i / n for i in range(n + 1)])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_k, of_pairs = shares(k), shares(max(k - 1, 1))
        means = np.array([_rounded([s / max(n, 1) for s in range(65)]) for n in range(9)])
        pairs_of = [max(n * (n - 1), 1) for n in range(9)]
        entropies: dict[int, float] = {}

        def entropy(counts: np.ndarray) -> np.ndarray:
            key, back = np.unique(((counts[0] * (k + 1) + counts[1]) * (k + 1) + counts[2]) * (k + 1) + counts[3], return_inverse=True)
            for x in key.tolist():
                if x not in entropies:
                    parts = [x // (k + 1) ** j % (k + 1) / k for j in (3, 2, 1, 0)]
                    entropies[x] = _rounded([(0.0 - sum(p * log2(p) for p in parts if p > 0)) / 2])[0]
            return np.array([entropies[x] for x in key.tolist()])[back]

        def part(block: _Block, lo: int, hi: int) -> pa.RecordBatch:
            mer, marks, c, many = block.mers[lo:hi], block.marks[lo:hi], block.coverage[lo:hi], block.many[lo:hi]
            codes = np.stack([(mer >> U64(2 * (k - 1 - j))).astype(np.uint8) & 3 for j in range(k)], axis=1)
            counts = np.stack([(codes == b).sum(axis=1) for b in range(4)])
            two = codes[:, :-1] * 4 + codes[:, 1:]
            indeg, outdeg = np.bitwise_count(marks & 15).astype(np.int64), np.bitwise_count(marks >> 4).astype(np.int64)
            kind = np.select([(indeg == 0) | (outdeg == 0), c <= 2, c <= 10, c <= 100], [4, 2, 0, 3], 1)
            on = np.zeros(hi - lo, np.int64)
            for m, n in closed.items():
                at = np.searchsorted(mer, U64(m))
                if at < len(mer) and mer[at] == U64(m):
                    on[at] = n
            share = np.zeros(hi - lo)
            some = np.flatnonzero(on)
            share[some] = _rounded([2.0 * t / pairs_of[n] for t, n in zip(on[some].tolist(), many[some].tolist(), strict=True)])
            values = [c, entropy(counts), np.full(hi - lo, k), c, of_k[counts[1] + counts[2]], *(kind == i for i in range(6)), indeg, outdeg, indeg + outdeg, share, on, means[many, block.around[lo:hi]], *(of_k[x] for x in counts), *(of_pairs[(two == p).sum(axis=1)] for p in (0, 1, 2, 3, 4, 5))]
            letters = np.frombuffer(b"ACGT", np.uint8)[codes]
            text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer((np.arange(hi - lo + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
            return pa.RecordBatch.from_arrays([text, *(pa.array(v.astype(np.float64)) for v in values)], names=["mer", *(f"f{i}" for i in range(len(values)))])

        for batch in batches:
            for block in _blocks(batch):
                for lo in range(0, len(block.mers), 1 << 15):
                    yield part(block, lo, min(lo + (1 << 15), len(block.mers)))

    told = _start(held, lambda b: total(b.marks), "marks")
    met = _met(held.repartition(tasks, "block"), told, summed, schema, "mers", "coverage", "marks")
    return met.mapInArrow(spelled, "mer string, " + ", ".join(f"f{i} double" for i in range(27)))


#: Steps of a branch within a block at once.
STRIDE = 64
_WALK = "start bigint, n int, branch int, block int, at bigint, root bigint, path binary, going boolean"


def packed(nodes: DataFrame, k: int) -> DataFrame:
    """(block, mers, outs) of a table of nodes (mer, outs), as graph() has them."""
    blocks, buckets, tasks = blocks_of(nodes.sparkSession)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(batch.column(0).to_numpy().view(U64), k, blocks, buckets)), *batch.columns], names=["block", "mer", "outs"])

    def together(table: pa.Table) -> pa.Table:
        mer, order = table.column("mer").to_numpy(), np.argsort(table.column("mer").to_numpy())
        return pa.Table.from_batches([_rows([(table.column("block")[0].as_py(), mer[order].tobytes(), table.column("outs").to_numpy()[order].astype(np.uint8).tobytes())], "block int, mers binary, outs binary")])

    rows = nodes.select("mer", F.col("outs").cast("int").alias("outs")).mapInArrow(dealt, "block int, mer bigint, outs int")
    return _by_block(rows, tasks).applyInArrow(together, "block int, mers binary, outs binary")


def _nodes(start: int, path: bytes, k: int) -> np.ndarray:
    """The k-mers that a branch passes after its start, in order."""
    before = np.array([start >> 2 * (k - 1 - j) & 3 for j in range(k)], np.uint8)
    return words(np.append(before, np.frombuffer(path, np.uint8)), k)[1:]


def _ended(start: int, path: bytes, k: int) -> tuple[bytes, int] | None:
    """A path as far as it passes no node again, and the least node of the ring that it ends in, if it does."""
    nodes = _nodes(start, path, k)
    order = np.argsort(nodes, kind="stable")
    again = order[1:][nodes[order][1:] == nodes[order][:-1]]
    if not len(again):
        return None
    stop = int(again.min())
    first = int(np.flatnonzero(nodes == nodes[stop])[0])
    return path[:stop], int(nodes[first:stop].min())


def bubbles(held: DataFrame, k: int, cut) -> DataFrame:
    """graph.bubbles() of blocks (block, mers, outs), kept().

    A branch goes on as long as one edge follows and ends at its root: a node that is followed by none or several, or the ring that it comes
    to pass again, named by its least node. Branches meet if and only if they have one root, so a start of which two branches have different
    roots is dropped at once, most of them within their block; the others' branches move on from block to block, each as its bases. Where
    all have one root, the first node that all pass is found from them. Rounds follow the longest branch of the starts that are left."""
    blocks, buckets, tasks = blocks_of(held.sparkSession)
    mask = U64((1 << 2 * k) - 1)

    def advance(mers: np.ndarray, outs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last node, whether it is the root, bases passed with 255 after the last) of branches at nodes of the block or, where they are none, as they are."""
        at, ended, steps = at.copy(), np.zeros(len(at), bool), np.full((STRIDE, len(at)), 255, np.uint8)
        on = np.arange(len(at))
        for j in range(STRIDE):
            i, there = _found(mers, at[on])
            on, i = on[there], i[there]
            one = np.bitwise_count(outs[i]) == 1
            base = np.log2(np.maximum(outs[i], 1)).astype(U64)
            then = ((at[on] << U64(2)) & mask) | base
            go = one & (then != at[on])
            ended[on[~go]] = True
            on = on[go]
            if not len(on):
                return at, ended, steps[:j]
            at[on], steps[j, on] = then[go], base[go]
        return at, ended, steps

    def rows(start: np.ndarray, n: np.ndarray, branch: np.ndarray, at: np.ndarray, ended: np.ndarray, paths: list[bytes], roots: dict[int, int], going: np.ndarray) -> pa.RecordBatch:
        root = at.view(np.int64).copy()
        for i, r in roots.items():
            root[i] = r
        none = ~ended
        none[list(roots)] = False
        return pa.RecordBatch.from_arrays([pa.array(start.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(branch.astype(np.int32)), pa.array(block_of(at, k, blocks, buckets)), pa.array(at.view(np.int64)), pa.array(root, mask=none), pa.array(paths, pa.binary()), pa.array(going)], names=[c.split()[0] for c in _WALK.split(", ")])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                many = np.bitwise_count(block.outs)
                starts = np.flatnonzero(many > 1)
                for lo in range(0, len(starts), 1 << 16):
                    s = starts[lo : lo + (1 << 16)]
                    of, branch = np.nonzero(block.outs[s][:, None] >> np.arange(4).astype(np.uint8) & 1)
                    at, ended, steps = advance(block.mers, block.outs, ((block.mers[s][of] << U64(2)) & mask) | branch.astype(U64))
                    least, most, left = np.full(len(s), ~U64(0)), np.zeros(len(s), U64), np.zeros(len(s), bool)
                    np.minimum.at(least, of[ended], at[ended])
                    np.maximum.at(most, of[ended], at[ended])
                    left[of[~ended]] = True
                    keep = np.flatnonzero((least >= most)[of])
                    of, branch, at, ended, steps = of[keep], branch[keep], at[keep], ended[keep], steps[:, keep]
                    paths = [bytes((b,)) + x[x < 255].tobytes() for b, x in zip(branch.tolist(), np.ascontiguousarray(steps.T), strict=True)]
                    yield rows(block.mers[s][of], many[s][of], branch, at, ended, paths, {}, left[of])

    def moved(own: pa.Table, told: pa.Table) -> pa.Table:
        block, (start, n, branch, at) = next(_blocks(own)), (told.column(c).to_numpy() for c in ("start", "n", "branch", "at"))
        at, ended, steps = advance(block.mers, block.outs, at.view(U64))
        paths, roots = [], {}
        for i, (s, old, x) in enumerate(zip(start.tolist(), told.column("path").to_pylist(), np.ascontiguousarray(steps.T), strict=True)):
            path = old + x[x < 255].tobytes()
            # Whether a path came back to itself is looked at whenever it has doubled.
            if not ended[i] and len(path).bit_length() > len(old).bit_length() and (ring := _ended(s, path, k)):
                path, roots[i] = ring
            paths.append(path)
        return pa.Table.from_batches([rows(start, n, branch, at, ended, paths, roots, np.ones(len(start), bool))])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("start", "path")), strict=True))
        out = []
        for start, of in groupby(each, key=lambda r: r[0]):
            passed: dict[int, list[int]] = {}
            paths = [p for _, p in of]
            for p in paths:
                for step, node in enumerate(_nodes(start, p, k).tolist()):
                    passed.setdefault(node, []).append(step)
            _, end = min((max(at), node) for node, at in passed.items() if len(at) == len(paths))
            out.append((start, end, len(paths)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["start", "end", "paths"])

    columns = [c.split()[0] for c in _WALK.split(", ")]
    state, found = cut(held.mapInArrow(begun, _WALK)), []
    while True:
        found.append(state.where("not going"))
        state = state.where("going")
        if state.isEmpty():
            break
        step = held.groupBy("block").cogroup(state.where("root is null").groupBy("block")).applyInArrow(lambda own, told: moved(own, told) if told.num_rows else pa.Table.from_batches([], _NO_WALK), _WALK)
        each = state.where("root is not null").unionByName(step)
        one = each.groupBy("start").agg(F.min("root").alias("least"), F.max("root").alias("most"), (F.count("root") < F.max("n")).alias("left"), F.collect_list(F.struct(*columns)).alias("x")).where("least is null or least = most")
        state = cut(one.select("left", F.explode("x").alias("x")).select("x.*", "left").withColumn("going", F.col("left")).drop("left"))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    end = whole.select("start", "path").repartition("start").sortWithinPartitions("start").mapInArrow(met, "start bigint, end bigint, paths bigint")
    return end.select("start", "end", "paths", F.when(F.col("paths") == 2, "simple").otherwise("complex").alias("kind"))
