"""Documents dealt to shards of near equal size, equal texts together: best-fit-decreasing bin packing in two steps.

A document's size is the UTF-8 bytes of its text plus 1; equal texts are one group, which is never split.

1. One pass makes (id, size, CRC-32, SHA-256 of the text); from there on no text is read. Groups are counted with partial
   aggregation, so a group of a third of all rows is a row for each task.
2. Bundles: groups are dealt by digest; each task packs its own, largest first, into bundles of a fixed capacity, a
   1/PARTS of a shard. A group enters the open bundle that it fills best: the least remaining capacity that still holds it,
   found in a balanced tree of remaining capacities. Any two bundles of a task are fuller than one capacity together, so there
   are at most 2 * shards * PARTS bundles plus one for each task, whatever the input.
3. That bounded list of bundles is packed on the driver into the fixed number of shards: the least capacity for which
   best-fit-decreasing needs no more shards is found by halving. A group larger than what is left over divided by the shards left has a
   shard of its own, and the others share the rest.
4. Slots are numbered without moving rows: each task that writes the table counts its rows of each shard, and a prefix sum
   over tasks (shards x tasks rows) turns its own numbers into gapless ones.

The law is `bytes`: but for a shard of a single group, sizes differ by less than a bundle or so. Null text counts as empty, and groups with it.
Repeated rows each get a slot. Ties in size are taken by digest. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_written, ship, small_side

SHARDS = 16
#: Bundles of a shard.
PARTS = 256
#: A group of more than 1 / HOT of all rows is joined by broadcast: there are fewer than HOT such groups.
HOT = 4096


class Tree:
    """A treap of (remaining capacity, bin): a search tree by key, a heap by a fixed mix of its keys, hence balanced."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _rank(key: tuple[int, int]) -> int:
        return (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xC2B2AE3D27D4EB4F) * 0xD6E8FEB86659FD93 % (1 << 64) >> 16

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._rank(key), None, None]), high)

    def take_least(self, at_least: int) -> tuple[int, int] | None:
        """Remove and return the least key of at least that capacity."""
        low, high = self._split(self.root, (at_least, -1))
        if high is None:
            self.root = low
            return None
        above, node = None, high
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            high = node[3]
        else:
            above[2] = node[3]
        self.root = self._join(low, high)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes before the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


class BestFit:
    """Bins of one capacity; put() says which bin an item goes to. What is larger than a bin has one of its own."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.open, self.bins = capacity, Tree(), 0

    def put(self, size: int) -> int:
        found = self.open.take_least(size)
        if found is None:
            found = (max(self.capacity, size), self.bins)
            self.bins += 1
        if found[0] > size:
            self.open.add((found[0] - size, found[1]))
        return found[1]


def pack(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: best fit decreasing at the least capacity at which that many shards do."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, total, own = [0] * len(sizes), sum(sizes), 0
    while own < len(order) and own < shards - 1 and sizes[order[own]] * (shards - own) > total:
        out[order[own]] = own
        total -= sizes[order[own]]
        own += 1
    rest, left = order[own:], shards - own

    def within(capacity: int) -> list[int] | None:
        bins = BestFit(capacity)
        placed = []
        for i in rest:
            placed.append(bins.put(sizes[i]))
            if bins.bins > left:
                return None
        return placed

    low = max(-(-total // left), sizes[rest[0]] if rest else 0)
    high, best = low, within(low)
    while best is None:
        low, high = high + 1, high + max(1, high // 64)
        best = within(high)
    while low < high:
        middle = (low + high) // 2
        found = within(middle)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    for i, b in zip(rest, best or [], strict=True):
        out[i] = own + b
    return out


def _bundles(groups: DataFrame, capacity: int) -> DataFrame:
    """(digest, total, rows, part, bundle) of groups, packed by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity)
        for batch in batches:
            yield batch.append_column("bundle", pa.array([bins.put(x) for x in batch.column(1).to_pylist()], pa.int64()))

    ship(groups.sparkSession)
    dealt = groups.repartition("digest").sortWithinPartitions(F.desc("total"), "digest").select("digest", "total", "rows", F.spark_partition_id().alias("part"))
    return dealt.mapInArrow(run, "digest binary, total bigint, rows bigint, part int, bundle bigint")


def _numbered(placed: DataFrame) -> DataFrame:
    """Adds part and place: the writing task, and the number of the row among that task's rows of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            place = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                place[at] = seen.get(s, 0) + np.arange(len(at))
                seen[s] = seen.get(s, 0) + len(at)
            yield batch.append_column("place", pa.array(place))

    kind = placed.schema["id"].dataType.simpleString()
    return placed.withColumn("part", F.spark_partition_id()).mapInArrow(run, f"id {kind}, size bigint, crc bigint, shard int, part int, place bigint")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each document."""
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    narrow = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("digest"))
    narrow = cut(narrow, "shards-narrow")
    groups = cut(narrow.groupBy("digest").agg(F.sum("size").alias("total"), F.count("*").alias("rows")), "shards-groups")
    every = groups.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    packed = cut(_bundles(groups, max(1, every.total // (shards * parts))), "shards-bundles")
    listed = packed.groupBy("part", "bundle").agg(F.sum("total").alias("total")).orderBy("part", "bundle").collect()  # bounded: see above
    placed_at = pack([r.total for r in listed], shards)
    chosen = docs.sparkSession.createDataFrame([(r.part, r.bundle, s) for r, s in zip(listed, placed_at, strict=True)], "part int, bundle bigint, shard int")
    at = cut(packed.join(small_side(cut(chosen, "shards-chosen")), ["part", "bundle"]).select("digest", "rows", "shard"), "shards-placed")
    many = F.col("rows") > every.rows // hot
    first = narrow.join(F.broadcast(at.where(many).select("digest", F.col("shard").alias("of_hot"))), "digest", "left")
    rest = first.where("of_hot is null").join(at.where(~many).select("digest", "shard"), "digest")
    placed = first.where("of_hot is not null").select("id", "size", "crc", F.col("of_hot").alias("shard")).unionByName(rest.select("id", "size", "crc", "shard"))
    numbered = cut(_numbered(placed), "shards-numbered")
    drop_written(groups, packed)
    count = numbered.groupBy("shard", "part").agg(F.max("place").alias("last"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(cut(count.select("shard", "part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("before")), "shards-offsets"))
    return numbered.join(offsets, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
