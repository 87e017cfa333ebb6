"""Removal of repeated long strings with a logarithmic family of sparse suffix arrays.

Suffixes. Of the suffixes of all texts, only those at window minimisers enter the index: each window of `length` bytes
belongs to the leftmost place where the hash of GRAM bytes is least among its places, so equal windows, wherever they
stand, belong to equal places. Consecutive windows of one place form a segment. An entry of the index is (key, content,
count): the fingerprint of the place's GRAM bytes, by which suffixes with a common start stand side by side, and the
128-bit fingerprint of all bytes of the segment. Entries are dealt by key range and travel as sorted arrays, one binary
value for each range, so Spark moves few rows; a task adds up equal entries before it sends them, so a group of copies
costs an entry a task.

Index family. Levels are tables of sorted arrays in a folder that outlives the job. A new batch becomes a sorted array
for each key range; it is merge-scanned against every level for starts that occur again; it merges with levels of about
its size, so there are logarithmically many and each entry is merged that often. A family that exists already is opened
from its folder, and later batches go on from there. Before a batch would give a range more than RANGE_ENTRIES suffixes on
average, every range is halved: the new batch's level has the finer ranges, and older levels are dealt again as they are
read, until a merge writes them so. A value holds at most PIECE entries; a range of more has several values.

Matches. A segment whose whole content occurs again is covered. One whose start occurs again, but not its whole, lies
at a match's edge: its bytes and one of each other content with that start go to one task, which orders all suffixes
of these bytes by prefix doubling until `length` bytes are compared; suffixes of equal rank are matches of that length.
A start with more than HOT different contents is compared by an aggregation of its windows' fingerprints, which Spark
spreads over tasks. Segments look up their range's entries in a stream; a range with very many of them is dealt to
several tasks, which all read its entries.

Result: each byte covered by a `length`-byte string that also starts anywhere else, in the same text or another, is
removed; strings are judged on the input. Null counts as empty; texts shorter than `length` keep all. Rows that repeat
are different texts with equal bytes. Further columns are not read. An empty table gives no rows. Equal fingerprints of
64 bits only propose; what is decided by fingerprints (whole contents, windows of hot starts) has 128 bits.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import BLOB_GROUP, arrow, cut, drop_written, remove_path, scratch, ship

GRAM = 64
#: Contents with one start beyond which windows are compared by aggregation.
HOT = 2_000
#: Bytes of contexts compared at once; contexts of one key stay together.
COMPARE_BYTES = 512 << 10
#: Batches into which one call deals its rows.
BATCHES = 2
#: Entries that a task holds before it sends them.
HELD = 100_000
#: Segments of a key range that one task looks up at most, if that is more than twice the mean.
SHARE = 100_000
#: Suffixes of a key range on average, over all levels, beyond which the ranges are halved: what a task holds of the index at once.
RANGE_ENTRIES = 2 << 20
#: Entries of one stored value at most.
PIECE = 1 << 18

ENTRY = np.dtype([("key", "<i8"), ("c1", "<i8"), ("c2", "<i8"), ("n", "<i8")])
MEMBER = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("k1", "<i8"), ("k2", "<i4"), ("lo", "<i4"), ("more", "<i4")])
SPAN = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("s", "<i4"), ("e", "<i4")])
BLOBS = "range int, size bigint, payload binary"


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM):
    """(text, first window, last window, key, content) of all segments of a chunk; windows count from their text's start."""
    n = len(data)
    gram = min(gram, length)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros((0, 2), np.int64)
    sums = K.prefix_sums(data)
    places = np.arange(n - gram + 1)
    h = K.slice_hash(sums, places, places + gram)
    bits = np.uint64(max(22, int(n).bit_length()))
    least = K.sliding_min((h >> bits << bits) | places.view(np.uint64), length - gram + 1)
    valid = np.zeros(n - length + 2, np.int8)  # window starts that stay within their text
    long = np.diff(off) >= length
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    edge = np.empty(len(valid), bool)
    edge[0] = True
    edge[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    edge[off[:-1][long]] = True
    start = np.flatnonzero(valid & edge)
    after = np.empty(len(valid), bool)
    after[-1] = True
    after[:-1] = edge[1:] | ~valid[1:]
    end = np.flatnonzero(valid & after)
    text = np.searchsorted(off, start, side="right") - 1
    # Least hashes are small ones, so keys are spread again before they are dealt by range.
    at = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return text, start - off[text], end - off[text], K.mix(h[at]).view(np.int64), K.digests128(data, start, end + length)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each place with `length` bytes from there: the rank of these bytes among all such strings, by prefix doubling."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    span = min(8, length)
    first = K.blocks8(data).byteswap() >> np.uint64(8 * (8 - span))
    r = np.unique(first[: len(data) - span + 1], return_inverse=True)[1]
    while span < length:
        step = min(span, length - span)
        r = paired(r[: len(r) - step], r[step:])
        span += step
    return r


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, two fingerprints that name a row, text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast("string"), text).alias("k1"), F.hash(text, docs[id_col].cast("string")).alias("k2"), text.alias("text"))


def _range(x: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit value, of so many ranges of equal width."""
    return ((x.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _blobs(rows: np.ndarray, where: np.ndarray, sizes: np.ndarray | None = None) -> tuple[list[int], list[int], list[bytes]]:
    """(range, size, bytes) of the rows of each range; sizes weigh rows."""
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(rows) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(rows))) if sizes is None or not len(rows) else np.add.reduceat(sizes[order], first)
    return where[first].tolist(), weight.tolist(), [rows[a:b].tobytes() for a, b in zip(first.tolist(), np.append(first, len(rows))[1:].tolist(), strict=True)]


def _blob_batch(ranges: list[int], sizes: list[int], payloads: list[bytes], **more) -> pa.RecordBatch:
    cols = {"range": pa.array(ranges, pa.int32()), "size": pa.array(sizes, pa.int64()), "payload": pa.array(payloads, pa.binary())}
    for name, (value, kind) in more.items():
        cols[name] = pa.array([value] * len(ranges), kind)
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def combined(rows: np.ndarray) -> np.ndarray:
    """Entries sorted by key and content, equal ones added up."""
    rows = rows[np.lexsort((rows["c2"], rows["c1"], rows["key"]))]
    if len(rows):
        new = np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["c1"][1:] != rows["c1"][:-1]) | (rows["c2"][1:] != rows["c2"][:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(rows["n"], first)
        rows = rows[first]
        rows["n"] = total
    return rows


def redealt(blobs: DataFrame, ranges: int) -> DataFrame:
    """(kind, range, size, payload): the same entries and starts in more and narrower ranges."""

    def work(batch: pa.RecordBatch):
        for i, kind in enumerate(batch.column(0).to_pylist()):
            rows = np.frombuffer(batch.column(1)[i].as_py(), "<i8" if kind == 1 else ENTRY)
            keys, sizes = (rows, None) if kind == 1 else (rows["key"], rows["n"])
            yield _blob_batch(*_blobs(rows, _range(keys.copy(), ranges), sizes), kind=(kind, pa.int32()))

    return arrow(blobs.select("kind", "payload"), work, BLOBS + ", kind int").select("kind", "range", "size", "payload")


def entries(keyed: DataFrame, length: int, ranges: int, batches: int = 1) -> DataFrame:
    """(batch, range, size, payload): sorted arrays of the suffix entries of all texts, by the batch that their row is dealt to."""
    ship(keyed.sparkSession)

    def run(incoming):
        held: list[list[np.ndarray]] = [[] for _ in range(batches)]

        def send(b: int):
            rows = combined(np.concatenate(held[b]))
            held[b] = []
            return _blob_batch(*_blobs(rows, _range(rows["key"].copy(), ranges), rows["n"]), batch=(b, pa.int32()))

        for batch in incoming:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            for i, data, off in K.chunks(batch.column(1)) if batch.num_rows else ():
                text, _, _, key, content = segments(data, off, length)
                rows = np.empty(len(key), ENTRY)
                rows["key"], rows["c1"], rows["c2"], rows["n"] = key, content[:, 0], content[:, 1], 1
                own = which[text + i]
                for b in range(batches):
                    held[b].append(rows[own == b] if batches > 1 else rows)
                    if sum(map(len, held[b])) >= HELD:
                        yield send(b)
        for b in range(batches):
            if held[b]:
                yield send(b)
        K.give_back()

    return keyed.select(F.pmod("k1", F.lit(batches)).cast("int").alias("batch"), "text").mapInArrow(run, BLOBS + ", batch int")


def _by_part(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(key values, iterator of (kind, bytes) in order of kind) for each group of blobs, which come one after the other."""
    ship(rows.sparkSession)

    def run(batches):
        def flat():
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(len(keys) + 1)]
                for i in range(b.num_rows):
                    yield tuple(c[i] for c in cols[:-1]), cols[-1][i], b.column(len(keys) + 1)[i].as_py()

        for key, group in groupby(flat(), key=lambda r: r[0]):
            yield from work(key, ((kind, payload) for _, kind, payload in group))
        K.give_back()

    return rows.select(*keys, "kind", "payload").repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, schema)


def _member_of(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of keys are in a sorted array: the merge-scan of two sorted arrays."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _own(fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the batch's sorted entries, those whose start occurs again in the batch itself)."""
    rows = combined(np.concatenate(fresh)) if fresh else np.zeros(0, ENTRY)
    again = rows["n"] > 1
    same = rows["key"][1:] == rows["key"][:-1]
    again[1:] |= same
    again[:-1] |= same
    return rows, again


class IndexFamily:
    """Levels of sorted suffix entries in a folder, of geometrically growing size, and the starts that were met again.

    A level's table has rows (kind, range, size, payload), several of one kind and range where one would be long: kind 0
    holds entries, kind 1 the starts that its last batch met again. Its name tells its first and last batch, the number of suffixes, and the number of ranges."""

    SCHEMA = "kind int, " + BLOBS

    def __init__(self, spark: SparkSession, folder: str, ranges: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(conf)
        names = [f.getPath().getName() for f in fs.listStatus(path(self.folder))] if fs.exists(path(self.folder)) else []
        done = [n for n in names if n.startswith("level-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        spans = [tuple(map(int, n.split("-")[1:])) for n in done]
        # A merged level stands for those that it was made of, should a job have ended before it removed them.
        self.levels = sorted(x for x in spans if not any(o != x and o[0] <= x[0] and x[1] <= o[1] for o in spans))
        self.batches = max((x[1] for x in self.levels), default=-1) + 1
        #: Ranges of the newest level; older levels may have fewer.
        self.ranges = max((x[3] for x in self.levels), default=0) or ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, level: tuple) -> str:
        return f"{self.folder}/level-" + "-".join(map(str, level))

    def read(self, level: tuple) -> DataFrame:
        """A level's rows by the family's ranges, whatever ranges it was written with."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self._path(level))
        return rows if level[3] == self.ranges else redealt(rows, self.ranges)

    def add(self, batch: DataFrame, dealt: int | None = None) -> None:
        """A new batch of blobs (range, size, payload) in `dealt` ranges (the family's): sorted, scanned against every level, merged with levels of about its size."""
        dealt = dealt or self.ranges
        total = batch.agg(F.sum("size")).first()[0] or 0
        while total + sum(x[2] for x in self.levels) > RANGE_ENTRIES * self.ranges:
            self.ranges *= 2
        if dealt != self.ranges:
            batch = redealt(batch.withColumn("kind", F.lit(-1)), self.ranges)
        at, merging = self.batches, []
        self.batches += 1
        while len(merging) < len(self.levels) and self.levels[-1 - len(merging)][2] <= (total + sum(x[2] for x in merging)) * 3 // 2:
            merging.append(self.levels[-1 - len(merging)])
        rows = batch.select("range", F.lit(-1).alias("kind"), "payload")
        for i, level in enumerate(self.levels):
            rows = rows.unionByName(self.read(level).select("range", (2 * F.lit(i) + F.col("kind")).alias("kind"), "payload"))
        merged = {2 * self.levels.index(x) for x in merging}

        def work(key, blobs):
            fresh, scanned, out, met, was = [], None, [], None, []
            for kind, payload in blobs:
                if kind < 0:
                    fresh.append(np.frombuffer(payload, ENTRY))
                    continue
                if scanned is None:
                    scanned, met = _own(fresh)
                if kind % 2:
                    if kind - 1 in merged:
                        was.append(np.frombuffer(payload, "<i8"))
                    continue
                level = np.frombuffer(payload, ENTRY)
                met |= _member_of(level["key"], scanned["key"])
                if kind in merged:
                    out.append(level)
            if scanned is None:
                scanned, met = _own(fresh)
            rows = combined(np.concatenate([scanned, *out])) if out else scanned
            keys = np.unique(np.concatenate([scanned["key"][met], *was]))
            for kind, whole in ((0, rows), (1, keys)):
                for lo in range(0, len(whole), PIECE):
                    piece = whole[lo : lo + PIECE]
                    size = len(piece) if kind else int(piece["n"].sum())
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key[0]], pa.int32()), pa.array([size], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["kind", "range", "size", "payload"])

        first = min((x[0] for x in merging), default=at)
        level = (first, at, total + sum(x[2] for x in merging), self.ranges)
        _by_part(rows, ["range"], work, self.SCHEMA).write.option("parquet.block.size", BLOB_GROUP).mode("overwrite").parquet(self._path(level))
        for old in merging:
            self.levels.remove(old)
            remove_path(self.spark, self._path(old))
        self.levels.append(level)

    def blobs(self) -> DataFrame:
        """All levels: (range, kind, size, payload)."""
        every = self.spark.createDataFrame([], self.SCHEMA)
        for level in self.levels:
            every = every.unionByName(self.read(level))
        return every


def matches(levels: list[np.ndarray], met: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entries of starts met again in order of content, how many contents the start of each has) of one key range."""
    rows = np.concatenate(levels) if levels else np.zeros(0, ENTRY)
    keys = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    rows = combined(rows[_member_of(keys, rows["key"])])
    _, back, many = np.unique(rows["key"], return_inverse=True, return_counts=True)
    order = np.lexsort((rows["c2"], rows["c1"]))
    return rows[order], many[back][order]


def _looked_up(index: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Place of each member's content in an index in order of content, or -1."""
    if not len(index):
        return np.full(len(members), -1)
    at = np.searchsorted(index["c1"], members["c1"])
    while True:  # one round, unless two contents share half of their fingerprint
        inside = np.minimum(at, len(index) - 1)
        same = (at < len(index)) & (index["c1"][inside] == members["c1"])
        other = same & (index["c2"][inside] != members["c2"])
        if not other.any():
            return np.where(same, inside, -1)
        at = np.where(other, at + 1, at)


FOUND = "key bigint, k1 bigint, k2 int, lo int, more int, target boolean, hot boolean, range int, payload binary"


def _found(family: IndexFamily, keyed: DataFrame, length: int) -> DataFrame:
    """Segments looked up in the index: spans of whole contents that occur again as blobs by row, edges as rows."""
    ranges, blobs = family.ranges, family.blobs()
    sizes = {r["range"]: r["n"] for r in blobs.where("kind = 0").groupBy("range").agg(F.sum("size").alias("n")).collect()}  # one for each range
    share = max(SHARE, 2 * sum(sizes.values()) // max(1, len(sizes)))
    parts = np.ones(ranges, np.int64)
    for r, n in sizes.items():
        parts[r] = -(-n // share) or 1
    ship(keyed.sparkSession)

    def send(held: list, salt: int):
        rows = np.concatenate([m for m, _ in held])
        where = np.concatenate([w for _, w in held])
        return _blob_batch(*_blobs(rows, where), part=(salt, pa.int32()), kind=(2, pa.int32()))

    def run(incoming):
        held: list = []
        salt = 0
        for batch in incoming:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, data, off in K.chunks(batch.column(2)) if batch.num_rows else ():
                text, lo, hi, key, content = segments(data, off, length)
                rows = np.empty(len(key), MEMBER)
                rows["c1"], rows["c2"], rows["k1"], rows["k2"], rows["lo"], rows["more"] = content[:, 0], content[:, 1], k1[text + i], k2[text + i], lo, hi - lo
                held.append((rows, _range(key, ranges)))
                if sum(len(m) for m, _ in held) >= HELD:
                    yield send(held, salt)
                    held, salt = [], salt + 1
        if held:
            yield send(held, salt)
        K.give_back()

    # A range of several parts: its members go to them in turn, its entries to all of them.
    many = F.lit(1)
    if (parts > 1).any():
        many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(int(x)) for r in np.flatnonzero(parts > 1) for x in (r, parts[r]))), F.col("range")), F.lit(1))
    members = keyed.select("k1", "k2", "text").mapInArrow(run, BLOBS + ", part int, kind int")
    members = members.select("range", F.pmod(F.xxhash64("part", F.spark_partition_id()), many).cast("int").alias("part"), "kind", "payload")
    index = blobs.select("range", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)).alias("part"), "kind", "payload")

    def work(key, incoming):
        levels, met, index, out = [], [], None, []
        for kind, payload in incoming:
            if kind == 0:
                levels.append(np.frombuffer(payload, ENTRY))
            elif kind == 1:
                met.append(np.frombuffer(payload, "<i8"))
            else:
                if index is None:
                    index, contents = matches(levels, met)
                    levels, met = [], []
                    shown = np.zeros(len(index), bool)
                m = np.frombuffer(payload, MEMBER)
                at = _looked_up(index, m)
                m, at = m[at >= 0], at[at >= 0]
                whole, several = index["n"][at] > 1, contents[at] > 1
                spans = np.empty(int(whole.sum()), SPAN)
                spans["k1"], spans["k2"], spans["s"], spans["e"] = m["k1"][whole], m["k2"][whole], m["lo"][whole], m["lo"][whole] + m["more"][whole] + length
                out.append(spans)
                # Edges, and one of each whole content for them to be compared with.
                one = np.flatnonzero(whole & several & ~shown[at])
                one = one[np.unique(at[one], return_index=True)[1]]
                shown[at[one]] = True
                rows = np.concatenate([np.flatnonzero(several & ~whole), one])
                if len(rows):
                    yield _edges(index["key"][at[rows]], m[rows], ~whole[rows], contents[at[rows]] > HOT)
                if sum(map(len, out)) >= HELD:
                    yield _spans(np.concatenate(out), ranges)
                    out = []
        if out:
            yield _spans(np.concatenate(out), ranges)

    return _by_part(index.unionByName(members), ["range", "part"], work, FOUND)


def _edges(key: np.ndarray, m: np.ndarray, target: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(m)
    cols = [pa.array(key), *(pa.array(m[c].copy()) for c in ("k1", "k2", "lo", "more")), pa.array(target), pa.array(hot), pa.array(none, pa.int32()), pa.array(none, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["key", "k1", "k2", "lo", "more", "target", "hot", "range", "payload"])


def _spans(rows: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Spans as blobs by range of their row's first fingerprint, in FOUND's columns."""
    rows = np.unique(rows)
    where, _, payloads = _blobs(rows, _range(rows["k1"].copy(), ranges))
    none = [None] * len(where)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([*(pa.array(none, k) for k in kinds), pa.array(where, pa.int32()), pa.array(payloads, pa.binary())], names=["key", "k1", "k2", "lo", "more", "target", "hot", "range", "payload"])


def _merged(blobs: DataFrame) -> DataFrame:
    """(k1, k2, spans): the merged spans of each row, as pairs of 32-bit numbers."""

    def work(key, incoming):
        rows = np.concatenate([np.frombuffer(p, SPAN) for _, p in incoming])
        rows = rows[np.lexsort((rows["s"], rows["k2"], rows["k1"]))]
        name = np.append(True, (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1]))
        # Ends are compared within a row: its number stands before them.
        number = np.cumsum(name).astype(np.int64) << 32
        reach = np.maximum.accumulate(number + rows["e"])
        new = name.copy()
        new[1:] |= number[1:] + rows["s"][1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        pairs = np.stack([rows["s"][first], (reach[last] & 0xFFFFFFFF).astype(np.int32)], 1)
        begin = np.flatnonzero(name[first])
        bounds = np.append(begin, len(first))
        own = rows[first[begin]]
        yield pa.RecordBatch.from_arrays([pa.array(own["k1"].copy()), pa.array(own["k2"].copy()), pa.array([pairs[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=["k1", "k2", "spans"])

    return _by_part(blobs.withColumn("kind", F.lit(0)), ["range"], work, "k1 bigint, k2 int, spans binary")


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """Bytes of the segments to compare, cut from their texts."""

    def work(batch: pa.RecordBatch):
        lists = batch.column(3)
        rows = [i for i in range(batch.num_rows) if lists[i].is_valid]
        if not rows:
            return
        data, off = K.raw(batch.column(2))
        view = memoryview(np.ascontiguousarray(data))
        out: list[list] = [[] for _ in range(7)]
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in rows:
            for x in lists[i].as_py():
                a = int(off[i]) + x["lo"]
                for c, v in zip(out, (x["key"], k1[i], k2[i], x["lo"], x["target"], x["hot"], bytes(view[a : a + x["more"] + length])), strict=True):
                    c.append(v)
                if len(out[0]) >= 5000:
                    yield _batch(out)
                    out = [[] for _ in range(7)]
        if out[0]:
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "k1", "k2", "lo", "target", "hot", "bytes"])

    return arrow(joined, work, "key bigint, k1 bigint, k2 int, lo int, target boolean, hot boolean, bytes binary")


def _windows(off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place in it) of all windows of contexts laid end to end."""
    count = np.diff(off) - length + 1
    who = np.repeat(np.arange(len(count)), count)
    return who, np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _compared(contexts: DataFrame, length: int, ranges: int) -> DataFrame:
    """Spans of windows of targets that other windows equal, as blobs; contexts of one key come together, in key order."""
    ship(contexts.sparkSession)

    def spans(rows: pa.Table):
        target = rows.column("target").to_numpy(zero_copy_only=False)
        if rows.num_rows < 2 or not target.any():
            return
        data, off = K.raw(rows.column("bytes"))
        who, at = _windows(off, length)
        _, back, many = np.unique(ranks(data, length)[off[who] + at], return_inverse=True, return_counts=True)
        hit = (many[back] > 1) & target[who]
        who, at = who[hit], at[hit]
        if not len(who):
            return
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(who)) - 1
        out = np.empty(len(first), SPAN)
        for c in ("k1", "k2"):
            out[c] = rows.column(c).to_numpy()[who[first]]
        lo = rows.column("lo").to_numpy()[who[first]]
        out["s"], out["e"] = lo + at[first], lo + at[last] + length
        where, _, payloads = _blobs(out, _range(out["k1"].copy(), ranges))
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(payloads, pa.binary())], names=["range", "payload"])

    def run(batches):
        held = None
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = pa.Table.from_batches([b.slice(lo, 1000)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.nbytes >= COMPARE_BYTES:
                    keys = held.column("key").to_numpy()
                    whole = int(np.searchsorted(keys, keys[-1]))
                    if whole:
                        yield from spans(held.slice(0, whole).combine_chunks())
                        held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from spans(held.combine_chunks())
        K.give_back()

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "range int, payload binary")


def _spread(contexts: DataFrame, length: int, ranges: int) -> DataFrame:
    """The same for starts with very many contents: windows meet by their fingerprint in an aggregation and a join."""

    def work(batch: pa.RecordBatch):
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        for i, data, off in K.chunks(col("bytes"), COMPARE_BYTES // 8):
            who, at = _windows(off, length)
            p = off[who] + at
            h = K.digests128(data, p, p + length)
            own = {c: col(c).to_numpy(zero_copy_only=False)[who + i] for c in ("k1", "k2", "lo", "target")}
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(own["k1"]), pa.array(own["k2"]), pa.array((own["lo"] + at).astype(np.int32)), pa.array(own["target"])], names=["h1", "h2", "k1", "k2", "s", "target"])

    windows = arrow(contexts, work, "h1 bigint, h2 bigint, k1 bigint, k2 int, s int, target boolean")
    twice = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    hit = windows.where("target").join(twice, ["h1", "h2"]).select("k1", "k2", "s")

    def pack(batch: pa.RecordBatch):
        out = np.empty(batch.num_rows, SPAN)
        for i, c in enumerate(("k1", "k2", "s")):
            out[c] = batch.column(i).to_numpy(zero_copy_only=False)
        out["e"] = out["s"] + length
        where, _, payloads = _blobs(out, _range(out["k1"].copy(), ranges))
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(payloads, pa.binary())], names=["range", "payload"])

    return arrow(hit, pack, "range int, payload binary")


def find(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(k1, k2, spans): for each row with repeated strings, its fingerprints and covered byte spans (start, end), merged."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    family = IndexFamily(spark, scratch(spark, "suffix-family"))
    dealt = family.ranges
    every = cut(entries(keyed, length, dealt, batches), "suffix-incoming", BLOB_GROUP)
    for b in range(batches):
        family.add(every.where(F.col("batch") == b), dealt)
    drop_written(every)
    found = cut(_found(family, keyed, length), "suffix-found", BLOB_GROUP)
    remove_path(spark, family.folder)
    edges = found.where("key is not null").groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "lo", "more", "target", "hot")).alias("list"))
    wanted = keyed.select("k1", "k2", "text").join(edges.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "list")
    contexts = cut(_contexts(wanted, length), "suffix-contexts")
    blobs = found.where("range is not null").select("range", "payload")
    return _merged(blobs.unionByName(_compared(contexts.where("not hot"), length, family.ranges)).unionByName(_spread(contexts.where("hot"), length, family.ranges)))


def remove(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) of every text: what repeats removed, with the bytes that stay."""
    keyed = _keyed(docs, id_col, text_col)
    spans = find(docs, length, id_col, text_col, batches)
    joined = keyed.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "spans")

    def work(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            data, off = K.raw(part.column(1))
            removed, runs, kept = [], [], []
            for i, found in enumerate(part.column(2).to_pylist()):
                text = data[off[i] : off[i + 1]]
                pairs = np.frombuffer(found or b"", "<i4").reshape(-1, 2)
                s, e = pairs[:, 0].tolist(), pairs[:, 1].tolist()
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip([0, *e], [*s, len(text)], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(s))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow(joined, work, f"`{id_col}` {keyed.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
