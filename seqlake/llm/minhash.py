"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and exact confirmation.

A document's set holds its distinct shingles of `width` words (runs without ASCII white space, A-Z lower-cased); with
fewer words the whole sequence is one shingle; without words the set is empty and linked with nothing. Two documents
are linked if intersection / union >= percent / 100, checked on whole sets.

1. One pass gives each document its set's size, a 128-bit fingerprint of its word sequence, BANDS band keys of ROWS
   minima each and a byte of every minimum. Documents with one word sequence are one node from here on.
2. Each bucket of a band proposes its members against the bucket's least node: as many pairs as members.
3. Verification compares bytes of the signatures in batches of STEP. After each batch a pair goes when the posterior
   probability (uniform prior) that its similarity reaches the threshold is below MISS. Survivors are confirmed on
   full shingle sets, taken from the texts again.
4. Components of the links, by alternating star contraction. In buckets that still hold several components, all pairs
   between different components are verified and, unless connected meanwhile, confirmed. Members are dealt into blocks
   for that, a task compares two blocks, and pairs stay inside it. Pairs inside one component cannot change the result, so
   a group of thousands of copies costs a star and not its square, and no link between different texts is lost but for
   the bands' and MISS's probability (at similarity 0.8 the bands miss one pair in 300,000).

Links are confirmed on sets of the words themselves. Set sizes count 64-bit fingerprints of shingles, nodes are told apart by 128 bits.

Null text has no words. Rows that repeat are documents of one node each; rows that share an id share its component
only through their texts. A null id never is the smallest of a component with other ids. Further columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from itertools import islice
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, cut, small_side

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP, MISS = 32, 1e-7
#: Members of a bucket that are compared with each other at once, and shingles of such a block's members.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Words of two texts whose sets of shingles are compared in one pass, and words of texts that a comparing task keeps.
PASS, HELD = 200_000, 100_000

WORD = K.byte_class((0x20, 0x20), (0x09, 0x0D))
_rng = np.random.Generator(np.random.PCG64(4711))
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SALT = np.uint64(0xA24BAED4963EE407)


def shingles(data: np.ndarray, off: np.ndarray, width: int):
    """(shingle fingerprints by text, each text's first and the end)."""
    low = K.lower_ascii(data)
    s, e, first = K.word_slices(low, off, WORD)
    n = np.diff(first)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    h = K.word_hash(low, s, e)
    whole = K.mix(h)
    for j in range(1, width):
        whole = K.mix(whole[: len(whole) - 1] * _SALT + h[j:]) if len(whole) > 1 else whole[:0]
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    at = np.repeat(first[:-1] - begin, count) + np.arange(int(count.sum()))
    short = np.flatnonzero((n > 0) & (n < width)).tolist()
    if short:
        at[begin[short]] = 0
    out = whole[at] if len(whole) else np.zeros(len(at), np.uint64)
    for k in short:
        x = np.uint64(len(h[first[k] : first[k + 1]]))
        for w in h[first[k] : first[k + 1]]:
            x = K.mix(np.array([x], np.uint64) * _SALT + w)[0]
        out[begin[k]] = x
    return out, np.append(begin, len(out))


def minima(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES minima of the shingles of each text that has some."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(first)), np.uint32)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], first)
    return out


def words_of(text: np.ndarray) -> list[bytes]:
    """The words of one text's bytes; bytes.split() parts at exactly the white space of WORD."""
    return K.lower_ascii(text).tobytes().split()


def overlap(x: list[bytes], y: list[bytes], width: int) -> tuple[int, int, int]:
    """Sizes of both sets of shingles and of their intersection, from the words themselves; long texts in several passes."""
    if min(len(x), len(y)) < width:
        return 1, 1, int(x == y)  # one of them is a single shingle, which no longer text has
    passes = 1 + (len(x) + len(y)) // PASS
    sizes = [0, 0, 0]
    for r in range(passes):
        a, b = ({t for t in zip(*(islice(w, k, None) for k in range(width)), strict=False) if passes == 1 or hash(t[0]) % passes == r} for w in (x, y))
        for k, n in enumerate((len(a), len(b), len(a & b))):
            sizes[k] += n
    return sizes[0], sizes[1], sizes[2]


def linked(x: list[bytes], y: list[bytes], width: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; a count of words alone rules out unequal lengths first."""
    if min(len(x), len(y)) < width:
        return x == y
    a, b, common = overlap(x, y, width)
    return 100 * common >= percent * (a + b - common)


class Words:
    """Words of the texts used last, as many as HELD allows."""

    def __init__(self, column):
        self.column, self.kept, self.size = column, OrderedDict(), 0

    def of(self, i: int) -> list[bytes]:
        if i in self.kept:
            self.kept.move_to_end(i)
            return self.kept[i]
        got = self.kept[i] = words_of(K.raw(self.column.slice(i, 1))[0])
        self.size += len(got)
        while self.size > HELD and len(self.kept) > 2:
            self.size -= len(self.kept.popitem(last=False)[1])
        return got


def least_matches(percent: int, step: int = STEP, total: int = HASHES, miss: float = MISS) -> list[int]:
    """After each batch, the least number of equal bytes at which a pair stays."""
    t = percent / 100
    j = (np.arange(20000) + 0.5) / 20000
    q = j + (1 - j) / 256  # bytes agree by chance too
    out = []
    for n in range(step, total + 1, step):
        keep = n
        for m in range(n, -1, -1):
            like = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(q) + (n - m) * np.log1p(-q)
            w = np.exp(like - like.max())
            if w[j >= t].sum() / w.sum() < miss:
                break
            keep = m
        out.append(keep)
    return out


def profile(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, k1 and k2 (fingerprints that name the row), n (set size), node, bands, sig of each row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast("string"), text).alias("k1"), F.hash(text, docs[id_col].cast("string")).alias("k2"), text.alias("text"))

    def work(batch: pa.RecordBatch):
        for i, data, off in K.chunks(batch.column(3)):
            s, first = shingles(data, off, width)
            texts = len(off) - 1
            n = np.array([len(np.unique(s[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.int64)
            some = np.flatnonzero(n)
            node, bands, sig = [None] * texts, [None] * texts, [None] * texts
            if len(some):
                low = minima(s, first[some]).astype(np.uint64)
                spread = K.mix(low + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))[:, None])
                one = np.ascontiguousarray((spread & np.uint64(255)).astype(np.uint8).T)
                keys = spread.reshape(BANDS, ROWS, -1)
                band = np.arange(BANDS, dtype=np.uint64)[:, None] * _SALT
                for j in range(ROWS):
                    band = K.mix(band * _SALT + keys[:, j])
                band = np.ascontiguousarray(band.T).view(np.int64)
                for k, t in enumerate(some.tolist()):
                    words = b" ".join(words_of(data[off[t] : off[t + 1]]))
                    node[t], bands[t], sig[t] = hashlib.blake2b(words, digest_size=16).digest(), band[k], one[k].tobytes()
            cols = [*(batch.column(j).slice(i, texts) for j in range(3)), pa.array(n), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "k1", "k2", "n", "node", "bands", "sig"])

    kind = keyed.schema["id"].dataType.simpleString()
    return arrow(keyed, work, f"id {kind}, k1 bigint, k2 int, n bigint, node binary, bands array<bigint>, sig binary")


def survivors(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of x and y (or of y against one x) that no batch of STEP bytes rules out."""
    live, same = np.arange(len(y)), np.zeros(len(y), np.int64)
    for k, keep in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        same = same + ((x[part] if x.ndim == 1 else x[live, part]) == y[live, part]).sum(1)
        stay = same >= keep
        live, same = live[stay], same[stay]
    return live


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures' bytes rules out."""
    least = least_matches(percent)
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def work(batch: pa.RecordBatch):
        x, y = (K.raw(batch.column(c))[0].reshape(-1, HASHES) for c in (2, 3))
        live = survivors(x, y, least)
        if len(live):
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(live)) for c in (0, 1)], names=["a", "b"])

    return arrow(both, work, "a binary, b binary")


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of needed nodes (node, k1, k2)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(docs[id_col].cast("string"), text).alias("k1"), F.hash(text, docs[id_col].cast("string")).alias("k2"), text.alias("text"))
    return cut(keyed.join(needed, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]), "minhash-texts")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs whose full sets meet the threshold; texts are read for the nodes of pairs only."""
    pairs = cut(pairs, "minhash-pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = small_side(cut(needed.join(nodes.select("node", "k1", "k2"), "node"), "minhash-needed"))
    texts = _texts(docs, needed, id_col, text_col)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def work(batch: pa.RecordBatch):
        x, y, good = Words(batch.column(2)), Words(batch.column(3)), []
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at: dict[tuple[int, bytes], int] = {}  # one row stands for each text, so a star's head is read once
        for i in range(batch.num_rows):
            if linked(x.of(at.setdefault((0, a[i]), i)), y.of(at.setdefault((1, b[i]), i)), width, percent):
                good.append(i)
        if good:
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good)) for c in (0, 1)], names=["a", "b"])

    return cut(arrow(both, work, "a binary, b binary"), "minhash-links")


def _grouped(batches, key: str):
    """Tables of the rows of one key each, from batches that are sorted by it."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        k = np.asarray(rows.column(key).to_pylist(), object)
        cut_at = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cut_at.tolist()]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield rows.slice(s, e - s)
        held = rows.slice(edges[-1])
    if held is not None:
        yield held


class _Union:
    """Which of a few things are connected."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def crossed(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Links between different components that share a bucket, as far as they connect more than is connected.

    The members of a bucket are dealt into blocks, large components into blocks of their own, small ones together. Each pair
    of blocks is a task's unit, but for blocks of one large component, so a bucket of N members with few of other components
    makes about N rows. Pairs never become rows. First, signatures are compared, each pair in the first bucket that it
    shares; then texts are fetched for the pairs of blocks in which pairs are left, and these are confirmed on full sets
    unless they are connected by now."""
    named = buckets.where("size > 2").join(labels, "node", "left").select("bucket", "band", "node", "head", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
    left = cut(named.join(mixed, "bucket").where("node != head").join(nodes.select("node", "n"), "node"), "minhash-mixed")
    need = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    by_label = left.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w")).select("*", need.alias("blocks")).withColumn("large", F.col("m") >= BLOCK)
    small = by_label.where("not large").groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("w").alias("w")).select("bucket", need.alias("blocks"))
    block = lambda label, k: F.concat_ws("/", label, k.cast("string"))
    listed = by_label.where("large").select("bucket", F.hex("label").alias("of"), "blocks").unionByName(small.select("bucket", F.lit("").alias("of"), "blocks"))
    listed = listed.groupBy("bucket").agg(F.collect_list(F.struct("of", "blocks")).alias("every"))
    owned = left.join(by_label.where("large").select("bucket", "label", F.col("blocks").alias("many")), ["bucket", "label"], "left").join(small.withColumnRenamed("blocks", "few"), "bucket", "left").join(listed, "bucket")
    of = F.when(F.col("many").isNotNull(), F.hex("label")).otherwise("")
    owned = owned.withColumns({"of": of, "own": block(of, F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("label", "node"), F.col("few"))))})
    others = F.filter("every", lambda b: (b["of"] == "") | (b["of"] != F.col("of")))
    partners = F.flatten(F.transform(others, lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda k: block(b["of"], k))))
    unit = F.explode(F.transform(partners, lambda b: F.concat_ws("-", F.hex("bucket"), F.least(b, F.col("own")), F.greatest(b, F.col("own")))))
    dealt = owned.select(unit.alias("unit"), "own", "node", "band", "label").join(nodes.select("node", "bands", "sig"), "node")
    least = least_matches(percent)

    def compare(batches):
        for rows in _grouped(batches, "unit"):
            if rows.num_rows < 2:
                continue
            node, label = rows.column("node").to_pylist(), rows.column("label").to_pylist()
            _, own = np.unique(np.array(rows.column("own").to_pylist(), object), return_inverse=True)
            _, name = np.unique(np.array(label, object), return_inverse=True)
            sig = np.stack([np.frombuffer(x, np.uint8) for x in rows.column("sig").to_pylist()])
            band = np.stack(rows.column("bands").to_pylist())[:, : rows.column("band")[0].as_py()]
            two, pairs = own.max() > 0, []
            solo = rows.column("unit")[0].as_py().split("-")
            if not two and solo[1] != solo[2]:
                continue
            for i in range(len(node) - 1):
                j = np.flatnonzero((name[i + 1 :] != name[i]) & ((own[i + 1 :] != own[i]) | (not two))) + i + 1
                if len(j):
                    j = j[survivors(sig[i], sig[j], least)]
                if len(j):
                    j = j[~(band[j] == band[i]).any(1)]
                pairs += [(i, x) for x in j.tolist()]
            if pairs:
                used = sorted({x for p in pairs for x in p})
                at = {x: k for k, x in enumerate(used)}
                yield pa.RecordBatch.from_pylist([{"unit": "-".join(solo), "nodes": [node[x] for x in used], "labels": [label[x] for x in used], "a": [at[x] for x, _ in pairs], "b": [at[y] for _, y in pairs]}], schema=pa.schema([("unit", pa.string()), ("nodes", pa.list_(pa.binary())), ("labels", pa.list_(pa.binary())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        K.give_back()

    units = dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "unit string, nodes array<binary>, labels array<binary>, a array<int>, b array<int>")
    units = cut(units, "minhash-units")
    needed = units.select(F.explode("nodes").alias("node")).distinct()
    needed = small_side(cut(needed.join(nodes.select("node", "k1", "k2"), "node"), "minhash-needed"))
    texts = _texts(docs, needed, id_col, text_col)
    head = F.col("at") == 0
    spread = units.select("unit", "labels", "a", "b", F.posexplode("nodes").alias("at", "node")).select("unit", "at", "node", F.get("labels", F.col("at")).alias("label"), *(F.when(head, F.col(c)).alias(c) for c in ("a", "b")))
    joined = spread.join(texts, "node")

    def confirm(batches):
        for rows in _grouped(batches, "unit"):
            order = np.argsort(rows.column("at").to_numpy())
            rows = rows.take(pa.array(order))
            have = Words(rows.column("text"))
            union, node, good = _Union(rows.column("label").to_pylist()), rows.column("node").to_pylist(), []
            for i, j in zip(rows.column("a")[0].as_py(), rows.column("b")[0].as_py(), strict=True):
                a, b = union.find(i), union.find(j)
                if a != b and linked(have.of(i), have.of(j), width, percent):
                    union.up[max(a, b)] = min(a, b)
                    good.append({"a": node[i], "b": node[j]})
            if good:
                yield pa.RecordBatch.from_pylist(good, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))
        K.give_back()

    return cut(joined.repartition("unit").sortWithinPartitions("unit").mapInArrow(confirm, "a binary, b binary"), "minhash-crossed")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links (a, b): label is the component's least node. Alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    was = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = cut(small, "stars")
        now = mark(edges)
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        was = now


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, k1, k2, n_shingles, component_id, kept) of each row; k1 and k2 name the row by fingerprints of id and text."""
    rows = cut(profile(docs, width, id_col, text_col), "minhash-rows")
    one = F.min(F.struct("id", "k1", "k2"))
    nodes = rows.where("node is not null").groupBy("node").agg(one.alias("r"), *(F.first(c).alias(c) for c in ("n", "bands", "sig")))
    nodes = cut(nodes.select("node", "r.k1", "r.k2", "n", "bands", "sig"), "minhash-nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    buckets = cut(members.join(heads, "bucket"), "minhash-buckets")
    stars = buckets.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = confirmed(verified(stars, nodes, percent), nodes, docs, percent, width, id_col, text_col)
    labels = components(links)
    more = crossed(buckets, nodes, labels, docs, percent, width, id_col, text_col)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    slim = rows.select("id", "k1", "k2", "n", "node")
    named = slim.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    out = named.join(least, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id_col), "k1", "k2", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()).alias("kept"))
