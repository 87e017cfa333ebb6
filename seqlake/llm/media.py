"""Media columns: payloads stored as content-defined chunks, deduplicated by Spark joins, rebuilt from ordered lists.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are the 8-bit mono samples of a WAV file;
that file is the medium. A gear hash rolls over it (64-bit, doubling additions in numpy) and cuts where its top bits are
zero, between a least and a greatest chunk size. The table that stores media has a row for each document: the medium's
SHA-256, the ordered list of its chunks' SHA-256 digests and sizes, and the bytes of those chunks that the row owns.

1. One pass makes digests only. Equal media have one owner row; of chunks in several media one medium is the owner.
   These are joins and aggregates of digests; payloads do not move.
2. A second pass over the texts writes the table: owned chunks that others refer to in one column, all other owned
   chunks in another. What a row doesn't own is not written.
3. Reading back takes the owner rows. Rows that own all their chunks are put together where they are read; for others,
   only the shared column is read and its chunks are joined in by digest. Each medium is verified against its
   SHA-256, its samples are taken from the WAV file, and features are computed once for each medium.

Bytes move only for chunks that several media share, once for each of these media. The roles of rows (what not to write) are
broadcast if their written size is within the bound of common.BROADCAST_BYTES; beyond it that join shuffles.

Null counts as the empty text, whose payload is 576 bytes 255. Repeated rows have equal results; a row that repeats
with id and text may be stored twice. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, cut, scratch, small_side

UNIT = 576
LEAST, MASK_BITS, MOST = 1024, 12, 16384
#: Header of a WAV file with one 8-bit PCM channel.
HEADER, RATE = 44, 8000

_GEAR = np.random.Generator(np.random.PCG64(65537)).integers(0, 1 << 64, 256, dtype=np.uint64)


def payload_of(text: bytes) -> bytes:
    fill = -len(text) % UNIT if text else UNIT
    return text + b"\xff" * fill


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples; RIFF pads odd data to even sizes, but payloads are multiples of 576."""
    n = len(samples)
    head = b"RIFF" + (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") * 2 + RATE.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    return head + b"data" + n.to_bytes(4, "little") + samples


def samples_of(medium: bytes) -> bytes:
    """The data of a WAV file written by wav()."""
    n = int.from_bytes(medium[40:44], "little")
    if medium[:4] != b"RIFF" or medium[36:40] != b"data" or len(medium) != HEADER + n:
        raise ValueError("not a WAV file of this store")
    return medium[HEADER:]


def cuts(medium: bytes) -> list[int]:
    """Ends of the chunks of a medium."""
    n = len(medium)
    h = _GEAR[np.frombuffer(medium, np.uint8)]
    for s in (1, 2, 4, 8, 16, 32):
        h[s:] += h[:-s] << np.uint64(s) if n > s else h[:0]
    found = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    out, at, i = [], 0, 0
    places = found.tolist()
    while n - at > LEAST:
        while i < len(places) and places[i] < at + LEAST:
            i += 1
        end = min(places[i] if i < len(places) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunked(medium: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks, in order."""
    out, at = [], 0
    for end in cuts(medium):
        part = medium[at:end]
        out.append((hashlib.sha256(part).digest(), part))
        at = end
    return out


def features(payload: bytes) -> str:
    """Mean, root mean square about 128, rate of crossings of 128, and the loudest 576-sample frame."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    energy = (x * x).reshape(-1, UNIT).sum(1)
    cross = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.sum() / len(x):.6f};rms={float(energy.sum() / len(x)) ** 0.5:.6f};zcr={cross / len(x):.6f};peak={int(energy.argmax())};frames={len(energy)}"


def _texts(column: pa.Array):
    data, off = K.raw(column)
    view = memoryview(data)
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield bytes(view[s:e])


def _digests(keyed: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            media, lists = [], []
            for t in _texts(part.column(2)):
                m = wav(payload_of(t))
                media.append(hashlib.sha256(m).digest())
                lists.append([d for d, _ in chunked(m)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(media, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["id", "k", "medium", "chunks"])

    return arrow(keyed, work, f"id {keyed.schema['id'].dataType.simpleString()}, k bigint, medium binary, chunks array<binary>")


_PART = "array<struct<digest: binary, data: binary>>"


def store(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the media table of all texts to the folder `to`."""
    keyed = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast("string"), docs[text_col].cast("string")).alias("k"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    first = cut(_digests(keyed), "media-digests")
    owner = F.min(F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "k")).alias("owner")
    owners = cut(first.groupBy("medium").agg(owner, F.first("chunks").alias("chunks")), "media-owners")
    in_media = owners.select("medium", F.explode(F.array_distinct("chunks")).alias("digest"))
    shared = in_media.groupBy("digest").agg(F.min("medium").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    parts = in_media.join(shared, "digest").groupBy("medium").agg(F.collect_list(F.when(F.col("keeper") == F.col("medium"), F.col("digest"))).alias("lend"), F.collect_list(F.when(F.col("keeper") != F.col("medium"), F.col("digest"))).alias("skip"))
    roles = owners.select("medium", "owner").join(parts, "medium", "left")
    mine = F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "k")
    role = first.select("id", "k", "medium").join(roles, "medium").select("id", "k", (mine != F.col("owner")).alias("copy"), "lend", "skip").where("copy or lend is not null").distinct()
    role = small_side(cut(role.withColumns({c: F.when(~F.col("copy"), F.col(c)) for c in ("lend", "skip")}), "media-roles"))
    joined = keyed.alias("a").join(role.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.k") == F.col("b.k")), "left").select("a.id", "text", "copy", "lend", "skip")

    def work(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            out: list[list] = [[] for _ in range(8)]
            for t, copy, lend, skip in zip(_texts(part.column(1)), *(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                m, seen = wav(payload_of(t)), set(skip or ())
                lend, own, lent, missing, names = set(lend or ()), [], [], False, []
                for d, b in chunked(m):
                    names.append({"digest": d, "size": len(b)})
                    if copy or d in seen:
                        missing = True
                        continue
                    (lent if d in lend else own).append({"digest": d, "data": b})
                    seen.add(d)
                missing = not copy and bool(skip)
                for c, v in zip(out, (hashlib.sha256(m).digest(), len(t), len(m), bool(copy), missing, names, own, lent), strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int64())])), *[pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))] * 2)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "medium", "n_bytes", "media_bytes", "copy", "missing", "chunks", "own", "lent"])

    kind = keyed.schema["id"].dataType.simpleString()
    arrow(joined, work, f"id {kind}, medium binary, n_bytes bigint, media_bytes bigint, copy boolean, missing boolean, chunks array<struct<digest: binary, size: bigint>>, own {_PART}, lent {_PART}").write.option("compression", "zstd").parquet(to)


def media(stored: DataFrame) -> DataFrame:
    """(medium, parts) of each medium of a store once: its chunk list with all its chunks' bytes, in no order."""
    owners = stored.where("not copy")
    whole = owners.where("not missing").select("medium", "chunks", F.concat("own", "lent").alias("parts"))
    lent = stored.where("not copy and size(lent) > 0").select(F.explode("lent").alias("part")).select("part.digest", "part.data").dropDuplicates(["digest"])
    needs = owners.where("missing").select("medium", F.explode(F.array_distinct(F.array_except(F.expr("transform(chunks, c -> c.digest)"), F.expr("transform(concat(own, lent), c -> c.digest)")))).alias("digest")).distinct()
    got = needs.join(lent, "digest").groupBy("medium").agg(F.collect_list(F.struct("digest", "data")).alias("others"))
    open_ = owners.where("missing").dropDuplicates(["medium"]).join(got, "medium", "left").select("medium", "chunks", F.concat("own", "lent", F.coalesce("others", F.array().cast(_PART))).alias("parts"))
    return whole.unionByName(open_)


def rebuild(chunks: list[dict], parts: list[dict], medium: bytes) -> bytes:
    """The medium's bytes from its ordered list, verified."""
    have = {p["digest"]: p["data"] for p in parts}
    out = b"".join(have[c["digest"]] for c in chunks)
    if hashlib.sha256(out).digest() != medium:
        raise ValueError("a medium does not match its digest")
    return out


def read(stored: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each row of a store, from the bytes read back."""

    def work(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            rows = []
            for m, chunks, parts in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                file = rebuild(chunks, parts, m)
                p = samples_of(file)
                rows.append({"medium": m, "n_bytes": len(p.rstrip(b"\xff")), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-32:]), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": features(p)})
            yield pa.RecordBatch.from_pylist(rows)

    facts = arrow(media(stored), work, "medium binary, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    facts = cut(facts, "media-facts").dropDuplicates(["medium"])
    return stored.select("id", "medium").join(facts, "medium").drop("medium")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media in the shared folder and read them back."""
    to = scratch(docs.sparkSession, "media")
    store(docs, to, id_col, text_col)
    return read(docs.sparkSession.read.parquet(to)).withColumnRenamed("id", id_col)
