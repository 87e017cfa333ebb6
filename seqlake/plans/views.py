"""Sequencing tables derived from the given tables, in Spark and in DuckDB's SQL.

Every letter of a document becomes a base; a document is one contig, and its pieces of READ bases are its reads, so the
whole text takes part. Qualities follow from base, place and document."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_letters, ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 150
#: More reads than a document can have: a string holds less than 2^31 bytes.
MOST_READS = 100_000_000
FROM, TO = ascii_uppercase + ascii_lowercase, ("ACGT" * 6 + "AC") * 2
assert len(ascii_letters) == len(TO)

SEQS_SQL = f"seqs AS (SELECT doc_id, source, lang, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{FROM}', '{TO}') AS seq FROM documents)"
READS_SQL = f"{SEQS_SQL}, reads AS (SELECT doc_id * {MOST_READS} + i AS read_id, doc_id, source, substring(seq, i * {READ} + 1, {READ}) AS seq FROM seqs, unnest(range(0, (length(seq) + {READ - 1}) // {READ})) AS t(i))"
QUALITY_SQL = f"{READS_SQL}, quals AS (SELECT read_id, doc_id, seq, list_transform(range(1, length(seq) + 1), lambda i: ((ascii(substring(seq, i, 1)) * 7 + i * (doc_id % 97)) % 41)::BIGINT) AS q FROM reads)"
CONTIGS_SQL = f"{SEQS_SQL}, contigs AS (SELECT doc_id AS contig_id, seq, length(seq) AS len, (2 + doc_id % 40)::DOUBLE AS coverage FROM seqs WHERE length(seq) > 0)"
SOURCES_SQL = f"sources AS (SELECT item_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{FROM}', '{TO}') AS seq FROM benchmark)"
#: Contigs to be checked: all documents, and each source as put together by rule: whole, its second half turned round, its middle third lost, or ending in the next source.
CHECKED_SQL = (
    f"{CONTIGS_SQL}, {SOURCES_SQL}, checked AS (SELECT contig_id, seq FROM contigs UNION ALL SELECT -1 - s.item_id, CASE s.item_id % 4 WHEN 0 THEN s.seq WHEN 1 THEN left(s.seq, length(s.seq) // 2) || reverse(translate(substring(s.seq, length(s.seq) // 2 + 1), 'ACGT', 'TGCA'))"
    " WHEN 2 THEN left(s.seq, length(s.seq) // 3) || substring(s.seq, 2 * (length(s.seq) // 3) + 1) ELSE left(s.seq, length(s.seq) // 2) || coalesce(n.seq, '') END FROM sources s LEFT JOIN sources n ON n.item_id = s.item_id + 1)"
)
#: Bases of the shortest contig that is put into bins or classified.
LEAST_CONTIG = 1000
LONG_CONTIGS_SQL = CONTIGS_SQL.replace("length(seq) > 0", f"length(seq) >= {LEAST_CONTIG}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """Dealt out over all cores where the files have fewer pieces than there are cores, as a single small file has; larger tables stay as they are read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


#: The base of each letter, 0 for all other bytes of UTF-8.
_BASE = np.zeros(256, np.uint8)
_BASE[np.frombuffer(FROM.encode(), np.uint8)] = np.frombuffer(TO.encode(), np.uint8)
#: Bytes of texts that are turned into bases at once.
AT_ONCE = 4 << 20


def _bases(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bases laid end to end, offsets) of texts."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _BASE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]
    kept = data != 0
    return data[kept], np.append(0, np.cumsum(kept))[off - off[0]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about AT_ONCE bytes of text, the last column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pa.compute.binary_length(batch.columns[-1]).fill_null(0)).astype(np.int64))
        cuts = np.unique(np.append(np.searchsorted(size, np.arange(0, int(size[-1]), AT_ONCE), side="left"), batch.num_rows))
        for lo, hi in zip(np.append(0, cuts[cuts > 0])[:-1].tolist(), cuts[cuts > 0].tolist(), strict=True):
            yield batch.slice(lo, hi - lo)


def _strings(data: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    mask = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data), mask)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        data, off = _bases(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], _strings(data, off, np.asarray(batch.column(3).is_null()))], names=["doc_id", "source", "lang", "seq"])


def _reads(batches: Iterator[pa.RecordBatch], qualities: bool) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        data, off = _bases(batch.column(2))
        many = -(-np.diff(off) // READ)
        doc, first = np.repeat(np.arange(batch.num_rows), many), np.cumsum(many) - many
        nth = np.arange(len(doc)) - first[doc]
        ends = np.append(off[:-1][doc] + nth * READ, len(data))
        ids = pa.compute.take(batch.column(0), pa.array(doc))
        columns = {"read_id": pa.compute.add(pa.compute.multiply(ids, pa.scalar(MOST_READS, pa.int64())), pa.array(nth)), "doc_id": ids}
        if qualities:
            # As Spark's and SQL's %, the sign is that of the left side.
            step = np.fmod(np.asarray(ids.fill_null(0)), 97)
            place = np.arange(1, len(data) + 1) - np.repeat(ends[:-1], np.diff(ends))
            q = np.fmod(data.astype(np.int64) * 7 + place * np.repeat(step, np.diff(ends)), 41)
            columns |= {"seq": _strings(data, ends), "q": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(q))}
        else:
            columns |= {"source": pa.compute.take(batch.column(1), pa.array(doc)), "seq": _strings(data, ends)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, seq. Texts become bases in Arrow batches by a table of bytes; a regular expression and translate() cost several times as much."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.mapInArrow(_sequences, "doc_id bigint, source string, lang string, seq string")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, doc_id, source, seq."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.mapInArrow(lambda x: _reads(x, False), "read_id bigint, doc_id bigint, source string, seq string")


def quality_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, doc_id, seq, q (Phred scores)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.mapInArrow(lambda x: _reads(x, True), "read_id bigint, doc_id bigint, seq string, q array<bigint>")


def contigs(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """contig_id, seq, len, coverage of sequences of at least so many bases."""
    s = sequences(spark, sf_dir).where(F.char_length("seq") >= least)
    return s.select(F.col("doc_id").alias("contig_id"), "seq", F.char_length("seq").cast("long").alias("len"), (2 + F.col("doc_id") % 40).cast("double").alias("coverage"))


def long_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those contigs that are put into bins or classified."""
    return contigs(spark, sf_dir, LEAST_CONTIG)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, seq: the sequences of the benchmark, of which documents hold pieces."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), FROM, TO).alias("seq"))


def checked_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, seq of all documents, and with ids below 0 of each source as put together by rule, three in four of them wrongly."""
    s = sources(spark, sf_dir).where("seq is not null")
    after = s.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("after"))
    half, third = F.floor(F.char_length("seq") / 2).cast("int"), F.floor(F.char_length("seq") / 3).cast("int")
    start = F.left("seq", half)
    rest = F.reverse(F.translate(F.substring("seq", half + 1, F.char_length("seq")), "ACGT", "TGCA"))
    kind = F.col("item_id") % 4
    made = F.when(kind == 0, F.col("seq")).when(kind == 1, F.concat(start, rest)).when(kind == 2, F.concat(F.left("seq", third), F.substring("seq", 2 * third + 1, F.char_length("seq")))).otherwise(F.concat(start, F.coalesce("after", F.lit(""))))
    return contigs(spark, sf_dir).select("contig_id", "seq").unionByName(s.join(after, "item_id", "left").select((-1 - F.col("item_id")).alias("contig_id"), made.alias("seq")))
