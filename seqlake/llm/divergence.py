"""How far the sources of a language differ in their words: dense group-by-term matrices in blocks of terms.

Groups are (lang, source). A language keeps the terms of at least `least_docs` of its documents; there are V of them. In a
group whose counts of kept terms add up to N a term has the share p = 1 + floor(10^9 * (count + 1) / (N + V)). The
difference of a share p from a share q is floor((p - q)^2 / q).

1. Terms are counted by batch with array work, (lang, source, term) with its count and number of documents is shuffled.
2. A column of the matrix is a kept term with its counts by source. Columns are dealt in blocks by hash, more of them to a
   language of more cells, so that a tile (groups x terms of a block) has about CELLS cells whatever the language; the groups'
   totals go to each of its language's tiles.
3. A tile is a dense numpy int64 matrix: its shares of all groups at once, then for each group its differences from all others by
   broadcasting, summed over the tile's terms. It also keeps a heap of each group's `top` terms by their difference from
   the share in the whole language.
4. Spark adds the partial matrices of pairs and merges the heaps: each task keeps a group's best rows before they meet.

All arithmetic is exact: shares by long division in steps of 1000 (N + V below 9 * 10^15), squares below 2^63. Null text, lang
and source are ''. Repeated rows count each. Languages without kept terms have pairs of value 0. Terms of any length
are whole. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, cut, drop_written, ship, small_side
from .spelling import strings

#: Cells of a tile, about: a dense matrix of 4 MB.
CELLS = 1 << 19
UNIT = 1_000_000_000
IN_TERM = K.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text)."""
    (langs, lang), (sources, source) = ((x.dictionary, np.asarray(x.indices)) for x in (K.string_array(batch.column(k)).dictionary_encode() for k in (0, 1)))
    group = lang.astype(np.int64) * len(sources) + source
    docs, terms = [], []
    for row, data, off in K.chunks(batch.column(2)):
        data = K.lower_ascii(data)
        start, end, first = K.word_slices(data, off, IN_TERM)
        docs.append(row + np.repeat(np.arange(len(off) - 1), np.diff(first)))
        terms.append(strings(data, start, end))
    coded = pa.chunked_array(terms, pa.large_string()).combine_chunks()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    named = max(len(coded.dictionary), 1)
    in_doc, n = np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]) * named + np.asarray(coded.indices), return_counts=True)
    key, back, of_docs = np.unique(group[in_doc // named] * named + in_doc % named, return_inverse=True, return_counts=True)
    total = np.bincount(back, n, len(key)).astype(np.int64)
    g = key // named
    columns = [langs.take(pa.array(g // len(sources))), sources.take(pa.array(g % len(sources))), coded.dictionary.take(pa.array(key % named)).cast(pa.string()), pa.array(total), pa.array(of_docs)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def shares(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + kept)), exactly."""
    of = np.asarray(total, np.int64) + kept
    whole, rest = np.divmod(count + 1, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


def tile(counts: np.ndarray, totals: np.ndarray, kept: int, terms: list[str], top: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Of a groups x terms matrix of counts: the sums of differences of each group (row) from each other (column); and of each
    group the best (place of term, difference from the language). Terms are sorted by their bytes."""
    p, q = shares(counts, totals[:, None], kept), shares(counts.sum(0), int(totals.sum()), kept)
    pairs = np.stack([((one - p) ** 2 // p).sum(1) for one in p])
    best = []
    for seen, one in zip(counts, p, strict=True):
        at = np.flatnonzero((seen > 0) & (one > q))
        value = (one[at] - q[at]) ** 2 // q[at]
        order = np.lexsort((at, -value))[:top]
        best.append(list(zip(at[order].tolist(), value[order].tolist(), strict=True)))
    return pairs, best


_ROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tiled(top: int):
    def work(key: tuple[pa.Scalar, ...], columns: pa.Table, groups: pa.Table) -> pa.Table:
        lang, kept = key[0].as_py(), groups.column("kept")[0].as_py()
        groups = groups.sort_by("source")
        sources, totals = groups.column("source").combine_chunks(), np.asarray(groups.column("total"), np.int64)
        columns = columns.sort_by("term")
        terms = columns.column("term").to_pylist()
        counts = np.zeros((len(sources), len(terms)), np.int64)
        cells = columns.column("cells").combine_chunks()
        cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
        flat = cells.flatten()
        if len(flat):
            at = np.repeat(np.arange(len(terms)), np.asarray(pc.list_value_length(cells)))
            counts[np.asarray(pc.index_in(flat.field("source"), value_set=sources)), at] = np.asarray(flat.field("n"))
        pairs, best = tile(counts, totals, kept, terms, top)
        named, s = sources.to_pylist(), len(sources)
        a, b = (x[~np.eye(s, dtype=bool)] for x in np.indices((s, s)))
        source, item = [named[i] for i in a.tolist()], [named[i] for i in b.tolist()]
        value, part = pairs[a, b].tolist(), ["pair"] * len(source)
        for g, rows in zip(named, best, strict=True):
            for t, v in rows:
                source.append(g), item.append(terms[t]), value.append(v), part.append("term")
        return pa.table([[lang] * len(source), source, part, item, value], schema=_ROW)

    return work


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, the other sources; part `term`, the terms that the source has more of than its language."""
    ship(docs.sparkSession)
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    narrow = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), docs[text_col].cast("string").alias("text"))
    counted = arrow(narrow.where("text is not null"), lambda b: iter([_counted(b)]), "lang string, source string, term string, n bigint, docs bigint")
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    columns = cut(counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "divergence-columns")
    totals = columns.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    groups = narrow.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = cut(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(columns.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    langs = small_side(cut(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("s") / cells)).cast("int")), "divergence-langs"))
    dealt = columns.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.hash("term"), "blocks").alias("block"), "term", "cells")
    sent = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    parts = dealt.groupBy("lang", "block").cogroup(sent.groupBy("lang", "block")).applyInArrow(_tiled(top), "lang string, source string, part string, item string, value bigint")
    parts = cut(parts, "divergence-parts")
    drop_written(counts)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    return pairs.unionByName(parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top))
