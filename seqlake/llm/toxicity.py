"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (run of letters, digits and non-ASCII characters, A-Z lower-cased) contributes itself and its n-grams of 3 to 6
UTF-8 bytes, those at its start or end told apart, hashed into 2^BITS rows of an embedding table. A text is the mean of
its rows, a softmax over two classes follows, and table and softmax are fitted together by Adam on batches of texts, so a
misspelling that was never seen shares the vectors of the n-grams that it keeps.

Since the mean is linear, scoring needs only each row's product with the difference of the softmax weights: one number
a row, 2^BITS of them, sent to the executors. Scoring is one pass over whole texts without a shuffle.

The fit uses at most TRAIN_TOXIC and TRAIN_CLEAN labelled rows (those of smallest hash of the id); all rows are scored.
Settings are chosen by cross_validated() on usable labels alone; held-out labels only serve to report. Only texts are inputs. Null or wordless texts score by the bias alone. Repeated rows have equal scores; labels that repeat or
contradict count each for themselves, null labels not at all. Without labels of both classes every score is 0.
Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow

BITS, DIM = 18, 6
#: Labelled rows that the fit uses at most.
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 3000
STEPS, BATCH, RATE, DECAY = 340, 250, 0.4, 1e-6
#: Subwords of zero vectors added to every mean, so that few words move a score little.
PRIOR = 40
#: Weight of the clean class against the toxic one.
CLEAN_WEIGHT = 2.0
#: Rows of the table that fewer training texts use stay zero: one of TEXTS_EACH texts, within these bounds.
LEAST_TEXTS, TEXTS_EACH = (2, 5), 850
THRESHOLD = 0.7
GRAMS = (3, 4, 5, 6)

_WORD = K.byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_START, _END, _WHOLE = (np.uint64(x) for x in (0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LENGTH = np.arange(max(GRAMS) + 1, dtype=np.uint64) * _END


def _row(h: np.ndarray) -> np.ndarray:
    """The table row of a hash."""
    return (h * _WHOLE >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(low: np.ndarray, s: np.ndarray, e: np.ndarray):
    """For each length, (words that are long enough, how many n-grams each has, places of all n-grams, their table rows)."""
    at = K.blocks8(low)
    for n in GRAMS:
        count = np.maximum(0, e - s - n + 1)
        has = np.flatnonzero(count)
        if not len(has):
            continue
        c = count[has]
        begin = np.cumsum(c) - c
        p = np.repeat(s[has] - begin, c) + np.arange(int(c.sum()))
        h = K.mix((at[p] & K.LOW_BYTES[n]) + _LENGTH[n])
        h[begin] ^= _START
        h[begin + c - 1] ^= _END
        yield has, c, begin, p, _row(h)


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of all subwords of a chunk, for each text its first one and the end), grouped by text."""
    low = K.lower_ascii(data)
    s, e, _ = K.word_slices(low, off, _WORD)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    rows, at = [_row(K.word_hash(low, s, e) + _WHOLE)], [s]
    for _, _, _, p, r in _grams(low, s, e):
        rows.append(r)
        at.append(p)
    where = np.searchsorted(off, np.concatenate(at), side="right") - 1
    order = np.argsort(where, kind="stable") if len(off) > 2 else slice(None)
    return np.concatenate(rows)[order], np.searchsorted(where[order], np.arange(len(off)))


class Model:
    """scores: a number for each table row; bias: the logit of a text without words."""

    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores, bias

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of the texts of a chunk. Sums over a text need no grouping of its subwords: each lands by its place."""
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        low = K.lower_ascii(data)
        s, e, first = K.word_slices(low, off, _WORD)
        if len(s):
            word = self.scores[_row(K.word_hash(low, s, e) + _WHOLE)].astype(float)
            n_word = np.ones(len(s))
            for has, c, begin, _, r in _grams(low, s, e):
                word[has] += np.add.reduceat(self.scores[r], begin)
                n_word[has] += c
            run, num = np.concatenate([[0], np.cumsum(word)]), np.concatenate([[0], np.cumsum(n_word)])
            total, count = run[first[1:]] - run[first[:-1]], num[first[1:]] - num[first[:-1]]
        return total / (count + PRIOR) + self.bias


def bags(data: np.ndarray, off: np.ndarray):
    """For each text of a chunk, (distinct table rows of its subwords, how often each stands in it)."""
    r, first = subwords(data, off)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        rows, count = np.unique(r[a:b], return_counts=True)
        yield rows.astype(np.int32), np.minimum(count, 65535).astype(np.uint16)


class Batch:
    """Bags of a batch of texts: one entry for each distinct row of a text, and the order of entries by row."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(r) for r, _ in held], np.int64)
        self.rows = np.concatenate([r for r, _ in held])
        self.count = np.concatenate([c for _, c in held])
        self.total = np.array([c.sum(dtype=np.int64) for _, c in held]) + PRIOR

    def keep(self, place: np.ndarray) -> None:
        """Renumber rows by place, without those of place -1."""
        rows = place[self.rows]
        often = rows >= 0
        self.size = np.add.reduceat(np.append(often, False), np.minimum(np.cumsum(self.size) - self.size, len(often)), dtype=np.int64) * (self.size > 0)
        self.rows, self.count = rows[often], self.count[often]
        self.order = np.argsort(self.rows, kind="stable").astype(np.int32)
        self.used, self.first_of = np.unique(self.rows[self.order], return_index=True)
        self.texts = np.flatnonzero(self.size)
        self.first = (np.cumsum(self.size) - self.size)[self.texts]

    def share(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, part of that text's mean) of each entry."""
        text = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        return text, (self.count / self.total[text]).astype(np.float32)[:, None]


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Model of texts that are at hand."""
    every = [x for _, data, off in K.chunks(pa.array(texts, pa.large_string())) for x in bags(data, off)]
    return fit_bags(every, labels, seed)


def fit_bags(held: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 11) -> Model:
    """Table and softmax together, classes weighted alike, by Adam on fixed batches. Takes the bags out of the list."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), -30.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    y = y[order]
    share = np.array([CLEAN_WEIGHT, 1.0]) / (CLEAN_WEIGHT + 1)
    weight = (share / np.bincount(y, minlength=2))[y].astype(np.float32) * (len(y) / BATCH)
    hot = np.eye(2, dtype=np.float32)[y]
    parts, texts_with = [], np.zeros(1 << BITS, np.int64)
    for lo in range(0, len(y), BATCH):
        own = order[lo : lo + BATCH].tolist()
        parts.append(Batch([held[i] for i in own]))
        for i in own:
            held[i] = None
        texts_with += np.bincount(parts[-1].rows, minlength=1 << BITS)
    used = np.flatnonzero(texts_with >= np.clip(round(len(y) / TEXTS_EACH), *LEAST_TEXTS))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    for part in parts:
        part.keep(place)
    table = rng.normal(0, 0.02, (len(used), DIM)).astype(np.float32)
    soft = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, soft, bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    epochs = -(-STEPS // len(parts))
    step, last = 0, epochs * len(parts)
    for _ in range(epochs):
        for k, part in enumerate(parts):
            step += 1
            span = slice(k * BATCH, k * BATCH + len(part.size))
            text, v = part.share()
            mean = np.zeros((len(part.size), DIM), np.float32)
            if len(v):
                mean[part.texts] = np.add.reduceat(table[part.rows] * v, part.first, axis=0)
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            g = (prob - hot[span]) * weight[span, None]
            g_table = DECAY * table
            if len(v):
                g_table[part.used] += np.add.reduceat((g @ soft.T)[text[part.order]] * v[part.order], part.first_of, axis=0)
            rate = RATE * (1 - (step - 1) / last)
            for p, m, d in zip(params, moments, (g_table, mean.T @ g + DECAY * soft, g.sum(0)), strict=True):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d * d
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
    scores = np.zeros(1 << BITS, np.float32)
    scores[used] = table @ (soft[:, 1] - soft[:, 0])
    return Model(scores, float(bias[1] - bias[0]))


def cross_validated(texts: list[str], labels: list[int], folds: int = 3, only: int | None = None) -> np.ndarray:
    """Logit of each text by a model of the other folds, classes dealt evenly (nan outside the fold `only`): what settings are compared by."""
    y, out = np.asarray(labels, np.int64), np.full(len(labels), np.nan)
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) % folds
    held = [x for _, data, off in K.chunks(pa.array(texts, pa.large_string())) for x in bags(data, off)]
    for f in range(folds) if only is None else [only]:
        learn, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        model = fit_bags([held[i] for i in learn], y[learn].tolist())
        out[test] = np.concatenate([model.logits(data, off) for _, data, off in K.chunks(pa.array([texts[i] for i in test], pa.large_string()))])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, most: tuple[int, int] = (TRAIN_CLEAN, TRAIN_TOXIC)) -> Model:
    """A model of the labelled rows for which `usable`, a condition on the labels' id, holds; at most most[class] of each class.

    Texts become bags where they are; one task fits, and the driver receives its table of scores alone."""
    kept = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    if usable is not None:
        kept = kept.where(usable)
    kept = kept.withColumn("at", F.xxhash64("id"))
    chosen = None
    for label, n in enumerate(most):
        part = kept.where(F.col("y") == label).orderBy("at", "id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("at", "y", "text")  # most rows at most, unless ids repeat

    def work(batch: pa.RecordBatch):
        for i, data, off in K.chunks(batch.column(2)):
            got = list(bags(data, off))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(got)), batch.column(1).slice(i, len(got)), pa.array([r.tobytes() for r, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["at", "y", "rows", "counts"])

    def learn(batches):
        held, y = [], []
        for b in batches:
            y += b.column(1).to_pylist()
            held += [(np.frombuffer(r, np.int32), np.frombuffer(c, np.uint16)) for r, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        model = fit_bags(held, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias])], names=["scores", "bias"])
        K.give_back()

    bagged = arrow(found, work, "at bigint, y int, rows binary, counts binary")
    got = bagged.repartition(1).sortWithinPartitions("at", "y", "rows").mapInArrow(learn, "scores binary, bias double").collect()
    return Model(np.frombuffer(got[0]["scores"], np.float32), got[0]["bias"]) if got else fit_bags([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, columns in keep, score, predicted) of every text."""
    columns = list(dict.fromkeys([id_col, *keep]))
    chosen = docs.select(*columns, docs[text_col].alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        for i, data, off in K.chunks(batch.column(len(columns))):
            s = 1 / (1 + np.exp(-np.clip(sent.value.logits(data, off), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, len(s)) for k in range(len(columns))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in columns)
    return arrow(chosen, work, f"{schema}, score double, predicted int")


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
