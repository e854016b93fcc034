"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.llm.text import Words, mix, slices
from panelfill.session import ship

WORD_BITS = 14
STEPS = 24
RANK = 8
TRAIN_ROWS = 6000
THRESHOLD = 0.3
FOLDS = 5
SCORED_BYTES = 1 << 20  # text at once: arrays of a byte or a word are some fifty times as large
STATISTICS = (
    "words", "bytes", "lines", "word_length", "distinct", "commonest", "echo", "symbols", "bars", "digits", "capitals", "stops", "commas", "wide", "line_copies", "long_words",
)
SIZE = (1 << WORD_BITS) + STEPS * len(STATISTICS)
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def _share(mask: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    count = np.append(0, np.cumsum(mask))
    return (count[offsets[1:]] - count[offsets[:-1]]) / np.maximum(of, 1)


def _step(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which of ``STEPS`` equal steps between low and high a value falls in; the ends are open."""
    return np.clip((values - low) / (high - low) * STEPS, 0, STEPS - 1).astype(np.int64)


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text in time linear in its length, as (row bounds, column, value).

    Hashed words have length 1 together; each statistic is one of its steps, with value 1. Metadata is the
    text's own size in bytes, words and lines; label, language, source and id are no inputs.
    """
    w = Words(texts)
    h, n, data = w.hashes(), w.counts, w.data
    doc = np.repeat(np.arange(len(n)), n)
    size = np.diff(w.offsets)
    order = np.lexsort((h, doc))
    sorted_h, sorted_doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(h)))
    owner = sorted_doc[head]
    distinct = np.bincount(owner, minlength=len(n))
    common = np.zeros(len(n), np.int64)
    np.maximum.at(common, owner, times)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = w.ends - w.starts
    last = data[w.ends - 1] if len(h) else data[:0]
    letters = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    digits = (data >= 48) & (data <= 57)
    marks = w.solid & ~letters & ~digits
    lines = _share(data == 10, w.offsets, np.ones(len(n))) + 1
    # lines that repeat within a text, by a hash of their words
    line = np.append(0, np.cumsum(data == 10))[w.starts] if len(h) else np.zeros(0, np.int64)
    cut = np.ones(len(h), bool)
    cut[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(cut)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    whole = np.add.reduceat(mix(h + mix(place.astype(np.uint64))), at) if len(at) else np.zeros(0, np.uint64)
    pair = np.unique(mix(whole + mix(doc[at].astype(np.uint64))), return_index=True)[1] if len(at) else at
    kinds = np.bincount(doc[at][pair], minlength=len(n))
    rows = np.bincount(doc[at], minlength=len(n))
    chars = np.maximum(size, 1)
    per_word = lambda mask: _share(mask, w.first, n)
    values = {
        "words": (np.log1p(n), 0, 10), "bytes": (np.log1p(size), 0, 12), "lines": (np.log1p(lines), 0, 7),
        "word_length": (np.add.reduceat(np.append(length, 0), w.first[:-1]) * (n > 0) / np.maximum(n, 1) if len(n) else n, 2, 14),
        "distinct": (distinct / np.maximum(n, 1), 0, 1), "commonest": (common / np.maximum(n, 1), 0, 0.5), "echo": (per_word(echo), 0, 0.5),
        "symbols": (_share(marks, w.offsets, chars), 0, 0.3), "bars": (_share(data == 124, w.offsets, np.maximum(n, 1)), 0, 0.6),
        "digits": (_share(digits, w.offsets, chars), 0, 0.3), "capitals": (_share((data >= 65) & (data <= 90), w.offsets, chars), 0, 0.2),
        "stops": (per_word(last == 46), 0, 0.3), "commas": (per_word(last == 44), 0, 0.2), "wide": (_share(data >= 192, w.offsets, chars), 0, 0.2),
        "line_copies": (1 - kinds / np.maximum(rows, 1), 0, 1), "long_words": (per_word(length > 14), 0, 0.5),
    }
    length_of = np.sqrt(np.bincount(owner, weights=times.astype(float) ** 2, minlength=len(n)))
    columns = [(sorted_h[head] >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    weights, owners = [times / np.maximum(length_of[owner], 1)], [owner]
    for k, name in enumerate(STATISTICS):
        columns.append((1 << WORD_BITS) + k * STEPS + _step(*values[name]))
        weights.append(np.ones(len(n)))
        owners.append(np.arange(len(n)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bounds = np.append(0, np.cumsum(distinct + len(STATISTICS)))
    return bounds, np.concatenate(columns)[order], np.concatenate(weights)[order].astype(np.float32)


@dataclass
class Machine:
    """Factorisation machine: bias, weights and ``RANK`` factors a feature."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, bounds, column, value) -> np.ndarray:
        """bias + sum w x + half of (sum v x) ** 2 - sum (v x) ** 2, summed over the factors: linear in the features."""
        if len(bounds) < 2:
            return np.zeros(0)
        part = self.factors[column] * value[:, None]
        single = np.add.reduceat(self.weights[column] * value, bounds[:-1])
        total, square = np.add.reduceat(part, bounds[:-1], axis=0), np.add.reduceat(part * part, bounds[:-1], axis=0)
        return self.bias + single + 0.5 * (total * total - square).sum(axis=1)

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts)), -30, 30).astype(float)))


def fit(bounds, column, value, label, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic loss by AdaGrad over small batches; one class alone, or no rows, gives a constant score."""
    random = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), random.normal(0, 0.02, (SIZE, RANK)).astype(np.float32))
    label = np.asarray(label, float)
    if len(label) == 0 or label.min() == label.max():
        m.bias, m.factors[:] = (0.0 if len(label) == 0 else 4.0 * (2 * label[0] - 1)), 0
        return m
    m.bias = float(np.log(label.mean() / (1 - label.mean())))
    grad_w, grad_v, grad_b = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(label))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            size = bounds[rows + 1] - bounds[rows]
            own = np.append(0, np.cumsum(size))
            pick = np.repeat(bounds[rows] - own[:-1], size) + np.arange(own[-1])
            c, x = column[pick], value[pick]
            part = m.factors[c] * x[:, None]
            total = np.add.reduceat(part, own[:-1], axis=0)
            raw = m.bias + np.add.reduceat(m.weights[c] * x, own[:-1]) + 0.5 * (total * total - np.add.reduceat(part * part, own[:-1], axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / len(rows)
            each = np.repeat(error, size).astype(np.float32)
            used, back = np.unique(c, return_inverse=True)
            gw = np.bincount(back, weights=each * x, minlength=len(used)).astype(np.float32) + decay * m.weights[used]
            slope = (each * x)[:, None] * (np.repeat(total, size, axis=0) - part)
            gv = np.zeros((len(used), RANK), np.float32)
            np.add.at(gv, back, slope)
            gv += decay * m.factors[used]
            grad_w[used] += gw * gw
            grad_v[used] += gv * gv
            grad_b += float(error.sum()) ** 2
            m.weights[used] -= rate * gw / np.sqrt(grad_w[used])
            m.factors[used] -= rate * gv / np.sqrt(grad_v[used])
            m.bias -= rate * float(error.sum()) / grad_b**0.5
    return m


def in_training(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) != 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in slices(batches, size=SCORED_BYTES):
        bounds, column, value = features(table["text"])
        offsets = pa.array(bounds, pa.int32())
        yield pa.record_batch(
            [table["quality"].combine_chunks(), pa.ListArray.from_arrays(offsets, pa.array(column, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32()))],
            ["quality", "columns", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents, the first by a hash of their id, none of the held-out fold.

    Only their features reach the driver. Labels without a document, and null labels, are left out; of a document
    labelled more than once the smallest label counts, of an id with several texts the smallest text.
    """
    ship(docs.sparkSession)
    known = labels.filter("quality IN (0, 1)").filter(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    found = texts.mapInArrow(_featured, "quality int, columns array<int>, values array<float>").toArrow()
    columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
    if not found.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), [])
    # the order of rows must not depend on the partitions
    size = pa.compute.list_value_length(columns).to_numpy()
    column, value = columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()
    bounds = np.append(0, np.cumsum(size))
    code = mix(np.add.reduceat(mix(column.astype(np.uint64) + mix(value.view(np.uint32).astype(np.uint64))), bounds[:-1]))
    order = np.argsort(code, kind="stable")
    pick = np.repeat(bounds[order] - np.append(0, np.cumsum(size[order]))[:-1], size[order]) + np.arange(len(column))
    return fit(np.append(0, np.cumsum(size[order])), column[pick], value[pick], found["quality"].to_numpy()[order])


def _scored(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = machine.value
        for table in slices(batches, size=SCORED_BYTES):
            score = model.scores(table["text"])
            yield pa.record_batch(
                [table["doc_id"].combine_chunks().cast(pa.int64()), table["held_out"].combine_chunks(), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. No shuffle; the model has a fixed size.

    Null text counts as empty and is scored like any text. A null doc_id counts as held out. Repeated rows give
    repeated rows, an empty table an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", (~in_training(F.col("doc_id"))).alias("held_out"))
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(machine)), RESULT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    machine = train(docs, labels)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [s >= THRESHOLD for table in slices(iter([batch]), size=SCORED_BYTES) for s in model.value.scores(table["text"])]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
