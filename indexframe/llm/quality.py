"""Quality classifier: naive Bayes support vectors.

A document becomes indicators of n-grams: its words and word pairs, and one to three word shapes (``Aa``,
``AA!``, ``a*`` ...), where a word that repeats the one before it has the shape of a repeat.  Each indicator is
scaled by its log-count ratio between the classes, rows are scaled to length one, and a linear
hinge-loss model is fitted by dual coordinate descent.  Margins become probabilities by a logistic fit
on margins out of fold.

Fitted on a documented, bounded sample of the labelled rows in one task; the model is two arrays
of 2**18 numbers.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_null_text, table, tidy, trim
from .wordhash import SPACE, Prefix, bounds, mix, slices

BITS = 18
_BIAS = 0  # feature of every row

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_REPEAT = np.uint64(0x5EED)


@dataclass(frozen=True)
class Params:
    """``sample``: labelled rows to fit on, at most.  ``cost``: of a slack, for a row of the mean class size."""

    sample: int = 6000
    cost: float = 1.0
    epochs: int = 12
    folds: int = 3
    seed: int = 11


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a text; an empty one has the bias only."""
    found = [np.array([_BIAS])]
    for data in slices(text.encode()):
        buf = np.frombuffer(data, np.uint8)
        gap = SPACE[buf]
        start, end = bounds(gap)
        if not len(start):
            continue
        words = Prefix(buf).hash(start, end)
        kind = np.where(gap, np.uint8(32), _CLASS[buf])
        # A run of one class is one character of the shape.
        keep = np.concatenate(([True], kind[1:] != kind[:-1]))
        squeezed = kind[keep]
        s, e = bounds(squeezed == 32)
        shapes = Prefix(squeezed).hash(s, e)
        again = np.concatenate(([False], words[1:] == words[:-1]))
        shapes = np.where(again, _REPEAT, shapes)
        grams = [words * np.uint64(3), shapes * np.uint64(5)]
        if len(words) > 1:
            grams += [words[1:] * np.uint64(7) + words[:-1] * np.uint64(11), shapes[1:] * np.uint64(13) + shapes[:-1] * np.uint64(17)]
        if len(words) > 2:
            grams.append(shapes[2:] * np.uint64(19) + shapes[1:-1] * np.uint64(23) + shapes[:-2] * np.uint64(29))
        found.append((mix(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.unique(np.concatenate(found)).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each feature, the smoothed log of its share of class 1's counts over its share of class -1's."""
    counts = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == c] or [np.empty(0, np.int32)]), minlength=1 << BITS) + 1.0 for c in (1, -1)]
    r = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    r[_BIAS] = 1.0
    return r


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, p: Params) -> np.ndarray:
    """Weights of the scaled indicators, by dual coordinate descent on the L1 hinge loss."""
    rng, w, alpha = np.random.default_rng(p.seed), np.zeros(1 << BITS), np.zeros(len(rows))
    values = [r[x] / np.linalg.norm(r[x]) for x in rows]
    share = {c: max(1, int((y == c).sum())) for c in (1, -1)}
    cost = np.array([p.cost * len(y) / (2 * share[c]) for c in y])
    for _ in range(p.epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # rows have length one
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * v
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


def margin(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([w[x] @ r[x] / np.linalg.norm(r[x]) for x in rows])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) in x, with Platt's smoothed targets; Newton steps."""
    up, down = (y == 1).sum(), (y != 1).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 0.0, float(np.log((up + 1) / (down + 1)))
    design = np.stack([x, np.ones_like(x)], axis=1)
    loss = lambda a, b: float(np.sum(np.logaddexp(0, z := a * x + b) - t * z))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = design.T @ (q - t)
        step = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 1e-6 * np.eye(2), grad)
        scale = 1.0
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > loss(a, b):
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if abs(scale * step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    weights: np.ndarray  # r * w
    ratio: np.ndarray
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        x = features(text or "")
        m = float(self.weights[x].sum() / np.linalg.norm(self.ratio[x]))
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """``labels``: 0 or 1.  With one class only, every score is that class's smoothed share."""
    y = np.where(labels == 1, 1, -1)
    if not len(y) or abs(y.sum()) == len(y):
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        ratio = np.ones(1 << BITS)
        return Model(np.zeros(1 << BITS), ratio, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(y)) % p.folds
    out = np.zeros(len(y))
    for f in range(p.folds):
        inside = np.flatnonzero(fold != f)
        if abs(y[inside].sum()) == len(inside):
            continue
        mine = [rows[i] for i in inside]
        r = log_count_ratio(mine, y[inside])
        w = fit_hinge(mine, y[inside], r, p)
        out[fold == f] = margin([rows[i] for i in np.flatnonzero(fold == f)], r, w)
    slope, offset = logistic(out, y)
    r = log_count_ratio(rows, y)
    w = fit_hinge(rows, y, r, p)
    return Model((r * w).astype(np.float32), np.abs(r).astype(np.float32), slope, offset)


def remainder(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, size: int, seed: int) -> DataFrame:
    """doc_id, y and text of at most ``size`` labelled documents among ``docs``, drawn by a hash of doc_id.

    Null labels and labels other than 0 and 1 don't count; a doc_id with several labels counts as its largest.  Of several
    rows of a doc_id one counts, by a hash of its text, so the sample has ``size`` rows at most whatever is repeated.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.join(docs.select(F.col("doc_id").alias("__there")), F.col("doc_id") == F.col("__there"), "left_semi")
    drawn = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(size)
    texts = docs.select("doc_id", no_null_text().alias("text")).join(F.broadcast(drawn), "doc_id")  # at most ``size`` pairs of numbers
    one = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))  # combined before it moves
    return one.select("doc_id", "y", "one.text")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, p: Params = Params(), label: str = "quality") -> Model:
    sample = labelled_sample(docs, labels, label, allowed, p.sample, p.seed)

    @tidy
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "y", "x"]
            )

    @tidy
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = train([np.frombuffer(x, np.int32) for _, _, x in got], np.array([y for _, y, _ in got]), p)
        arrays = [pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), pa.array([m.ratio.astype("<f4").tobytes()], pa.binary()), pa.array([m.slope]), pa.array([m.offset])]
        yield pa.RecordBatch.from_arrays(arrays, ["w", "r", "slope", "offset"])

    found = sample.select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, x binary")
    row = found.repartition(1).mapInArrow(learn, "w binary, r binary, slope double, offset double").head()  # the sample is bounded
    return Model(np.frombuffer(row["w"], "<f4"), np.frombuffer(row["r"], "<f4"), row["slope"], row["offset"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, of all documents; a null text scores as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratio, model.slope, model.offset))  # 2 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


CUT = 0.7


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels whose crc32 remainder isn't 2.

    A row of ``documents`` gives a row: repeated ones score alike, a null text as the empty one (the bias alone), a null doc_id
    counts as not held out.  Null labels and labels other than 0 and 1 teach nothing; of a doc_id with several labels the
    largest counts, of one with several texts one by a hash.  With labels of one class only, or none, all scores are that
    class's smoothed share.  Other columns aren't read.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return scored(docs, model).select(
        "doc_id", (F.coalesce(remainder("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_if(docs: DataFrame, model_score, wanted) -> DataFrame:
    """The rows of ``docs`` whose text's score ``wanted`` accepts, all their columns as they were; no shuffle."""
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model_score()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                yield some.filter(pa.array([bool(wanted(score(t.as_py()))) for t in some.column(at)], pa.bool_()))
                trim()

    return docs.mapInArrow(run, docs.schema)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below the cut go; all columns of the others stay as they were.

    Learns from at most ``Params.sample`` labelled ones of the documents it gets, held-out ones left out.  Nulls, repeated rows and
    ties as in ``op4_quality``.
    """
    m = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    shared = spark.sparkContext.broadcast((m.weights, m.ratio, m.slope, m.offset))
    return keep_if(docs, lambda: Model(*shared.value).score, lambda s: s >= CUT)
