"""k-nearest-neighbour search over an array column: exact, with filters before or after."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import COSINE, DOT_PRODUCT, EUCLIDEAN, dot, similarity, unit
from ..sources.shared import checkpoint

#: Parameters of graph indices; taken and without effect, as search here is exact.
PRESETS = {"small": (8, 50), "medium": (16, 100), "large": (32, 200), "high_precision": (64, 400)}


#: Vectors of a block, at most: blocks are multiplied as matrices, so this bounds a task's memory.
BLOCK = 4096


def _scores(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """All scores of the rows of ``q`` with those of ``x``, in double precision."""
    if kind == DOT_PRODUCT:
        return q @ x.T
    if kind == EUCLIDEAN:
        return 1 / (1 + np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0.0))
    lengths = [np.sqrt((m * m).sum(1)) for m in (q, x)]
    return (q / np.where(lengths[0] > 0, lengths[0], 1)[:, None]) @ (x / np.where(lengths[1] > 0, lengths[1], 1)[:, None]).T


def _number(rows: DataFrame) -> type:
    """What the numbers of v are stored as."""
    return np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows (i, v) as blocks of about ``size`` rows, a row each (x, ids and v as bytes, ids ascending), and how many blocks there may be."""
    n = max(1, -(-rows.count() // size))
    number = _number(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made():
            t = pa.Table.from_batches(held).combine_chunks()
            v = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(number)
            raw = (t.column(1).to_numpy().tobytes(), v.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([held[0].column(0)[0].as_py()], pa.int32()), *(pa.array([r], pa.binary()) for r in raw)], ["x", "ids", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != key[lo]:
                    yield made()
                    held.clear()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield made()

    dealt = rows.select(F.pmod(F.xxhash64("i"), F.lit(n)).cast("int").alias("x"), "i", "v")
    dealt = dealt.repartitionById(min(n, 1024), F.col("x")).sortWithinPartitions("x", "i")
    return checkpoint(dealt.mapInArrow(pack, "x int, ids binary, v binary")), n


def _meeting(left: tuple[DataFrame, int], right: tuple[DataFrame, int], upper: bool = False) -> DataFrame:
    """Every pair of packed blocks, (x, ids, v) with (y, others, w); ``upper``: those with x <= y.

    Blocks are read from where they were packed for each pair, so nothing is moved or written a second time.  Pairs of one left block
    come one after another in a task, as far as there are enough left blocks to keep all cores busy.
    """
    (a, n), (b, m) = left, right
    b = b.toDF("y", "others", "w").hint("shuffle_replicate_nl")
    met = a.join(b, F.col("x") <= F.col("y")) if upper else a.crossJoin(b)
    width = max(2, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.coalesce(min(n, 1024) * min(m, -(-width // n)))


def _block_pairs(batches: Iterator[pa.RecordBatch], number: type) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Number, ids and vectors of both sides of each pair of blocks."""
    ids_of = lambda r: np.frombuffer(r.as_buffer(), np.int64)
    vectors_of = lambda r, n: np.frombuffer(r.as_buffer(), number).astype(np.float64).reshape(n, -1)
    for batch in batches:
        for i in range(batch.num_rows):
            x, ids, v, y, others, w = (c[i] for c in batch.columns)
            ids, others = ids_of(ids), ids_of(others)
            yield x.as_py(), ids, vectors_of(v, len(ids)), y.as_py(), others, vectors_of(w, len(others))


def _nearest(pairs: Iterator[tuple], k: int, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query ids, ids and scores of the k best of each query among the blocks that its block meets one after another; ties by id."""
    now, qids, held = None, None, None

    def found():
        return qids[held[0]], held[1], held[2]

    for x, asking, q, _, ids, v in pairs:
        if x != now:
            if held is not None:
                yield found()
            now, qids = x, asking
            held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            least = np.full(len(qids), -np.inf)  # the k-th best score so far
        new = [held]
        for at in range(0, len(q), 256):
            score = _scores(q[at : at + 256], v, kind)
            key = score if np.isfinite(score.sum()) else np.where(np.isnan(score), np.inf, score)
            edge = least[at : at + 256]
            if len(ids) > k and np.isneginf(edge).any():
                edge = np.maximum(edge, np.partition(key, len(ids) - k, axis=1)[:, len(ids) - k])
            row, near = np.nonzero(key >= edge[:, None] - 1e-9)  # ties are cut below, where the order is known
            new.append((row + at, ids[near], score[row, near]))
        row, id_, score = (np.concatenate(c) for c in zip(*new, strict=True))
        key = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((id_, -key, row))
        row, id_, score, key = row[order], id_[order], score[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == k - 1
        least[row[last]] = key[last]
        keep = place < k
        held = row[keep], id_[keep], score[keep]
    if held is not None:
        yield found()


@dataclass(frozen=True)
class VectorIndex:
    """Rows with a vector of fixed dimension.  Rows whose vector is null take no part."""

    df: DataFrame
    id: str
    vector: str
    dimension: int
    kind: str = COSINE
    preset: str = "medium"

    def __post_init__(self) -> None:
        if self.kind not in (COSINE, DOT_PRODUCT, EUCLIDEAN):
            raise ValueError(f"unknown similarity {self.kind}")
        if self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset}")

    def _asked(self, vector: Sequence[float] | None, k: int) -> list[float]:
        if vector is None:
            raise ValueError("a query vector can't be null")
        if k <= 0:
            raise ValueError("k must be positive")
        if len(vector) != self.dimension:
            raise ValueError(f"the index has {self.dimension} dimensions, the query {len(vector)}")
        if not all(math.isfinite(x) for x in vector):
            raise ValueError("a query vector must be finite")
        return [float(x) for x in vector]

    def search(self, vector: Sequence[float], k: int, beam: int | None = None) -> DataFrame:
        """The k rows of largest score, ties by id.  ``beam`` has no effect."""
        asked = F.array(*map(F.lit, self._asked(vector, k)))
        rows = self.df.where(F.col(self.vector).isNotNull())
        return rows.withColumn("score", similarity(F.col(self.vector), asked, self.kind)).orderBy(F.desc("score"), self.id).limit(k)

    def vector_of(self, entity_id: int) -> list[float] | None:
        row = self.df.where(F.col(self.id) == entity_id).select(self.vector).head()
        return None if row is None else row[0]

    def search_like(self, entity_id: int, k: int) -> DataFrame:
        """Search with a row's own vector; the row itself is among the results."""
        return self.search(self.vector_of(entity_id), k)

    def _rows_of(self, block: int) -> int:
        """Rows of a block: so many, or what 16 MB hold."""
        return max(64, min(block, (16 << 20) // (8 * max(1, self.dimension))))

    def search_batch(self, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
        """k rows a query (query_id long, query_vector): query_id, rank, id, score.  Ids are whole numbers and unique.

        Index and queries are packed into blocks of at most about ``block`` rows, once; every pair of blocks is one matrix product. The
        blocks that a query's block meets in a task are merged there, so what is moved grows with the rows and not with the pairs.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        kind = self.kind
        rows = self.df.where(F.col(self.vector).isNotNull()).select(F.col(self.id).cast("long").alias("i"), F.col(self.vector).alias("v"))
        asks = queries.where(F.col("query_vector").isNotNull()).select(F.col("query_id").cast("long").alias("i"), F.col("query_vector").cast(rows.schema["v"].dataType).alias("v"))

        number = _number(rows)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in _nearest(_block_pairs(batches, number), k, kind):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "i", "score"])

        found = _meeting(_packed(asks, self._rows_of(block)), _packed(rows, self._rows_of(block))).mapInArrow(best, "query_id long, i long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "i")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("i").alias(self.id), "score")

    def within(self, vector: Sequence[float], k: int, least: float) -> DataFrame:
        """Of the k nearest, those that score at least so much."""
        return self.search(vector, k).where(F.col("score") >= least)

    def post_filtered(self, vector: Sequence[float], k: int, ids: DataFrame) -> DataFrame:
        """The k nearest whose id is among ``ids`` (first column): may be fewer than k."""
        return self.search(vector, k).join(ids.select(F.col(ids.columns[0]).alias("__s")), F.col(self.id) == F.col("__s"), "left_semi")

    def pre_filtered(self, vector: Sequence[float], k: int, ids: DataFrame) -> DataFrame:
        """The k nearest among the rows whose id is among ``ids``."""
        allowed = self.df.join(ids.select(F.col(ids.columns[0]).alias("__s")), F.col(self.id) == F.col("__s"), "left_semi")
        return VectorIndex(allowed, self.id, self.vector, self.dimension, self.kind).search(vector, k)

    def near_duplicates(self, least: float, tables: int = 0, bits: int = 0, seed: int = 3) -> DataFrame:
        """Pairs (a < b) of cosine at least ``least`` with their score.

        Exact for ``tables == 0``: rows meet by blocks, each pair of blocks in one matrix product.  Else random hyperplanes deal the
        rows into ``tables`` times 2**``bits`` buckets, and only rows of one bucket meet: faster, and pairs may be missed.
        """
        if not tables:
            plain = self.df.where(F.col(self.vector).isNotNull()).select(F.col(self.id).cast("long").alias("i"), F.col(self.vector).alias("v"))
            blocks, number = _packed(plain, self._rows_of(BLOCK)), _number(plain)

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for m, ids, x, n, others, y in _block_pairs(batches, number):
                    for at in range(0, len(ids), 512):
                        score = _scores(x[at : at + 512], y, COSINE)
                        a, b = np.nonzero(score >= least)
                        u, v, s = ids[at : at + 512][a], others[b], score[a, b]
                        # A block with itself sees a pair twice, two blocks once; either way the smaller id comes first.
                        low, high = np.minimum(u, v), np.maximum(u, v)
                        keep = (u < v) if m == n else u != v
                        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (low, high, s)], ["a", "b", "score"])

            return _meeting(blocks, blocks, upper=True).mapInArrow(near, "a long, b long, score double")
        rows = self.df.where(F.col(self.vector).isNotNull()).select(F.col(self.id).alias("i"), unit(F.col(self.vector)).alias("v"))
        plane = lambda t, b: F.transform(F.sequence(F.lit(1), F.lit(self.dimension)), lambda d: F.when(F.xxhash64(F.lit(seed), F.lit(t), F.lit(b), d) % 2 == 0, 1.0).otherwise(-1.0))
        side = lambda t, b: F.when(F.aggregate(F.zip_with("v", plane(t, b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) >= 0, F.lit(1 << b)).otherwise(F.lit(0))
        marks = [F.struct(F.lit(t).alias("t"), sum((side(t, b) for b in range(bits)), F.lit(0)).alias("m")) for t in range(tables)]
        left = rows.withColumn("k", F.explode(F.array(*marks)))
        right = left
        met = left.alias("x").join(right.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.i") < F.col("y.i")))
        found = met.select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), dot(F.col("x.v"), F.col("y.v")).alias("score")).where(F.col("score") >= least)
        return found.dropDuplicates(["a", "b"])


def vectorized(rows: DataFrame, source: str, name: str, vectorizer: Callable[[list], list[Sequence[float] | None]]) -> DataFrame:
    """Adds vectors that a function makes of whole batches of a column's values; it may give None for some."""
    at = rows.columns.index(source)
    kept = rows.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(vectorizer(batch.column(at).to_pylist()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{name}` array<float>"]))


@dataclass
class VectorIndices:
    """Indices by name."""

    named: dict[str, VectorIndex] = field(default_factory=dict)

    def add(self, name: str, index: VectorIndex) -> VectorIndex:
        if name in self.named:
            raise ValueError(f"there is an index {name!r}")
        self.named[name] = index
        return index

    def ensure(self, name: str, index: VectorIndex) -> VectorIndex:
        return self.named.setdefault(name, index)

    def get(self, name: str) -> VectorIndex:
        if name not in self.named:
            raise KeyError(f"no index {name!r}; there are {sorted(self.named)}")
        return self.named[name]

    def remove(self, name: str) -> None:
        self.get(name)
        del self.named[name]
