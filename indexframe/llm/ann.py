"""Approximate nearest neighbours by largest inner product.

Product quantisation with four-bit codes, trained score-aware: the part of a vector's residual that is
parallel to the vector changes its inner products with the queries that matter (those it scores high with), so
the loss weighs it ``eta`` times the orthogonal part.  Codes are chosen by coordinate descent over the
subspaces and codebooks by solving the weighted least squares.  Directions are coded, lengths kept; further levels of codes hold
what is left of the directions.  A code's score is the product of the query with the vector it stands for, so a scan decodes a block once and multiplies.
What the codes leave over is kept as a length, which bounds the score on both sides: no vector is dropped whose
bound reaches the k-th best sure score.  Those that are left are scored exactly on the original vectors, so none of the nearest is missed.

Blocks of codes and blocks of queries meet; original vectors don't: they are read once, where the last candidates are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_width, table


@dataclass(frozen=True)
class Params:
    """``sample``: vectors that fit the codebooks, at most (every row is indexed).  ``sub``: dimensions of a subspace.
    ``threshold``: cosine from which a query matters, which gives eta.  ``levels``: codes of a subspace.  ``rerank``: candidates of a query
    that a block names one by one; where it has more, its vectors are scored exactly one and all.
    ``block``: vectors of a block, at most, and ``block_mb``: its vectors' megabytes, about; ``queries``: queries of a block."""

    sample: int = 4096
    sub: int = 2
    threshold: float = 0.2
    rounds: int = 6
    levels: int = 3
    rerank: int = 400
    block: int = 8192
    block_mb: int = 64
    queries: int = 1024
    seed: int = 7


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (double) of the rows that take part: a key and a vector that is finite throughout and not zero."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(F.col(vector), lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(fine & some)
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def eta_of(threshold: float, dims: int) -> float:
    """Weight of the parallel against the orthogonal residual, for queries spread evenly above the threshold cosine."""
    t2 = threshold * threshold
    return max(1.0, (dims - 1) * t2 / (1 - t2))


def _encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (n, subspaces) that minimise the anisotropic loss by coordinate descent."""
    s, _, d = books.shape
    parts = x.reshape(len(x), s, d)
    if eta == 1:  # the nearest codeword: a square less what all choices have in common
        away = (books**2).sum(-1)[:, None] - 2 * np.matmul(parts.transpose(1, 0, 2), books.transpose(0, 2, 1))
        return np.ascontiguousarray(away.argmin(-1).T.astype(np.uint8))
    # Squared distance and parallel residual of each choice.
    square = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    parallel = (unit * parts).sum(-1)[:, :, None] - np.einsum("nsd,skd->nsk", unit, books)
    codes = square.argmin(-1)
    chosen = np.take_along_axis(parallel, codes[:, :, None], 2)[:, :, 0]
    total = chosen.sum(1)
    for _ in range(rounds):
        for j in range(s):
            rest = total - chosen[:, j]
            loss = square[:, j] + (eta - 1) * (rest[:, None] + parallel[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            chosen[:, j] = np.take_along_axis(parallel[:, j], codes[:, j : j + 1], 1)[:, 0]
            total = rest + chosen[:, j]
    return codes.astype(np.uint8)


def _fit(x: np.ndarray, eta: float, p: Params, rest: bool) -> np.ndarray:
    """Codebooks (subspaces, 16, sub) of sample vectors; ``rest``: of what is left of them, so the first codeword is zero."""
    n, dims = x.shape
    s, d, rng = dims // p.sub, p.sub, np.random.default_rng(p.seed)
    books = np.stack([x[rng.integers(0, n, 16), j * d : (j + 1) * d] for j in range(s)]).astype(np.float64)
    books += rng.normal(0, 1e-3 * (np.abs(x).mean() or 1), books.shape)
    if rest:
        books[:, 0] = 0
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(size > 0, size, 1)
    for _ in range(p.rounds):
        codes = _encode(x, books, eta)
        if eta == 1:  # means
            for k in range(int(rest), 16):
                m = (codes == k).astype(np.float64)
                books[:, k] = np.where(m.sum(0)[:, None] > 0, np.einsum("ns,nsd->sd", m, x.reshape(n, s, d)) / np.maximum(m.sum(0), 1)[:, None], books[:, k])
            continue
        # One subspace after another: sum over its vectors of |r|^2 + (eta - 1) (u . r)^2 is quadratic in its codewords.
        for j in range(s):
            at = slice(j * d, (j + 1) * d)
            recon = books[np.arange(s), codes].reshape(n, dims)
            u = unit[:, at]
            other = ((x - recon) * unit).sum(1) - ((x - recon)[:, at] * u).sum(1)
            target = (u * x[:, at]).sum(1) + other
            for k in range(int(rest), 16):
                m = codes[:, j] == k
                if m.sum() < 1:
                    continue
                a = np.eye(d) * m.sum() + (eta - 1) * u[m].T @ u[m]
                b = x[m][:, at].sum(0) + (eta - 1) * (u[m] * target[m][:, None]).sum(0)
                books[j, k] = np.linalg.solve(a, b)
    return books


def _decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Directions (n, dims) that codes (levels, n, subspaces) stand for."""
    return sum(b[np.arange(b.shape[0]), c].reshape(c.shape[0], -1) for b, c in zip(books, codes, strict=True))


def _code(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Codes (levels, n, subspaces) of directions; the first level is score-aware."""
    codes, left = [], x
    for level, b in enumerate(books):
        codes.append(_encode(left, b, 1.0 if level else eta))
        left = left - _decode(codes[-1][None], b[None])
    return np.stack(codes)


def fit(x: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Codebooks (levels, subspaces, 16, sub) and eta from sample directions (their dimensions padded with zeros)."""
    eta, books, left = eta_of(p.threshold, x.shape[1]), [], x
    for level in range(p.levels):
        books.append(_fit(left, 1.0 if level else eta, p, level > 0))
        left = left - _decode(_encode(left, books[-1], 1.0 if level else eta)[None], books[-1][None])
    return np.stack(books), eta


def _polar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, and lengths as a largest part times a factor: squares of tiny and huge numbers don't get lost."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    size = np.sqrt((y * y).sum(axis=1))
    return y / size[:, None], most, size


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties at the edge by place (ids ascend with it); never one of minus infinity."""
    if len(score) <= k:
        return np.flatnonzero(score > -np.inf)
    edge = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > edge)
    return np.concatenate((above, np.flatnonzero((score == edge) & (score > -np.inf))[: k - len(above)]))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows of equal first column, in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != keys[lo]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def top_k(vectors: DataFrame, is_query: str, k: int, p: Params = Params()) -> DataFrame:
    """The k nearest of every query among all other vectors: query_id, rank, vec_id, score.

    ``vectors``: id, v, as from ``usable``; ``is_query``: SQL that says which rows are queries.  Nearness is
    the inner product in double precision; ties go to the smaller id.  Only vectors of equal length have one, so each length is
    searched by itself.  Repeated ids are candidates like any other row, but never their own id's; of the rows of a repeated
    query id the one with the least vector asks.  No rows give no rows.
    """
    lengths = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect())  # one, in a sound table
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, n in enumerate(lengths):
        one = _top_k(vectors if len(lengths) == 1 else vectors.where(F.size("v") == n), is_query, k, n, p)
        found = found.unionByName(one) if i else one
    return found


def _top_k(vectors: DataFrame, is_query: str, k: int, dims: int, p: Params) -> DataFrame:
    spark = vectors.sparkSession
    pad = lambda m: np.pad(m, ((0, 0), (0, -dims % p.sub)))
    sample = vectors.orderBy(F.xxhash64(F.lit(p.seed), "id"), "id", "v").limit(p.sample).select("v").toArrow().column(0).combine_chunks()
    x = pad(_rows(sample))
    scale = np.abs(x).max()
    books, eta = fit(_polar(x)[0], p)
    asking = vectors.where(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("q"))
    asked = checkpoint(asking)
    n, q = vectors.count(), asked.count()
    per_block = max(64, min(p.block, (p.block_mb << 20) // (8 * dims)))
    blocks, asks = max(1, -(-n // per_block)), max(1, -(-q // p.queries))
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(blocks)))
    width = shuffle_width(spark)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _grouped(batches):
            v = _rows(rows.column(2).combine_chunks())
            packed, far = [], []
            unit, most, size = _polar(v)
            length = most / scale * size
            for at in range(0, len(v), 2048):
                u = pad(unit[at : at + 2048])
                c = _code(u, books, eta)
                # What bounds the score: the length of what is left, and some for rounding.
                left = np.linalg.norm(u - _decode(c, books), axis=1) + 1e-12
                far.append(np.nextafter((length[at : at + 2048] * left).astype(np.float32), np.float32(np.inf)))
                c = np.pad(c, ((0, 0), (0, 0), (0, c.shape[2] % 2)))
                packed.append(c[:, :, ::2] << 4 | c[:, :, 1::2])  # two four-bit codes a byte
            raw = (rows.column(1).to_numpy(), np.concatenate(packed, axis=1), length, np.concatenate(far))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([np.ascontiguousarray(r).tobytes()], pa.binary()) for r in raw)], ["b", "ids", "codes", "length", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, rows in _grouped(batches):
            arrays = [pa.array([a], pa.int64()), pa.array([rows.column(1).to_numpy().tobytes()], pa.binary()), pa.array([_rows(rows.column(2).combine_chunks()).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "qids", "qs"])

    held = dealt.select("b", "id", "v").repartition(width, "b").sortWithinPartitions("b", "id", "v")
    held = checkpoint(held.mapInArrow(index, "b long, ids binary, codes binary, length binary, far binary"))
    packed = asked.select(F.pmod(F.xxhash64(F.lit(2), "query_id"), F.lit(asks)).alias("a"), "query_id", "q").repartition(width, "a").sortWithinPartitions("a", "query_id")
    packed = checkpoint(packed.mapInArrow(pack, "a long, qids binary, qs binary"))
    every = lambda name, size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name)
    pairs = max(width, min(blocks * asks, 8192))
    left = held.select("b", "ids", "codes", "length", "far", every("a", asks)).repartition(pairs, "a", "b")
    right = packed.select(F.col("a").alias("a2"), "qids", "qs", every("b2", blocks)).repartition(pairs, "a2", "b2")
    meets = left.join(right.hint("merge"), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).select("b", "ids", "codes", "length", "far", "qids", "qs")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, s = books.shape[:2]
        for batch in batches:
            for b, *packs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, length, far, qids = (np.frombuffer(packs[i], t) for i, t in ((0, np.int64), (2, np.float64), (3, np.float32), (4, np.int64)))
                both = np.frombuffer(packs[1], np.uint8).reshape(levels, len(ids), (s + 1) // 2)
                coded = _decode(np.stack((both >> 4, both & 15), axis=-1).reshape(levels, len(ids), -1)[:, :, :s], books) * length[:, None]
                asked_for = np.frombuffer(packs[5], np.float64).reshape(len(qids), dims)
                asked_for = pad(asked_for / np.abs(asked_for).max(axis=1)[:, None])
                reach = np.linalg.norm(asked_for, axis=1)
                for at in range(0, len(qids), 128):
                    # Bounds of each score on both sides; the own id's are minus infinity.
                    low = asked_for[at : at + 128] @ coded.T
                    slack = reach[at : at + 128, None] * far[None].astype(np.float64)
                    high = low + slack
                    low -= slack
                    lo, hi = np.searchsorted(ids, qids[at : at + 128]), np.searchsorted(ids, qids[at : at + 128], "right")
                    for i in np.flatnonzero(hi > lo):
                        low[i, lo[i] : hi[i]] = high[i, lo[i] : hi[i]] = -np.inf
                    sure = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else low
                    edge = sure.min(axis=1) if len(ids) >= k else np.full(len(low), -np.inf)
                    out = []
                    for i, h in enumerate(high):
                        near = np.flatnonzero((h >= edge[i]) & (h > -np.inf))
                        if len(near):
                            one_by_one = len(near) <= p.rerank
                            out.append((int(qids[at + i]), b, sure[i].tobytes(), near.astype(np.int32).tobytes() if one_by_one else None, (h[near] if one_by_one else h.max(keepdims=True)).tobytes()))
                    if out:
                        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["query_id", "b", "sure", "at", "high"])

    found = meets.mapInArrow(scan, "query_id long, b long, sure binary, at binary, high binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qid, rows in _grouped(batches):
            bs, sures, ats, highs = (rows.column(i).to_pylist() for i in range(1, 5))
            sure = np.frombuffer(b"".join(sures))
            edge = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
            out = []
            for b, at, high in zip(bs, ats, highs, strict=True):
                keep = np.frombuffer(high) >= edge
                if keep.any():
                    out.append((b, qid, None if at is None else np.frombuffer(at, np.int32)[keep].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["b", "query_id", "at"])

    kept = found.repartition(width, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, "b long, query_id long, at binary")
    asks_of = kept.join(asked, "query_id").select("b", F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("v"), "at")
    both = dealt.select("b", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("at")).unionByName(asks_of)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            kind = rows.column(1).to_numpy()
            cut = int(np.searchsorted(kind, 1))
            ids, v = rows.column(2).to_numpy(), _rows(rows.column(3).combine_chunks())
            out = []
            size = np.sqrt((v[:cut] * v[:cut]).sum(axis=1).max(initial=0.0))
            for i in range(cut, len(ids)):
                at = rows.column(4)[i].as_py()
                if at is not None:
                    at = np.frombuffer(at, np.int32)
                else:
                    # The whole block: a product with rounding of its own first, then the sums of those near the edge.
                    rough = v[:cut] @ v[i]
                    rough[slice(*np.searchsorted(ids[:cut], (ids[i], ids[i] + 1)))] = -np.inf
                    edge = np.partition(rough, cut - k)[cut - k] - 1e-12 * size * np.sqrt((v[i] * v[i]).sum()) if cut > k else -np.inf
                    at = np.flatnonzero(~(rough < edge) & (ids[:cut] != ids[i]))
                score = (v[at] * v[i]).sum(axis=1)
                near = _best(score, k) if len(score) > k and np.isfinite(score).all() else np.arange(len(score))
                out.append((np.full(len(near), ids[i]), ids[at[near]], score[near]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    # A block's vectors, in the order its codes have, and then the queries that have candidates in it.
    exact = both.repartition(max(width, min(blocks, 8192)), "b").sortWithinPartitions("b", "kind", "id", "v").mapInArrow(rescore, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose vec_id is divisible by 20, among all others.

    Rows without vec_id, and vectors that are null, zero or hold null or non-finite numbers, take no part.  Vectors of several
    lengths, repeated ids, ties and empty tables as in ``top_k``; other columns aren't read.
    """
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, "id % 20 = 0", 20)
