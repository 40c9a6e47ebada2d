"""Near-duplicates by an exact join of shingle sets: texts whose sets of five-word shingles have a Jaccard likeness of at least 0.8.

All sets are put into one order of shingles, common ones last.  The first shingle that two sets of likeness 0.8 share comes so early in
both that those from there on can make up all they need to share (prefix filter with positions).  Sets that have such
a shingle are compared where they meet, by bit sketches from which at least so many elements differ as bits do, and only pairs that may
be alike leave the group.  Equal sets are one node.  So that a large group of near copies isn't paired out, links that are known
(``first``, and then rounds in which each node is counted against the nearest one it isn't connected with) come
before the rest, and connected nodes aren't compared.  No link is lost: a pair is counted exactly, ruled out by a bound, or connected
by other links already.

The order and the sketches only decide how many pairs are looked at, never which are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_width, tidy, written_by_hash
from .components import connected
from .wordhash import SPACE, Prefix, bounds, mix, slices

WORDS = 5
#: Shingles are counted by their upper bits; common ones of a task are those in this many of its rows and more.
_COUNT_BITS, _COMMON, _MOST = 22, 8, 1 << 16
_SEED_BITS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(256)).lower()
_CHUNK = 1 << 18
#: Pairs whose sketches are compared at once, and the bits of a sketch.
_PAIRS, _SKETCH_BITS = 1 << 16, 1024
#: Rounds of nearest nodes, each over another part of the groups.
_ROUNDS = 2
#: Rows of a link table that one task reads.
_ROWS_A_TASK = 1 << 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of five words (of all its words if fewer); none without words."""
    found = []
    for data in slices((text or "").encode().translate(_LOWER)):
        buf = np.frombuffer(data, np.uint8)
        start, end = bounds(SPACE[buf])
        if len(start):
            found.append(Prefix(buf).hash(start, end))
    if not found:
        return np.empty(0, np.uint64)
    words = np.concatenate(found)
    size = min(len(words), WORDS)
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = mix(h * _STEP + words[i : i + n])
    return np.unique(h)


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether ``common`` elements make sets of ``a`` and ``b`` elements 0.8 alike, or would."""
    return 9 * common >= 4 * (a + b)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots (upper bits) of common shingles and their counts, a bounded number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << _COUNT_BITS, np.int32), [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append((shingles(t.as_py()) >> np.uint64(64 - _COUNT_BITS)).astype(np.int64))
                n += len(held[-1])
                if n > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        slot = np.flatnonzero(total >= _COMMON)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot].astype(np.int64))], ["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = found.orderBy(F.desc("n"), "slot").limit(_MOST).collect()
    return np.array([r["slot"] for r in got], np.int64), np.array([r["n"] for r in got], np.int32)


def sketch(s: np.ndarray) -> bytes:
    """One bit a slot, whether an odd number of elements falls there: two sets differ in as many elements as their sketches in bits, or more."""
    slot = ((s >> np.uint64(20)) & np.uint64(_SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=_SKETCH_BITS) & 1).tobytes()


def keyed(docs: DataFrame, *carry: str, sign: Callable[[str | None], int]) -> DataFrame:
    """``carry``, key (of the shingle set), n (its size), prefix and fp (``sign`` of the text, 64 bits) of all rows; a row without words has n = 0."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))  # at most _MOST pairs
    last = len(carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), "key long, n long, prefix binary, fp long"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << _COUNT_BITS, np.int32)
        count[shared.value[0]] = shared.value[1]
        for batch in batches:
            keys, sizes, prefixes, fps = [], [], [], []
            for t in batch.column(last):
                text = t.as_py()
                s = shingles(text)
                order = np.argsort(count[(s >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)], kind="stable")
                keys.append(_key(s))
                sizes.append(len(s))
                prefixes.append(s[order[: len(s) - (4 * len(s) + 4) // 5 + 1]].tobytes())
                fps.append(sign(text))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps)]
            arrays = [signed[0], pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), signed[1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *arrays], [*carry, "key", "n", "prefix", "fp"])

    return docs.select(*carry, "text").mapInArrow(run, schema)


@tidy
def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n, prefix -> one row a shingle of the prefix, with its place in it."""
    for batch in batches:
        key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = [np.frombuffer(p.as_py(), np.int64) for p in batch.column(2)]
        size = np.array([len(x) for x in lists], np.int64)
        for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(np.cumsum(size) // _CHUNK)) + 1):
            if len(part):
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in size[part]])
                columns = [np.concatenate([lists[i] for i in part]), np.repeat(key[part], size[part]), np.repeat(n[part], size[part]).astype(np.int32), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "key", "n", "at"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns in pieces that hold whole groups of equal h (the first column, sorted); sketches are rows of a matrix."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if c.type == pa.binary() else c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on
        if cut or (held and held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _starts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return start, np.diff(np.concatenate((start, [len(h)])))


def _may(n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` may be alike if what stands at their places is the first shingle that they share."""
    need = (4 * (n[a] + n[b]) + 8) // 9
    return (at[a] + need <= n[a]) & (at[b] + need <= n[b])


def _unlinked(h: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal h and unlike root that may be alike by their places; the rows are sorted by h and root."""
    n = n.astype(np.int64)
    start, size = _starts(h)
    end = np.repeat(start + size, size)
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (root[1:] != root[:-1]))))
    block = np.diff(np.concatenate((new, [len(h)])))
    after = np.repeat(new + block, block)  # the first row of another root
    rows = np.flatnonzero(after < end)
    for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum((end - after)[rows]) // _PAIRS)) + 1):
        if len(part):
            m = (end - after)[part]
            a = np.repeat(part, m)
            b = after[a] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            ok = _may(n, at, a, b)
            if ok.any():
                yield a[ok], b[ok]


def _near(h: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Those pairs that may be alike by their sketches too, and the bits in which these differ."""
    for a, b in _unlinked(h, n, at, root):
        apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
        ok = 9 * apart <= n[a].astype(np.int64) + n[b]  # as in alike(): of all elements of both a ninth may differ
        if ok.any():
            yield a[ok], b[ok], apart[ok]


@tidy
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key, n, at, root -> the rows that have such a pair in their group."""
    for columns in _groups(batches):
        h, _, n, at, root = columns
        keep = np.zeros(len(h), bool)
        for a, b in _unlinked(h, n, at, root):
            keep[a] = keep[b] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["h", "key", "n", "at", "root"])


@tidy
def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key, n, at, root, sketch -> each row (v) with the row of unlike root whose sketch is nearest (u), if one may be alike."""
    for h, key, n, at, root, odd in _groups(batches):
        none = np.iinfo(np.int64).max
        best = np.full(len(h), none)
        for a, b, apart in _near(h, n, at, root, odd):
            np.minimum.at(best, a, apart << 40 | b)
            np.minimum.at(best, b, apart << 40 | a)
        v = np.flatnonzero(best < none)
        if len(v):
            columns = [key[best[v] & ((1 << 40) - 1)], key[v], (best[v] >> 40).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "apart"])


@tidy
def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key, n, at, root, sketch -> u < v: pairs of unlike root that may be alike."""
    for h, key, n, at, root, odd in _groups(batches):
        for a, b, _ in _near(h, n, at, root, odd):
            found = np.unique(np.stack((np.minimum(key[a], key[b]), np.maximum(key[a], key[b])), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["u", "v"])


def _sets(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """k, s (the whole set) and sketch of the keys that ``ends`` (k) holds."""
    # 2**24 bits at most, which keep most other sets from leaving Python; the join is exact.
    bits = ends.groupBy(F.expr(f"bitmap_bucket_number(shiftrightunsigned(k, {64 - _SEED_BITS}) + 1)").alias("b")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position(shiftrightunsigned(k, {64 - _SEED_BITS}) + 1))").alias("m")
    )
    asked = np.zeros(1 << (_SEED_BITS - 3), np.uint8)
    for r in bits.toLocalIterator():
        at = (int(r["b"]) - 1) * 4096
        asked[at : at + 4096] = np.packbits(np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little"))
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            keys, found, sketches = [], [], []
            for t in batch.column(0):
                s = shingles(t.as_py())
                k = _key(s)
                if wanted[k >> (64 - _SEED_BITS)]:
                    keys.append(k)
                    found.append(s.tobytes())
                    sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(found, pa.binary()), pa.array(sketches, pa.binary())], ["key", "s", "sketch"])

    found = docs.select("text").mapInArrow(sets, "key long, s binary, sketch binary").join(ends, F.col("key") == F.col("k"), "left_semi")
    return found.dropDuplicates(["key"]).select(F.col("key").alias("k"), "s", "sketch")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of keys that are alike by the exact count; of a pair without sets, nothing."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                ok.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("k").alias("ku"), F.col("s").alias("su")), F.col("u") == F.col("ku"))
    both = both.join(sets.select(F.col("k").alias("kv"), F.col("s").alias("sv")), F.col("v") == F.col("kv"))
    return both.select("u", "v", "su", "sv").mapInArrow(count, "u long, v long")


def components(docs: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """(node, root) of the keys of ``rows`` (as of ``keyed``) that links join to a lesser key; other keys stand alone.

    ``first`` (u, v) are pairs of keys that are counted before all others.
    """
    width = shuffle_width(docs.sparkSession)
    nodes = rows.where("n > 0").select("key", "n", "prefix").dropDuplicates(["key"])
    row = "h long, key long, n int, at int, root long"
    posted = nodes.mapInArrow(_post, "h long, key long, n int, at int").repartition(width, "h").sortWithinPartitions("h", "key").withColumn("root", F.col("key"))
    shared = checkpoint(posted.mapInArrow(_met, row).drop("root"))  # a row that meets no other is gone
    ends = checkpoint(shared.select(F.col("key").alias("k")).distinct())  # no other key has a link
    sets = written_by_hash(_sets(docs, ends), "shingle_sets", "k", width)  # the pairs move to the sets
    sketches = sets.select("k", "sketch")
    least = lambda pairs: pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    def grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The groups that aren't connected, whole and sorted by root, with the root that links give each row by now and the sketches."""
        rooted = rows.join(roots, F.col("key") == F.col("node"), "left").select("h", "key", "n", "at", F.coalesce("root", "key").alias("root"))
        met = rooted.repartition(width, "h").sortWithinPartitions("h", "root").mapInArrow(_met, row)
        return met.join(sketches, F.col("key") == F.col("k")).drop("k").repartition(width, "h").sortWithinPartitions("h", "root", "key")

    def more(roots: DataFrame, found: DataFrame) -> DataFrame:
        return connected(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found), _ROWS_A_TASK) if found.head(1) else roots

    roots = connected(_exact(least(first), sets), _ROWS_A_TASK)
    for i in range(_ROUNDS):
        part = shared.where(F.pmod("h", F.lit(_ROUNDS)) == i)
        near = grouped(part, roots).mapInArrow(_nearest, "u long, v long, apart int").groupBy("v").agg(F.min(F.struct("apart", "u")).alias("to"))  # one a row
        roots = more(roots, checkpoint(_exact(least(near.select(F.col("to.u").alias("u"), "v")), sets)))
    rest = grouped(shared, roots).mapInArrow(_all_pairs, "u long, v long").distinct()
    return more(roots, checkpoint(_exact(rest, sets)))
