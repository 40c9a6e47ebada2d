"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most one bit in one of three
segments (22, 21 and 21 bits).  In a segment the anchors are a covering code: the perfect Hamming
code [15, 11], of covering radius 1, on 15 bits, and every value of the other 6 or 7 bits.  A fingerprint
has a home, the anchor nearest to it, and visits every anchor within the covering radius plus
the threshold of the segment (about 14 of 2**17): of two linked fingerprints the one visits
the home of the other, whichever bit differs.  Comparison is per anchor, homes with visitors, over the
whole 64 bits.  An anchor with many homes is dealt out in chunks of homes, each of which sees all visitors.

Equal fingerprints are one node; links are given as a forest per anchor, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import checkpoint, shuffle_width, table
from .components import connected

THRESHOLD = 4
#: (lowest bit, bits) of the segments; the first 15 bits of each carry the Hamming code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Homes of one anchor that are compared by one task.
CHUNK = 4096
_PAIRS = 1 << 20
_LOWER = bytes(range(256)).lower()


def _shingle_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a text; 0 for one without words (null, empty)."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts)))
    n = max(1, len(parts) - words + 1)
    at = [0, *[e + i + 1 for i, e in enumerate(ends[: n - 1])]]
    to = [ends[min(i + words, len(parts)) - 1] + min(i + words, len(parts)) - 1 for i in range(n)]
    digest = xxhash.xxh64_intdigest
    total, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):
        total += _shingle_bits(np.array([digest(joined[a:b], 42) for a, b in zip(at[i : i + step], to[i : i + step], strict=True)], "<u8"))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long.  Rows without doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _near_code() -> tuple[np.ndarray, np.ndarray]:
    """Of each 15-bit word: its nearest codeword, and the 8 codewords within distance 2 (repeated if fewer)."""
    v = np.arange(1 << 15)
    syndrome = np.zeros_like(v)
    for i in range(15):
        syndrome ^= ((v >> i) & 1) * (i + 1)
    flip = np.where(syndrome, 1 << np.maximum(syndrome - 1, 0), 0)
    near = np.repeat((v ^ flip)[:, None], 8, axis=1)
    for s in range(1, 16):
        pairs = [(i, i ^ s) for i in range(1, 16) if i < i ^ s]
        rows = np.flatnonzero(syndrome == s)
        for k, (i, j) in enumerate(pairs):
            near[rows, k + 1] = rows ^ (1 << (i - 1)) ^ (1 << (j - 1))
    return v ^ flip, near


_code: list[np.ndarray] = []


def _anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchor keys and whether the row is at home there."""
    if not _code:
        _code.extend(_near_code())
    home, near = _code
    rows, keys, homes = [], [], []
    every = np.arange(len(fps))
    for n, (low, bits) in enumerate(SEGMENTS):
        segment = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        code, rest = segment & 0x7FFF, segment >> 15
        own = (n << 24) | (home[code] << 7) | rest
        others = ((n << 24) | (near[code] << 7)) | rest[:, None]
        flips = own[:, None] ^ (1 << np.arange(bits - 15))
        visits = np.concatenate((others[:, 1:], flips), axis=1)
        visits = np.where(visits == own[:, None], -1, visits)
        r, c = np.nonzero(visits >= 0)
        rows += [every, r]
        keys += [own, visits[r, c]]
        homes += [np.ones(len(fps), bool), np.zeros(len(r), bool)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, reps = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        for i in range(0, len(fps), 1 << 14):
            rows, keys, homes = _anchors(fps[i : i + (1 << 14)])
            columns = [keys.astype(np.int32), homes, fps[i : i + (1 << 14)][rows].view(np.int64), reps[i : i + (1 << 14)][rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "home", "fp", "rep"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _forest(fps: np.ndarray, reps: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group: a spanning forest of its close pairs."""
    label = np.arange(len(fps))
    u, v = [], []
    for h in homes:
        found = np.flatnonzero(_close(fps, fps[h]))
        other = np.unique(label[found])
        other = other[other != label[h]]
        if len(other):
            # one link to each part that joins: its first member that is close
            first = found[np.unique(label[found], return_index=True)[1]]
            first = first[label[first] != label[h]]
            u.append(np.full(len(first), reps[h]))
            v.append(reps[first])
            label[np.isin(label, other)] = label[h]
    none = np.empty(0, np.int64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def _links(anchor: np.ndarray, home: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within whole groups of equal anchor; the rows are sorted by anchor."""
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((start, [len(anchor)])))
    group = np.repeat(np.arange(len(start)), size)
    h = np.flatnonzero(home & (size[group] > 1))
    pairs = size[group[h]] * np.bincount(group[h], minlength=len(start))[group[h]]
    small, large = h[pairs <= 4096], h[pairs > 4096]
    us, vs = [], []
    cuts = np.cumsum(size[group[small]]) // _PAIRS
    for part in np.split(small, np.flatnonzero(np.diff(cuts)) + 1):
        if not len(part):
            continue
        n = size[group[part]]
        left = np.repeat(part, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[part]], n)
        hit = _close(fp[left], fp[right]) & (left != right)
        us.append(rep[left[hit]])
        vs.append(rep[right[hit]])
    for g in np.unique(group[large]):
        rows = slice(start[g], start[g] + size[g])
        u, v = _forest(fp[rows], rep[rows], np.flatnonzero(home[rows]))
        us.append(u)
        vs.append(v)
    if us and sum(map(len, us)):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not len(now[0]):
            continue
        now[2] = now[2].view(np.uint64)
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on
        if cut or (held and held[-1][0][-1] != now[0][0]):
            whole = [*held, [c[:cut] for c in now]]
            yield from _links(*(np.concatenate(c) for c in zip(*whole, strict=True)))
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield from _links(*(np.concatenate(c) for c in zip(*held, strict=True)))


def links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (distinct fp, rep) -> links (u, v) between reps, enough to connect all that differ by at most 4 bits."""
    width = shuffle_width(nodes.sparkSession)
    dealt = nodes.mapInArrow(_replicate, "anchor int, home boolean, fp long, rep long")
    hot = checkpoint(dealt.where("home").groupBy(F.col("anchor").alias("a")).count().where(F.col("count") > CHUNK))
    key = ["anchor"]
    if hot.head(1):
        chunks = F.ceil(F.col("count") / CHUNK)
        place = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), chunks))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
        others = F.filter(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: c != F.pmod(F.xxhash64("fp"), chunks))
        split = dealt.join(hot, F.col("anchor") == F.col("a"), "left").withColumn("chunk", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(place)))
        # A home is also a visitor of the other chunks.
        again = dealt.where("home").join(hot, F.col("anchor") == F.col("a")).withColumn("chunk", F.explode(others)).withColumn("home", F.lit(False))
        columns = [(F.col("anchor").cast("long") * (1 << 32) + F.col("chunk")).alias("anchor"), "home", "fp", "rep"]
        dealt = split.select(*columns).unionByName(again.select(*columns))
    return dealt.repartition(width, *key).sortWithinPartitions(*key).mapInArrow(_compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach, itself included) of all documents.

    Texts that are null, empty or without words share fingerprint zero.  Repeated rows stay repeated.
    """
    prints = checkpoint(fingerprints(docs, words))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected(links(nodes))
    named = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close_pairs(rows: DataFrame) -> DataFrame:
    """Links (u, v) between the keys of ``rows`` (fp, key) whose fingerprints differ by at most 4 bits, enough to connect all of them."""
    marked = checkpoint(rows.select("fp", "key").distinct())
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("key").alias("rep")))
    equal = marked.join(nodes.select(F.col("fp").alias("f"), "rep"), F.col("fp") == F.col("f")).select(F.col("key").alias("u"), F.col("rep").alias("v"))
    return links(nodes).unionByName(equal).where("u <> v")


def _sign(text: str | None) -> int:
    return fingerprint(text, jaccard.WORDS)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts that are 0.8 alike (Jaccard, sets of five-word shingles) are linked; of each component one row stays.

    Fingerprints of five-word shingles and the anchors above give the first links, each checked exactly; near copies that
    differ in more bits are found by the exact join of ``jaccard``, so none is lost.
    All texts without words are alike.  The row of least doc_id stays, one without doc_id only if none has one (ties go by a hash of the
    row, so reruns agree).  Rows are told apart by their texts: unlike texts under one doc_id, or under none, are unlike rows.
    """
    whole = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    rows = checkpoint(jaccard.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("row"), "text"), "doc_id", "row", sign=_sign))
    roots = jaccard.components(docs, rows, close_pairs(rows.where("n > 0")))
    named = rows.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "key").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    stays = checkpoint(best.select(F.col("least.row").alias("__stays")).distinct())
    kept = docs.withColumn("__whole", whole).join(stays, F.col("__whole") == F.col("__stays"), "left_semi")
    twice = rows.groupBy("row").count().where("count > 1")
    if twice.join(stays, F.col("row") == F.col("__stays"), "left_semi").head(1):
        kept = kept.dropDuplicates(["__whole"])
    return kept.select(*docs.columns)
