"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines).  Every paragraph hashes to a wide vector; the
fingerprint is the sum of these vectors modulo powers of two, so it doesn't depend on the order of
paragraphs, and a paragraph is inserted or deleted by adding or subtracting its vector.

* 16 lanes modulo 2**64 are a BLAKE2b digest of the paragraph: they decide equality.
* 128 lanes modulo 2**32 are a signed count sketch of the paragraph's distinct word pairs: their inner products
  estimate how much two multisets have in common.  A lane would have to count 2**31 pairs to wrap, more than a text can hold.

Null texts count as empty.  The empty text has no paragraph and the fingerprint zero.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_null_text, shuffle_width, table
from .wordhash import SLICE, SPACE, Prefix, bounds, mix

STRONG, SKETCH = 16, 128
HEX = 2 * (8 * STRONG + 4 * SKETCH)
#: Words over this many bytes count as several words, whatever the text.
LONG_WORD = 48

def _slices(data: bytes) -> Iterator[bytes]:
    """Pieces of at most SLICE bytes that cut no word, but one over SLICE bytes where it is cut anyway."""
    at = 0
    while len(data) - at > SLICE:
        to = max(data.rfind(s, at, at + SLICE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if to <= at:
            to = at + SLICE - SLICE % LONG_WORD
        yield data[at:to]
        at = to
    yield data[at:]


def _word_pairs(data: bytes) -> np.ndarray:
    """Hashes of the distinct pairs of a word and the word before it, of each paragraph."""
    words, lines, above = [], [], 0
    for part in _slices(data):
        buf = np.frombuffer(part, np.uint8)
        start, end = bounds(SPACE[buf])
        breaks = np.flatnonzero(buf == 10)
        if len(start):
            if (end - start).max() > LONG_WORD:
                cuts = [np.arange(s, e, LONG_WORD) for s, e in zip(start, end, strict=True)]
                ends = [np.minimum(c + LONG_WORD, e) for c, e in zip(cuts, end, strict=True)]
                start, end = np.concatenate(cuts), np.concatenate(ends)
            words.append(Prefix(buf).hash(start, end))
            lines.append(np.searchsorted(breaks, start) + above)
        above += len(breaks)
    if not words:
        return np.empty(0, np.uint64)
    own, line = np.concatenate(words), np.concatenate(lines)
    before = np.concatenate((np.zeros(1, np.uint64), own[:-1]))
    before[np.concatenate(([True], line[1:] != line[:-1]))] = 0
    pairs = mix(own + before * np.uint64(3))
    if line[-1] == line[0]:
        return np.unique(pairs)
    order = np.lexsort((pairs, line))
    pairs, line = pairs[order], line[order]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (line[1:] != line[:-1])))]


def lanes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of a text as its two groups of lanes."""
    data = (text or "").encode()
    if len(data) == 0:
        return np.zeros(STRONG, np.uint64), np.zeros(SKETCH, np.uint32)
    digests = b"".join(hashlib.blake2b(x, person=p).digest() for x in data.split(b"\n") for p in (b"lanes a", b"lanes b"))
    strong = np.frombuffer(digests, "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
    place = (_word_pairs(data) >> np.uint64(56)).astype(np.int64)
    sketch = np.bincount(place, minlength=2 * SKETCH).reshape(2, SKETCH).astype(np.int64).T @ np.array([1, -1])
    return strong, (sketch & 0xFFFFFFFF).astype(np.uint32)


def to_hex(strong: np.ndarray, sketch: np.ndarray) -> str:
    return (strong.astype("<u8").tobytes() + sketch.astype("<u4").tobytes()).hex()


def from_hex(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * STRONG], "<u8"), np.frombuffer(raw[8 * STRONG :], "<u4")


def _changed(fingerprint: str, paragraphs: Iterable[str], sign: int) -> str:
    strong, sketch = (x.copy() for x in from_hex(fingerprint))
    for paragraph in paragraphs:
        if "\n" in paragraph:
            raise ValueError("a paragraph has no newline")
        more, pairs = lanes(paragraph) if paragraph else lanes("\n")
        if not paragraph:  # a newline alone is two empty paragraphs
            more = np.frombuffer(b"".join(hashlib.blake2b(b"", person=p).digest() for p in (b"lanes a", b"lanes b")), "<u8")
        strong = strong + more if sign > 0 else strong - more
        sketch = sketch + pairs if sign > 0 else sketch - pairs
    return to_hex(strong, sketch)


def inserted(fingerprint: str, paragraphs: Iterable[str]) -> str:
    """The fingerprint after inserting paragraphs."""
    return _changed(fingerprint, paragraphs, 1)


def deleted(fingerprint: str, paragraphs: Iterable[str]) -> str:
    """The fingerprint after deleting paragraphs that it holds."""
    return _changed(fingerprint, paragraphs, -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the estimated cosine of two multisets of word pairs; 1 for equal fingerprints."""
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    scale = (x @ x) * (y @ y)
    return float(min(1.0, max(0.0, (x @ y) / np.sqrt(scale)))) if scale > 0 else 0.0


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below the key: a search in blocks of blocks."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    lit = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    coarse = F.size(F.filter(lit([b[-1] for b in blocks]), lambda c: c < key))
    fine = F.size(F.filter(F.get(F.array(*map(lit, blocks)), coarse), lambda c: c < key))
    return F.when(coarse >= len(blocks), F.lit(len(cuts))).otherwise(coarse * step + fine)


def with_next(docs: DataFrame, key: str) -> DataFrame:
    """Documents (key, text) dealt into buckets that are contiguous in ``key``, each with the row that follows it.

    Columns: bucket, helper, key, text; a partition is sorted so that a reader meets the documents of a bucket by
    descending key and then, as ``helper``, the document that comes next: the first of the bucket below or, after
    the last document, the first of all.  Texts are moved once.
    """
    width = shuffle_width(docs.sparkSession)
    ids = docs.select(key)
    found = ids.agg(F.percentile_approx(key, [i / width for i in range(1, width)], 20000)).head()[0] or []
    cuts = sorted(set(found))
    bucket = _bucket(F.col(key), cuts)
    tops = {r["b"]: r["top"] for r in ids.groupBy(bucket.alias("b")).agg(F.max(key).alias("top")).collect()}  # a row a bucket
    full = sorted((b for b, top in tops.items() if top is not None), reverse=True)
    above = {b: full[i - 1] for i, b in enumerate(full)}  # the bucket that needs the top of b; the lowest needs the highest's
    every = range(len(cuts) + 1)
    top = F.get(F.array(*[F.lit(tops.get(b)).cast("long") for b in every]), F.col("bucket"))
    goes = F.get(F.array(*[F.lit(above.get(b, 0)) for b in every]), F.col("bucket"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("helper"))
    lent = F.struct(goes.alias("bucket"), F.lit(True).alias("helper"))
    return (
        docs.withColumn("bucket", bucket)
        .withColumn("__to", F.explode(F.when(F.col(key) == top, F.array(own, lent)).otherwise(F.array(own))))
        .select("__to.bucket", "__to.helper", key, "text")
        .repartitionById(width, "bucket")
        .sortWithinPartitions("bucket", "helper", F.col(key).desc(), "text")
    )


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows: list[tuple] = []
    last = None  # (bucket, doc_id, text, lanes) that waits for the next document

    def settle(after: tuple) -> None:
        _, doc_id, text, own = last
        n = len(text)
        changed = text[: n - n // 3] + after[2][: n // 3]
        other = lanes(changed)
        rows.append((doc_id, n, hashlib.sha256(changed.encode()).hexdigest(), to_hex(*own), to_hex(*other), likeness(own, other), likeness(own, after[3])))

    for batch in batches:
        for bucket, helper, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if helper and (last is None or last[0] != bucket):
                continue  # a repeated helper
            now = (bucket, doc_id, text, lanes(text))
            if last is not None and last[0] == bucket:
                settle(now)
            last = None if helper else now
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows.clear()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness to the edited and to the next.

    Null texts count as empty.  Rows of one doc_id follow each other by text; rows without doc_id are left out,
    as they have no place in the order.  A single document is its own next.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", no_null_text().alias("text"))
    return with_next(docs, "doc_id").mapInArrow(_edited, _OUT)
