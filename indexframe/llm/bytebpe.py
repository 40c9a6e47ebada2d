"""Byte-level BPE by Spark higher-order functions over the distinct words of all documents.

Documents are taken in blocks of some megabytes of text, with no shuffle, and written in terms of the distinct words of
their block (matches of the pattern).  The words of all blocks meet by hash, in buckets of about equal size whatever the
corpus, and every distinct word is folded once, in the JVM: its byte array becomes the array of
its neighbouring pairs, and each step of ``aggregate`` merges the leftmost pair of least rank, which a
constant rank map gives.  Pieces are named by their ranks, which are the token ids, so the map goes from
(left rank, right rank) to the rank of the two concatenated; it is a perfect hash table in arrays.  The arrays are one literal
row, which is broadcast: written into the expressions they would make every plan's text megabytes long, and the driver keeps such
texts.  Ids go back to the blocks that have the word, as one small array a bucket and block.  Decoding concatenates the binary pieces of
the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_null_text, shuffle_width, table, tidy, written_by_hash

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
_NONE = 1 << 20
_EDGE = 65535  # the token beside a word


@dataclass(frozen=True)
class Params:
    """``block``: characters of a block of documents, about.  ``bucket``: bytes of text for which there is a bucket of
    words.  ``fold``: bytes of the longest word that is folded as an array; longer ones are merged with a heap, to the same ids."""

    block: int = 14_000_000
    bucket: int = 4_000_000
    fold: int = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@dataclass(frozen=True)
class Tables:
    """Constants of a vocabulary.  A pair is rank * 2**32 + left * 2**16 + right, of rank ``_NONE`` if it doesn't merge."""

    byte_pairs: list[int]  # of all two bytes, by left * 257 + right; 256 is the edge of a word
    pieces: list[str]  # hex
    displacement: list[int]
    cells: list[int]  # pairs, or -1


_GROUPS, _MODULUS = 65521, 16777213


@lru_cache(2)
def tables(path: str) -> Tables:
    ranks = load_ranks(path)
    if max(ranks.values()) >= _EDGE:
        raise ValueError("ranks must fit 16 bits")
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 16 | right] = rank
    size = 1 << max(10, (2 * len(pairs)).bit_length())
    groups = defaultdict(list)
    for k in pairs:
        groups[k % _GROUPS].append(k)
    used, displacement, cells = bytearray(size), [0] * _GROUPS, [-1] * size
    for g in sorted(groups, key=lambda g: (-len(groups[g]), g)):
        d = 0
        while True:
            at = [((k % _MODULUS) ^ d) & (size - 1) for k in groups[g]]
            if len(set(at)) == len(at) and not any(used[x] for x in at):
                break
            d += 2654435
        displacement[g] = d
        for k, x in zip(groups[g], at, strict=True):
            used[x], cells[x] = 1, pairs[k] << 32 | k
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    first = [*(ranks[bytes([b])] for b in range(256)), _EDGE]
    byte_pairs = [pairs.get(a << 16 | b, _NONE) << 32 | a << 16 | b for a in first for b in first]
    return Tables(byte_pairs, pieces, displacement, cells)


def with_tables(rows: DataFrame, t: Tables, version: str) -> DataFrame:
    """Adds the arrays of a vocabulary to each row of a few large rows; ``version`` is a column of ones."""
    arrays = [pa.array([t.byte_pairs]), pa.array([t.displacement]), pa.array([t.cells])]
    literal = pa.table([pa.array([1], pa.int32()), *arrays], ["__version", "byte_pairs", "displacement", "cells"])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(literal)), F.col(version) == F.col("__version"))  # one row, as large as the vocabulary


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_words(words: Column, t: Tables) -> Column:
    """array<array<smallint>> of the bytes of words, an edge (256) before and after -> array<array<int>> of their ids.

    For rows with the arrays of ``with_tables``.
    """
    byte_pairs, displacement, cells = F.col("byte_pairs"), F.col("displacement"), F.col("cells")

    def ranked(k: Column) -> Column:
        """The pair of a key left * 2**16 + right."""
        place = (k % F.lit(_MODULUS)).bitwiseXOR(F.get(displacement, (k % F.lit(_GROUPS)).cast("int"))).bitwiseAND(F.lit(len(t.cells) - 1))
        return _let(F.get(cells, place.cast("int")), lambda e: F.when(e.bitwiseAND(F.lit(0xFFFFFFFF)) == k, e).otherwise(k + F.lit(_NONE << 32)))

    def step(e: Column, _: Column) -> Column:
        def merge(v: Column, j: Column) -> Column:
            # The pairs on either side get the merged piece for the one that they share with it.
            m = F.shiftright(v, 32)
            left = F.get(e, j - 2).bitwiseAND(F.lit(0xFFFF0000)) + m
            right = F.shiftleft(m, 16) + F.get(e, j).bitwiseAND(F.lit(65535))
            return F.concat(F.slice(e, F.lit(1), j - 2), F.transform(F.array(left, right), ranked), F.slice(e, j + 2, F.lit(1 << 30)))

        return _let(F.array_min(e), lambda v: F.when(v >= F.lit(_NONE << 32), e).otherwise(_let(F.array_position(e, v).cast("int"), lambda j: merge(v, j))))

    def word(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.get(byte_pairs, F.get(w, i).cast("int") * 257 + F.get(w, i + 1)))
        ids = lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda x: x.bitwiseAND(F.lit(65535)).cast("int"))
        folded = F.aggregate(F.sequence(F.lit(1), F.size(w) - 2), pairs, step, ids)
        return F.when(F.size(w) < 3, F.slice(F.array(F.lit(0)), F.lit(1), F.lit(0))).otherwise(folded)

    return F.transform(words, word)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the same rule (leftmost pair of least rank first), in n log n."""
    n = len(word)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ranks.get(word[i : end[j]]) != r:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (s := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (s, i))
        if before[i] >= 0 and (s := ranks.get(word[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (s, before[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Irregular(Exception):
    pass


class _Chunks(dict):
    """Numbers of chunks: a word stands for itself after a space; a mark says what else a key is.

    Between a character that isn't white space and a single space no match of the pattern goes on, so texts are cut
    there and the pattern sees each distinct chunk once.  A key that ends in white space could belong to a
    longer run of it: its text is matched as a whole.
    """

    def __missing__(self, key: str) -> int:
        if key[:1] not in _MARKS and (not key or key[-1].isspace()) or key == "":
            raise _Irregular
        number = self[key] = len(self)
        return number


_START, _END, _WORD = "\x00", "\x01", "\x02"
_MARKS = (_START, _END, _WORD)
_find = regex.compile(PATTERN).findall


class _Block:
    """Documents of a block as numbers of chunks, chunks as numbers of words."""

    def __init__(self) -> None:
        self.chunks, self.doc_ids, self.codes, self.sizes, self.chars = _Chunks(), [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        number = self.chunks.__getitem__
        words = text.split(" ")
        try:
            if any(m in text for m in _MARKS) or len(words) > 1 and words[0][-1:].isspace():
                raise _Irregular
            if len(words) > 1:
                words[-1] = _END + words[-1]
            if words[0]:
                words[0] = _START + words[0]
            else:
                del words[0]
            codes = np.fromiter(map(number, words), np.uint32, len(words))
        except _Irregular:
            codes = np.array([number(_WORD + w) for w in _find(text)], np.uint32)
        self.doc_ids.append(doc_id)
        self.codes.append(codes)
        self.sizes.append(len(codes))
        self.chars += len(text)

    def words(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the words of all chunks one after another, and how many each chunk has."""
        number: dict[str, int] = {}
        flat, sizes = [], []
        for key in self.chunks:
            mark = key[0]
            if key.isalpha():  # letters only: one match
                flat.append(number.setdefault(" " + key, len(number)))
                sizes.append(1)
                continue
            if mark not in _MARKS and key[-1] in ".,;:!?" and key[:-1].isalpha():
                flat.append(number.setdefault(" " + key[:-1], len(number)))
                flat.append(number.setdefault(key[-1], len(number)))
                sizes.append(2)
                continue
            found = [key[1:]] if mark == _WORD else _find(key[1:]) if mark == _START else _find(" " + key[1:]) if mark == _END else _find(" " + key)
            sizes.append(len(found))
            for w in found:
                flat.append(number.setdefault(w, len(number)))
        return list(number), np.array(flat, np.int32), np.array(sizes, np.int32)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[_Block]:
    """Blocks of the rows (doc_id, text)."""
    block = _Block()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if block.chars and block.chars + len(text) > limit:
                yield block
                block = _Block()
            block.add(doc_id, text)
    if block.doc_ids:
        yield block


def _byte_arrays(words: list[bytes]) -> pa.Array:
    """The bytes of each word between two edges."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    flat, inside = np.full(int(size.sum()), 256, np.int16), np.ones(int(size.sum()), bool)
    inside[ends - 1] = inside[ends - size] = False
    flat[inside] = np.frombuffer(b"".join(words), np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))


def _pressed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpressed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _split(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_PACKED = "block long, bucket int, doc_ids array<long>, sizes array<int>, codes binary, chunk_sizes binary, chunk_words binary, lengths binary, words binary"
_GATHERED = "bucket int, blocks array<long>, places array<binary>, b array<array<smallint>>, long_at array<int>, long_ids array<array<int>>, version int"
_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


@tidy
def _pack(batches: Iterator[pa.RecordBatch], limit: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row a block, of bucket -1, with its documents in terms of its words; and one a block and bucket with the words."""
    whole = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=1).compress
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(_PACKED))

    for number, block in enumerate(_blocks(batches, limit)):
        words, flat, sizes = block.words()
        words = [w.encode() for w in words]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        codes = np.concatenate(block.codes)
        yield batch([(whole + number, -1, block.doc_ids, block.sizes, _pressed(codes), _pressed(sizes), _pressed(place[flat]), None, None)])
        del block, codes, flat, sizes, place
        held, cuts = [], [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(words)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                raw = [words[i] for i in order[lo:hi].tolist()]
                lengths = _pressed(np.fromiter(map(len, raw), np.int64, len(raw)))
                held.append((whole + number, int(bucket[order[lo]]), None, None, None, None, None, lengths, press(b"".join(raw))))
            if len(held) >= 1000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


@tidy
def _gather(batches: Iterator[pa.RecordBatch], fold: int, ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """bucket, block, lengths, words, sorted by bucket -> the distinct words of each bucket, and where its blocks have them."""
    number, blocks, places, bucket = {}, [], [], None
    unpress = zstandard.ZstdDecompressor().decompress

    def made() -> pa.RecordBatch:
        words, long_at, long_ids = list(number), [], []
        for i, w in enumerate(words):
            if len(w) > fold:
                long_at.append(i)
                long_ids.append(merge_long(w, ranks))
                words[i] = b""
        nested = _byte_arrays(words)
        arrays = [
            pa.array([bucket], pa.int32()), pa.array([blocks], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(nested)], pa.int32()), nested),
            pa.array([long_at], pa.list_(pa.int32())), pa.array([long_ids], pa.list_(pa.list_(pa.int32()))), pa.array([1], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, _names(_GATHERED))

    for batch in batches:
        for now, block, lengths, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != bucket and blocks:
                yield made()
                number, blocks, places = {}, [], []
            bucket = now
            own = [number.setdefault(w, len(number)) for w in _split(unpress(words), _unpressed(lengths))]
            blocks.append(block)
            places.append(_pressed(np.array(own, np.int64)))
    if blocks:
        yield made()


@tidy
def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded buckets -> block, bucket and the ids of the block's words of the bucket: how many each has, and all of them."""
    for batch in batches:
        for r in range(batch.num_rows):
            bucket, blocks, places, long_at, long_ids, ids = (batch.column(i)[r] for i in range(6))
            start = ids.values.offsets.to_numpy().astype(np.int64)
            flat = ids.values.values.to_numpy(zero_copy_only=False)
            start, size = start[:-1].copy(), np.diff(start)
            for at, own in zip(long_at.as_py(), long_ids.as_py(), strict=True):
                start[at], size[at] = len(flat), len(own)
                flat = np.concatenate((flat, np.array(own, flat.dtype)))
            found = []
            for place in places.as_py():
                at = _unpressed(place).astype(np.int64)
                found.append((_pressed(size[at]), _pressed(flat[_ragged(start[at], size[at])])))
            arrays = [blocks.values, pa.array([bucket.as_py()] * len(found), pa.int32()), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "bucket", "sizes", "ids"])


@tidy
def _digest(batches: Iterator[pa.RecordBatch], pieces: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """doc_ids, sizes, codes, chunk_sizes, chunk_words and the block's ids by bucket -> digests of each document."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = {i: str(i) for i in pieces}
    for batch in batches:
        for r in range(batch.num_rows):
            doc_ids, doc_sizes, codes, chunk_sizes, chunk_words, found = (batch.column(i)[r].as_py() for i in range(6))
            ids, decoded = [], []
            for one in found or []:
                flat, at = _unpressed(one["ids"]).tolist(), 0
                for n in _unpressed(one["sizes"]).tolist():
                    own = flat[at : at + n]
                    ids.append(",".join([names[i] for i in own]))
                    decoded.append(b"".join([pieces[i] for i in own]))
                    at += n
            place, texts, raws, at = _unpressed(chunk_words).tolist(), [], [], 0
            for n in _unpressed(chunk_sizes).tolist():
                if n == 1:
                    texts.append(ids[place[at]])
                    raws.append(decoded[place[at]])
                else:
                    texts.append(",".join([ids[k] for k in place[at : at + n]]))
                    raws.append(b"".join([decoded[k] for k in place[at : at + n]]))
                at += n
            del ids, decoded, place
            codes, out, at = _unpressed(codes), [], 0
            for doc_id, n in zip(doc_ids, doc_sizes, strict=True):
                chosen = codes[at : at + n].tolist()
                joined = ",".join(map(texts.__getitem__, chosen))
                raw = b"".join(map(raws.__getitem__, chosen))
                out.append((doc_id, joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
                at += n
            del texts, raws, codes
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], _names(_OUT))


def encode(docs: DataFrame, path: str = VOCABULARY, p: Params = Params()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of all rows (doc_id, text); a null text counts as empty.

    Repeated rows stay repeated, rows without doc_id stay too, other columns go.  The digests come from the ids of the folds and from the
    pieces these decode to.
    """
    t, spark = tables(path), docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null_text().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets, width = max(1, -(-size // p.bucket)), shuffle_width(spark)
    shared = spark.sparkContext.broadcast({bytes.fromhex(x): i for i, x in enumerate(t.pieces) if x})  # the vocabulary
    # Written: words and documents are read apart, and a lost task begins at its blocks.  By block, so that only ids move later.
    homes = min(4 * width, 100_000)
    packed = written_by_hash(docs.mapInArrow(lambda rows: _pack(rows, p.block, buckets), _PACKED), "words", "block", homes)
    words = packed.where("bucket >= 0").select("bucket", "block", "lengths", "words")
    words = words.repartitionById(width, F.col("bucket") % width).sortWithinPartitions("bucket", "block")
    gathered = words.mapInArrow(lambda rows: _gather(rows, p.fold, shared.value), _GATHERED)
    folded = with_tables(gathered, t, "version").select("bucket", "blocks", "places", "long_at", "long_ids", fold_words(F.col("b"), t).alias("ids"))
    spread = folded.mapInArrow(_spread, "block long, bucket int, sizes binary, ids binary")
    found = spread.repartition(homes, "block").groupBy(F.col("block").alias("own")).agg(F.sort_array(F.collect_list(F.struct("bucket", "sizes", "ids"))).alias("found"))
    whole = packed.where("bucket = -1").drop("bucket", "lengths", "words")
    both = whole.join(found, F.col("block") == F.col("own"), "left").select("doc_ids", F.col("sizes"), "codes", "chunk_sizes", "chunk_words", "found")
    return both.mapInArrow(lambda rows: _digest(rows, {i: x for x, i in shared.value.items()}), _OUT)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    return encode(table(spark, sf_dir, "documents"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids' digests of each row that is left."""
    return encode(docs)
