"""Token ids in a binary format: static range asymmetric numeral systems (rANS).

All blocks share one frequency table, made of the counts of the whole corpus and scaled to 2**20.  A block holds whole
documents; its ids are dealt over interleaved lanes, each a rANS state, whose 32-bit words share one stream.  A
block is decoded by itself, and from any of its checkpoints (all lane states and the place in the
stream at some step), so that decoders can work in parallel; a checksum covers the ids it gives.

Files are Parquet tables of such blocks, one file number a range of document ids, and one table of
frequencies.  A block is, little-endian:

=========  =====================================================================================
bytes      content
=========  =====================================================================================
4          ``IDF1``
4 x 5      documents, ids (count), lanes, steps between checkpoints, checkpoints
4          crc32 of the ids as unsigned 32-bit integers
8 + 4      a document: doc_id and its number of ids (documents times; least doc_id first)
4 + 8      a checkpoint: words read before it, then the lane states (lanes times)
4          words of the stream
=========  =====================================================================================
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import no_null_text, shuffle_width, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
SCALE_BITS = 20
_LOW = np.uint64(1 << 31)
_MAGIC = b"IDF1"


@dataclass(frozen=True)
class Params:
    """``block``: ids of a block, about.  ``lanes``: at most.  ``every``: steps between checkpoints.
    ``cache``: words that a worker keeps with their ids."""

    block: int = 1 << 20
    lanes: int = 4096
    every: int = 64
    cache: int = 1_200_000


# --- tokenizing -------------------------------------------------------------------------------


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class WordTokenizer:
    """The library's ids of whole texts, found by encoding each distinct word once.

    The vocabulary drops white space and no match of its pattern spans it, so a text's ids are those of its words in
    turn.  Words of Latin-1 letters are lower-cased, as the vocabulary's normalizer does, and punctuation after a letter
    is a match of its own.  Words are encoded together, parted by a control character.
    """

    PART = "\x01"

    def __init__(self, path: str, cache: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        ids = self.tokenizer.encode(self.PART, add_special_tokens=False).ids
        if len(ids) != 1:
            raise ValueError("the parting character must be one token")
        self.part = ids[0]
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leads = sorted({s[:1] for s in self.special})
        self.ends = np.zeros(1 << 16, bool)  # ids of tokens that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}  # words with their 16-bit ids

    def _learn(self, words: list[bytes], risky: bool) -> dict[bytes, bytes]:
        found, letters, plain = {}, [], []
        for w in words:
            if w.isalpha() if w.isascii() else w.decode().isalpha():
                letters.append(w)
            elif b"\x01" in w or risky and self._special(w):
                found[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes()
            else:
                plain.append(w)
        # A word of letters is one match, whose last token says that it ends a word; others are parted by a character.
        found.update(self._together(letters, b" ", lambda ids: np.flatnonzero(self.ends[ids]) + 1, 0) or self._together(letters, b" \x01 ", self._parted, 1))
        found.update(self._together(plain, b" \x01 ", self._parted, 1))
        return found

    def _parted(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(ids == self.part), len(ids))

    def _together(self, words: list[bytes], joint: bytes, ends_of, skip: int) -> dict[bytes, bytes] | None:
        """The ids of words encoded as one text; ``skip`` ids stand between two.  None if the ends don't fit the words."""
        found = {}
        groups = [words[i : i + 400] for i in range(0, len(words), 400)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for g, e in zip(some, self.tokenizer.encode_batch_fast([joint.join(g).decode() for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u2")
                ends = ends_of(ids)
                if len(ends) != len(g):
                    return None
                raw, stop = ids.tobytes(), (2 * ends).tolist()
                start = [0, *[x + 2 * skip for x in stop[:-1]]]
                found.update(zip(g, [raw[a:b] for a, b in zip(start, stop, strict=True)], strict=True))
        return found

    def _special(self, word: bytes) -> bool:
        return any(x in word for x in self.leads) and any(s in word.lower() for s in self.special)

    def _parts(self, word: bytes, risky: bool) -> tuple[bytes, bytes]:
        """A word as it is encoded, and the punctuation that ends it; one that may hold a special token stays as it is."""
        if risky and self._special(word):
            return word, b""
        if word.isascii():
            word = word.lower()
        else:
            text = word.decode()
            if max(text) > "\xff":
                return word, b""
            word = text.lower().encode()
        base = word.rstrip(_PUNCTUATION)
        if len(base) < len(word) and base[-1:].isalpha():
            return base, word[len(base) :]
        return word, b""

    def encode(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        ends, words = split.offsets.to_numpy() - split.offsets[0].as_py(), split.flatten().dictionary_encode()
        codes, distinct = words.indices.to_numpy(), words.dictionary.cast(pa.binary()).to_pylist()
        known = self.known
        raw = list(map(known.get, distinct))
        missing = [i for i, x in enumerate(raw) if x is None]
        if missing:
            words_ = [distinct[i] for i in missing]
            risky = any(s in t for t in map(bytes.lower, words_) for s in self.special)
            parts = [self._parts(w, risky) for w in words_]
            new = {a for a, _ in parts if a not in known}
            new.update(b for _, b in parts if b and b not in known)
            new.discard(b"")  # white space at an end of a text gives an empty word
            fresh = self._learn(list(new), risky)
            fresh[b""] = b""
            get = lambda p: x if (x := fresh.get(p)) is not None else known[p]
            found = [get(a) + get(b) if b else get(a) for a, b in parts]
            for i, x in zip(missing, found, strict=True):
                raw[i] = x
            for more in (fresh, dict(zip(words_, found, strict=True))):
                room = self.cache - len(known)
                known.update(more if len(more) <= room else list(more.items())[: max(0, room)])
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        ids = np.frombuffer(b"".join(raw), "<u2")
        start = np.cumsum(size) - size
        del raw, distinct, split, words
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            c = codes[a:b]
            n = size[c]
            total = int(n.sum())
            yield ids[np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.empty(0, np.uint16)


_tokenizers: dict[str, WordTokenizer] = {}
_TOKENS = "doc_id long, n int, ids binary, counts array<long>"
_TEXTS = 40_000_000  # bytes of text that share a dictionary


def tokenized(docs: DataFrame, path: str, p: Params) -> DataFrame:
    """Rows (doc_id, n, ids: compressed 16-bit ids, the end id included) and, a row a task, the counts of all ids (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path, p.cache)
        words, pack = _tokenizers[path], zstandard.ZstdCompressor(level=1)
        counts = np.zeros(words.tokenizer.get_vocab_size(), np.int64)
        if len(counts) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        names = [x.split()[0] for x in _TOKENS.split(", ")]

        def ids_of(keys: pa.Array, texts: pa.StringArray) -> pa.RecordBatch:
            sizes, packed, every = [], [], []
            for ids in words.encode(texts):
                ids = np.append(ids, np.uint16(END))
                every.append(ids)
                sizes.append(len(ids))
                packed.append(pack.compress(ids.astype("<u2").tobytes()))
            np.add(counts, np.bincount(np.concatenate(every), minlength=len(counts)), out=counts)
            return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(keys), pa.list_(pa.int64()))], names)

        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // _TEXTS
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield ids_of(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([counts], pa.list_(pa.int64()))], names)

    return docs.mapInArrow(run, _TOKENS)


# --- coding -----------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS; every id that occurs has at least one."""
    total, goal = counts.sum(), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(1, (counts * (goal / total)).astype(np.int64)), 0)
    over = int(f.sum()) - goal
    order = np.lexsort((np.arange(len(f)), -f))
    for i in order if over < 0 else np.tile(order, 64):
        if over == 0:
            break
        step = over if over < 0 else min(over, int(f[i]) // 2 if f[i] > 1 else 0)
        f[i] -= step
        over -= step
    return f.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.f = frequencies.astype(np.uint64)
        self.c = np.concatenate(([0], np.cumsum(frequencies)[:-1])).astype(np.uint64)
        self.symbol: np.ndarray | None = None

    def encode(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, p: Params) -> bytes:
        n = len(ids)
        lanes = max(1, min(p.lanes, n // 64))
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW)
        words, marks, written = [], [], 0
        fs, cs = self.f[ids], self.c[ids]
        limits = fs << np.uint64(63 - SCALE_BITS)
        for t in range(steps - 1, -1, -1):
            at = slice(t * lanes, min(n, (t + 1) * lanes))
            f, k = fs[at], min(n, (t + 1) * lanes) - t * lanes
            y = x[:k]
            full = y >= limits[at]
            if full.any():
                out = y[full]
                words.append(out.astype(np.uint32))
                written += len(out)
                y[full] = out >> np.uint64(32)
            q = y // f
            x[:k] = (q << np.uint64(SCALE_BITS)) + (y - q * f) + cs[at]
            if t % p.every == 0:
                marks.append((written, x.copy()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        parts = [_MAGIC, struct.pack("<5I", len(doc_ids), n, lanes, p.every, len(marks)), struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))]
        docs = np.zeros(len(doc_ids), [("id", "<i8"), ("n", "<u4")])
        docs["id"], docs["n"] = [-(1 << 63) if d is None else d for d in doc_ids], sizes
        parts.append(docs.tobytes())
        for before, states in reversed(marks):
            parts += [struct.pack("<I", written - before), states.astype("<u8").tobytes()]
        return b"".join([*parts, stream.astype("<u4").tobytes()])

    def _table(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self.symbol

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """doc_ids, their numbers of ids, and the ids from checkpoint ``first`` up to checkpoint ``last`` (else the end)."""
        if block[:4] != _MAGIC:
            raise ValueError("not a block of ids")
        n_docs, n, lanes, every, n_marks = struct.unpack_from("<5I", block, 4)
        (check,) = struct.unpack_from("<I", block, 24)
        docs = np.frombuffer(block, [("id", "<i8"), ("n", "<u4")], n_docs, 28)
        mark, at = 4 + 8 * lanes, 28 + 12 * n_docs
        stream = np.frombuffer(block, "<u4", offset=at + mark * n_marks).astype(np.uint64)
        (place,) = struct.unpack_from("<I", block, at + mark * first)
        x = np.frombuffer(block, "<u8", lanes, at + mark * first + 4).astype(np.uint64)
        symbol, low = self._table(), np.uint64((1 << SCALE_BITS) - 1)
        begin, stop = first * every * lanes, n if last is None else min(n, last * every * lanes)
        ids = np.empty(stop - begin, np.uint32)
        for i in range(begin, stop, lanes):
            k = min(stop, i + lanes) - i
            y = x[:k]
            slot = y & low
            s = symbol[slot]
            ids[i - begin : i - begin + k] = s
            y = self.f[s] * (y >> np.uint64(SCALE_BITS)) + slot - self.c[s]
            more = y < _LOW
            if more.any():
                m = int(np.count_nonzero(more))
                y[more] = (y[more] << np.uint64(32)) | stream[place : place + m]
                place += m
            x[:k] = y
        if stop == n and (place != len(stream) or (x != _LOW).any()):
            raise ValueError("a block's stream doesn't end as it began")
        if first == 0 and stop == n and zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("a block's ids don't fit its checksum")
        return [None if d == -(1 << 63) else int(d) for d in docs["id"]], docs["n"].astype(np.int64), ids


_BLOCKS = "file int, block int, first long, n_ids long, payload binary"


def write_files(docs: DataFrame, path: str = TOKENIZER, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Writes the ids of (doc_id, text) in ascending doc_id order; returns the written blocks and frequencies, read again.

    Null texts count as empty; rows without doc_id come first; rows of one doc_id stand in the order of their ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null_text().alias("text"))
    rows = written(tokenized(docs, path, p), "ids")
    counts = rows.where("counts is not null").select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    got = counts.where("n > 0").toArrow()  # a row an id of the vocabulary
    size = max([END, *got.column("id").to_pylist()]) + 1
    total = np.zeros(size, np.int64)
    total[got.column("id").to_numpy()] = got.column("n").to_numpy()
    frequencies = scaled(total)
    spark = docs.sparkSession
    tables = written(spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies) if f], "id int, frequency int").coalesce(1), "frequencies")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, unpack = Coder(frequencies), TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        keys, sizes, parts, held, first, block = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = coder.encode(keys, sizes, np.concatenate(parts), p)
            columns = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and held + n > p.block:
                    yield flush()
                    keys, sizes, parts, held, first, block = [], [], [], 0, first + held, block + 1
                keys.append(doc_id)
                sizes.append(n)
                parts.append(np.frombuffer(unpack.decompress(ids.as_py()), "<u2"))
                held += n
        if keys:
            yield flush()

    ranged = rows.where("n is not null").select("doc_id", "n", "ids").repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return written(ranged.mapInArrow(encode, _BLOCKS), "blocks"), tables


def read_files(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of all documents in written blocks."""
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    bases = totals.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    got = tables.toArrow()  # a row an id of the vocabulary
    frequencies = np.zeros(max([0, *got.column("id").to_pylist()]) + 1, np.uint64)
    frequencies[got.column("id").to_numpy()] = got.column("frequency").to_numpy()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, sizes, ids = coder.decode(payload.as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    placed = blocks.join(F.broadcast(bases), F.col("file") == F.col("f"))  # as many rows as files
    return placed.select((F.col("base") + F.col("first")).alias("start"), "payload").mapInArrow(decode, schema)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, from the files they were written to."""
    return read_files(*write_files(table(spark, sf_dir, "documents")))
