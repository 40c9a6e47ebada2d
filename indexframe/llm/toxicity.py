"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and, for words that come in many endings, their first four and five letters.  The
vocabulary is all terms of the examples but stop words, those that more than a share of the examples hold; every example and
every document has its full TF-IDF vector.  Examples, sorted so that like ones stand
together, are cut into blocks; the index keeps for each term its postings by block and the
largest weight in each block.  A search bounds the cosines of every block, scores the most promising blocks, and then those
that the k-th cosine so far doesn't rule out, so the neighbours are exact.  Neighbours vote with weights that
fall with their distance, against a prior; a logistic fit on the examples' own votes (each
without itself) makes scores of them.  The nearest neighbours are the evidence.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, trim
from .quality import keep_if, labelled_sample, logistic, remainder
from .wordhash import Prefix, bounds, mix, slices

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_HEADS = (4, 5)
#: Postings that are worked on at once, but for those of one term.
_SPAN = 1 << 17


@dataclass(frozen=True)
class Params:
    """``sample``: labelled rows that become examples, at most.  ``stop``: a term that more than this share of the examples
    (and more than ``stop_least`` of them) hold is a stop word.  ``neighbours``: examples that vote, one in ``one_in`` of all but
    15 at least and ``neighbours`` at most; ``evidence``: the nearest of them that are returned.  ``prior``: weight of the prior's vote."""

    sample: int = 8000
    stop: float = 0.06
    stop_least: int = 30
    neighbours: int = 200
    one_in: int = 16
    evidence: int = 5
    prior: float = 0.2
    block: int = 512
    seed: int = 23


def terms(text: str | None) -> np.ndarray:
    """Hashes of all terms of a text, repeats included."""
    found = []
    for data in slices((text or "").lower().encode()):
        buf = np.frombuffer(data, np.uint8)
        start, end = bounds(~_LETTER[buf])
        if not len(start):
            continue
        prefix = Prefix(buf)
        found.append(prefix.hash(start, end))
        for n in _HEADS:
            long = end - start > n
            found.append(mix(prefix.hash(start[long], start[long] + n) + np.uint64(n)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text, ascending, and how often it has them."""
    return np.unique(terms(text), return_counts=True)


class Vocabulary:
    """Known terms by hash; a table of the hashes' upper bits turns most other words away at once."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order]
        self._gate()

    def _gate(self) -> None:
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def __getstate__(self) -> tuple:
        return self.hashes, self.idf

    def __setstate__(self, state: tuple) -> None:
        self.hashes, self.idf = state
        self._gate()

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms (ascending) and TF-IDF weights of length one; none of either for a text without known terms."""
        h = terms(text)
        return self.weighed(*np.unique(h[self.gate[(h >> np.uint64(42)).astype(np.int64)]], return_counts=True))

    def known(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct hashes and their counts the known ones, as terms and counts."""
        if not len(h) or not len(self.hashes):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return at[known].astype(np.int32), n[known]

    def weighed(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.known(h, n)
        w = (1 + np.log(n)) * self.idf[at]
        return at, w / np.linalg.norm(w) if len(at) else w


def _spans(first: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """Runs of terms lo to hi and their postings, so many at a time that what is worked out of them stays small."""
    lo, n = 0, len(first) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + _SPAN, "right")) - 1)
        yield lo, hi, slice(int(first[lo]), int(first[hi]))
        lo = hi


class BlockMaxIndex:
    """Postings of example vectors by term and block, with the largest weight of each.

    Bounds and cosines add up in the order of terms, so no rounding lifts a cosine over the bound of its block.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int) -> None:
        self.n, self.block, self.n_terms = len(vectors), block, n_terms
        term = np.concatenate([v[0] for v in vectors] or [np.empty(0, np.int64)]).astype(np.int32)
        weight = np.concatenate([v[1] for v in vectors] or [np.empty(0)])
        doc = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[0]) for v in vectors])
        order = np.argsort(term, kind="stable")  # within a term by document
        self._tables(doc[order], weight[order], np.searchsorted(term[order], np.arange(n_terms + 1)))

    @classmethod
    def of_postings(cls, n: int, block: int, doc: np.ndarray, weight: np.ndarray, first: np.ndarray) -> BlockMaxIndex:
        """From postings by term and document; those of term t are first[t] to first[t + 1]."""
        made = cls.__new__(cls)
        made.n, made.block, made.n_terms = n, block, len(first) - 1
        made._tables(doc, weight, first)
        return made

    def _tables(self, doc: np.ndarray, weight: np.ndarray, first: np.ndarray) -> None:
        self.doc, self.weight, self.first = doc.astype(np.uint16 if max(self.n, self.block) < 1 << 16 else np.int32, copy=False), weight, first
        self.blocks = max(1, -(-self.n // self.block))
        df = np.diff(first)
        # Most terms stand in one example; the others have rows in the tables.
        self.row = np.where(df > 1, np.cumsum(df > 1) - 1, -1).astype(np.int32)
        rows = int((df > 1).sum())
        self.most = np.zeros((rows, self.blocks))
        self.start = np.zeros((rows, self.blocks + 1), np.int32)  # a term's postings of block b are start[b] to start[b + 1]
        self.start[:, 0] = first[:-1][df > 1]
        for lo, hi, here in _spans(first):
            row, own = np.repeat(self.row[lo:hi], df[lo:hi]), self.doc[here] // self.block
            for b in range(self.blocks):
                at = np.flatnonzero((own == b) & (row >= 0))
                r, w = row[at], weight[here][at]
                new = np.flatnonzero(np.diff(r, prepend=-1))
                if len(new):
                    self.start[r[new], b + 1] = np.diff(new, append=len(r))
                    self.most[r[new], b] = np.maximum.reduceat(w, new)
        np.cumsum(self.start, axis=1, out=self.start)

    def _add(self, score: np.ndarray, blocks: np.ndarray, start: np.ndarray, w: np.ndarray, lone: tuple[np.ndarray, ...]) -> None:
        """Adds the cosines of all examples of some blocks: of terms with tables first, then of lone postings."""
        gap = np.flatnonzero(np.diff(blocks) > 1)
        lo = start[:, blocks[np.append(0, gap + 1)]].ravel()  # by term, then by run of neighbouring blocks
        size = start[:, blocks[np.append(gap, len(blocks) - 1)] + 1].ravel() - lo
        at = np.repeat(lo - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        here = np.isin(lone[0], blocks)
        weight = self.weight[at]
        weight *= np.repeat(np.repeat(w, len(gap) + 1), size)
        score += np.bincount(np.append(self.doc[at], lone[1][here]), np.append(weight, lone[2][here]), self.n)

    def search(self, at: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, ties to the earlier one, and their cosines; never ``but``."""
        if not len(at) or not self.n:
            return np.empty(0, np.int64), np.empty(0)
        row = self.row[at]
        alone = (row < 0) & (self.first[at] < self.first[at + 1])
        single = self.first[at[alone]]
        lone = self.doc[single] // self.block, self.doc[single], self.weight[single] * w[alone]
        row, w = row[row >= 0], w[row >= 0]
        start, score = self.start[row].astype(np.int64), np.zeros(self.n)
        bound = np.add.reduce(self.most[row] * w[:, None], axis=0)
        np.add.at(bound, lone[0], lone[2])
        wave = np.sort(np.argsort(-bound, kind="stable")[: -(-k // self.block)])
        left = bound > 0
        left[wave] = False
        self._add(score, wave, start, w, lone)
        if 0 <= but:
            score[but] = 0
        best = self._best(score, k)
        if len(best) == k:  # a block that can only tie matters if it begins before the last of the best
            edge = score[best[-1]]
            left &= (bound > edge) | (bound == edge) & (np.arange(self.blocks) * self.block < best[-1])
        if left.any():
            self._add(score, np.flatnonzero(left), start, w, lone)
            if 0 <= but:
                score[but] = 0
            best = self._best(score, k)
        return best, score[best]

    @staticmethod
    def _best(score: np.ndarray, k: int) -> np.ndarray:
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            own = score[found]
            edge = np.partition(own, len(own) - k)[len(own) - k]
            above = found[own > edge]
            found = np.concatenate((above, found[own == edge][: k - len(above)]))
        return found[np.lexsort((found, -score[found]))]


class Model:
    """Examples with their index and the calibration of votes."""

    def __init__(self, vocabulary: Vocabulary, examples: list[tuple[int, int, np.ndarray, np.ndarray]], p: Params) -> None:
        """``examples``: doc_id, label, terms and their counts of each, those that are alike side by side."""
        self.p, self.vocabulary = p, vocabulary
        self.k = min(p.neighbours, max(15, len(examples) // p.one_in))
        y = np.array([x[1] for x in examples], float)
        self.base = (y.sum() + 0.5) / (len(y) + 1)
        self.ids, self.labels = np.array([x[0] for x in examples], np.int64), y
        term = np.concatenate([x[2] for x in examples] or [np.empty(0, np.int64)]).astype(np.int32)
        order = np.argsort(term, kind="stable")  # within a term by document
        small = lambda x: x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x
        self.first = np.append(0, np.cumsum(np.bincount(term, minlength=max(1, len(vocabulary.hashes))))).astype(np.int32)
        doc = np.repeat(np.arange(len(examples), dtype=np.int32), [len(x[2]) for x in examples])[order]
        self.counts = small(np.concatenate([x[3] for x in examples] or [np.empty(0, np.int64)]))[order]
        del term, order
        weigh = lambda at, n: (1 + np.log(n, dtype=np.float64)) * vocabulary.idf[at]
        self.norms = np.array([np.linalg.norm(weigh(x[2], x[3])) if len(x[2]) else 1.0 for x in examples])
        self._open(doc)
        del doc
        trim()
        votes = [self.vote(*self.index.search(x[2], weigh(x[2], x[3]) / self.norms[i], self.k, but=i)) for i, x in enumerate(examples)]
        self.slope, self.offset = logistic(np.array(votes), np.where(y == 1, 1, -1)) if len(y) else (1.0, 0.0)
        if self.slope < 0:  # so few examples that likeness tells nothing
            self.slope, self.offset = 0.0, float(np.log(self.base / (1 - self.base)))

    def _open(self, doc: np.ndarray) -> None:
        weight = np.empty(len(doc))
        for lo, hi, here in _spans(self.first[: len(self.vocabulary.idf) + 1]):
            w = weight[here]
            np.log(self.counts[here], out=w, dtype=np.float64)
            w += 1
            w *= np.repeat(self.vocabulary.idf[lo:hi], np.diff(self.first[lo : hi + 1]))
            w /= self.norms[doc[here]]
        self.index = BlockMaxIndex.of_postings(len(self.ids), self.p.block, doc, weight, self.first)

    def __getstate__(self) -> dict:
        """Counts instead of weights, and no more bytes a number than it needs."""
        return {k: v for k, v in self.__dict__.items() if k != "index"} | {"doc": self.index.doc.astype(np.uint16 if self.index.n <= 1 << 16 else np.int32)}

    def __setstate__(self, state: dict) -> None:
        doc = state.pop("doc")
        self.__dict__.update(state)
        self._open(doc)

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the neighbours' votes, each weighing one over its distance, and the prior's."""
        weight = 1 / (1.05 - np.minimum(cosine, 1.0))
        share = ((weight * self.labels[near]).sum() + self.p.prior * self.base) / (weight.sum() + self.p.prior)
        share = min(max(share, 1e-3), 1 - 1e-3)
        return float(np.log(share / (1 - share)))

    def search(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.index.search(*self.vocabulary.vector(text), self.k)

    def score(self, text: str | None) -> float:
        return self.explain(text)[0]

    def explain(self, text: str | None) -> tuple[float, list[dict]]:
        near, cosine = self.search(text)
        z = self.slope * self.vote(near, cosine) + self.offset
        n = self.p.evidence
        evidence = [{"doc_id": int(self.ids[i]), "cosine": float(c), "label": int(self.labels[i])} for i, c in zip(near[:n], cosine[:n], strict=True)]
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))), evidence


def learn(examples: list[tuple[int, int, np.ndarray, np.ndarray]], p: Params = Params()) -> Model:
    """A model of examples: doc_id, label, distinct terms and their counts.  Uses the list up, to hold less memory."""
    n = len(examples)
    held = np.concatenate([x[2] for x in examples] or [np.empty(0, np.uint64)])
    held.sort()
    last = np.flatnonzero(np.append(held[1:] != held[:-1], True)[: len(held)])
    hashes, df = held[last], np.diff(last, prepend=-1)
    del held, last
    stop = df > max(p.stop * n, p.stop_least)
    vocabulary, stops = Vocabulary(hashes[~stop], np.log(1 + n / df[~stop])), hashes[stop]
    del hashes, df, stop
    keys = []
    for i, (doc_id, y, h, count) in enumerate(examples):
        # Like examples share blocks: their commonest stop word tells languages apart; then label and weightiest term.
        own = np.flatnonzero(np.isin(h, stops, assume_unique=True))
        common = int(h[own[np.argmax(count[own])]]) if len(own) else -1
        at, count = vocabulary.known(h, count)
        w = (1 + np.log(count, dtype=np.float64)) * vocabulary.idf[at]
        keys.append((common, y, int(at[np.argmax(w)]) if len(at) else -1, doc_id))
        examples[i] = (doc_id, y, at, count)
    trim()
    return Model(vocabulary, [examples[i] for i in sorted(range(n), key=keys.__getitem__)], p)


class Packed:
    """A model as bytes, all that the driver and idle workers hold of it.

    ``parts`` are the arrays' own bytes, which an opened model reads where they are.  Each reading of ``model`` opens it anew,
    so it goes with the task that opened it; Python workers of an executor are more than its tasks at a time.
    """

    def __init__(self, data: bytes, parts: Iterable[bytes] = ()) -> None:
        self.data, self.parts = data, tuple(parts)

    @classmethod
    def of(cls, model: Model) -> Packed:
        arrays: list[pickle.PickleBuffer] = []
        data = pickle.dumps(model, protocol=5, buffer_callback=arrays.append)
        return cls(data, [bytes(a.raw()) for a in arrays])

    @property
    def model(self) -> Model:
        model = pickle.loads(self.data, buffers=self.parts)
        trim()
        return model

    def __reduce__(self) -> tuple:
        return Packed, (self.data, self.parts)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest needs."""
    return n.astype(np.min_scalar_type(n.max()).newbyteorder("<") if len(n) else np.uint8)


def gathered(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Examples of batches of doc_id, label, hashes and narrow counts as bytes, copied out of them."""
    examples = []
    for batch in batches:
        for i, y, h, n in zip(*batch.columns, strict=True):
            h, n = np.frombuffer(h.as_buffer(), "<u8").copy(), n.as_py()
            examples.append((i.as_py(), y.as_py(), h, np.frombuffer(n, f"<u{len(n) // max(1, len(h))}") if len(h) else np.empty(0, np.uint8)))
    return examples


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, p: Params = Params(), label: str = "toxic") -> Packed:
    """Texts become term counts on the executors; those of the sample, which is bounded, meet in one task, which learns the model."""
    sample = labelled_sample(docs, labels, label, allowed, p.sample, p.seed)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t.as_py()) for t in batch.column(2)]
            arrays = [pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([narrow(n).tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "y", "h", "n"])

    @tidy
    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = gathered(batches)  # by now the batches are gone
        trim()
        model = Packed.of(learn(examples, p))
        yield pa.RecordBatch.from_arrays([pa.array([model.data], pa.binary()), pa.array([model.parts], pa.list_(pa.binary()))], ["data", "parts"])

    counts = sample.select("doc_id", "y", "text").mapInArrow(count, "doc_id long, y int, h binary, n binary")
    row = counts.repartition(1).mapInArrow(teach, "data binary, parts array<binary>").head()
    return Packed(bytes(row["data"]), map(bytes, row["parts"]))


def scored(docs: DataFrame, model: Packed) -> DataFrame:
    """doc_id, score and evidence of all documents, repeated rows and rows without doc_id included; other columns go.

    A null text scores as the empty one, which has no neighbour: its score is the prior's.  Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.model
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            found = [m.explain(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kind)], ["doc_id", "score", "evidence"])

    schema = "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


CUT = 0.5


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from labels whose crc32 remainder isn't 0.

    A row of ``documents`` gives a row: repeated ones score alike, a null text as the empty one, a null doc_id counts as not
    held out.  Null labels and labels other than 0 and 1 teach nothing; of a doc_id with several labels the largest
    counts, of one with several texts one by a hash.  Neighbours of equal cosine go by the order of the index.  Without a
    label every score is one half.  ``evidence`` has the ``Params.evidence`` nearest of the examples that vote.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5), F.lit(1)) == 0
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score at the cut or above go; all columns of the others stay as they were.

    Learns from at most ``Params.sample`` labelled ones of the documents it gets, held-out ones left out.  Nulls, repeated rows and
    ties as in ``op1_toxicity``; without a label no document goes.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    shared = spark.sparkContext.broadcast(model)

    def scorer() -> Callable[[str | None], float]:
        m = shared.value.model
        return m.score if len(m.labels) else lambda text: 0.0

    return keep_if(docs, scorer, lambda s: s < CUT)
