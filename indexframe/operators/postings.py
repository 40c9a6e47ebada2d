"""A stored full-text index: postings with positions, written once and read by term.

``postings`` has the documents of each term of each text or exact field, how often each has it and where.  Rows are packed where they are
read, some million tokens at a time, and no row is moved: a file is a run of such parts, each in the order of field and term, so that a query
reads the pages of its terms only; ``numbers`` has the values of number fields in their order; ``lengths`` the tokens of each
document and field.  Clauses and query strings are those of ``fulltext``.  New documents are added as a further segment, removed
ones are noted and left out; ``write`` again makes one segment of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fulltext as ft

_REMOVED = "removed"

#: Tokens that are packed at once, about: they bound a task's memory.
TOKENS = 1 << 20
_PACKED = "field string, term string, ids array<long>, tf array<int>, at array<array<int>>"


def _packer(tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of field, id, words -> rows as ``_PACKED`` of so many tokens at a time.  Workers needn't import this package."""

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by([("field", "ascending"), ("id", "ascending")]).combine_chunks()
        field, id_, words = (c.chunk(0) for c in rows.columns)
        sizes = words.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        terms = words.flatten().dictionary_encode()
        if len(terms.dictionary) == 0:
            return
        place = np.empty(len(terms.dictionary), np.int64)
        place[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
        code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        own = field.dictionary_encode().indices.to_numpy()  # rises, as rows are in its order
        key = own[row] * len(place) + place[code]
        order = np.argsort(np.where(code < 0, np.iinfo(np.int64).max, key), kind="stable")[: np.count_nonzero(code >= 0)]
        key, row, at, code = key[order], row[order], at[order], code[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))  # of a term and document
        lead = np.flatnonzero(np.concatenate(([True], key[first[1:]] != key[first[:-1]])))  # of a term
        ends = pa.array(np.append(lead, len(first)), pa.int32())
        wheres = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))
        columns = [
            field.take(pa.array(row[first[lead]])),
            terms.dictionary.take(pa.array(code[first[lead]])),
            pa.ListArray.from_arrays(ends, id_.take(pa.array(row[first]))),
            pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(first, len(at))), pa.int32())),
            pa.ListArray.from_arrays(ends, wheres),
        ]
        made = pa.RecordBatch.from_arrays(columns, ["field", "term", "ids", "tf", "at"])
        for lo in range(0, made.num_rows, 4096):
            yield made.slice(lo, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.cumsum(batch.column(2).value_lengths().to_numpy()) // tokens
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(lo, hi - lo)
                held.append(piece)
                n += pc.sum(piece.column(2).value_lengths()).as_py()
                if n >= tokens:
                    yield from packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held))

    return run


@dataclass(frozen=True)
class StoredText:
    """``index`` says id, fields and analyzers; its rows are what was indexed last.  Ids are whole numbers and unique."""

    index: ft.TextIndex
    path: str

    @staticmethod
    def write(index: ft.TextIndex, path: str) -> StoredText:
        """Indexes all rows anew, in place of what is there."""
        made = StoredText(index, path)
        made._segment(index.df, "overwrite")
        index.df.limit(0).select(F.col(index.id).cast("long").alias("id")).write.mode("overwrite").parquet(f"{path}/{_REMOVED}")
        return made

    def add(self, rows: DataFrame) -> StoredText:
        """Indexes further rows.  Rows of removed ids stay removed until all is written anew."""
        self._segment(rows, "append")
        return self

    def remove(self, ids: DataFrame) -> StoredText:
        ids.select(F.col(ids.columns[0]).cast("long").alias("id")).write.mode("append").parquet(f"{self.path}/{_REMOVED}")
        return self

    def _segment(self, rows: DataFrame, mode: str) -> None:
        key, texts, numbers = F.col(self.index.id).cast("long").alias("id"), None, None
        for f in self.index.fields.values():
            if f.number:
                one = rows.select(F.lit(f.name).alias("field"), key, f.column.cast("double").alias("value")).where("value is not null")
                numbers = one if numbers is None else numbers.unionByName(one)
            else:
                words = f.analyzer(f.column) if f.analyzed else F.array(f.column)
                one = rows.select(F.lit(f.name).alias("field"), key, F.coalesce(words, F.array().cast("array<string>")).alias("words"))
                texts = one if texts is None else texts.unionByName(one)
        spark = rows.sparkSession
        texts = spark.createDataFrame([], "field string, id long, words array<string>") if texts is None else texts
        numbers = spark.createDataFrame([], "field string, id long, value double") if numbers is None else numbers
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Short pages, so that of a term little else is read.
        postings = texts.mapInArrow(_packer(TOKENS), _PACKED)
        postings.write.mode(mode).option("parquet.page.row.count.limit", 1000).parquet(f"{self.path}/postings")
        numbers.repartitionByRange(width, "field", "value", "id").sortWithinPartitions("field", "value").write.mode(mode).parquet(f"{self.path}/numbers")
        texts.select("field", "id", F.size("words").alias("length")).write.mode(mode).parquet(f"{self.path}/lengths")

    @property
    def _spark(self) -> SparkSession:
        return self.index.df.sparkSession

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self.path}/{name}")

    def _postings(self, name: str, on_term: Column, more: str) -> DataFrame:
        """field, term, id and ``more`` (tf or at) of the terms of a field that pass a test, a row a document."""
        rows = self._table("postings").where(F.col("field") == name).where(on_term)
        return rows.select("field", "term", F.inline(F.arrays_zip("ids", more))).toDF("field", "term", "id", more)

    def documents(self) -> DataFrame:
        """id of all documents that are there."""
        known = self._table("lengths").select("id").unionByName(self._table("numbers").select("id")).distinct()
        return known.join(self._table(_REMOVED), "id", "left_anti")

    def hits(self, clause: ft.Clause) -> DataFrame:
        """id and tf (how often; 1 for phrases and numbers) of the documents that a clause matches, removed ones included."""
        if clause.field == "*":
            return self.documents().withColumn("tf", F.lit(1).cast("long"))
        f = self.index.field(clause.field)
        if f.number:
            rows = self._table("numbers").where(F.col("field") == f.name).where(clause.on_tokens(F.array("value")))
            return rows.select("id", F.lit(1).cast("long").alias("tf")).distinct()
        if clause.on_term is not None:
            return self._postings(f.name, clause.on_term(F.col("term")), "tf").groupBy("id").agg(F.sum("tf").alias("tf"))
        if not clause.words:
            return self._postings(f.name, F.lit(False), "tf").select("id", F.col("tf").cast("long"))
        rows = self._postings(f.name, F.col("term").isin(*set(clause.words)), "at")

        def begin(k: int) -> Column:
            return F.transform("at", lambda x: x - k)

        # Where the phrase would begin, by each of its words.
        begins = [F.flatten(F.collect_list(F.when(F.col("term") == w, begin(k)))).alias(f"b{k}") for k, w in enumerate(clause.words)]
        common = F.col("b0")
        for k in range(1, len(clause.words)):
            common = F.array_intersect(common, F.col(f"b{k}"))
        return rows.groupBy("id").agg(*begins).where(F.size(common) > 0).select("id", F.lit(1).cast("long").alias("tf"))

    def _ids(self, part: ft.Clause | ft.TextQuery) -> DataFrame:
        if isinstance(part, ft.Clause):
            return self.hits(part).select("id")
        if part.must:
            found = self._ids(part.must[0])
            for p in part.must[1:]:
                found = found.join(self._ids(p), "id", "left_semi")
        elif part.should:
            found = self._ids(part.should[0])
            for p in part.should[1:]:
                found = found.unionByName(self._ids(p))
            found = found.distinct() if len(part.should) > 1 else found
        else:
            return self._spark.createDataFrame([], "id long")
        for p in part.must_not:
            found = found.join(self._ids(p), "id", "left_anti")
        return found

    def matches(self, query: ft.TextQuery | str) -> DataFrame:
        """id of the matching documents."""
        return self._ids(self.index._read(query)).join(self._table(_REMOVED), "id", "left_anti")

    def search(self, query: ft.TextQuery | str, most: int | None = None, offset: int = 0) -> DataFrame:
        """id and BM25 score of the matching documents, best first, ties by id; as ``TextIndex.search`` but for what is read."""
        query = self.index._read(query)
        rows, score = self.matches(query), F.lit(0.0)
        if most is not None and most <= 0:
            return rows.withColumn("score", score).where(F.lit(False))
        clauses = query.scoring()
        gone = self._table(_REMOVED)
        lengths = self._table("lengths").join(gone, "id", "left_anti")
        seen = {r["field"]: r for r in lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).collect()}  # a row a field
        for name in sorted({c.field for c in clauses}):
            own = self._table("lengths").where(F.col("field") == name).select("id", F.col("length").alias(f"len_{name}"))
            rows = rows.join(own, "id", "left")
        for i, c in enumerate(clauses):
            found = self.hits(c).join(gone, "id", "left_anti")
            df, stats = float(found.count()), seen.get(c.field)
            n, mean = (float(stats["n"]), float(stats["mean"] or 1.0)) if stats else (0.0, 1.0)
            rows = rows.join(found.select("id", F.col("tf").cast("double").alias(f"tf{i}")), "id", "left")
            tf, length = F.coalesce(f"tf{i}", F.lit(0.0)), F.col(f"len_{c.field}") / F.lit(mean or 1.0)
            idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
            score = score + F.lit(c.weight) * idf * tf * (ft.K1 + 1) / (tf + ft.K1 * (1 - ft.B + ft.B * length))
        scored = rows.withColumn("score", score).select("id", "score").orderBy(F.desc("score"), "id")
        scored = scored.offset(offset) if offset else scored
        return scored if most is None else scored.limit(most)
