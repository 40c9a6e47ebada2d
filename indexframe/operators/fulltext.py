"""Full-text search over named fields: terms, phrases, wildcards, fuzzy terms, ranges, booleans, BM25 scores.

Clauses are built as objects; each says which documents match and how they score.  Terms are lower-cased runs of ASCII
letters and digits (``functions.text.tokens``), or what a custom analyzer makes.  A field must be named.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Field:
    """``analyzed``: tokenised text, else an exact value.  ``number``: a number, whose ranges compare as numbers."""

    name: str
    column: Column
    analyzed: bool = True
    analyzer: Callable[[Column], Column] = tokens
    number: bool = False


@dataclass(frozen=True)
class Clause:
    """A test on a field: of one term (matching each of its tokens) or of a token array."""

    field: str
    on_term: Callable[[Column], Column] | None = None
    on_tokens: Callable[[Column], Column] | None = None
    weight: float = 1.0
    #: Of a phrase: its words.
    words: tuple[str, ...] = ()

    def boost(self, factor: float) -> Clause:
        return replace(self, weight=self.weight * factor)


def term(name: str, value: str) -> Clause:
    return Clause(name, on_term=lambda t: t == F.lit(value.lower()))


def prefix(name: str, value: str) -> Clause:
    return Clause(name, on_term=lambda t: t.startswith(value.lower()))


def wildcard(name: str, pattern: str) -> Clause:
    """``*`` for any characters, ``?`` for one; may lead."""
    special = "\\.[]{}()+^$|"
    regex = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern.lower())
    return Clause(name, on_term=lambda t: t.rlike(f"^{regex}$"))


def fuzzy(name: str, value: str, edits: int = 2) -> Clause:
    """Terms within Levenshtein edits; a transposition counts as two."""
    return Clause(name, on_term=lambda t: F.levenshtein(t, F.lit(value.lower())) <= edits)


def between(name: str, low: str, high: str) -> Clause:
    """Some term from ``low`` to ``high``, both included."""
    return Clause(name, on_term=lambda t: t.between(low, high))


def number(name: str, low: float | None, high: float | None, *, with_low: bool = True, with_high: bool = True) -> Clause:
    """A number between bounds; None is no bound.  Ranges don't score."""

    def test(own: Column) -> Column:
        x = F.get(own, F.lit(0))
        return (x.isNotNull() if low is None else x >= low if with_low else x > low) & (F.lit(True) if high is None else x <= high if with_high else x < high)

    return Clause(name, on_tokens=test)


def everything() -> Clause:
    return Clause("*", on_tokens=lambda own: F.lit(True))


def phrase(name: str, text: str) -> Clause:
    """The words of a text one after another; a text without words matches nothing."""
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
    def found(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - len(words) + 1)
        return F.when(F.size(own) >= len(words), F.exists(starts, lambda i: F.slice(own, i, F.lit(len(words))) == F.array(*map(F.lit, words)))).otherwise(False)

    if not words:
        return Clause(name, on_tokens=lambda own: F.lit(False))

    def test(own: Column) -> Column:
        # Bound once: inside the lambda of exists the tokens would be made anew for every start.
        return F.get(F.transform(F.array(own), found), F.lit(0))

    return Clause(name, on_tokens=test, words=tuple(words))


@dataclass(frozen=True)
class TextQuery:
    """``must`` all, ``must_not`` none and, if there is no ``must``, some ``should``; negations alone match nothing.

    A part is a clause or another query.
    """

    must: tuple[Clause | TextQuery, ...] = ()
    should: tuple[Clause | TextQuery, ...] = ()
    must_not: tuple[Clause | TextQuery, ...] = ()

    def boost(self, factor: float) -> TextQuery:
        return TextQuery(*(tuple(p.boost(factor) for p in parts) for parts in (self.must, self.should)), self.must_not)

    def scoring(self) -> list[Clause]:
        """The clauses over terms that count for the score."""
        return [c for p in (*self.must, *self.should) for c in (p.scoring() if isinstance(p, TextQuery) else [p]) if c.on_term is not None]


def all_of(*clauses: Clause) -> TextQuery:
    return TextQuery(must=clauses)


def any_of(*clauses: Clause) -> TextQuery:
    return TextQuery(should=clauses)


@dataclass(frozen=True)
class TextIndex:
    df: DataFrame
    id: str
    fields: Mapping[str, Field] = field(default_factory=dict)
    default_field: str | None = None

    @staticmethod
    def of(rows: DataFrame, entity_id: str, *fields: Field, default: str | None = None) -> TextIndex:
        return TextIndex(rows, entity_id, {f.name: f for f in fields}, default)

    def field(self, name: str | None) -> Field:
        found = self.fields.get(name or self.default_field or "")
        if found is None:
            raise KeyError(f"no field {name!r}; there are {sorted(self.fields)}")
        return found

    def named(self, name: str | None) -> str:
        return self.field(name).name

    def phrase_of(self, name: str | None, text: str) -> Clause:
        """What a text without operators asks of a field: a number, an exact value, a term or a phrase."""
        f = self.field(name)
        if f.number:
            return number(f.name, float(text), float(text))
        if not f.analyzed:
            return Clause(f.name, on_term=lambda t: t == F.lit(text))
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        return term(f.name, words[0]) if len(words) == 1 else phrase(f.name, text)

    def range_of(self, name: str | None, low: str | None, high: str | None, with_low: bool, with_high: bool) -> Clause:
        f = self.field(name)
        if f.number:
            return number(f.name, None if low is None else float(low), None if high is None else float(high), with_low=with_low, with_high=with_high)
        bound = (lambda x: x) if not f.analyzed else str.lower

        def test(t: Column) -> Column:
            above = F.lit(True) if low is None else t >= bound(low) if with_low else t > bound(low)
            return above & (F.lit(True) if high is None else t <= bound(high) if with_high else t < bound(high))

        return Clause(f.name, on_term=test)

    def _tokens(self, name: str) -> Column:
        if name == "*":
            return F.array(F.lit(""))
        found = self.field(name)
        if found.number:
            return F.array(found.column.cast("double"))
        return found.analyzer(found.column) if found.analyzed else F.array(found.column)

    def _read(self, query: TextQuery | str) -> TextQuery:
        if isinstance(query, TextQuery):
            return query
        from .textquery import parse

        return parse(query, self)

    def _hit(self, clause: Clause | TextQuery) -> Column:
        if isinstance(clause, TextQuery):
            return self.matches(clause)
        own = self._tokens(clause.field)
        hit = clause.on_tokens(own) if clause.on_tokens else F.exists(own, clause.on_term)
        return F.coalesce(hit, F.lit(False))

    def matches(self, query: TextQuery | str) -> Column:
        query = self._read(query)
        any_, all_ = F.lit(False), F.lit(True)
        for c in query.should:
            any_ = any_ | self._hit(c)
        for c in query.must:
            all_ = all_ & self._hit(c)
        for c in query.must_not:
            all_ = all_ & ~self._hit(c)
        return all_ if query.must else all_ & any_

    def query(self, query: TextQuery | str) -> DataFrame:
        """The matching documents, unscored.  A string is read as ``textquery`` says."""
        return self.df.where(self.matches(query))

    def search(self, query: TextQuery | str, most: int | None = None, offset: int = 0) -> DataFrame:
        """Matching documents with their BM25 score, best first, ties by id.

        A clause over terms scores by the terms it hits together: their count in the document, and the number of
        documents that it hits.  Phrases and must-nots don't score.  One pass counts what scores need, one
        scores; documents aren't shuffled.  Without ``most`` all matches come; none do if it isn't positive.
        """
        query = self._read(query)
        clauses = query.scoring()
        if most is not None and most <= 0:
            return self.df.withColumn("score", F.lit(0.0)).where(F.lit(False))
        rows, score = self.df, F.lit(0.0)
        names = sorted({c.field for c in clauses})
        for n in names:
            rows = rows.withColumn(f"__t_{n}", self._tokens(n))
        for i, c in enumerate(clauses):
            rows = rows.withColumn(f"__tf{i}", F.size(F.filter(F.col(f"__t_{c.field}"), c.on_term)).cast("double"))
        if clauses:
            sums = [F.sum((F.col(f"__tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(clauses))]
            sums += [F.avg(F.size(f"__t_{n}")).alias(f"len_{n}") for n in names]
            seen = rows.agg(F.count(F.lit(1)).alias("n"), *sums).head().asDict()  # one row
            for i, c in enumerate(clauses):
                df, n = seen[f"df{i}"] or 0.0, float(seen["n"])
                idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
                tf, length = F.col(f"__tf{i}"), F.size(f"__t_{c.field}") / F.lit(seen[f"len_{c.field}"] or 1.0)
                score = score + F.lit(c.weight) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        scored = rows.where(self.matches(query)).withColumn("score", score).select(*self.df.columns, "score").orderBy(F.desc("score"), self.id)
        scored = scored.offset(offset) if offset else scored
        return scored if most is None else scored.limit(most)

    def facets(self, query: TextQuery | str, facet: Column) -> DataFrame:
        return self.query(query).groupBy(facet.alias("facet")).agg(F.count(F.lit(1)).alias("count"))


def highlight(text: Column, word: str, before: str = "<b>", after: str = "</b>") -> Column:
    """A text with each occurrence of a whole word marked, case ignored."""
    escaped = "".join(c if c.isalnum() else "\\" + c for c in word)
    return F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9])({escaped})(?![A-Za-z0-9])", f"{before}$1{after}")
