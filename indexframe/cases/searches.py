"""Full text (J) and vectors (K)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fulltext as ft
from ..operators.postings import StoredText
from ..sources.shared import shared_dir
from ..operators.vector import COSINE, DOT_PRODUCT, EUCLIDEAN, VectorIndex
from .registry import Tables, case

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_DOCS = f"(SELECT *, {_TOKENS} AS tok FROM documents)"
_FOUND = f"SELECT doc_id FROM {_DOCS} WHERE "


def _index(t: Tables) -> ft.TextIndex:
    fields = ft.Field("text", F.col("text")), ft.Field("lang", F.col("lang"), analyzed=False), ft.Field("n_chars", F.col("n_chars"), number=True)
    return ft.TextIndex.of(t.documents, "doc_id", *fields, default="text")


def _ids(t: Tables, query: ft.TextQuery) -> DataFrame:
    return _index(t).query(query).select("doc_id")


@case(_FOUND + "list_contains(tok, 'idiot')")
def fts_term(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.term("text", "idiot")))


@case(_FOUND + "contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ')")
def fts_phrase(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.phrase("text", "of the")))


@case(_FOUND + "len(list_filter(tok, lambda x: regexp_full_match(x, 'th.*tion'))) > 0")
def fts_wildcard(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.wildcard("text", "th*tion")))


@case(_FOUND + "len(list_filter(tok, lambda x: regexp_full_match(x, '.*able'))) > 0")
def fts_leading_wildcard(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.wildcard("text", "*able")))


@case(_FOUND + "len(list_filter(tok, lambda x: starts_with(x, 'wor'))) > 0")
def fts_prefix(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.prefix("text", "wor")))


@case(_FOUND + "len(list_filter(tok, lambda x: levenshtein(x, 'moron') <= 1)) > 0")
def fts_fuzzy(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.fuzzy("text", "moron", 1)))


@case(_FOUND + "(list_contains(tok, 'the') OR list_contains(tok, 'der')) AND NOT list_contains(tok, 'and')")
def fts_boolean(t: Tables) -> DataFrame:
    return _ids(t, ft.TextQuery(should=(ft.term("text", "the"), ft.term("text", "der")), must_not=(ft.term("text", "and"),)))


@case(_FOUND + "FALSE")
def fts_only_not(t: Tables) -> DataFrame:
    return _ids(t, ft.TextQuery(must_not=(ft.term("text", "and"),)))


@case(_FOUND + "len(list_filter(tok, lambda x: x BETWEEN 'wor' AND 'worz')) > 0")
def fts_range(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.between("text", "wor", "worz")))


def _bm25(words: dict[str, float], where: str, limit: str) -> str:
    parts, joins = [], []
    for i, (w, boost) in enumerate(words.items()):
        parts.append(f"{boost} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len(tok) / l))")
        joins.append((f"CAST(len(list_filter(tok, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}", f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS df{i}"))
    d = f"(SELECT *, {', '.join(a for a, _ in joins)} FROM {_DOCS})"
    s = f"(SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS l, {', '.join(b for _, b in joins)} FROM {d})"
    score = f"round({' + '.join(parts)}, 6)"
    return f"SELECT doc_id, {score} AS score FROM {d}, {s} WHERE {where} ORDER BY {' + '.join(parts)} DESC, doc_id {limit}"


@case(_bm25({"idiot": 1.0, "clown": 1.0}, "tf0 + tf1 > 0", "LIMIT 20"))
def fts_bm25(t: Tables) -> DataFrame:
    return _index(t).search(ft.any_of(ft.term("text", "idiot"), ft.term("text", "clown")), 20).select("doc_id", F.round("score", 6).alias("score"))


@case(_bm25({"idiot": 3.0, "clown": 1.0}, "tf0 + tf1 > 0", "LIMIT 20"))
def fts_boost(t: Tables) -> DataFrame:
    return _index(t).search(ft.any_of(ft.term("text", "idiot").boost(3.0), ft.term("text", "clown")), 20).select("doc_id", F.round("score", 6).alias("score"))


@case(_bm25({"the": 1.0, "and": 1.0}, "tf0 > 0 AND tf1 > 0", "LIMIT 10 OFFSET 10"))
def fts_page(t: Tables) -> DataFrame:
    return _index(t).search(ft.all_of(ft.term("text", "the"), ft.term("text", "and")), 10, 10).select("doc_id", F.round("score", 6).alias("score"))


@case(f"SELECT lang AS facet, count(*) AS count FROM {_DOCS} WHERE list_contains(tok, 'de') GROUP BY 1")
def fts_facets(t: Tables) -> DataFrame:
    return _index(t).facets(ft.all_of(ft.term("text", "de")), F.col("lang"))


@case(f"SELECT doc_id FROM {_DOCS} WHERE lang = 'en' AND list_contains(tok, 'with')")
def fts_exact_field(t: Tables) -> DataFrame:
    return _ids(t, ft.all_of(ft.Clause("lang", on_term=lambda x: x == "en"), ft.term("text", "with")))


@case(
    _FOUND + "(list_contains(tok, 'idiot') OR contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ') OR len(list_filter(tok, lambda x: starts_with(x, 'pathe'))) > 0)"
    " AND lang <> 'de' AND NOT list_contains(tok, 'clown')"
)
def fts_query_string(t: Tables) -> DataFrame:
    return _ids(t, '(idiot OR "of the" OR text:pathe*) AND NOT lang:de AND NOT clown')


@case(_FOUND + "list_contains(tok, 'the') AND NOT len(list_filter(tok, lambda x: levenshtein(x, 'moron') <= 1)) > 0 AND n_chars >= 200 AND n_chars < 900")
def fts_signed_query(t: Tables) -> DataFrame:
    return _ids(t, "+the -moron~1 +n_chars:[200 TO 900} and")


def _stored(t: Tables) -> StoredText:
    return StoredText.write(_index(t), f"{shared_dir(t.spark)}/text-{uuid.uuid4().hex}")


@case(
    _FOUND + "(list_contains(tok, 'idiot') OR contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ') OR len(list_filter(tok, lambda x: starts_with(x, 'pathe'))) > 0)"
    " AND lang <> 'de' AND NOT list_contains(tok, 'clown') AND n_chars <= 5000"
)
def fts_stored_query(t: Tables) -> DataFrame:
    found = _stored(t).matches('(idiot OR "of the" OR text:pathe*) AND NOT lang:de AND NOT clown AND n_chars:[* TO 5000]')
    return found.select(F.col("id").alias("doc_id"))


@case(_bm25({"idiot": 3.0, "clown": 1.0}, "tf0 + tf1 > 0", "LIMIT 20"))
def fts_stored_search(t: Tables) -> DataFrame:
    return _stored(t).search("idiot^3 OR clown", 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@case(_FOUND + "list_contains(tok, 'the') AND (doc_id % 3 = 0 OR doc_id % 3 = 1)")
def fts_stored_updates(t: Tables) -> DataFrame:
    """A first part, a second one added, and a third added and removed again."""
    index = _index(t)
    part = lambda k: t.documents.where(F.col("doc_id") % 3 == k)
    stored = StoredText.write(ft.TextIndex(part(0), index.id, index.fields, index.default_field), f"{shared_dir(t.spark)}/text-{uuid.uuid4().hex}")
    return stored.add(part(1)).add(part(2)).remove(part(2).select("doc_id")).matches("the").select(F.col("id").alias("doc_id"))


@case(_FOUND + "n_chars > 500 AND n_chars <= 1000")
def fts_numeric_range(t: Tables) -> DataFrame:
    return _ids(t, "n_chars:{500 TO 1000]")


@case(f"SELECT count(*) AS n FROM {_DOCS} WHERE list_contains(tok, 'the')")
def fts_default_max(t: Tables) -> DataFrame:
    return _index(t).search("the").agg(F.count(F.lit(1)).alias("n"))


@case(_FOUND + "len(list_filter(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), lambda x: x = 'the')) > 0")
def fts_custom_analyzer(t: Tables) -> DataFrame:
    letters = ft.Field("text", F.col("text"), analyzer=lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != ""))
    return ft.TextIndex.of(t.documents, "doc_id", letters).query(ft.all_of(ft.term("text", "the"))).select("doc_id")


@case("SELECT item_id, regexp_replace(text, '\\b([Tt][Hh][Ee])\\b', '<b>\\1</b>', 'g') AS marked FROM benchmark WHERE regexp_matches(text, '^[\\x00-\\x7f]*$')")
def fts_highlight(t: Tables) -> DataFrame:
    ascii_only = t.benchmark.where(F.col("text").rlike(r"^[\x00-\x7f]*$"))
    return ascii_only.select("item_id", ft.highlight(F.col("text"), "the").alias("marked"))


# --- vectors ---

_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 3)"
_V, _W = "CAST(embedding AS DOUBLE[])", "CAST(q AS DOUBLE[])"
_COS, _DOT = f"list_cosine_similarity({_V}, {_W})", f"list_inner_product({_V}, {_W})"
_EUC = f"1 / (1 + power(list_distance({_V}, {_W}), 2))"


def _vectors(t: Tables, kind: str = COSINE) -> VectorIndex:
    return VectorIndex(t.embeddings, "vec_id", "embedding", 64, kind)


def _top(score: str, more: str = "", k: int = 10) -> str:
    return f"SELECT vec_id, round({score}, 6) AS score FROM embeddings, {_Q} {more} ORDER BY {score} DESC, vec_id LIMIT {k}"


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@case(_top(_COS))
def vec_like_entity(t: Tables) -> DataFrame:
    return _scored(_vectors(t).search_like(3, 10))


@case(_top(_COS, k=7))
def vec_beam(t: Tables) -> DataFrame:
    v = _vectors(t)
    return _scored(v.search(v.vector_of(3), 7, beam=3))


@case(_top(_COS, "WHERE vec_id % 3 <> 0"))
def vec_null_vectors(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return _scored(VectorIndex(rows, "vec_id", "embedding", 64).search(_vectors(t).vector_of(3), 10))


@case("""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY
list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 10""")
def vec_batch_all(t: Tables) -> DataFrame:
    """Every vector asks."""
    asks = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _vectors(t, DOT_PRODUCT).search_batch(asks, 10).select("query_id", "vec_id", "rank")


@case(_top(_DOT))
def vec_dot(t: Tables) -> DataFrame:
    return _scored(_vectors(t, DOT_PRODUCT).search_like(3, 10))


@case(_top(_EUC))
def vec_euclid(t: Tables) -> DataFrame:
    return _scored(_vectors(t, EUCLIDEAN).search_like(3, 10))


@case(_top(_COS, "WHERE vec_id <> 3 AND label % 2 = 0"))
def vec_hybrid_pre(t: Tables) -> DataFrame:
    ids = t.embeddings.where("vec_id <> 3 and label % 2 = 0").select("vec_id")
    v = _vectors(t)
    return _scored(v.pre_filtered(v.vector_of(3), 10, ids))


@case(f"SELECT vec_id, score FROM ({_top(_COS, k=20)}) WHERE vec_id % 2 = 0")
def vec_hybrid_post(t: Tables) -> DataFrame:
    v = _vectors(t)
    return _scored(v.post_filtered(v.vector_of(3), 20, t.embeddings.where("vec_id % 2 = 0").select("vec_id")))


@case(f"SELECT vec_id, score FROM ({_top(_COS, k=50)}) WHERE score >= 0.2")
def vec_threshold(t: Tables) -> DataFrame:
    v = _vectors(t)
    return _scored(v.within(v.vector_of(3), 50, 0.2))


@case("""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY
list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0) WHERE rank <= 5""")
def vec_batch(t: Tables) -> DataFrame:
    asks = t.embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _vectors(t).search_batch(asks, 5).select("query_id", "vec_id", "rank")


@case("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4")
def vec_near_dup(t: Tables) -> DataFrame:
    return _vectors(t).near_duplicates(0.4).select("a", "b")
