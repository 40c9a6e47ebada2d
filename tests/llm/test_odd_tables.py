"""Every query and stage on odd tables: nulls anywhere, empty and long texts, repeated rows, clashing columns, no rows."""

import pytest

import corpus_pipeline
from indexframe.llm import queries

from .conftest import write_tables

NAN, INF = float("nan"), float("inf")
TEXTS = [
    (0, "The cat sat on the mat. It was a good day.\nAnother line here.", "en", "a", 60),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", None, 6),
    (4, "same text " * 3, "en", "b", 30),
    (5, "same text " * 3, "en", "b", 30),
    (5, "same text " * 3, "en", "b", 30),
    (None, "no id here", "en", "c", 10),
    (7, "x" * 5000 + " " + "long words " * 3000, "en", "a", 38000),
    (8, "idiot moron trash \x00\x01 é ß 你好 \U0001f600", "de", "c", 30),
    (9, "word", "fr", "a", 4),
]
LABELS = [(0, 1, 0), (4, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (7, 1, 0), (2, 0, 0)]
VECTORS = [(i, [float(i % 7 - 3), 1.0, float(i % 3)], 0) for i in range(45)] + [(100, None, 0), (120, [0.0, 0.0, 0.0], 0), (140, [NAN, 1.0, 0.0], 0), (160, [1.0, None, 2.0], None), (180, [INF, 0.0, 0.0], 1), (200, [1.0], 1), (None, [1.0, 2.0, 3.0], 1)]
TALKS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "x"), (3, None, "system", "</s> \\ <|turn|>"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]


@pytest.fixture(scope="module", params=["odd", "clashing", "empty"])
def folder(request, spark, tmp_path_factory):
    where = tmp_path_factory.mktemp(request.param)
    if request.param == "empty":
        return request.param, write_tables(spark, where, [])
    return request.param, write_tables(spark, where, TEXTS, LABELS, VECTORS, TALKS, extra=request.param == "clashing")


ROWS = {"op1_toxicity": 11, "op2_fingerprint": 10, "op3_simhash": 10, "op4_quality": 11, "op5_sharding": 11, "op6_token_file": 11, "op9_mixing": 11, "op10_bpe": 11}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, folder, name):
    kind, path = folder
    rows = queries()[name](spark, path).collect()
    if name == "op8_chat":
        assert len(rows) == (1 if kind == "empty" else 4)
    elif name == "op7_ann":
        assert len(rows) == (0 if kind == "empty" else 3 * 20)
    else:
        assert len(rows) == (0 if kind == "empty" else ROWS[name])


def test_pipeline(spark, folder):
    kind, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs.write.mode("overwrite").parquet(f"{path}/stage{i}")
            docs = spark.read.parquet(f"{path}/stage{i}")
    assert (docs.count() == 0) or kind != "empty"
