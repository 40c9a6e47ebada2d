import pytest

from indexframe.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write_tables(spark, folder, documents, labels=(), embeddings=(), conversations=(), extra=False):
    """Small tables as Parquet; ``extra`` adds columns whose names operators use themselves."""

    def put(name, rows, schema):
        df = spark.createDataFrame(list(rows), schema)
        if extra:
            for c in ("score", "size", "id", "fp", "y", "bucket", "shard", "copies", "v", "w", "record", "formatted", "__part", "held_out"):
                df = df.selectExpr("*", f"'x' as `{c}`") if c not in df.columns else df
        df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")

    put("documents", documents, DOCUMENTS)
    put("labels", labels, "doc_id long, quality int, toxic int")
    put("embeddings", embeddings, "vec_id long, embedding array<float>, label int")
    put("conversations", conversations, "conv_id long, turn long, role string, text string")
    return str(folder)
