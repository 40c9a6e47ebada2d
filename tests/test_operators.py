"""Collections, traversal, search, storage and streams on small literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexframe.functions.vectors import DOT_PRODUCT, EUCLIDEAN
from indexframe.operators import flow, fulltext, retention
from indexframe.operators.collection import Collection, ConstraintViolation, Custom, CustomChange, Unique
from indexframe.operators.vector import VectorIndex, VectorIndices, vectorized
from indexframe.plans import keys as K
from indexframe.sources import csv_convert, tables
from indexframe.streaming import windows


@pytest.fixture
def people(spark):
    df = spark.createDataFrame([("ann", 30), ("bob", 20), ("cy", None)], "name string, age int")
    return Collection.of(df, ["name"], K.TextKey("name"), K.OrderedKey("age"))


def names(c):
    return {r["_id"]: r["name"] for r in c.df.collect()}


def test_ids_are_never_reused(spark, people):
    more = spark.createDataFrame([("dee", 40)], "name string, age int")
    fewer = people.remove([2])
    assert names(fewer) == {0: "ann", 1: "bob"} and names(fewer.add(more, ["name"])) == {0: "ann", 1: "bob", 3: "dee"}
    assert fewer.highest_used_id() == 2 and fewer.get(2) is None
    back = spark.createDataFrame([(2, "cyd", 1)], "_id long, name string, age int")
    assert names(fewer.set(back))[2] == "cyd"
    with pytest.raises(ValueError):
        fewer.set(spark.createDataFrame([(9, "no", 1)], "_id long, name string, age int"))
    empty = fewer.remove_all()
    assert empty.size() == 0 and names(empty.add(more, ["name"])) == {0: "dee"}


def test_constraints(spark, people):
    unique = people.with_constraint(Unique(people.key("name")))
    with pytest.raises(ConstraintViolation):
        unique.add(spark.createDataFrame([("eve", 1), ("ann", 2)], "name string, age int"), ["name"])
    assert unique.size() == 3
    with pytest.raises(ConstraintViolation):
        people.with_constraint(Custom("aged", people.key("age").not_null()))
    grown = people.with_constraint(CustomChange("grow", lambda old, new: new("age") >= old("age")))
    assert names(grown.update(people.key("name").is_("bob"), {"age": F.lit(25)}))[1] == "bob"
    with pytest.raises(ConstraintViolation):
        grown.update(people.key("name").is_("bob"), {"age": F.lit(5)})
    assert names(unique.without_constraint(unique.constraints[0]).replace_entity(1, {"name": F.lit("ann")}))[1] == "ann"


def test_rows_in_memory(people):
    assert people.test(people.key("age").less_than(25), {"age": 20}) and not people.test(people.key("age").less_than(25), {"age": None})
    assert people.by_example(["name"], {"name": "cy"}).count() == 1


def test_matches_of_nothing(spark):
    none = spark.createDataFrame([], "x int")
    assert not flow.any_match(none, F.col("x") > 0).head()[0] and flow.all_match(none, F.col("x") > 0).head()[0] and flow.none_match(none, F.col("x") > 0).head()[0]
    assert sorted(map(tuple, flow.partitioning_by(none, F.col("x") > 0, F.count("x").alias("count")).collect())) == [(False, 0), (True, 0)]


def test_traversal_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    got = {r.node: r.steps for r in flow.reachable(edges, spark.createDataFrame([(1,)], "n int")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "n int")
    assert {r.n for r in flow.orphans(edges, nodes, spark.createDataFrame([(1,)], "r int")).collect()} == {4, 5}


def test_repeated_map_key_is_an_error(spark):
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string").agg(flow.to_map(F.col("k"), F.col("v"))).collect()


def test_floor_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "g string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "g string, k int, v string")
    got = sorted(map(tuple, flow.floor_join(left, right, "g", "at", "k", ["v"]).fillna("", ["g", "v"]).collect()))
    assert got == [("", 3, ""), ("a", 1, ""), ("a", 5, "y"), ("b", 9, "")]


def test_retention(spark):
    e = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 9), (4, "d", 9)], "k int, v string, n int")
    get = lambda df: {r.k: r.v for r in df.collect()}
    assert get(retention.put(e, new, "k")) == {1: "a", 2: "B", 3: "c", 4: "d"}
    assert get(retention.put(e, new, "k", only_absent=True)) == {1: "a", 2: "b", 3: "c", 4: "d"}
    assert get(retention.replace_existing(e, new, "k")) == {1: "a", 2: "B", 3: "c"}
    assert get(retention.remove(e, "k", [1])) == {2: "b", 3: "c"} and get(retention.get_all(e, "k", [1, 7])) == {1: "a"}
    assert get(retention.invoke(e, "k", [1], {"v": F.upper("v")}))[1] == "A"
    assert get(retention.evict(e, retention.LFU, 2, "k", hits="n")) == {1: "a", 3: "c"}
    with pytest.raises(ValueError):
        retention.evict(e, "no", 1, "k")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0])], "i int, v array<float>")
    index = VectorIndex(df, "i", "v", 2)
    assert [r.i for r in index.search([1.0, 0.0], 10).collect()] == [1, 2, 4, 5]
    assert [r.i for r in VectorIndex(df, "i", "v", 2, DOT_PRODUCT).search([1.0, 0.0], 2).collect()] == [2, 1]
    assert VectorIndex(df, "i", "v", 2, EUCLIDEAN).search([1.0, 0.0], 1).head().score == 1.0
    assert index.search_like(1, 1).head().i == 1
    for bad in ((None, 1), ([1.0], 1), ([1.0, 0.0], 0), ([1.0, float("nan")], 1)):
        with pytest.raises(ValueError):
            index.search(*bad)
    pairs = {(r.a, r.b) for r in index.near_duplicates(0.9).collect()}
    assert pairs == {(1, 2)} and {(r.a, r.b) for r in index.near_duplicates(0.9, tables=4, bits=2).collect()} <= pairs


def test_vectorizers_and_names(spark):
    df = vectorized(spark.createDataFrame([(1, "aa"), (2, None), (3, "b")], "i int, t string"), "t", "v", lambda ts: [None if t is None else [float(len(t)), 1.0] for t in ts])
    indices = VectorIndices()
    indices.add("len", VectorIndex(df, "i", "v", 2, DOT_PRODUCT))
    assert [r.i for r in indices.get("len").search([1.0, 0.0], 5).collect()] == [1, 3]
    assert indices.ensure("len", None) is indices.get("len")
    with pytest.raises(ValueError):
        indices.add("len", None)
    indices.remove("len")
    with pytest.raises(KeyError):
        indices.get("len")


def test_full_text(spark):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick, QUICK fox"), (3, "brown the quick"), (4, None)], "i int, t string")
    index = fulltext.TextIndex.of(df, "i", fulltext.Field("t", F.col("t")))
    ids = lambda q: sorted(r.i for r in index.query(q).collect())
    assert ids(fulltext.all_of(fulltext.phrase("t", "quick brown"))) == [1]
    assert ids(fulltext.all_of(fulltext.wildcard("t", "q?ick"), fulltext.prefix("t", "bro"))) == [1, 3]
    assert ids(fulltext.TextQuery(must_not=(fulltext.term("t", "fox"),))) == []
    assert ids(fulltext.TextQuery(must=(fulltext.term("t", "quick"),), must_not=(fulltext.term("t", "fox"),))) == [3]
    assert [r.i for r in index.search(fulltext.all_of(fulltext.term("t", "quick")), 2).collect()][0] == 2
    assert index.search(fulltext.all_of(fulltext.term("t", "quick")), 0).count() == 0
    with pytest.raises(KeyError):
        index.query(fulltext.all_of(fulltext.term("", "quick")))
    assert df.where("i = 2").select(fulltext.highlight(F.col("t"), "quick", "[", "]")).head()[0] == "[quick], [QUICK] fox"


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, True, ["a", "b,c", "[x]", "\\"], "x;y", 1.5), (2, None, [], "", None), (3, False, None, None, -0.5), (4, True, ["q"], 'say "hi"', 0.0)]
    df = spark.createDataFrame(rows, "i int, b boolean, l array<string>, s string, d double")
    csv_convert.write_csv(df, str(tmp_path / "csv"))
    back = csv_convert.read_csv(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_saved_tables(spark, tmp_path):
    path = str(tmp_path / "saved")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    tables.save_root(df, path, "things")
    tables.save_root(df.withColumn("more", F.lit(1)), path, "things", append=True)
    loaded = tables.load_root(spark, path, "things")
    assert loaded.count() == 4 and set(loaded.columns) == {"id", "kind", "more"}
    target = T.StructType().add("ID", "long").add("sort", "string").add("new", "double")
    assert [tuple(r) for r in tables.evolve(df, target, {"sort": "kind"}).orderBy("ID").collect()] == [(1, "a", None), (2, "b", None)]
    tables.backup(df, path + "/copy")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.backup(df, path + "/copy")


def test_windows_on_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), "a") for m in (0, 5, 61, 200)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    batch = windows.tumbling(df, "ts", "1 hour", ["kind"], F.count("*").alias("n"))
    assert sorted(r.n for r in batch.collect()) == [1, 1, 2]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "ts", "1 hour", ["kind"], F.count("*").alias("n"), late="10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 1, 2]
    assert windows.sessions(df, "ts", "30 minutes", ["kind"], F.count("*").alias("n")).count() == 3


def test_query_strings(spark):
    from indexframe.operators import fulltext as ft
    from indexframe.operators.textquery import QuerySyntaxError

    rows = [(1, "The quick brown fox", "en", 5), (2, "quick red fox", "en", 10), (3, "brown bear", "de", 15), (4, None, None, None), (5, "well-known a*b", "fr", 20)]
    df = spark.createDataFrame(rows, "id long, body string, lang string, year int")
    index = ft.TextIndex.of(df, "id", ft.Field("body", F.col("body")), ft.Field("lang", F.col("lang"), analyzed=False), ft.Field("year", F.col("year"), number=True), default="body")
    want = {
        "fox": {1, 2},
        '"quick brown"': {1},
        "quick AND fox AND NOT red": {1},
        "quick bear": {1, 2, 3},
        "+brown -fox": {3},
        "brown AND (fox OR bear)": {1, 3},
        "lang:(de OR fr)": {3, 5},
        "year:[5 TO 10]": {1, 2},
        "year:{5 TO 15}": {2},
        "year:[* TO 10}": {1},
        "body:[bear TO brown]": {1, 3},
        "br*n OR b?ar": {1, 3},
        "quikc~2": {1, 2},
        "well-known": {5},
        "-fox": set(),
        "*:* -fox": {3, 4, 5},
        "fox^3 OR bear": {1, 2, 3},
        "red OR brown AND bear": {2, 3},
        "lang:DE": set(),
    }
    for text, ids in want.items():
        assert {r.id for r in index.query(text).collect()} == ids, text
    assert [r.id for r in index.search("fox OR red^5").collect()][0] == 2
    assert index.search("fox", 0).count() == 0
    for bad in ("(fox", "fox)", "year:[5]", "", "AND fox", "field:"):
        with pytest.raises(QuerySyntaxError):
            index.query(bad)
    with pytest.raises(KeyError):
        index.query("nofield:x")


def test_hashed_near_duplicates_find_most(spark):
    import numpy as np

    from indexframe.operators.vector import VectorIndex

    rng = np.random.default_rng(1)
    base = rng.normal(size=(100, 16))
    rows = [(i, [float(t) for t in base[i % 100] + 0.05 * rng.normal(size=16)]) for i in range(300)]
    index = VectorIndex(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 16)
    exact = {(r.a, r.b) for r in index.near_duplicates(0.95).collect()}
    hashed = {(r.a, r.b) for r in index.near_duplicates(0.95, tables=6, bits=4).collect()}
    assert len(exact) >= 300 and hashed <= exact and len(hashed) >= 0.9 * len(exact)


def test_batches_of_many_small_blocks(spark):
    import numpy as np

    from indexframe.operators.vector import EUCLIDEAN, VectorIndex

    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8))
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = VectorIndex(df, "id", "v", 8, EUCLIDEAN).search_batch(df.selectExpr("id query_id", "v query_vector"), 5, block=20).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        near.setdefault(r.query_id, []).append(r.id)
    for q in range(150):
        assert near[q] == np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:5].tolist()
    assert set(near) == set(range(150))


def test_numbers_and_floor_joins_across_ranges(spark):
    """One key has all rows: they are spread over the tasks, and numbers and last rows go on from range to range."""
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    got = flow.numbered(rows, "n", ["x"], 5)
    assert {(r.x, r.n) for r in got.collect()} == {(i, i + 5) for i in range(1000)}
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    right = spark.createDataFrame([(None, 3, "n"), ("a", 10, "first"), ("a", 500, "later"), ("b", 0, "b")], "k string, at int, v string")
    left = spark.range(1000).selectExpr("'a' AS k", "cast(id AS int) AS t").unionByName(spark.createDataFrame([(None, 2), (None, 4), ("b", 7), ("c", 1)], "k string, t int"))
    found = {(r.k, r.t): r.v for r in flow.floor_join(left, right, "k", "t", "at", ["v"]).collect()}
    assert len(found) == 1004
    assert all(found["a", t] == (None if t < 10 else "first" if t < 500 else "later") for t in range(1000))
    assert (found[None, 2], found[None, 4], found["b", 7], found["c", 1]) == (None, "n", "b", None)


def test_rollups_take_rows_off(spark):
    from indexframe.operators.rollup import Rollup

    r = Rollup(("k",), sums=("x",))
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 5), (None, 2)], "k string, x int")
    kept = r.without(r.merge(r.build(rows), r.build(rows)), r.build(rows.where("k = 'b' or x is null")))
    kept = r.without(kept, r.build(rows.where("k = 'b'")))
    assert {(x.k, x.n, x.x_count, x.x_sum, x.x_avg) for x in r.read(kept).collect()} == {("a", 3, 2, 2, 1.0), (None, 2, 2, 4, 2.0)}
    with pytest.raises(ValueError):
        Rollup(("k",), least=("x",)).without(kept, kept)


def test_stored_text_answers_as_the_scan_does(spark, tmp_path):
    from indexframe.operators import fulltext as ft
    from indexframe.operators.postings import StoredText

    rows = [(1, "The quick brown fox", "en", 5), (2, "quick red fox fox", "en", 10), (3, "brown bear brown", "de", 15), (4, None, None, None), (5, "the the quick", "fr", 20)]
    df = spark.createDataFrame(rows, "id long, body string, lang string, year int")
    index = ft.TextIndex.of(df, "id", ft.Field("body", F.col("body")), ft.Field("lang", F.col("lang"), analyzed=False), ft.Field("year", F.col("year"), number=True), default="body")
    stored = StoredText.write(index, str(tmp_path / "text"))
    for text in ("fox", '"quick brown"', '"the the"', '"fox fox"', "lang:(de OR fr)", "year:{5 TO 15]", "br*n -bear", "*:* -fox", "quikc~2", "-fox", "+quick +lang:en", "[bear TO brown]"):
        assert {r.id for r in stored.matches(text).collect()} == {r.id for r in index.query(text).collect()}, text
    for text in ("fox OR brown^2", "quick", "fox AND quick"):
        scan = [(r.id, round(r.score, 9)) for r in index.search(text).collect()]
        assert [(r.id, round(r.score, 9)) for r in stored.search(text).collect()] == scan, text
    assert stored.search("fox", 0).count() == 0
    plan = stored.hits(ft.term("body", "fox"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(field,body)" in plan and "EqualTo(term,fox)" in plan
    stored.remove(spark.createDataFrame([(1,)], "id long")).add(spark.createDataFrame([(9, "a new fox", "en", 1)], df.schema))
    assert {r.id for r in stored.matches("fox").collect()} == {2, 9}


@pytest.mark.parametrize("tokens", [5, 1 << 20])
def test_stored_text_is_packed_where_it_is_read(spark, tmp_path, monkeypatch, tokens):
    """A term has a row for each part of the rows that are packed at once, not one a document, and no row is moved."""
    from indexframe.operators import fulltext as ft
    from indexframe.operators import postings

    monkeypatch.setattr(postings, "TOKENS", tokens)
    rows = [(i, " ".join(["the", "fox", f"w{i}", "fox"] if i % 2 else ["no", f"w{i % 7}"]) if i % 5 else None, None if i % 3 else "en") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, body string, lang string").coalesce(1)
    index = ft.TextIndex.of(df, "id", ft.Field("body", F.col("body")), ft.Field("lang", F.col("lang"), analyzed=False), default="body")
    stored = postings.StoredText.write(index, str(tmp_path / "text"))
    for text in ("fox", '"the fox w3 fox"', '"fox w3"', "lang:en", "w* -the", "w3 OR no"):
        assert sorted(r.id for r in stored.matches(text).collect()) == sorted(r.id for r in index.query(text).collect()), text
    scan = [(r.id, round(r.score, 9)) for r in index.search("fox OR w3^2").collect()]
    assert [(r.id, round(r.score, 9)) for r in stored.search("fox OR w3^2").collect()] == scan
    fox = spark.read.parquet(str(tmp_path / "text" / "postings")).where("term = 'fox'").collect()
    assert sum(len(r.ids) for r in fox) == 24 and all(r.tf == [2] * len(r.ids) for r in fox)
    assert len(fox) == 1 if tokens > 5 else 1 < len(fox)


@pytest.mark.parametrize("kind", ["DOT_PRODUCT", "EUCLIDEAN", "COSINE"])
def test_batches_over_many_blocks_copy_no_rows(spark, kind):
    """Blocks meet where they were packed: no row is multiplied by the blocks it meets; ties go to the smaller id, over all blocks."""
    import numpy as np

    from indexframe.operators import vector

    x = np.random.default_rng(5).integers(-3, 4, (300, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<float>")
    index = vector.VectorIndex(rows, "id", "v", 4, kind)
    found = index.search_batch(rows.where("id % 3 = 0").selectExpr("id query_id", "v query_vector"), 7, block=70)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert set(got) == set(range(0, 300, 3))
    for q, near in got.items():
        score = vector._scores(x[[q]], x, kind)[0]
        want = np.lexsort((np.arange(300), -np.round(score, 9)))[:7]
        assert [s for _, s in near] == pytest.approx(score[want].tolist())
        if kind != "COSINE":  # whole numbers, so equal scores are equal to the last bit
            assert [i for i, _ in near] == want.tolist()


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    import numpy as np

    from indexframe.operators import vector

    monkeypatch.setattr(vector, "BLOCK", 70)
    x = np.random.default_rng(6).normal(size=(300, 3))
    pairs = vector.VectorIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 3).near_duplicates(0.95)
    assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
    score = vector._scores(x, x, "COSINE")
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a, b) for a in range(300) for b in range(a + 1, 300) if score[a, b] >= 0.95]
