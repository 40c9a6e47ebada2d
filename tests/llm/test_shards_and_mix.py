"""Shards and mixes against plain versions, and the pipeline's stages."""

import zlib

import pytest

import corpus_pipeline
from indexframe.llm import mixing, queries, sharding

from .conftest import write_tables

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_shards(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries()["op5_sharding"](spark, SMALL).collect()}
    total, before, slots = sum(len(t.encode()) + 1 for _, t in docs), 0, {}
    for i, text in docs:
        size = len(text.encode()) + 1
        shard = (2 * before + size) * 8 // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        r = got[i]
        assert (r.size, r.text_crc32, r.shard, r.slot, r.law, r.grown_shard) == (size, zlib.crc32(text.encode()), shard, slots[shard], "bytes", None)
        before += size


def test_shards_of_ties_and_few_rows(spark):
    rows = spark.createDataFrame([(i // 3, 1 + i % 2) for i in range(30)], "k long, size int")
    got = sharding.byte_shards(rows, "k", "size", 4).orderBy("shard", "slot").collect()
    for s in range(4):
        own = [r for r in got if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own))) and abs(sum(r["size"] for r in own) - 45 / 4) <= 2
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert sharding.byte_shards(rows.limit(1), "k", "size", 4).count() == 1


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        level = rest / max(1e-12, sum(weight[s] for s in order if s not in full))
        over = [s for s in order if s not in full and level * weight[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full.update(over)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 10, "é": 7, "z": 0}, {"x": 10}, {"a": 1, "b": 1, "c": 10_000}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.water_fill(rows, (5.0, 2.0, 1.0), 3.0).collect()}
    want = plain_targets(sizes)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_words(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0cd\re\nf ", "a\xa0b 　", "\x1cx y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(mixing.word_count("t")).collect()]
    assert got == [0, 0, 0, 1, 6, 2, 2]


def test_mix(spark):
    rows = queries()["op9_mixing"](spark, MIDDLE).collect()
    again = queries()["op9_mixing"](spark, MIDDLE).collect()
    assert sorted(rows) == sorted(again)
    docs = {r.doc_id: (r.source, len(r.text.encode().split())) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    sizes, taken, largest = {}, {}, {}
    for s, n in docs.values():
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    for r in rows:
        s, n = docs[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1


def test_fold_keeps_words_and_expectation(spark):
    """Over many seeds every document gets its expected copies."""
    items = spark.createDataFrame([(i, "s", 10 + i % 5, 0.3) for i in range(60)], "id long, source string, size long, p double").cache()
    won, words = {}, sum(10 + i % 5 for i in range(60)) * 0.3
    for seed in range(12):
        ids = [r.id for r in mixing.pivotal_winners(items, seed).collect()]
        assert len(set(ids)) == len(ids) and abs(sum(10 + i % 5 for i in ids) - words) <= 14
        for i in ids:
            won[i] = won.get(i, 0) + 1
    assert 0.25 < sum(won.values()) / (60 * 12) < 0.35 and len(won) > 50


def test_reduction_tree_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    items = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 5 as string)) as source", "100 + id % 3 as size", "0.4D as p")
    ids = {r.id for r in mixing.pivotal_winners(items, 1).collect()}
    for source, own in {"hot": range(0, 3000, 3), "1": [i for i in range(3000) if i % 3 and i % 5 == 1]}.items():
        assert abs(sum(100 + i % 3 for i in own if i in ids) - 0.4 * sum(100 + i % 3 for i in own)) <= 102, source


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    counts = [docs.count()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "byte_bpe"]
    for name in list(stages)[:3]:
        kept = stages[name](spark, docs, SMALL)
        assert kept.columns == columns and kept.join(docs, columns, "left_anti").isEmpty()
        docs = kept.cache()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    assert sum(labels[r.doc_id].quality for r in docs.collect() if r.doc_id in labels) >= 0.75 * sum(r.quality for r in labels.values() if not r.toxic)
    mixed = stages["mixing"](spark, docs, SMALL)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().where("count > 3").isEmpty()
    assert stages["byte_bpe"](spark, mixed, SMALL).count() == mixed.count()


def test_near_duplicates_keep_one_of_each_group(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(400))
    texts = [long, long, long + " tail", "other text of its own kind", None, "", "unique words here today", long]
    path = write_tables(spark, tmp_path, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, path).collect()}
    assert kept == {0, 3, 4, 6}


def test_rows_without_id_are_told_apart(spark):
    rows = [(None, "a", i % 7) for i in range(200)] + [(None, None, 3)] * 50 + [(4, "b", 5), (4, "b", 5), (5, "b", 2)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and len({(r.id, r.nth) for r in got}) == len(rows)
    assert sorted((r.nth for r in got if r.id == 4)) == [1, 2]
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.id is None, r.id or 0, r.source or "", r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
