"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

from indexframe.llm import jaccard, simhash

from .conftest import DOCUMENTS
from .test_pairs_and_groups import plain_components

SMALL = "/root/testdata/sf0.001"


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_roots(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = sorted(texts)
    linked = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    return plain_components(ids, linked)


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def texts():
    """Chains of edited copies about the limit, one large group of near copies, a line that many texts share, short texts."""
    rng = random.Random(3)
    line = "this very common line stands in many of the texts here"
    out = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 150, 600]))]
        for _ in range(8):
            out.append(" ".join(words))
            words = edited(rng, words, rng.choice([0.01, 0.03, 0.05]))
    base = [f"g{i}" for i in range(90)]
    out += [" ".join(edited(rng, base, 0.02)) for _ in range(80)]
    out += [f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 6, 30]))) for _ in range(60)]
    out += ["one", "One", "one two", "", "  ", None, "a b c d e", "A b\tc d\ne"]
    rng.shuffle(out)
    return dict(enumerate(out))


def test_stage_keeps_one_of_each_component(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCUMENTS)
    got = {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()}
    want = plain_roots(texts)
    assert got == {i for i, root in want.items() if i == root}
    sizes = np.unique(list(want.values()), return_counts=True)[1]
    assert sizes.max() >= 40 and len(got) > 60


def test_stage_on_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id for r in simhash.stage_simhash(spark, docs, SMALL).collect()}
    want = plain_roots({r.doc_id: r.text for r in docs.collect()})
    assert got == {i for i, root in want.items() if i == root}


def test_common_shingles_do_not_change_the_result(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCUMENTS)
    monkeypatch.setattr(jaccard, "_common", lambda d: (np.empty(0, np.int64), np.empty(0, np.int32)))
    got = {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()}
    assert got == {i for i, root in plain_roots(texts).items() if i == root}


def test_rows_without_or_of_one_doc_id(spark):
    copied = "one two three four five six seven"
    rows = [
        (None, "nothing is like this text without an id", "en", "a", 1),
        (None, copied, "en", "a", 1),
        (3, copied, "en", "b", 1),
        (5, "the first of two unlike texts of five", "en", "a", 1),
        (5, "a second text that shares its id only", "en", "a", 1),
        (7, "said twice in full by one id", "en", "a", 1),
        (7, "said twice in full by one id", "en", "a", 1),
        (8, "said twice in full by one id", "en", None, 1),
        (None, "twice without an id at all here", None, "a", 1),
        (None, "twice without an id at all here", None, "a", 1),
    ]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = [tuple(r) for r in simhash.stage_simhash(spark, docs.repartition(3), "").collect()]
    assert sorted(got, key=str) == sorted((rows[i] for i in (0, 2, 3, 4, 5, 8)), key=str)


def test_stage_takes_links_of_the_anchors(spark, texts, monkeypatch):
    """The fingerprints' links come first; what they join isn't left to the exact join."""
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCUMENTS)
    made, links = [], simhash.links

    def spied(nodes):
        found = links(nodes)
        made.append({(r.u, r.v) for r in found.collect()})
        return found

    monkeypatch.setattr(simhash, "links", spied)
    first = []
    components = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda docs, rows, pairs: first.append({(r.u, r.v) for r in pairs.collect()}) or components(docs, rows, pairs))
    got = {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()}
    assert got == {i for i, root in plain_roots(texts).items() if i == root}
    assert len(made) == 1 and len(made[0]) > 20 and {p for p in made[0] if p[0] != p[1]} <= first[0]


def one_group(sets):
    """All sets as one group of a shingle, as it reaches the comparison: no two of them connected."""
    keys = np.arange(len(sets), dtype=np.int64)
    columns = [np.zeros_like(keys), keys, np.array([len(s) for s in sets], np.int32), np.zeros(len(keys), np.int32), keys]
    arrays = [*(pa.array(c) for c in columns), pa.array([jaccard.sketch(s) for s in sets], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["h", "key", "n", "at", "root", "sketch"])


def near_sets(count, size, share):
    rng = np.random.default_rng(5)
    core = rng.integers(0, 1 << 63, round(size * share), np.uint64)
    return [np.unique(np.concatenate((core, rng.integers(0, 1 << 63, size - len(core), np.uint64)))) for _ in range(count)]


def test_group_of_unlike_copies_is_not_paired_out():
    batch = one_group(near_sets(200, 300, 0.8))  # any two have a likeness of 2/3
    assert sum(len(b) for b in jaccard._all_pairs(iter([batch]))) == 0  # of 19900 pairs
    alike = one_group(near_sets(200, 300, 0.95))
    assert sum(len(b) for b in jaccard._nearest(iter([alike]))) == 200


def test_sketches_rule_out_no_alike_pair():
    rng = np.random.default_rng(7)
    for size in (5, 40, 400, 4000):
        whole = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        sets = [whole, *(np.delete(whole, rng.choice(size, k, replace=False)) for k in (1, size // 10, size // 8, size // 6))]
        got = {(int(u), int(v)) for b in jaccard._all_pairs(iter([one_group(sets)])) for u, v in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), strict=True)}
        want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        assert want <= got
