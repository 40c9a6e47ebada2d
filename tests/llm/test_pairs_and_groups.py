"""SimHash, components, fingerprints and nearest neighbours against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from indexframe.llm import ann, fingerprint, queries, simhash
from indexframe.llm.components import connected

from .conftest import write_tables

SMALL = "/root/testdata/sf0.001"


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", "  ", "One", "one two THREE", "a b c d", "É b c d é\x1cx\ny", "w " * 300])
def test_simhash_of_text(text):
    assert simhash.fingerprint(text) == plain_simhash(text)


def test_simhash_query(spark):
    got = {r.doc_id: r for r in queries()["op3_simhash"](spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = np.array([int(got[i].fingerprint, 16) for i in ids], np.uint64)
    for i in ids[:60]:
        assert int(got[i].fingerprint, 16) == plain_simhash(texts[i])
    linked = [(i, ids[j]) for k, i in enumerate(ids) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4)]
    want = plain_components(ids, linked)
    assert {i: got[i].component_id for i in ids} == want


@pytest.mark.parametrize("chunk", [4096, 40])
def test_links_of_clusters(spark, monkeypatch, chunk):
    """Random fingerprints with chains of near ones, and one crowded anchor that is dealt out in chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    fps = list(map(int, rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    for _ in range(300):
        fps.append(fps[rng.integers(0, len(fps))] ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7), dtype=np.uint64))))
    crowd = int(rng.integers(0, 1 << 63, dtype=np.uint64))
    fps += [crowd ^ (1 << a) ^ (1 << b) for a in range(50, 64) for b in range(40, 50)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(signed)], "fp long, rep long")
    roots = {r.node: r.root for r in connected(simhash.links(nodes)).collect()}
    a = np.array(fps, np.uint64)
    linked = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4)]
    assert {i: roots.get(i, i) for i in range(len(a))} == plain_components(range(len(a)), linked)


def test_forest_links_large_groups():
    rng = np.random.default_rng(1)
    base = np.uint64(12345)
    fps = np.array([base ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) for _ in range(300)], np.uint64)
    u, v = simhash._forest(fps, np.arange(300), np.arange(300))
    linked = [(i, int(j)) for i in range(300) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)]
    assert plain_components(range(300), zip(u.tolist(), v.tolist(), strict=True)) == plain_components(range(300), linked)
    assert len(u) < 300


def test_components_of_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_fingerprint_is_a_multiset_sum():
    whole = fingerprint.to_hex(*fingerprint.lanes("a b\nc d e\n\nlast"))
    assert whole == fingerprint.to_hex(*fingerprint.lanes("last\n\na b\nc d e"))
    assert fingerprint.inserted(fingerprint.to_hex(*fingerprint.lanes("a b\nlast\n")), ["c d e"]) == whole
    assert fingerprint.deleted(whole, ["c d e", "last"]) == fingerprint.to_hex(*fingerprint.lanes("a b\n"))
    assert whole != fingerprint.to_hex(*fingerprint.lanes("a b\nc d e\nlast"))
    assert set(fingerprint.to_hex(*fingerprint.lanes(None))) == {"0"} and len(whole) == fingerprint.HEX


def test_fingerprint_of_long_paragraphs():
    text = "word " * 200_000
    assert fingerprint.to_hex(*fingerprint.lanes(text + "\nend")) == fingerprint.to_hex(*fingerprint.lanes("end\n" + text))


def test_fingerprint_query(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries()["op2_fingerprint"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == fingerprint.to_hex(*fingerprint.lanes(edited))
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert np.median([r.near_edited for r in got.values()]) > 0.5 > np.median([r.near_next for r in got.values()])
    by_text = {}
    for i, text in docs:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint


@pytest.mark.parametrize("size", [1, 2, 7])
def test_next_document_wraps(spark, tmp_path, size):
    path = write_tables(spark, tmp_path, [(i, f"abcdef {i}", "en", "a", 8) for i in range(size)])
    got = {r.doc_id: r.edited_sha256 for r in queries()["op2_fingerprint"](spark, path).collect()}
    for i in range(size):
        text, after = f"abcdef {i}", f"abcdef {(i - 1) % size}"
        assert got[i] == hashlib.sha256((text[: len(text) - len(text) // 3] + after[: len(text) // 3]).encode()).hexdigest()


def test_nearest_neighbours(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries()["op7_ann"](spark, SMALL).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        score = x @ x[ids == q][0]
        want = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({r.vec_id for r in found} & set(ids[want]))
        for r in found:
            assert r.score == pytest.approx(score[ids == r.vec_id][0], rel=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert set(got) == {i for i in ids if i % 20 == 0} and hits / (20 * len(got)) >= 0.9


def test_neighbour_ties_and_copies(spark):
    vectors = [(i, [1.0, 2.0, 3.0] if i % 3 else [3.0, -1.0, 0.5]) for i in range(400)]
    random.Random(2).shuffle(vectors)
    rows = ann.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = ann.top_k(rows, "id = 1", 5, ann.Params(block=64, rerank=20)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 4, 5, 7, 8]


# --- fingerprints against plain sums and exact cosines ------------------------------------------


def plain_lanes(text):
    """The BLAKE2b sums, by Python's own integers."""
    sums = [0] * 16
    for line in text.split("\n") if text else []:
        raw = b"".join(hashlib.blake2b(line.encode(), person=p).digest() for p in (b"lanes a", b"lanes b"))
        sums = [(s + int.from_bytes(raw[8 * i : 8 * i + 8], "little")) % 2**64 for i, s in enumerate(sums)]
    return b"".join(s.to_bytes(8, "little") for s in sums).hex()


def pair_cosine(a, b):
    """The cosine of the multisets of the distinct word pairs of each line; words are pieces of 48 bytes at most."""

    def counts(text):
        found = Counter()
        for line in text.split("\n"):
            words = [w.encode()[i : i + 48] for w in re.findall(r"[^\x20\x09-\x0D]+", line) for i in range(0, len(w.encode()), 48)]
            found.update({(words[i - 1] if i else None, w) for i, w in enumerate(words)})
        return found

    x, y = counts(a), counts(b)
    scale = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(v * y[k] for k, v in x.items()) / scale**0.5 if scale else 0.0


def test_fingerprints_against_plain_sums_and_cosines(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries()["op2_fingerprint"](spark, SMALL).collect()}
    off = []
    for k, (i, text) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        assert got[i].fingerprint[:256] == plain_lanes(text) and got[i].edited_fingerprint[:256] == plain_lanes(edited)
        off += [abs(got[i].near_edited - pair_cosine(text, edited)), abs(got[i].near_next - pair_cosine(text, after))]
    assert np.quantile(off, 0.98) < 0.3 and np.mean(off) < 0.08  # 128 lanes have a deviation of some 0.09; of texts of one or two words a collision is more


@pytest.mark.parametrize("times", [400, 40_000])
def test_likeness_of_lines_repeated_many_times(times):
    text, after = "a b\n" * times, "quite other words\n" * times
    edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
    got = fingerprint.likeness(fingerprint.lanes(text), fingerprint.lanes(edited))
    assert abs(got - pair_cosine(text, edited)) < 0.1


def test_long_paragraphs_lose_no_pair(monkeypatch):
    text = " ".join(f"w{i}" for i in range(60_000)) + " " + "x" * 700_000 + " tail\nnext line"
    whole = fingerprint.lanes(text)
    monkeypatch.setattr(fingerprint, "SLICE", 1 << 12)
    cut = fingerprint.lanes(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(fingerprint._word_pairs(" ".join(map(str, range(200_000))).encode())) == 200_000


# --- nearest neighbours of odd and clustered vectors --------------------------------------------


def exact_neighbours(ids, x, q, k):
    score = x @ x[ids == q][0]
    return [i for i in ids[np.lexsort((ids, -score))] if i != q][:k]


def recall_of(spark, rows, p, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in ann.top_k(ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), "id % 20 = 0", k, p).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return np.mean([len(set(got[q]) & set(exact_neighbours(ids, x, q, k))) / k for q in got])


@pytest.mark.parametrize("kind", ["even", "clustered", "nearly equal"])
def test_recall_of_blocks_of_production_density(spark, kind):
    """Three blocks and the production parameters; an exact search would score all 6000 rows, this one ``rerank`` of them."""
    rng = np.random.default_rng(8)
    if kind == "even":
        x = rng.normal(size=(6000, 32))
    elif kind == "clustered":
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    else:
        x = rng.normal(size=32) + 0.05 * rng.normal(size=(6000, 32))
    rows = [(i, [float(t) for t in v]) for i, v in enumerate(x)]
    assert recall_of(spark, rows, ann.Params(block=2000)) >= 0.9


@pytest.mark.parametrize("kind", ["uneven dimensions", "uneven lengths", "tight clusters"])
def test_no_neighbour_is_missed(spark, kind):
    """Vectors whose codes of one level tell few of them apart: all of the nearest are found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    if kind == "uneven dimensions":
        x *= np.exp(2 * rng.normal(size=64))
    elif kind == "uneven lengths":
        x *= np.exp(2 * rng.normal(size=(6000, 1)))
    else:
        x = rng.normal(size=(5, 64))[rng.integers(0, 5, 6000)] + 1e-6 * x
    rows = [(i, [float(t) for t in v]) for i, v in enumerate(x)]
    assert recall_of(spark, rows, ann.Params(block=2000)) == 1.0


def test_vectors_of_several_lengths_meet_their_own(spark, tmp_path):
    vectors = [(i, [1.0 + i, 2.0], 0) for i in range(60)] + [(i, [float(i % 7), 1.0, float(i % 5)], 0) for i in range(60, 100)]
    path = write_tables(spark, tmp_path, [], embeddings=vectors)
    got = {}
    for r in queries()["op7_ann"](spark, path).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 60, 80} and all(len(v) == 20 for v in got.values())
    assert all(max(v) < 60 for q, v in got.items() if q < 60) and all(min(v) >= 60 for q, v in got.items() if q >= 60)


def test_scores_are_those_of_double_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(t) for t in rng.normal(size=5) * (1e-60 if i % 3 == 0 else 1)]) for i in range(50)]
    got = ann.top_k(ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), "id % 10 = 0", 49).collect()
    x = dict(rows)
    assert len(got) == 5 * 49
    for r in got:
        assert r.score == pytest.approx(float(np.dot(x[r.query_id], x[r.vec_id])), rel=1e-12, abs=0)


def test_repeated_ids_and_queries(spark):
    vectors = [(i, [float(i), 1.0]) for i in range(30)] + [(5, [50.0, 1.0]), (5, [50.0, 1.0]), (10, [0.0, 1.0])]
    rows = ann.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = ann.top_k(rows, "id = 10 or id = 5", 3).collect()
    ten = [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 10]
    assert ten == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]  # the lesser vector of id 10 asks
    assert all(r.vec_id != 5 for r in got if r.query_id == 5)
