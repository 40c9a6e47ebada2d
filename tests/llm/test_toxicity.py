"""The toxicity query against plain TF-IDF cosines, votes and a calibration at its optimum."""

import math
import pickle
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from indexframe.llm import queries, toxicity

from .conftest import write_tables

MIDDLE = "/root/testdata/sf0.01"


def plain_terms(text):
    words = re.findall("[a-z\u0080-\U0010ffff]+", (text or "").lower())
    raw = [w.encode() for w in words]
    return Counter([(0, w) for w in raw] + [(n, w[:n]) for n in (4, 5) for w in raw if len(w) > n])


def cosines(own, others):
    return [sum(w * o[t] for t, w in own.items() if t in o) for o in others]


def plain_vote(pairs, base, k=15, prior=0.2):
    near = sorted((p for p in pairs if p[0] > 0), key=lambda p: -p[0])[:k]
    weight = [1 / (1.05 - min(c, 1.0)) for c, _ in near]
    share = (sum(w * y for w, (_, y) in zip(weight, near, strict=True)) + prior * base) / (sum(weight) + prior)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return math.log(share / (1 - share))


def test_query_against_plain_neighbours(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = [i for i in labels if i in docs]
    counts = [plain_terms(docs[i]) for i in ids]
    df, n = Counter(t for c in counts for t in c), len(ids)
    idf = {t: math.log(1 + n / k) for t, k in df.items() if k <= max(0.06 * n, 30)}

    def vector(c):
        w = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors, y = [vector(c) for c in counts], [labels[i] for i in ids]
    base, k = (sum(y) + 0.5) / (n + 1), n // 16
    assert k > 15
    own = [plain_vote([p for j, p in enumerate(zip(cosines(v, vectors), y, strict=True)) if j != i], base, k) for i, v in enumerate(vectors)]
    rows = queries()["op1_toxicity"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    votes = {}
    for r in rows:
        near = cosines(vector(plain_terms(docs[r.doc_id])), vectors)
        votes[r.doc_id] = plain_vote(list(zip(near, y, strict=True)), base, k)
        want = sorted((c for c in near if c > 0), reverse=True)[:5]
        assert [e.cosine for e in r.evidence] == pytest.approx(want)
        assert all(labels[e.doc_id] == e.label and e.cosine == pytest.approx(near[ids.index(e.doc_id)]) for e in r.evidence)
    # Scores are a logistic curve of the votes; its slope and offset leave no gradient on the examples' own votes.
    z = np.array([votes[r.doc_id] for r in rows])
    logit = np.log([r.score / (1 - r.score) for r in rows])
    slope, offset = np.polyfit(z, logit, 1)
    assert np.allclose(slope * z + offset, logit, atol=1e-6)
    up, down = sum(y), n - sum(y)
    target = np.where(np.array(y) == 1, (up + 1) / (up + 2), 1 / (down + 2))
    miss = 1 / (1 + np.exp(-(slope * np.array(own) + offset))) - target
    assert abs(miss.sum()) < 1e-3 and abs((miss * own).sum()) < 1e-3


def examples(texts):
    return [(i, y, *toxicity.counted(t)) for i, (y, t) in enumerate(texts)]


def test_search_skips_blocks_that_can_only_tie():
    """Copies of one example fill many blocks: the first k of them are found, and few blocks are looked at."""
    v = (np.array([0, 1]), np.array([0.6, 0.8]))
    index = toxicity.BlockMaxIndex([v] * 1000, 2, 10)
    seen, add = [], index._add
    index._add = lambda score, blocks, *more: (seen.append(len(blocks)), add(score, blocks, *more))
    near, cosine = index.search(*v, 15)
    assert near.tolist() == list(range(15)) and np.allclose(cosine, 1) and sum(seen) == 2


def test_every_example_is_indexed_and_every_known_word_counts():
    m = toxicity.learn(examples([(1, "bad words here"), (0, "good words there"), (0, "plain"), (0, ""), (1, "bad thing"), (1, "so bad"), (0, "good day"), (0, "a good one")]))
    assert m.index.n == 8 and len(m.ids) == 8
    assert {int(m.ids[i]) for i in m.search("plain bad")[0]} == {0, 2, 4, 5}
    assert m.score("bad") > m.score("") > 0 and len({m.score(t) for t in ("bad", "good", "unheard", None)}) == 3


def test_repeated_documents_teach_once(spark, tmp_path):
    rows = [(1, "awful idiot", "en", "a", 11)] * 500 + [(1, "another text of one id", "en", "a", 22)] + [(i, f"fine words {i}", "en", "a", 12) for i in range(2, 40)]
    path = write_tables(spark, tmp_path, rows, [(i, 1, int(i == 1)) for i in range(1, 40)])
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    packed = toxicity.fit(docs, labels, labels.doc_id > 0)
    assert toxicity.scored(docs, packed).count() == len(rows)
    m = packed.model
    assert sorted(m.ids.tolist()) == list(range(1, 40)) and m.labels.sum() == 1


def test_very_long_and_empty_texts():
    m = toxicity.learn(examples([(1, "vile rubbish"), (0, "a kind word"), (0, "calm")]))
    long = "calm " * 200_000 + "vile rubbish " * 50_000
    assert m.score(long) == pytest.approx(m.explain(long)[0]) and len(m.search(long)[0]) == 2
    assert m.explain(None) == m.explain("") and m.explain("")[1] == []
    assert toxicity.learn([]).score("anything") == 0.5


def test_a_model_comes_through_bytes_as_it_was():
    m = toxicity.learn(examples([(i % 3 == 0, f"word{i % 7} more{i % 5} vile" if i % 3 == 0 else f"word{i % 7} calm{i % 4} " * (i % 6)) for i in range(60)]))
    again = toxicity.Packed(pickle.dumps(m)).model
    for text in ("word1 vile", "calm2 more3", "", "word6 " * 70_000):
        assert again.explain(text) == m.explain(text)


def test_an_opened_model_goes_with_its_task_and_reads_the_bytes_in_place():
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    m = toxicity.learn(examples([(i % 2, f"{word(i % 37)} x{word(i % 29)} " * (1 + i % 300)) for i in range(400)]))
    packed = pickle.loads(pickle.dumps(toxicity.Packed.of(m)))
    opened = packed.model
    assert all(opened.explain(t) == m.explain(t) for t in ("b xc", "bd " * 400, "", None)) and opened.explain("b")[1]
    parts = [np.frombuffer(x, np.uint8) for x in packed.parts]
    assert all(any(np.shares_memory(a, x) for x in parts) for a in (opened.counts, opened.first, opened.vocabulary.hashes, opened.index.doc))
    gone = weakref.ref(opened)
    del opened
    assert gone() is None
    empty = toxicity.Packed.of(toxicity.learn([])).model
    assert not len(empty.labels) and empty.score("anything") == 0.5


def test_opening_a_model_takes_little_more_than_the_model():
    rng = np.random.default_rng(5)
    draw = lambda: np.unique(rng.integers(0, 1 << 40, 600) % 60_000).astype(np.uint64) * np.uint64(1 << 40)
    packed = toxicity.Packed(pickle.dumps(toxicity.learn([(i, i % 2, h, np.ones(len(h), np.int64)) for i, h in ((i, draw()) for i in range(2000))])))
    tracemalloc.start()
    opened = packed.model
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(opened.counts) > 1_100_000 and peak - kept < 12e6


def test_counts_of_any_size_reach_the_learner():
    counts = [[1, 2], [1, 300], [70_000], [], [1, 1 << 33]]
    hashes = [np.arange(len(n), dtype=np.uint64) for n in counts]
    columns = [range(5), [0, 1, 0, 1, 0], [h.tobytes() for h in hashes], [toxicity.narrow(np.array(n, np.int64)).tobytes() for n in counts]]
    got = toxicity.gathered(iter([pa.RecordBatch.from_pydict(dict(zip("iyhn", columns, strict=True)))]))
    assert [x[:2] for x in got] == list(zip(*columns[:2], strict=True))
    assert [x[3].tolist() for x in got] == counts and [x[2].tolist() for x in got] == [h.tolist() for h in hashes]
    assert [len(n) for n in columns[3]] == [2, 4, 4, 0, 16]
