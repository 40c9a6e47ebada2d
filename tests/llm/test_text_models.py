"""Classifiers on held-out rows, the block-max index and the tokenizers against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from indexframe.llm import bytebpe, chat, oracle_sql, quality, queries, tokenfile, toxicity

from .conftest import write_tables

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def auc(scores, labels):
    up, down = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries()["op4_quality"](spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.97


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries()["op1_toxicity"](spark, MIDDLE).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert all(e.cosine > 0 for e in r.evidence)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right / len(held) > 0.9


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        at = np.unique(rng.integers(0, 60, rng.integers(1, 12)))
        w = rng.random(len(at))
        vectors.append((at, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 60, 16)
    dense = np.zeros((500, 60))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for i in range(0, 500, 7):
        near, cosine = index.search(*vectors[i], 10, but=i)
        score = dense @ dense[i]
        score[i] = 0
        want = [j for j in np.lexsort((np.arange(500), -score)) if score[j] > 0][:10]
        assert np.allclose(cosine, score[want]) and set(near[cosine > cosine[-1] + 1e-9]) <= set(want)


def test_dual_descent_meets_its_optimum():
    """At the optimum no dual variable can be bettered, and the weights are their sum."""
    rng = np.random.default_rng(3)
    rows = [np.unique(np.append(rng.integers(1, 50, 8), 0)).astype(np.int32) for _ in range(80)]
    y = np.where([(x < 20).sum() > 3 for x in rows], 1, -1)
    r = quality.log_count_ratio(rows, y)
    p = quality.Params(epochs=400)
    w = quality.fit_hinge(rows, y, r, p)
    v = [r[x] / np.linalg.norm(r[x]) for x in rows]
    share = {c: (y == c).sum() for c in (1, -1)}
    cost = np.array([p.cost * len(y) / (2 * share[c]) for c in y])
    primal = 0.5 * w @ w + sum(c * max(0, 1 - k * (w[x] @ z)) for x, z, k, c in zip(rows, v, y, cost, strict=True))
    for _ in range(30):
        other = w + rng.normal(0, 0.05, len(w)) * (w != 0)
        assert primal <= 0.5 * other @ other + sum(c * max(0, 1 - k * (other[x] @ z)) for x, z, k, c in zip(rows, v, y, cost, strict=True)) + 1e-2


PIECES = [*" \n\t'abst1é!\x00\x01\x1c\x85\xa0 　́ßİ你TΣ.,", "  ", "'s", "'ll", "\r\n", " \n", "<|endoftext|>", "<|STARTOFTEXT|>", "%%%"]
LONG = [(9000, None), (9001, ""), (9002, "a" * 3000), (9003, "ab!" * 2000 + " x"), (9004, " " * 500), (9005, "the " * 3000 + "end\n"), (9006, "\n lead"), (9007, "x \n")]


def odd_texts(seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices(PIECES, k=rng.randint(0, 12)))) for i in range(1500)] + LONG


def check_byte_bpe(rows, texts):
    encoding = tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=bytebpe.load_ranks(bytebpe.VOCABULARY), special_tokens={})
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), text


def test_byte_bpe_of_odd_texts(spark):
    texts = odd_texts(1)
    rows = bytebpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), p=bytebpe.Params(block=3000, fold=64)).collect()
    check_byte_bpe(rows, dict(texts))


def test_byte_bpe_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_byte_bpe(queries()["op10_bpe"](spark, SMALL).collect(), texts)


def test_long_words_merge_alike():
    ranks = bytebpe.load_ranks(bytebpe.VOCABULARY)
    encoding = tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("a" * 999, "abcde" * 77, " " + "éa" * 50, "mississippi" * 9):
        assert bytebpe.merge_long(word.encode(), ranks) == encoding.encode_ordinary(word)


def check_token_file(rows, texts):
    tokenizer = Tokenizer.from_file(tokenfile.TOKENIZER)
    got, start = {r.doc_id: r for r in rows}, 0
    assert len(got) == len(texts)
    for doc_id in sorted(texts):
        ids = tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[doc_id]
        start += len(ids)


def test_token_file_of_odd_texts(spark):
    texts = odd_texts(2)
    files = tokenfile.write_files(spark.createDataFrame(texts, "doc_id long, text string"), p=tokenfile.Params(block=500, cache=10))
    check_token_file(tokenfile.read_files(*files).collect(), dict(texts))


def test_token_file_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_token_file(queries()["op6_token_file"](spark, SMALL).collect(), texts)


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 40_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint16)
    coder = tokenfile.Coder(tokenfile.scaled(np.bincount(ids, minlength=1000)))
    p = tokenfile.Params(lanes=64, every=8)
    block = coder.encode([7, None], [n - 1, 1], ids, p)
    keys, sizes, back = coder.decode(block)
    assert keys == [7, None] and sizes.tolist() == [n - 1, 1] and (back == ids).all()
    marks = np.frombuffer(block, "<u4", 6, 4)[4]
    parts = [coder.decode(block, k, k + 1 if k + 1 < marks else None)[2] for k in range(marks)]
    assert (np.concatenate(parts) == ids).all()
    if n > 1000:
        assert len(block) < 2.2 * n
        bad = bytearray(block)
        bad[-3] ^= 1
        with pytest.raises((ValueError, IndexError)):
            coder.decode(bytes(bad))


def test_frequencies_keep_rare_ids():
    counts = np.array([10**12, 1, 0, 1, 5])
    f = tokenfile.scaled(counts)
    assert f.sum() == 1 << tokenfile.SCALE_BITS and f[2] == 0 and (f[[1, 3, 4]] >= 1).all()
    many = np.ones(49_000, np.int64)
    many[0] = 10**9
    assert tokenfile.scaled(many).sum() == 1 << tokenfile.SCALE_BITS and tokenfile.scaled(many).min() == 1


# --- chat -------------------------------------------------------------------------------------


def test_templates_escape_reversibly():
    rng = random.Random(1)
    pieces = ["\\", "</s>", "<", "/s>", "[INST]", "a", "|", "<|turn|>", "<|end|>", "\n", "n", "turn|>"]
    for _ in range(3000):
        turns = [("".join(rng.choices(pieces, k=rng.randint(0, 4))), "".join(rng.choices(pieces, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 3))]
        text, _ = chat.render(turns)
        assert chat.parse(text) == turns
        assert text.count(chat.OPEN) == len(turns) and "</s>" not in text and "[INST]" not in text


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ('{"prompt": "q", "completion": "a"}', [("user", "q"), ("assistant", "a")]),
        ('{"output": "a", "instruction": "q"}', [("user", "q"), ("assistant", "a")]),
        ('{"instruction": "q", "input": "more", "output": "a"}', [("user", "q\n\nmore"), ("assistant", "a")]),
        ('{"messages": [{"role": "system", "content": "s"}, {"content": null, "role": "user"}]}', [("system", "s"), ("user", "")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', [("user", "q"), ("assistant", "a")]),
        ('{"data": {"user": "q", "assistant": "a"}}', [("user", "q"), ("assistant", "a")]),
        ('{"messages": []}', []),
        ('{"unknown": 1}', None),
        ("not json", None),
        (None, None),
    ],
)
def test_layouts(spark, record, turns):
    row = chat.format_records(spark.createDataFrame([(1, record)], "id long, record string"), "record").head()
    assert (row.formatted is None) == (turns is None)
    if turns is not None:
        assert chat.parse(row.formatted) == turns


def test_chat_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    said = "</s>[INST] ok [/INST]"
    want[-1] = [("user", said), ("assistant", said)]
    got = {r.conv_id: r for r in queries()["op8_chat"](spark, SMALL).collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[i].n_turns, got[i].loss_chars, got[i].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len({r.layout for r in got.values()}) > 1


def test_rare_toxic_word_counts_in_a_full_sample(spark):
    """A word that 8 of 5000 examples hold, all toxic, is a term; 0.2 % of the examples would be 10."""
    rows = [(i, 1 if i < 500 else 0, "rareword text" if i < 8 else "insult text" if i < 500 else "plain text") for i in range(5000)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, labels.doc_id >= 0).model
    assert len(m.search("a rareword here")[0]) and m.score("a rareword here") > 0.5 > m.score("a plain text")


def test_sample_is_drawn_among_the_documents_at_hand(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 200, 2)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(200)] + [(None, 1)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "quality", labels.doc_id >= 0, 60, 1).collect()
    assert len({r.doc_id for r in got}) == len(got) == 60 and all(r.text == f"text {r.doc_id}" and r.y == r.doc_id % 4 // 2 for r in got)


def test_conversation_of_the_added_number_stays_apart(spark, tmp_path):
    path = write_tables(spark, tmp_path, [], conversations=[(-1, 0, "user", "own"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", "x" * 400_000)])
    rows = queries()["op8_chat"](spark, path).collect()
    assert sorted((r.conv_id if r.conv_id is not None else 0, r.n_turns, r.loss_chars) for r in rows) == [(-1, 1, 0), (-1, 2, 21), (0, 2, 1), (3, 1, 0)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    found = con.sql(oracle_sql()["op8_chat"])
    names = found.columns
    assert sorted((tuple(r[c] for c in names) for r in rows), key=repr) == sorted(found.fetchall(), key=repr)
