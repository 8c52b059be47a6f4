import json
import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from loomstat.llm import wavelet as W


@pytest.fixture(scope="module")
def encoder():
    return W.WordEncoder(W.TOKENIZER)


HARD = ["I'm don't we'LL 'S", "a..,b , . x , .", "ÀÉ Ünïcödé straße İstanbul ΑΣ", "café, é", "日本語、テスト。",
        "<|startoftext|> hi <|endoftext|>,", "\x1c\x85tab\tx y z", "A.B,C. A. B, a. b,", "", "   ", "\n\n",
        "ｆｕｌｌ Ｗｉｄｔｈ,", "x1y2 3.14,15 3.14,", "👍🏽 ok.", "ǅ ǆ Ǆ,", "x" * 1000 + " " + "Y" * 300 + ".",
        "The THE the. The, THE,", "́a ́ ,́"]


def same(encoder, texts):
    ids, sizes = encoder.encode([t.encode() for t in texts])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for k, t in enumerate(texts):
        assert ids[edge[k]:edge[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t[:60]


def test_encoder_equals_the_tokenizer(encoder, spark, sf):
    same(encoder, HARD)
    same(encoder, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    same(encoder, HARD)
    assert [len(x) for x in encoder.encode([])] == [0, 0]


def test_encoder_forgets_when_full(monkeypatch):
    monkeypatch.setattr(W.ChunkTable, "ENTRIES", 60)
    small = W.WordEncoder(W.TOKENIZER)
    small.PIECE = 7
    for _ in range(2):
        same(small, HARD)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50, 3000), rng.integers(0, 49408, 700), np.array([5]), np.zeros(0, np.int64),
                np.full(1025, 7), np.array([0, 1 << 20, 3, 1 << 20])):
        blob = W.pack(ids.astype(np.uint32), [3, None], np.array([len(ids), 0]))
        wm, docs, lengths = W.unpack(blob)
        assert (wm.decode() == ids).all() and docs == [3, None] and lengths.tolist() == [len(ids), 0]
        for at in range(0, len(ids), 97):
            assert wm.access(at) == ids[at]
        for token in {*ids[:5].tolist(), 1, 49407, -1, 1 << 30}:
            places = np.flatnonzero(ids == token).tolist()
            assert wm.occurrences(token) == places and wm.count(token) == len(places)
            assert wm.count(token, 10, 200) == sum(10 <= p < 200 for p in places)
            assert wm.select(token, len(places)) == -1


def expected(docs):
    from tokenizers import Tokenizer
    t, start, out = Tokenizer.from_file(W.TOKENIZER), 0, []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [W.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in W.op9_wavelet_shards(spark, sf).collect()) == expected(docs)


def test_small_shards_odd_rows_and_order(spark, odd_docs, no_docs, tmp_path):
    shards = W.write_shards(odd_docs.repartition(5), f"{tmp_path}/a", shard_ids=100)
    out = sorted((tuple(r) for r in W.read_shards(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert out == expected([(r[0], texts[r[0]]) for r in out])
    sizes = [r.n_tokens for r in shards.collect() if r.n_docs > 1]
    assert len(shards.collect()) > 3 and max(sizes) <= 100
    assert W.read_shards(W.write_shards(no_docs, f"{tmp_path}/b")).count() == 0


def test_other_tokenizers_go_through_the_library(spark, tmp_path):
    """A file with another normaliser or splitter is not taken for the one that chunks are right for."""
    other = W.TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    assert W.is_chunked(W.TOKENIZER) and not W.is_chunked(other)
    told = json.load(open(W.TOKENIZER))
    told["normalizer"]["normalizers"].pop()  # keeps capitals
    path = f"{tmp_path}/cased.json"
    json.dump(told, open(path, "w"))
    assert not W.is_chunked(path)
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for file in (other, path):
        plain = W.PlainEncoder(file).tokenizer
        out = {r.doc_id: r for r in W.read_shards(W.write_shards(df, f"{tmp_path}/s{len(file)}", tokenizer=file, end_id=2)).collect()}
        for i, t in enumerate(HARD):
            ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
            assert (out[i].n_tokens, out[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_chunks_that_share_a_hash(encoder, monkeypatch):
    monkeypatch.setattr(W.WordEncoder, "_hashes", lambda self, b, raw, start, length, real=W.WordEncoder._hashes: real(
        self, b, raw, start, length) & np.array([[7], [(1 << 64) - 1]], np.uint64))
    small = W.WordEncoder(W.TOKENIZER)
    texts = ["12 34 56 78 90 a1 b2 c3 d4 e5 f6 == ++ -- 1.5"]
    ids, _ = small.encode([t.encode() for t in texts])
    assert ids.tolist() == small.tokenizer.encode(texts[0], add_special_tokens=False).ids


PEAK = """
import numpy as np, psutil
from loomstat.llm import wavelet as W

encoder = W._encoder(W.TOKENIZER)
rng, letters = np.random.default_rng(2), np.array(list("abcdefghijklmnopqrstuvwxyz"))
words = ["".join(w) for w in letters[rng.integers(0, 26, (300_000, 9))]]
texts = [" ".join(words[i:i + 500]).encode() for i in range(0, len(words), 500)]
before, most, plain = psutil.Process().memory_info().rss, 0, encoder._ids
def watched(some):
    global most
    out = plain(some)
    most = max(most, psutil.Process().memory_info().rss - before)
    return out
encoder._ids = watched
encoder.encode(texts)
print(most >> 20)
"""


def test_new_words_are_encoded_in_little_memory():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": str(Path(W.__file__).parents[2])}
    took = subprocess.run([sys.executable, "-c", PEAK], env=env, capture_output=True, text=True, check=True, timeout=300)
    assert int(took.stdout) < 100  # MB above the loaded tokenizer
