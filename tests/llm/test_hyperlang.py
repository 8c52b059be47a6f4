import zlib

import numpy as np

from loomstat.llm import hyperlang as H


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = H.op10_language_id(spark, sf).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_cosines_against_plain_vectors():
    """Document vectors by the definition, n-gram by n-gram."""
    space = H.Space()
    text = "Ab, été!  x"
    symbols = [0]
    for c in text.lower() + " ":
        s = ord(c) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    want = np.zeros(H.DIM)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        want += np.roll(space.letters[a], 2).astype(int) * np.roll(space.letters[b], 1) * space.letters[c]
    _, code, n = H._counted(*space.grams([text]))
    assert (space.bundle(code, n) == want).all()


def test_odd_rows(spark, odd_docs, no_docs, prose):
    model = H.learn(odd_docs)
    out = {r.doc_id: r for r in H.predict(odd_docs, model).collect()}
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (3, 4, 5, 10))
    assert out[1].lang_pred == out[8].lang_pred == out[9].lang_pred == "en"
    assert H.predict(odd_docs, model).count() == 12 and not out[None].held_out
    assert H.predict(no_docs, model).count() == 0
    assert H.learn(no_docs)[0] == []
    assert all(r.lang_pred == "und" for r in H.predict(odd_docs, H.learn(no_docs)).collect())
    twins = spark.createDataFrame([(1, prose(50, 1), "b"), (2, prose(50, 1), "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in H.predict(twins, H.learn(twins)).collect()} == {"a"}


def test_vectors_are_forgotten_when_full(monkeypatch):
    full = H.Space()
    _, code, n = H._counted(*full.grams(["the quick brown fox jumps over the lazy dog"]))
    want = full.bundle(code, n)
    monkeypatch.setattr(H.Space, "ROWS", 10)
    small = H.Space()
    small.bundle(code[:8], n[:8])
    assert (small.bundle(code, n) == want).all()
