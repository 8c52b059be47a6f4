import random
from collections import Counter

import numpy as np
import pytest

from loomstat.llm import decontam as D


@pytest.fixture(scope="module")
def corpus(spark, prose):
    """Clean documents, and leaks: whole items, items with some words changed, in short and long documents."""
    rng = random.Random(2)
    items = [(q, prose(rng.randint(12, 50), 9000 + q) + ".") for q in range(30)]
    rows, truth = [], set()
    for i in range(300):
        text = prose(rng.choice([20, 100, 400]), i)
        if i % 5 == 0:
            q = rng.randrange(30)
            words = items[q][1].split()
            if i % 10 == 0:
                for k in range(0, len(words), 8):
                    words[k] = f"other{k}"
            at = rng.randrange(len(text.split()))
            text = " ".join(text.split()[:at] + [w.upper() if i % 3 else w for w in words] + text.split()[at:])
            truth.add((i, q))
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, "one"), (None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, terms string")
    return docs.repartition(3), spark.createDataFrame(items, "item_id long, text string"), truth


def test_leaks_are_found_and_clean_rows_left(corpus):
    docs, items, truth = corpus
    out = D.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in out if r.doc_id is not None} == truth
    assert sum(r.doc_id == 0 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    clean = D.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in truth} - {None}


def test_blocks_of_items_give_the_same(corpus, monkeypatch):
    docs, items, truth = corpus
    monkeypatch.setattr(D, "MAX_ITEMS", 12)
    out = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect() if r.doc_id is not None}
    assert out == truth
    clean = D.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in truth} - {None}


def test_given_table(spark, sf):
    """Every item that stands word for word in a document is found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    joined = {r.doc_id: b" " + b" ".join(D.words_of(r.text.encode())) + b" " for r in docs}
    truth = {(d, r.item_id) for d, t in joined.items() for r in items
             if b" " + b" ".join(D.words_of(r.text.encode())) + b" " in t}
    assert truth <= {(r.doc_id, r.item_id) for r in D.op3_decontaminate(spark, sf).collect()}


def test_subspace_against_a_full_svd(spark):
    rng = np.random.default_rng(4)
    rows = [sorted(rng.choice(40, rng.integers(2, 9), replace=False).tolist()) for _ in range(300)]
    weight = rng.uniform(1, 3, 40)
    a = np.zeros((300, 40))
    for i, r in enumerate(rows):
        a[i, r] = weight[r]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    df = spark.createDataFrame([(r,) for r in rows], "terms array<int>").repartition(4)
    basis = D.latent_basis(df, weight, rank=40)
    assert np.allclose(basis.T @ basis, np.eye(40), atol=1e-8)
    top = np.linalg.svd(a, full_matrices=False)[1]
    got = np.linalg.norm(a @ basis, axis=0)
    assert np.allclose(np.sort(got)[::-1], top, rtol=1e-6)


def test_common_subsequence_against_a_table():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([bytes([rng.randrange(4)]) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.common_subsequence(D._masks(a), len(a), b) == t[-1][-1]


def test_empty_tables(spark, odd_docs, no_docs, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, prose(20, 77)), (2, None), (3, "too short to stand there"), (4, "")], "item_id long, text string")
    assert D.find_leaks(odd_docs, none).count() == 0 and D.keep_clean(odd_docs, none).count() == 12
    assert D.find_leaks(no_docs, some).count() == 0 and D.find_leaks(odd_docs, some).count() == 0


def brute(text, item, answer=None):
    """Whether some stretch of the text leaks the item: every start, no candidates."""
    words, own = D.words_of(text.encode()), D.words_of(item.encode())
    size, span = len(own), len(own) + max(3, len(own) // 4)
    if size < D.TINY:
        return words == own
    tail = D.words_of(answer.encode()) if answer else own[-D.ANSWER_WORDS:] if size >= D.OWN_ANSWER else []
    for at in range(len(words)):
        if size < D.WHOLE and not tail:
            if words[at:at + size] == own:
                return True
            continue
        stretch = words[at:at + span]
        found = D.common_subsequence(D._masks(own), size, stretch)
        if found >= (D.VERBATIM * size if size >= D.WHOLE else size):
            return True
        with_answer = found >= (D.PARAPHRASE if size >= D.WHOLE else D.VERBATIM) * size
        if with_answer and tail and D.common_subsequence(D._masks(tail), len(tail), stretch) >= D.ANSWER * len(tail):
            return True
    return False


def test_short_items(spark):
    """Clean documents beside short items stay; whole ones are found, also below five words; a real answer counts."""
    items = [(1, "what is the capital of france", None), (2, "what is the speed of light", None), (3, "name it", None),
             (4, "who wrote the old book", "jane roe"), (5, "the quick brown fox jumps over one lazy dog", None), (6, "word", None), (7, "Word.", None)]
    texts = ["we went to the capital of france last year", "so what is the capital of france then", "what is the capital of spain",
             "Name it!", "you may name it", "who wrote the book, it was jane roe", "who wrote the old book is not known",
             "who wrote the new book", "a quick brown fox jumps over the lazy dog", "the quick brown cat runs over one lazy dog",
             "fox jumps over one lazy dog", "word", "word by word", "what is the speed of sound", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    want = {(i, q) for i, t in enumerate(texts) for q, x, a in items if brute(t, x, a)}
    assert got == want
    assert {(1, 1), (3, 3), (5, 4), (6, 4), (8, 5), (11, 6)} <= got and not {d for d, _ in got} & {0, 2, 4, 7, 12, 13, 14}
    assert {r.doc_id for r in D.keep_clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in got}


def test_clashing_columns(spark, prose):
    names = ["_own", "_key", "item_id", "terms", "n", "cosine", "block", "data", "digest"]
    item = prose(20, 5)
    docs = spark.createDataFrame([(1, item, *["x"] * len(names)), (2, prose(30, 6), *["y"] * len(names))],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for copies in (1, 3):
        bench = spark.createDataFrame([(q, item, 1, "z") for q in range(copies)], "item_id long, text string, digest int, _key string")
        kept = D.keep_clean(docs, bench)
        assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
        assert D.find_leaks(docs, bench).count() == copies


def test_edited_items_against_brute_force(spark, prose):
    """Items whose rarest words were replaced in place, by prose words, at several shares: as every stretch checked."""
    rng = random.Random(8)
    items = [(q, prose(rng.randint(15, 45), 7000 + q)) for q in range(40)]
    texts = [prose(rng.choice([30, 150]), 100 + i) for i in range(160)]
    seen = Counter(w for t in texts for w in t.split())
    truth, rows = set(), []
    for i, text in enumerate(texts):
        q, share = i % 40, (1.0, 0.85, 0.78, 0.6)[i // 40]
        words = items[q][1].split()
        free = range(len(words) - 5 if share == 0.6 else len(words))
        for k in sorted(free, key=lambda k: seen[words[k]])[:int((1 - share) * len(words))]:
            words[k] = prose(1, 20000 + 50 * i + k)
        at = rng.randrange(len(text.split()))
        rows.append((i, " ".join(text.split()[:at] + words + text.split()[at:])))
        truth |= {(i, p) for p, t in items if brute(rows[-1][1], t)}
    assert len(truth) >= 150
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == truth
