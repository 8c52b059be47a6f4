import re
from collections import Counter

from loomstat.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri, covered = Counter(zip(w, w[1:], w[2:])), [0] * len(w)
    for k in range(len(w) - 2):
        if tri[tuple(w[k:k + 3])] > 1:
            covered[k:k + 3] = [1, 1, 1]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(covered),
            len(w) < 50 or 100 * sum(covered) > 50 * len(w))


def test_base_counts_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = Q.op6_quality_rules(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(
            texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    out = Q.judge(odd_docs, labels).collect()
    assert len(out) == 12
    for r in out:
        assert brute(texts[r.doc_id])[:5] == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    kept = Q.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in out)
    assert Q.judge(no_docs, labels).count() == 0
    none = Q.judge(odd_docs, labels.limit(0)).collect()
    assert all(r.score == 0.0 and r.kept != r.base_failed for r in none)


def test_junk_is_rejected_and_prose_kept(spark, prose):
    good = [(i, prose(150, i)) for i in range(120)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!!$$" for w in prose(150, i).split())) for i in range(40)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(10)],
                                   "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in Q.judge(docs, labels).collect()}
    assert all(out[i] for i in range(120)) and not any(out[1000 + i] for i in range(40))


def test_every_trusted_id_counts(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert Q.trusted_ids(labels.unionByName(labels)).count() == 30_000


def test_trusted_ids_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('some words of text number ', id % 7, repeat(' more of it', id % 5)) AS text")
    labels = spark.range(0, 300, 2).selectExpr("id AS doc_id", "int(id % 4 == 0) AS quality", "0 AS toxic")
    one, low = Q.fit(docs, labels)
    monkeypatch.setattr(Q, "BROADCAST_IDS", 0)
    two, low2 = Q.fit(docs, labels)
    assert (one == two).all() and one.any() and abs(low - low2) < 1e-12
