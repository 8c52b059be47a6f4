import math
import re
import zlib

import numpy as np

from loomstat.llm import additive as A

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_features(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    if not words:
        return [0.0] * len(A.FEATURES)
    n, seen = len(words), [c for c in t if c not in BLANK]
    raw = t.encode()
    lines = [x for x in t.split("\n") if x.strip(BLANK)]
    size = [len(w.encode()) for w in words]

    def share(chars):
        return sum(c in chars for c in seen) / len(seen)

    triples = set(zip(words, words[1:], words[2:]))
    shown = [b for b in raw if chr(b) not in BLANK]
    return [math.log1p(n), len(seen) / n, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!\"#$%&()*+/<=>@[\\]^_`{|}~"),
            share("0123456789"), share(".,;:?"), len(set(words)) / n, len(triples) / max(1, n - 2),
            1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), math.log1p(max(size)),
            sum(x < 4 for x in size) / n, sum(w.encode().istitle() for w in words) / n,
            max(shown.count(b) for b in set(shown)) / len(shown), float(len(set(raw)))]


def test_query_on_held_out_rows(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = A.op11_quality_classifier(spark, sf).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([labels[r.doc_id] == r.predicted for r in held]) >= 0.98
    good = [r.score for r in held if labels[r.doc_id]]
    bad = [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_features_against_plain_counts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in [*texts, "É à ü 漢字 𝒳", "a", "", "\n\t ", "x\n\nx\n y z x y z x y z"]:
        assert np.allclose(A.features(t.encode()), plain_features(t))


def test_cuts_against_every_cut():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=9), rng.uniform(2.1, 4, 9)

    def value(*parts):
        return sum(g[p].sum() ** 2 / (h[p].sum() + A.RIDGE) for p in parts)

    cuts = {k: value(slice(0, k), slice(k, 9)) for k in range(1, 9)}
    best = max(cuts, key=cuts.get)
    gain, cut = A._best_cut(g, h)
    assert cut == best and math.isclose(gain, cuts[best] - value(slice(0, 9)))
    steps = A.shallow_tree(g, h)
    assert len(set(steps.tolist())) <= 4
    for v in set(steps.tolist()):
        leaf = steps == v
        assert math.isclose(v, g[leaf].sum() / (h[leaf].sum() + A.RIDGE))
    g2, h2 = rng.normal(size=(4, 5)), rng.uniform(0.1, 2, (4, 5))
    every = {}
    for i in range(1, 4):
        for j in range(1, 5):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
            every[i, j] = sum(g2[p].sum() ** 2 / (h2[p].sum() + A.RIDGE) for p in parts)
    i, j = max(every, key=every.get)
    gain, steps = A.cross_cut(g2, h2)
    assert math.isclose(gain, every[i, j] - g2.sum() ** 2 / (h2.sum() + A.RIDGE))
    assert math.isclose(steps[0, 0], g2[:i, :j].sum() / (h2[:i, :j].sum() + A.RIDGE))
    assert math.isclose(steps[3, 4], g2[i:, j:].sum() / (h2[i:, j:].sum() + A.RIDGE))


def test_interactions_are_found():
    """An exclusive-or of two features: no additive model separates it, one pair table does."""
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = A.fit(x, y)
    assert (model.pairs[0][0], model.pairs[0][1]) == (3, 1)
    fresh = rng.uniform(size=(500, 4))
    assert (((model.score(fresh) > 0.5) == ((fresh[:, 1] > 0.5) ^ (fresh[:, 3] > 0.5))).mean()) > 0.95


def test_score_is_the_sum_of_looked_up_bins():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    model = A.fit(x, (x[:, 0] + rng.normal(size=300) > 0).astype(float))
    assert model.score(x).std() > 0.1
    for row, s in zip(x[:20], model.score(x)):
        bins = [sum(e < v for e in edges) for edges, v in zip(model.edges, row)]
        m = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i], bins[j]] for i, j, t in model.pairs)
        assert math.isclose(s, 1 / (1 + math.exp(-m)))
    same = A.fit(np.ones((40, 3)), np.arange(40) % 2.0)
    assert np.allclose(same.score(np.ones((1, 3))), 0.5)


def test_odd_rows(spark, odd_docs, no_docs, prose):
    rows = [(1, 1), (2, 1), (3, 0), (4, 0), (9, 0), (7, None), (8, 7), (None, 1), (2, 1)]
    labels = spark.createDataFrame([(i, q, "x") for i, q in rows], "doc_id long, quality int, _label string")
    clash = odd_docs.withColumnsRenamed({"path": "_doc", "n": "_text", "cls": "score"})
    for docs in (odd_docs, clash):
        out = A.classify(docs, A.learn(docs, labels)).collect()
        assert len(out) == 12 and all(0 <= r.score <= 1 for r in out)
        assert not next(r for r in out if r.doc_id is None).held_out
        assert len({r.score for r in out if r.doc_id in (3, 4)}) == 1
        assert len({r.score for r in out if r.doc_id == 2}) == 1
    assert A.classify(no_docs, A.learn(no_docs, labels)).count() == 0
    assert {r.score for r in A.classify(odd_docs, A.learn(odd_docs, labels.limit(0))).collect()} == {0.5}
    only = spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int")
    assert len({r.score for r in A.classify(odd_docs, A.learn(odd_docs, only)).collect()}) == 1
    assert A.labelled_sample(labels.filter("doc_id = 1").union(labels.filter("doc_id = 1").selectExpr(
        "doc_id", "0", "_label"))).first()["_label"] == 0
    two = A.labelled_sample(spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int"), 5)
    assert two.count() == 5
