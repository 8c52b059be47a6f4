import random
import re
from collections import Counter, defaultdict

import numpy as np

from loomstat.llm import neardup as N
from loomstat.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, size=4):
    """(set size, component) of each id, over all pairs that share a shingle."""
    sets, where = {}, defaultdict(list)
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
        for s in sets[i]:
            where[s].append(i)
    common = Counter((a, b) for ids in where.values() for x, a in enumerate(ids) for b in ids[x + 1:])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, texts, size=4):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in N.link(df, size=size).collect()}
    assert out.keys() == texts.keys()
    for i, (n, c) in brute(texts, size).items():
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (n, c, c == i), i


def test_given_table(spark, sf):
    check(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_groups_chains_and_common_passages(spark, prose, monkeypatch):
    """Copies, near copies, chains of edits, texts that share a passage; small nodes, so that branching is used."""
    monkeypatch.setattr(N, "SMALL", 6)
    rng, texts, k = random.Random(3), {}, 0
    for g in range(6):
        words = prose(90, 100 + g).split()
        for _ in range(30):
            if g % 2:  # a chain: each edits the one before
                words = list(words)
                source = words
            else:
                source = prose(90, 100 + g).split()
            for _ in range(rng.choice([0, 1, 2, 3])):
                source[rng.randrange(90)] = f"edit{rng.randrange(10**6)}"
            texts[k] = " ".join(source)
            k += 1
    passage = prose(60, 9)
    for j in range(60):
        texts[k] = prose(40, 500 + j) + " " + passage
        k += 1
    for t in ("a b c", "A  b\nc", "a b c d", "one", "", None, "  "):
        texts[k] = t
        k += 1
    check(spark, texts)


def test_odd_rows(spark, odd_docs, no_docs):
    out = N.link(odd_docs).collect()
    assert len(out) == 12
    by = {r.doc_id: r for r in out}
    assert by[6].component_id == 1 and not by[6].kept and by[1].kept
    assert by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (3, 4, 5, 10))
    kept = N.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert N.link(no_docs).count() == 0 and N.keep_first(no_docs).count() == 0


def test_rows_that_share_an_id_are_one_node(spark, prose):
    df = spark.createDataFrame([(5, prose(50, 1)), (5, prose(50, 2)), (7, prose(50, 1)), (8, prose(50, 2)),
                                (9, prose(50, 3))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.link(df).collect()) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_recall_of_one_tree_at_the_threshold():
    rng, hit = np.random.default_rng(0), 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 10, np.uint64)]) for _ in range(2))
        with np.errstate(over="ignore"):
            hit += bool(set(N.walk(a, N._ROOTS[0], N.START_DEPTH)) & set(N.walk(b, N._ROOTS[0], N.START_DEPTH)))
    assert hit / 400 > 0.9


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_five_words(spark, prose):
    """The stage's size: pairs between the two thresholds are linked by one size and not by the other."""
    texts = {}
    for g in range(40):
        words = prose(120, 40 + g).split()
        texts[2 * g] = " ".join(words)
        for k in range(6, 120, 120 // (2 + g % 3)):
            words[k] = f"edit{g}x{k}"
        texts[2 * g + 1] = " ".join(words)
    check(spark, texts, 5)
    assert brute(texts, 5) != brute(texts, 4) and N.SHINGLE == 5


def test_pairs_whose_smallest_common_leaf_is_large(spark, prose, monkeypatch):
    """A passage that all texts share makes large leaves beside small ones; pairs at the threshold lose no link."""
    monkeypatch.setattr(N, "SMALL", 8)
    rng, texts = random.Random(11), {}
    passage = prose(45, 1)
    for g in range(60):
        words = (prose(45, 3000 + g) + " " + passage).split()
        texts[3 * g] = " ".join(words)
        for j in (1, 2):
            other = list(words)
            for k in rng.sample(range(45), 2):
                other[k] = f"new{g}x{j}x{k}"
            texts[3 * g + j] = " ".join(other)
    want = brute(texts)
    assert sum(c != i for i, (_, c) in want.items()) >= 60
    check(spark, texts)


def test_clashing_columns_and_repeated_ids(spark, prose):
    names = ["_kept", "_place", "cls", "rep", "n", "node", "component", "path", "paths", "size", "tokens", "a", "b"]
    rows = [(3, prose(40, 1), *["z"] * len(names)), (3, prose(40, 1), *["a"] * len(names)), (4, prose(40, 1), *["b"] * len(names)),
            (None, None, *["c"] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = N.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r["_kept"]) for r in kept.collect()) == [(0, "c"), (3, "a")]
    assert N.link(df).count() == 4
