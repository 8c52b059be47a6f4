import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomstat.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs=D.MIN_DOCS):
    """Rows of the audit term by term. docs: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), a or "", s or "") for t, a, s in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(t for terms, _, _ in mine for t in set(terms))
        kept = sorted(t for t in df if df[t] >= min_docs)
        groups = {s: Counter(t for terms, _, g in mine if g == s for t in terms if df[t] >= min_docs) for _, _, s in mine}
        groups[None] = Counter(t for terms, _, _ in mine for t in terms if df[t] >= min_docs)
        p = {g: [1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept] for g, c in groups.items()}
        for g in groups.keys() - {None}:
            pairs = [(sum(abs(x - y) for x, y in zip(p[g], p[h])), h) for h in groups.keys() - {None, g}]
            terms = [(x - q, t) for x, q, t in zip(p[g], p[None], kept) if groups[g][t] and x > q]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, g, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)}
    return out


def as_set(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df]
    assert len(rows) == len(set(rows))
    return set(rows)


def by_sql(path, sql=D.OP13_SQL):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return as_set(con.execute(sql).df().to_dict("records"))


def test_query_against_brute_force(spark, sf):
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = as_set(D.op13_source_divergence(spark, sf).collect())
    assert out == brute(docs) and {r[2] for r in out} == {"pair", "term"}


@pytest.mark.parametrize("groups", [1, 3, 64])
def test_blocks_of_every_size(spark, sf, monkeypatch, groups):
    """Blocks of terms and groups, cuts by columns and flushes: the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()])
    for name, value in (("BLOCK_TERMS", 40), ("BLOCK_GROUPS", groups), ("MAX_COLUMNS", 30), ("HELD_TERMS", 50), ("PIECE", 7)):
        monkeypatch.setattr(D, name, value)
    assert as_set(D.audit(docs).collect()) == want


@pytest.mark.parametrize("split", [0, 3])
def test_products_against_plain_sums(monkeypatch, split):
    rng = np.random.default_rng(6)
    counts = rng.zipf(1.4, (200, 8)).clip(0, 10**6) - 1
    sizes = counts.sum(0)
    p = (10**9 * (counts + 5)) // (sizes + 5 * 200) + 1
    want = np.abs(p[:, :, None] - p[:, None, :]).sum(0)
    want = want[:split, split:] if split else want
    for most in (10, 100, 100_000):
        monkeypatch.setattr(D, "MAX_COLUMNS", most)
        got = D.level_products(counts, split, lambda g, levels: 1 + 10**9 * (levels + 5) // (sizes[g] + 5 * 200))
        assert (got == want).all()


def test_odd_rows(spark, prose, odd_docs, no_docs, folder):
    rows = [("Ab ab É漢 x1y", "en", "a")] * 35 + [("ab zz Zz", "en", "b")] * 40 + [("É漢 \x00 q", "en", None)] * 31
    rows += [(None, "en", "empty"), ("", None, "a"), ("word", "", "b"), ("word", None, None), ("solo " * 40, "xx", "one")]
    rows += [("tie1 tie2", "yy", "s"), ("tie2 tie1", "yy", "t")] * 30 + [(prose(30000, 2), "en", "a")]
    docs = spark.createDataFrame([(None, *r, 7, "v", "n") for r in rows],
                                 "doc_id long, text string, lang string, source string, size int, item string, term string")
    out = as_set(D.audit(docs.repartition(3)).collect())
    assert out == brute(rows)
    assert {r for r in out if r[0] == ""} == {("", g, "pair", h, 0, i) for g in ("", "a", "b")
                                              for i, h in enumerate(sorted({"", "a", "b"} - {g}), 1)}
    assert ("en", "empty", "pair", "b") in {r[:4] for r in out} and not {r for r in out if r[0] == "xx"}
    assert by_sql(folder(documents=docs)) == out
    assert D.audit(no_docs).count() == 0
    assert as_set(D.audit(odd_docs).collect()) == set()


def test_counts_beyond_64_bits_of_product(spark):
    """Prices of counts whose product with the unit needs more than 64 bits."""
    big = 4 * 10**12
    cells = spark.createDataFrame([("en", s, t, n, 2 * big + 1) for s, t, n in (
        ("a", "x", big), ("b", "x", big + 1), ("a", "y", 1), ("b", "y", 2 * big))],
        "lang string, source string, term string, n long, total long")
    sizes = {"a": big + 1, "b": 3 * big + 1}
    groups = spark.createDataFrame([("en", s, n, 4 * big + 2, 2, 2) for s, n in sizes.items()],
                                   "lang string, source string, size long, lang_size long, v long, groups long")

    def p(n, s):
        return 1 + 10**9 * (n + 5) // (sizes[s] + 10)

    want = abs(p(big, "a") - p(big + 1, "b")) + abs(p(1, "a") - p(2 * big, "b"))
    assert {(r.source, r.item, r.value) for r in D.pair_distances(cells, groups).collect()} == {("a", "b", want), ("b", "a", want)}
    got = cells.join(groups, ["lang", "source"]).selectExpr("source", "n", f"{D._probability('n', 'size')} AS p").collect()
    assert all(r.p == p(r.n, r.source) for r in got)
