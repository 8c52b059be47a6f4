import re
from itertools import permutations

import duckdb
import numpy as np

from loomstat.llm import survival as S


def brute(docs, labels):
    """Rows of the audit by applying every order to every document. docs: (doc_id, text, part)."""
    fails = []
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "D": bool(re.search(r"[#$%&*|]", t)),
             "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        said = [x for x in labels if x[0] == i and i is not None]
        fails.append((p or "", f, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {x[0] for x in fails}:
        rows, shapley = [x for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone, left = [x for x in left if x[1][name]], [x for x in left if not x[1][name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x[1][name] for x in rows) - len(gone),
                    sum(x[1][name] and sum(x[1].values()) == 1 for x in rows), sum(x[2] for x in gone),
                    sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def as_dict(rows):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    out = S.op12_filter_audit(spark, sf).collect()
    assert len(out) == 600 * len({d[2] for d in docs})
    assert as_dict(out) == brute(docs, labels)


def test_positional_counts_against_plain_sums():
    rng = np.random.default_rng(4)
    for sizes in ((0,), (1,), (2, 1), (3, 3, 3), (1000, 1, 0, 4097), (5,) * 50):
        parts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in sizes]
        count = S.PositionalCount()
        for p in parts:
            count.add(p)
        words = np.concatenate(parts)
        assert count.counts().tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]
        assert all(len(h) <= 2 for h in count.held)


def test_words():
    for failed in range(32):
        assert [int(S.WORDS[failed]) >> s & 1 for s in range(32)] == [int(s & failed == 0) for s in range(32)]


def odd_rows(prose):
    many = " ".join(f"w{i}" for i in range(120))
    return [(5, many, "en"), (3, many, "en"), (3, many, None), (9, many, ""), (None, many, "en"), (4, None, "en"), (2, "", "en"),
            (1, many.upper(), "de"), (6, many + " #", "de"), (7, "É " * 130, "de"), (8, prose(30000, 1), "de"),
            (10, "a " * 200, "de"), (11, None, None), (12, "   \n", "x")]


ODD_LABELS = [(5, 1, 0), (5, 0, 1), (3, 1, 1), (None, 1, 1), (4, 1, None), (7, 0, 1), (99, 1, 1), (6, 1, 1)]


def test_odd_rows(spark, prose, no_docs, folder, monkeypatch):
    monkeypatch.setattr(S, "HELD_PARTS", 1)
    rows = odd_rows(prose)
    docs = spark.createDataFrame(
        [(*r, 1, b"x", "t") for r in rows],
        "doc_id long, text string, lang string, failed int, digest binary, _first string").repartition(3)
    labels = spark.createDataFrame([(*r, 0) for r in ODD_LABELS], "doc_id long, quality int, toxic int, part int")
    want = brute(rows, ODD_LABELS)
    assert as_dict(S.audit(docs, labels).collect()) == want
    path = folder(documents=docs, labels=labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    assert as_dict(con.execute(S.OP12_SQL).df().to_dict("records")) == want
    assert S.audit(no_docs, labels).count() == 0
    zero = S.audit(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "max"}).first()
    assert tuple(zero) == (0, 0)


def test_many_copies_of_one_text(spark):
    """A third of the rows share one text, over several languages."""
    text = " ".join(f"w{i}" for i in range(150))
    rows = [(i, text if i % 3 == 0 else f"{text} {i}", f"l{i % 2}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = as_dict(S.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect())
    assert out["l0", "EABCD", 1][:4] == [301, 149, 0, 149] and out["l1", "EABCD", 1][:4] == [300, 150, 0, 150]
    assert out["l1", "ABCDE", 5][6] == 120 * 150
