import re

import duckdb
import pytest

from loomstat.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """Base places and labels, and all (label, containment) matches, by plain loops."""
    w, places, labels = words(text), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split(" ")
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    met = []
    for label, t in L.TEMPLATES:
        tw = set(words(t))
        span = len(words(t)) + len(words(t)) // 4
        for k in range(max(1, len(w) - span + 1)):
            share = len(tw & set(w[k:k + span])) / len(tw)
            if share >= L.THRESHOLD - 1e-9:
                met.append((label, share))
    return w, places, labels, met


def check(out, texts):
    for r in out:
        w, places, labels, met = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert r.labels == ",".join(sorted(labels | {x for x, _ in met}))
        assert abs(r.score - max([s for _, s in met], default=0.0)) < 1e-9


def test_against_brute_force(spark, folder, prose):
    texts = {1: "Released under the MIT License.\n" + prose(200, 3) + "\nmit license MIT-LICENSE mit license",
             2: "x " * 150 + "Licensed under the Apache License, Version 2.0 (the License)" + " y" * 200,
             3: "CC BY-NC 4.0, cc by nc, licensed", 4: None, 5: "", 6: "Apache  License\nversion 2",
             7: "Permission granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files", 8: "the of a license", 9: "É MIT License É"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    check(L.op1_license_scan(spark, folder(documents=df)).collect(), texts)


def test_given_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = L.op1_license_scan(spark, sf).collect()
    assert len(out) == len(texts)
    check(out, texts)


def test_odd_rows(spark, folder, odd_docs, no_docs):
    out = L.op1_license_scan(spark, folder(documents=odd_docs)).collect()
    assert len(out) == 12
    assert all(r.n_words == 0 and r.labels == "" for r in out if r.doc_id in (3, 4, 5, 10))
    assert L.scan(no_docs).count() == 0


def test_main_path_is_native(spark, sf):
    plan = L.op1_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_notices_wrapped_over_lines(spark, folder, prose):
    """Notices broken over lines, with comment marks, at any place between prose; scattered words are no notice."""
    texts, i = {}, 0
    for label, t in L.TEMPLATES:
        for width, mark, before in ((4, "\n", 0), (3, "\n// ", 41), (9, "\r\n * ", 90), (11, "\n# ", 333)):
            tw = t.split(" ")
            notice = mark + mark.join(" ".join(tw[k:k + width]) for k in range(0, len(tw), width))
            texts[i := i + 1] = prose(before, i) + notice + "\n" + prose(70, i + 500)
    plain = max(texts)
    scattered = ["released", prose(9, 1), "under the", prose(9, 2), "mit", prose(9, 3), "license"]
    texts[plain + 1], texts[plain + 2] = "\n".join(scattered), " ".join(scattered)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = folder(documents=df)
    out = L.op1_license_scan(spark, path).collect()
    check(out, texts)
    for r in out:
        assert r.doc_id > plain or L.TEMPLATES[(r.doc_id - 1) // 4][0] in r.labels.split(",")
        assert r.doc_id <= plain or r.labels == ""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cur = con.execute(L.OP1_SQL)
    rows = [dict(zip([c[0] for c in cur.description], row)) for row in cur.fetchall()]
    assert sorted(rows, key=lambda r: r["doc_id"]) == sorted((r.asDict() for r in out), key=lambda r: r["doc_id"])


@pytest.mark.parametrize("piece", [1, 7, 512])
def test_every_matching_block(spark, prose, monkeypatch, piece):
    """Blocks, not only labels: each start at a token of the template, ties and repeats included, over pieces."""
    monkeypatch.setattr(L, "PIECE", piece)
    texts = {1: "Released under the MIT License. " * 3, 2: prose(40, 1) + " the mit license released under the mit",
             3: "license under released mit the", 4: "Licensed under CC BY-SA 4.0 " + prose(5, 2) + " CC BY-SA"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r["at"], r.template, round(r.containment, 9)) for r in L.scan(df).collect()}
    want = set()
    for d, text in texts.items():
        w = words(text)
        for i, (_, t) in enumerate(L.TEMPLATES):
            tw, n = set(words(t)), len(words(t))
            for k in range(len(w)):
                share = len(tw & set(w[k:k + n + n // 4])) / len(tw)
                if w[k] in tw and share >= L.THRESHOLD - 1e-9:
                    want.add((d, k, i, round(share, 9)))
    assert got == want and len({x[2] for x in got}) > 1
