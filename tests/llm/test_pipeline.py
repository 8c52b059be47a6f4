import re
import zlib

import numpy as np

import corpus_pipeline as P
from loomstat.llm import decontam, quality, wavelet
from loomstat.llm.common import materialize, remove_run, run_folder


def test_stages_against_plain_rules(spark, sf):
    """Each stage, on what the one before it kept, does what its rule says."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = given, []
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == given.columns, name
        seen.append((before, docs))
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for _, x in seen]
    verdict = {r.doc_id: r.kept for r in quality.judge(given, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(ids[0]) == sorted(i for i, k in verdict.items() if k)
    texts = {r.doc_id: r.text for r in seen[0][1].collect()}
    from test_neardup import brute
    assert sorted(ids[1]) == sorted(i for i, (_, c) in brute(texts, 5).items() if c == i)
    items = [b" ".join(decontam.words_of(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {i: b" " + b" ".join(decontam.words_of(t.encode())) + b" " for i, t in texts.items()}
    assert all(b" " + x + b" " not in plain[i] for i in ids[2] for x in items)
    assert set(ids[3]) == set(ids[2]) and len(ids[3]) > len(ids[2])
    out = P.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(ids[3])
    from tokenizers import Tokenizer
    t, at = Tokenizer.from_file(wavelet.TOKENIZER), 0
    for r in sorted(out, key=lambda r: r.start):
        x = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)


def test_odd_and_empty_documents(spark, sf, odd_docs, no_docs):
    for given in (odd_docs, no_docs):
        docs = given
        for _, stage in P.STAGES:
            docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert docs.count() <= 2 * given.count()


def test_registered(spark):
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op") and re.match(r"op\d+_", n)) == list(
        range(1, 14))


def test_a_run_has_one_folder(spark, no_docs):
    import os
    kept = materialize(spark.range(5), "numbers")
    place = run_folder(spark).removeprefix("file://")
    assert kept.count() == 5 and os.listdir(place)
    remove_run(spark)
    assert not os.path.exists(place)
    assert materialize(no_docs, "again").count() == 0


def test_batches_are_bounded(spark, sf):
    from loomstat.llm import common as C
    for given, want in (("64m", C.BATCH_BYTES), ("1m", 1 << 20), ("2097152b", 2 << 20)):
        spark.conf.set(C._BATCH_SETTING, given)
        C.table(spark, sf, "labels")
        size, unit = re.fullmatch(r"(\d+)([mb]?)", spark.conf.get(C._BATCH_SETTING)).groups()
        assert int(size) << (20 if unit == "m" else 0) == want
