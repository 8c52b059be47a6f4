"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte 4-grams are counted: the raw corpus (every
document) and a trusted target (documents labelled good).  A document's score is
the mean log-likelihood ratio of its n-grams, target against raw, both smoothed
with ``SMOOTH`` expected counts a bucket; it is kept when it passes the surface
rules and reaches the threshold.  The threshold is ``MIN_SCORE``, or lower where
the trusted documents themselves score lower (their 1 % quantile less ``MARGIN``):
a small or uneven labelled table must not reject what it calls good.

The raw corpus is counted over all documents, the trusted target over all that are
labelled good.  Up to ``BROADCAST_IDS`` of their ids are broadcast, so that texts
stay where they are; more meet the texts in Spark's own join.  Each task adds its documents up in one vector
of ``BUCKETS`` counts and emits it once; Spark sums the vectors, and only the sums
(a fixed number of buckets) reach the driver.

Edge cases: a null or empty text has no words, scores 0 and fails the base rules;
with no labelled document or no text at all every score is 0; very long texts
are counted whole; repeated rows are judged row by row; a null ``doc_id`` is never
trusted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import materialize, table
from loomstat.llm.kernels import MIX, WordHashes, rolled, steps, tidy, utf8

BITS = 16
BUCKETS = 1 << BITS
GRAM = 4
BROADCAST_IDS = 2_000_000
MIN_SCORE = -0.15
TRUSTED_QUANTILE, MARGIN = 0.01, 0.1
SMOOTH = 5.0
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

# Byte classes of the base rules.
_SYMBOLS = np.zeros(256, np.bool_)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = np.zeros(256, np.bool_)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, score double, kept boolean")


def gram_buckets(text: bytes) -> np.ndarray:
    """Bucket of every byte n-gram of a text."""
    b = np.frombuffer(text, np.uint8)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = b[:n].astype(np.uint64)
    for i in range(1, GRAM):
        key <<= np.uint64(8)
        key |= b[i: n + i]
    key *= MIX
    return (key >> np.uint64(64 - BITS)).astype(np.int64)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, trusted = utf8(batch.column(0)), batch.column(1).to_pylist()
        for text, good in zip(texts, trusted):
            for at in range(0, max(1, len(text) - GRAM + 1), 1 << 20):
                c = np.bincount(gram_buckets(text[at: at + (1 << 20) + GRAM - 1]), minlength=BUCKETS)
                raw += c
                if good:
                    target += c
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])],
                                     names=["bucket", "raw", "target"])


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids labelled good, all of them."""
    ids = labels.filter((F.col(f"`{quality}`") == 1) & F.col(f"`{doc_id}`").isNotNull())
    return ids.select(F.col(f"`{doc_id}`").alias("_trusted")).distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log p_target - log p_raw of every bucket, both smoothed; zeros when either side is empty."""
    flagged = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    flagged = flagged.join(trusted, F.col("_id") == F.col("_trusted"), "left")
    counts = flagged.select("_text", F.col("_trusted").isNotNull().alias("_good")).mapInArrow(
        tidy(_count_task), "bucket int, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"].to_numpy(np.int64)] = sums["raw"].to_numpy(float)
    target[sums["bucket"].to_numpy(np.int64)] = sums["target"].to_numpy(float)
    if not raw.sum() or not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (raw * (target.sum() / raw.sum()) + SMOOTH))


def _repeats(h: np.ndarray) -> int:
    """Words that stand in a 3-word window found at least twice."""
    g = rolled(h, 3)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), np.bool_)
    for i in range(3):
        covered[i: i + len(g)] |= twice
    return int(covered.sum())


def base_counts(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    b = np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(len(b) - (_BLANK[b] | _CONTINUES[b]).sum()), int(_SYMBOLS[b].sum()),
            len(lines) - len(set(lines)), _repeats(hashes.of(words)))


def _score_task(ratios: np.ndarray, min_score: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in steps(texts):
                rows = []
                for text in texts[lo:hi]:
                    n, chars, symbols, dup, repeat = base_counts(text, hashes)
                    total, grams = 0.0, max(0, len(text) - GRAM + 1)
                    for at in range(0, grams, 1 << 20):
                        total += float(ratios[gram_buckets(text[at: at + (1 << 20) + GRAM - 1])].sum())
                    score = total / grams if grams else 0.0
                    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n
                    rows.append((n, chars, symbols, dup, repeat, failed, score, not failed and score >= min_score))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_(), pa.float64(),
                                                                                       pa.bool_()])]
                ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *cols], names=[f.split()[0] for f in SCHEMA.split(", ")])
    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """(log ratios, threshold) of a corpus."""
    trusted = materialize(trusted_ids(labels), "trusted")
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    ratios = log_ratios(docs, trusted, doc_id, text)
    pairs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    good = pairs.join(trusted, F.col("doc_id") == F.col("_trusted"), "left_semi")
    scores = good.mapInArrow(tidy(_score_task(ratios, MIN_SCORE)), SCHEMA).filter("NOT base_failed")
    low = scores.agg(F.percentile_approx("score", TRUSTED_QUANTILE, 1000)).first()[0]
    return ratios, MIN_SCORE if low is None else min(MIN_SCORE, low - MARGIN)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, score and verdict of every document (columns of ``SCHEMA``)."""
    ratios, threshold = fit(docs, labels, doc_id, text)
    pairs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return pairs.mapInArrow(tidy(_score_task(ratios, threshold)), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: one pass, no join."""
    ratios, threshold = fit(docs, labels, doc_id, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score_task(ratios, threshold)
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows), pa.int64())
            pair = pa.RecordBatch.from_arrays([ids, batch.column(at)], names=["doc_id", "text"])
            mask = [k for out in score(iter([pair])) for k in out.column("kept").to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
