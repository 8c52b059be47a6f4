"""Filter interaction audit: which filter removes what, in every order of application, from survival words.

A document becomes a 32-bit word: bit S (a subset of the five filters, filter i being bit i of S) is set when the
document survives every filter of S.  The words of a part and label class are added up by carry-save positional
popcounts: full adders on whole arrays of words turn three words of one weight into a sum word of that weight and a
carry word of twice the weight, until two words a weight are left; only those are taken apart into 32 counts.  The
survivors of all 32 subsets give every order's kept and removed documents, the redundant and the unique failures and
the Shapley values, as differences.

Filters A-D look at one text.  E needs the whole table: the smallest ``doc_id`` of each text (by its SHA-256) is found
with partial aggregation, and a document passes E when (digest, doc_id) is among those; joining on both spreads a text
that a third of the documents share over all tasks.  No text is shuffled.

Edge cases: a null text is an empty one, a null part the empty string; a text without words fails A, not B or C; ids
that repeat with the same text are not copies of one another (none is smaller); a null ``doc_id`` is no copy and makes no
copies, and has no labels; a document counts as good (toxic) when any of its label rows says so; a part whose documents
never fail has zeros; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstat.llm.common import materialize, table
from loomstat.llm.kernels import tidy, utf8

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
COPY = FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT = 100, 80, 10
#: Parts that a task holds counters for before it gives out what it has.
HELD_PARTS = 2048

# Byte classes of filters C and D.
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"
_CONTINUES = bytes(range(0x80, 0xC0))

#: Survival word of each of the 32 sets of failed filters.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def failures(text: bytes) -> int:
    """Filters A-D that a text fails, as bits."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    chars = len(text.translate(None, _CONTINUES))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PCT * n) << 1
            | (100 * upper > MAX_UPPER_PCT * chars) << 2 | (len(text.translate(None, _MARKS)) < len(text)) << 3)


def _judge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([failures(t) for t in texts], pa.int32()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            names=["doc_id", "part", "failed", "digest"])


class PositionalCount:
    """Counts of set bits at each of the 32 places over words added so far, held as at most two words a weight."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        weight = 0
        while len(words):
            if weight == len(self.held):
                self.held.append(np.zeros(0, np.uint32))
            words = np.concatenate([self.held[weight], words])
            carries = []
            while len(words) > 2:
                n = len(words) // 3
                a, b, c = words[:n], words[n:2 * n], words[2 * n:3 * n]
                half = a ^ b
                carries.append((a & b) | (half & c))
                words = np.concatenate([half ^ c, words[3 * n:]])
            self.held[weight] = words
            words = np.concatenate(carries) if carries else words[:0]
            weight += 1

    def counts(self) -> np.ndarray:
        places = np.arange(32, dtype=np.uint32)
        total = np.zeros(32, np.int64)
        for weight, words in enumerate(self.held):
            total += ((words[:, None] >> places) & 1).astype(np.int64).sum(0) << weight
        return total


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[PositionalCount]] = {}

    def out():
        for part, classes in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * SUBSETS, pa.string()), pa.array(np.arange(SUBSETS, dtype=np.int32)),
                 *(pa.array(c.counts()) for c in classes)], names=["part", "subset", "n", "good", "toxic"])
        held.clear()

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        part = coded.indices.to_numpy(zero_copy_only=False)
        words = WORDS[batch.column(1).to_numpy(zero_copy_only=False)]
        flags = [np.ones(len(part), np.bool_), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(len(coded.dictionary) + 1))
        for i, name in enumerate(coded.dictionary.to_pylist()):
            rows = order[ends[i]:ends[i + 1]]
            if name not in held and len(held) >= HELD_PARTS:
                yield from out()
            for count, flag in zip(held.setdefault(name, [PositionalCount() for _ in range(3)]), flags):
                count.add(words[rows[flag[rows]]])
    yield from out()


def failed_filters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, failed): the filters each document fails as bits of one number, E included."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text}`").alias("text"))
    judged = materialize(rows.mapInArrow(tidy(_judge_task), "doc_id long, part string, failed int, digest binary"),
                         "judged")
    first = judged.filter("doc_id IS NOT NULL").groupBy(F.col("digest").alias("_digest")).agg(
        F.min("doc_id").alias("_first"))
    joined = judged.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left")
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", F.when(copy, F.col("failed") + F.lit(1 << COPY)).otherwise(
        F.col("failed")).alias("failed"))


def survivors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of the documents of a part that survive each of the 32 subsets."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        *(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"_{c}") for c in ("quality", "toxic")))
    flag = [F.coalesce(F.col(f"_{c}"), F.lit(False)).alias(c) for c in ("quality", "toxic")]
    rows = failed.join(said, F.col("doc_id") == F.col("_id"), "left").select("part", "failed", *flag)
    counts = rows.mapInArrow(tidy(_count_task), "part string, subset int, n long, good long, toxic long")
    counts = counts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    columns = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic")))
    return counts.groupBy("part").agg(columns.alias("t")).select(
        "part", *(F.col(f"t.{c}").alias(c) for c in ("n", "good", "toxic")))


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters applied before, bit of the step's filter) for all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with the columns of ``op12_filter_audit``."""
    spark = docs.sparkSession
    counts = survivors(failed_filters(docs, doc_id, text, part), labels)
    steps = spark.createDataFrame(order_steps(), "filter_order string, step int, before int, bit int")
    at = counts.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1)))).join(
        F.broadcast(steps), F.col("subset") == F.col("before"))

    def n(column, subset):
        return F.element_at(column, (subset + 1).cast("int"))

    before, bit = F.col("before"), F.col("bit")
    after, rest = before.bitwiseOR(bit), F.lit(SUBSETS - 1).bitwiseXOR(bit)
    removed = n("n", before) - n("n", after)
    one_filter = W.partitionBy("part", "bit")  # 120 rows: the orders
    return at.select(
        "part", "filter_order", "step", "bit", n("n", after).alias("kept"), removed.alias("removed"),
        (n("n", F.lit(0)) - n("n", bit) - removed).alias("redundant"),
        (n("n", rest) - n("n", F.lit(SUBSETS - 1))).alias("unique_fails"),
        (n("good", before) - n("good", after)).alias("good_lost"),
        (n("toxic", before) - n("toxic", after)).alias("toxic_lost"),
    ).withColumn("shapley", F.sum("removed").over(one_filter)).drop("bit")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the five filters over ``documents``, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT body, min(doc_id) AS first_id FROM docs GROUP BY body),
fails AS (
  SELECT d.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.body, '[^A-Z]', '', 'g')) > 10 * length(d.body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > f.first_id THEN 16 ELSE 0 END AS failed
  FROM docs d JOIN firsts f ON f.body = d.body LEFT JOIN said s ON s.doc_id = d.doc_id),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM names a, names b, names c, names d, names e
  WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before
          FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
