"""Source divergence audit: how differently the sources of a language use its terms, from one-hot level products.

Every (language, source) group counts the kept terms of its language, and a term's probability in a group is a function
of its count there (the *level*) alone.  So the distance of two groups, summed over all kept terms, only needs their
joint table: how many terms have level a in the one and level b in the other.  For a block of terms, each (group, level)
pair becomes an indicator column over the terms; the product of the transposed columns with the columns holds the joint
tables of all pairs of groups at once.  Each entry is priced with the exact difference of the two probabilities, and
the prices of a pair of groups are added up over all blocks.

Terms are dealt into blocks of about ``BLOCK_TERMS`` by a hash, groups into blocks of about ``BLOCK_GROUPS``; a task
multiplies one block of terms for one pair of group blocks.  Within it, terms are sorted by frequency and cut until a
product has at most ``MAX_COLUMNS`` indicator columns a side.  Products are in 32-bit floats: entries are counts of at
most ``2 * BLOCK_TERMS`` terms, exact below 2^24; probabilities are integers (Python's, so no count overflows), sums 64-bit.

Counting: a task adds up its texts in bounded counters and gives out, a term and language, its documents and its
occurrences by source; one shuffle by (language, term) finds the document frequency, drops the rare terms and adds up
the rest, so that a term or a source with a third of all rows is a few rows a task.

Edge cases: null text, language and source are empty strings; a row is a document, also when its ``doc_id`` repeats or is
null; a group without terms has zero counts; a language without kept terms gives distance 0 to all its pairs; a language
with one source has no pairs; ties go by the UTF-8 order of the item; very long texts are counted whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstat.llm.common import materialize, table
from loomstat.llm.kernels import tidy, utf8

MIN_DOCS = 30
TOP_TERMS = 50
UNIT, PRIOR = 1_000_000_000, 5
BLOCK_TERMS, BLOCK_GROUPS, MAX_COLUMNS = 2048, 64, 1024
#: Entries that a counting task holds before it gives them out, and bytes of a text that it splits at once.
HELD_TERMS, PIECE = 800_000, 4 << 20
SCHEMA = "lang string, source string, part string, item string, value long, rank int"

# Letters, and all bytes of longer characters, stay; A-Z become a-z; the rest separates.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Terms of a text in order, in lists from pieces of about ``size`` bytes."""
    at, plain = 0, text.translate(_TERM_BYTES)
    while at < len(plain):
        end = plain.find(b" ", at + size) if at + size < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    #: Per language: documents of each term, and occurrences of each term by source.
    found: dict[str, tuple[Counter, dict[str, Counter]]] = {}
    held = 0

    def out():
        for lang, (docs, sources) in found.items():
            place = {t: i for i, t in enumerate(docs)}
            term = np.concatenate([np.fromiter(map(place.__getitem__, n), np.int64, len(n)) for n in sources.values()])
            order = np.argsort(term, kind="stable")
            ends = np.searchsorted(term[order], np.arange(len(place) + 1)).astype(np.int32)
            source = np.repeat(np.arange(len(sources)), [len(n) for n in sources.values()])[order]
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in sources.values()])[order]
            names = pa.array(list(sources), pa.string()).take(pa.array(source))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(place)), pa.array(list(place), pa.binary()).cast(pa.string()),
                 pa.array(docs.values(), pa.int64()), pa.ListArray.from_arrays(ends, names),
                 pa.ListArray.from_arrays(ends, pa.array(n))], names=["lang", "term", "docs", "sources", "n"])
        found.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            docs, sources = found.setdefault(lang, (Counter(), {}))
            n = sources.setdefault(source, Counter())
            before, seen = len(n) + len(docs), set()
            for terms in pieces(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) + len(docs) - before
            if held >= HELD_TERMS:
                yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total) of the terms in at least ``min_docs`` documents of their language."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"))), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(tidy(_count_task), "lang string, term string, docs long, sources array<string>, n array<long>")
    # One shuffle, by term; what few documents hold goes before its sources are taken apart.
    kept = counted.withColumn("df", F.sum("docs").over(W.partitionBy("lang", "term"))).filter(F.col("df") >= min_docs)
    cells = kept.select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("n").alias("n"))))
    cells = cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy("lang", "term")).alias("total")
    return cells.select("lang", "source", "term", "n", total)


def group_sizes(docs: DataFrame, cells: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, size, lang_size, v, groups) of every occurring group: term counts, kept terms and sources of its
    language."""
    groups = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                           for c, name in ((lang, "lang"), (source, "source")))).distinct()
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept = cells.groupBy("lang", "term").agg(F.max("total").alias("t")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("t").alias("lang_size"))
    counted = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    counted = counted.join(kept, "lang", "left").select(
        "lang", "groups", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("v", "lang_size")))
    return groups.join(sizes, ["lang", "source"], "left").join(counted, "lang").select(
        "lang", "source", F.coalesce(F.col("size"), F.lit(0)).alias("size"), "lang_size", "v", "groups")


def level_products(counts: np.ndarray, split: int, price) -> np.ndarray:
    """Priced joint tables of the groups before ``split`` with those from it on (all with all when it is 0).

    ``counts`` is terms x groups; ``price(group, levels)`` gives the integers whose absolute differences price an entry.
    """
    sides = [np.arange(split), np.arange(split, counts.shape[1])] if split else [np.arange(counts.shape[1])] * 2
    total = np.zeros([len(s) for s in sides], np.int64)
    rows = counts[np.argsort(counts.sum(1), kind="stable")]

    def columns(block, groups):
        """Indicator columns, their prices, and where each group's columns begin."""
        hot, prices, starts, width = [], [], [], 0
        for g in groups:
            levels, which = np.unique(block[:, g], return_inverse=True)
            hot.append(which + width)
            prices.append(price(g, levels))
            starts.append(width)
            width += len(levels)
        x = np.zeros((len(block), width), np.float32)
        for at in hot:
            x[np.arange(len(block)), at] = 1
        return x, np.concatenate(prices), np.array(starts)

    def width(block, groups):
        s = np.sort(block[:, groups], 0)
        return len(groups) + int((s[1:] != s[:-1]).sum())

    todo = [rows]
    while todo:
        block = todo.pop()
        if len(block) > 1 and max(width(block, s) for s in sides) > MAX_COLUMNS:
            todo += [block[:len(block) // 2], block[len(block) // 2:]]
            continue
        x, p, starts = columns(block, sides[0])
        y, q, ends = columns(block, sides[1]) if split else (x, p, starts)
        joint = (x.T @ y).astype(np.int64)
        joint *= np.abs(p[:, None] - q)
        total += np.add.reduceat(np.add.reduceat(joint, starts, 0), ends, 1)
    return total


def _block_task(rows: pa.Table) -> pa.Table:
    """Distances of one block of terms and one pair of group blocks; heads (no term) come with the group's sizes."""
    data = {c: rows.column(c) for c in rows.column_names}
    is_head = np.array([t is None for t in data["term"].to_pylist()])
    place = sorted(zip(data["block"].filter(pa.array(is_head)).to_pylist(),
                       data["source"].filter(pa.array(is_head)).to_pylist(),
                       data["size"].filter(pa.array(is_head)).to_pylist()))
    lang, low, high = (data[c][0].as_py() for c in ("lang", "low", "high"))
    v = int(np.max(data["v"].to_numpy()))
    index = {source: i for i, (_, source, _) in enumerate(place)}
    split = 0 if low == high else sum(b == low for b, _, _ in place)
    cells = pa.array(~is_head)
    term = data["term"].filter(cells).combine_chunks().dictionary_encode()
    counts = np.zeros((len(term.dictionary), len(place)), np.int64)
    at = np.fromiter((index[s] for s in data["source"].filter(cells).to_pylist()), np.int64)
    counts[term.indices.to_numpy(zero_copy_only=False), at] = data["size"].filter(cells).to_numpy()

    def price(g, levels):
        below = place[g][2] + PRIOR * v
        return np.array([1 + UNIT * (n + PRIOR) // below for n in levels.tolist()], np.int64)

    names = [source for _, source, _ in place]
    if low != high and not 0 < split < len(names):
        a, b, value = [], [], []  # one of the two group blocks is empty
    else:
        # A term that no group here has stands at level 0 in both: the block numbered 0 counts all kept terms so, and
        # every block takes back those that it has itself.
        zero = np.array([price(g, np.zeros(1, np.int64))[0] for g in range(len(place))]) if v else np.zeros(len(place), np.int64)
        one, two = (zero[:split], zero[split:]) if split else (zero, zero)
        total = np.abs(one[:, None] - two) * ((v if data["terms"][0].as_py() == 0 else 0) - len(counts))
        if len(counts):
            total += level_products(counts, split, price)
        i, j = np.indices(total.shape).reshape(2, -1)
        one, two, worth = [names[k] for k in i], [names[split + k] for k in j], total.ravel()
        if split:
            a, b, value = one + two, two + one, np.concatenate([worth, worth])
        else:
            a, b, value = one, two, worth
    out = pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(a, pa.string()),
                    "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})
    return out.filter(pa.array([x != y for x, y in zip(a, b)], pa.bool_()))


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    langs = materialize(groups.groupBy("lang").agg(F.max("v").alias("v"), F.max("groups").alias("groups")).select(
        "lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int").alias("term_blocks"),
        F.ceil(F.col("groups") / BLOCK_GROUPS).cast("int").alias("group_blocks")), "langs")
    block = F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int").alias("block")
    heads = groups.select("lang", "source", "size").join(langs, "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "size", "v", "group_blocks", block,
        F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("terms"))
    body = cells.join(langs, "lang").select(
        "lang", "source", "term", F.col("n").alias("size"), "v", "group_blocks", block,
        F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("terms"))
    dealt = heads.unionByName(body).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    dealt = dealt.select("lang", "source", "term", "size", "v", "block", "terms",
                         F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    priced = dealt.groupBy("lang", "terms", "low", "high").applyInArrow(
        _block_task, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _probability(n: str, size: str) -> str:
    return (f"1 + (CAST({n} + {PRIOR} AS DECIMAL(28, 0)) * CAST({UNIT} AS DECIMAL(10, 0))) "
            f"div (CAST({size} AS DECIMAL(28, 0)) + {PRIOR} * CAST(v AS DECIMAL(20, 0)))")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Columns of ``SCHEMA``: distances of source pairs (part ``pair``) and telling terms (part ``term``)."""
    cells = materialize(term_counts(docs, text, lang, source), "cells")
    groups = materialize(group_sizes(docs, cells, lang, source), "groups")
    pairs = pair_distances(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    gap = F.expr(f"({_probability('n', 'size')}) - ({_probability('total', 'lang_size')})")
    terms = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap.alias("value")).filter("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", rank]
    return pairs.select(*columns).unionByName(terms.select(*columns).filter(F.col("rank") <= TOP_TERMS))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the sources of every language of ``documents``."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = f"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
grps AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs)
         GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
cells AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs)
          JOIN kept USING (lang, term) GROUP BY ALL),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size
          FROM grps g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
probs AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {PRIOR}) // (s.size + {PRIOR} * w.v) AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang JOIN vocab w ON w.lang = s.lang
  LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
whole AS (SELECT t.lang, t.term, 1 + CAST({UNIT} AS HUGEINT) * (t.n + {PRIOR}) // (l.size + {PRIOR} * w.v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) t
  JOIN (SELECT lang, sum(size) AS size FROM sizes GROUP BY lang) l ON l.lang = t.lang JOIN vocab w ON w.lang = t.lang),
met AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - w.q FROM probs p JOIN whole w ON w.lang = p.lang AND w.term = p.term
  WHERE p.n > 0 AND p.p > w.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
