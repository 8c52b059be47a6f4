"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``size`` words (hashed to 64 bits): ``SHINGLE`` = 5, the contract's 4 in
the registered query.  In each
of ``TREES`` independent trees a document walks down several paths: at a node it
picks the ``BRANCH`` tokens of its set that are smallest under the node's own hash
(minwise tokens) and follows one branch per token.  Similar sets pick the same
tokens, so a pair with Jaccard similarity 0.8 shares a leaf of one tree with
probability above 0.93, and of one of four trees above 0.9999.

Documents with equal sets are one class from the start, so copies cost nothing
further.  Then, on classes, with components joined up after every step:

1. in a node of at most ``SMALL`` members all are compared by sketch, and the pairs
   of a maximum spanning forest over those that may be linked are confirmed on full
   sets (a group of n near copies costs n confirmations, not n squared);
2. nodes that still hold several components give every pair across components that
   may be linked, each pair once (from the smallest of the small nodes that both are in), to be confirmed as well;
3. in larger nodes the members meet ``PIVOTS`` pivots first; those that still hold
   several components branch one level deeper and go through the steps again;
4. nodes that are still large after ``MAX_ROUNDS`` levels are cut into blocks, and all
   pairs of blocks are compared, so no node is left out.

Links are confirmed by exact intersection of full sets.  Before that a pair is ruled
out only when its sizes or its sketches do so: a sketch holds two bits of each of
1024 minwise hashes; a pair at the threshold differs in 154 +- 11.4 of them, and
``MAX_DIFFERENT`` lies 4.5 standard deviations above.

Edge cases: a document without words (or with null text) has an empty set and is
linked with nothing; with fewer than ``size`` words the whole sequence is its one
shingle; very long texts are taken whole; rows that share a ``doc_id`` are one
node of the graph and each gives a result row (``keep_first`` keeps the smallest of them, column by column); a row with a null ``doc_id`` is
linked with nothing (component null, kept); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstat.llm.common import materialize, table, unused
from loomstat.llm.graph import components
from loomstat.llm.kernels import MIX, WordHashes, mix64, rolled, tidy, utf8

SHINGLE, QUERY_SHINGLE = 5, 4
NUMERATOR, DENOMINATOR = 4, 5  # link: DENOMINATOR * |A & B| >= NUMERATOR * |A | B|
TREES, BRANCH, START_DEPTH = 4, 2, 2
PIVOTS = 3
SMALL = 3_000
MAX_ROUNDS = 6
SKETCH, MAX_DIFFERENT = 1024, 205
#: Up to this many ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = rolled(hashes.of(words), min(size, len(words)))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


_MASK = (1 << 64) - 1


def _branch(tokens: np.ndarray, path: int) -> list[int]:
    """Paths of the children that a set follows below ``path``: one for each of its smallest tokens there."""
    order = (tokens ^ np.uint64(path)) * np.uint64(path | 1)
    picks = range(len(tokens)) if len(tokens) <= BRANCH else np.argpartition(order, BRANCH - 1)[:BRANCH]
    out = []
    for i in picks:
        x = (int(tokens[i]) + path * 3) & _MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
        out.append(x ^ (x >> 29))
    return out


def walk(tokens: np.ndarray, path: int, depth: int) -> list[int]:
    leaves = [path]
    for _ in range(depth):
        leaves = [child for p in leaves for child in _branch(tokens, p)]
    return leaves


_FLIPS, _FACTORS = (mix64(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * MIX) >> np.uint64(32)).astype(
    np.uint32).reshape(2, SKETCH)
_FACTORS = _FACTORS | np.uint32(1)
_LOW_BITS = np.uint64(0x5555555555555555)


def sketch(tokens: np.ndarray) -> bytes:
    """Two bits of each of ``SKETCH`` minwise hashes."""
    t, low = (tokens >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, np.uint32(0xFFFFFFFF))
    for at in range(0, len(t), 4096):
        part = t[at:at + 4096]
        for k in range(0, SKETCH, 64):
            h = part[None, :] ^ _FLIPS[k:k + 64, None]
            h *= _FACTORS[k:k + 64, None]
            np.minimum(low[k:k + 64], h.min(1), out=low[k:k + 64])
    two = (mix64(low.astype(np.uint64) * MIX) & np.uint64(3)).astype(np.uint8)
    return np.packbits(np.stack([two >> 1, two & 1], 1).ravel()).tobytes()


NONE = np.uint16(0xFFFF)


def differences(bits: np.ndarray, n: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first row, matrix) of the number of minwise hashes in which the sketches of two members differ; ``NONE``
    where the pair cannot be linked, or is in one group already."""
    for lo in range(0, len(bits), 256):
        part = bits[lo:lo + 256]
        out = np.zeros((len(part), len(bits)), np.uint16)
        for k in range(bits.shape[1]):
            d = part[:, k, None] ^ bits[None, :, k]
            d |= d >> np.uint64(1)
            d &= _LOW_BITS
            out += np.bitwise_count(d)
        own = n[lo:lo + 256, None]
        out[(out > MAX_DIFFERENT) | (group[lo:lo + 256, None] == group[None, :])
            | (np.minimum(own, n) * DENOMINATOR < np.maximum(own, n) * NUMERATOR)] = NONE
        yield lo, out


_ROOTS = [int(x) for x in mix64(np.arange(1, TREES + 1, dtype=np.uint64) * MIX)]


def _signature_task(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, classes, paths = [], [], []
            with np.errstate(over="ignore"):
                for text in utf8(batch.column(1)):
                    tokens = shingle_set(text, hashes, size)
                    sizes.append(len(tokens))
                    classes.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    leaves = [p for root in _ROOTS for p in walk(tokens, root, START_DEPTH)] if len(tokens) else []
                    paths.append(np.array(leaves, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(paths, pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "paths"])
    return run


def _set_task(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo in range(0, len(texts), 200):
                with np.errstate(over="ignore"):
                    sets = [shingle_set(t, hashes, size) for t in texts[lo:lo + 200]]
                    bits = [sketch(s) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array(bits, pa.binary()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "sketch", "tokens"])
    return run


def _deeper_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, cls, rep, n, sketch, paths, tokens) -> the members of the nodes below ``path``."""
    for batch in batches:
        at, children = [], []
        with np.errstate(over="ignore"):
            for i, path in enumerate(batch.column(0).to_pylist()):
                tokens = batch.column(6)[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                found = _branch(tokens, path & _MASK)
                at += [i] * len(found)
                children += found
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(children, np.uint64).view(np.int64), pa.int64()),
             *(batch.column(k).take(rows) for k in range(1, 6))], names=["path", "cls", "rep", "n", "sketch", "paths"])


_MEMBER = "path long, cls binary, rep long, n long, sketch binary, paths array<long>"
_PAIR = "a_cls binary, a_rep long, b_cls binary, b_rep long"


def _forest(cost: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest over the pairs that may be linked (Prim, a row at a time)."""
    best, origin = np.full(len(cost), NONE), np.zeros(len(cost), np.int64)
    out, todo = [], np.ones(len(cost), np.bool_)
    at = 0
    while True:
        todo[at] = False
        closer = todo & (cost[at] < best)
        best[closer], origin[closer] = cost[at][closer], at
        rest = np.flatnonzero(todo)
        if not len(rest):
            return out
        at = int(rest[np.argmin(best[rest])])
        if best[at] != NONE:
            out.append((int(origin[at]), at))


def _first_shared(paths: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest path that both members of each pair follow (they share one)."""
    width, none = max(map(len, paths)), np.iinfo(np.int64).max
    table_ = np.full((len(paths), width), none)
    for i, p in enumerate(paths):
        table_[i, :len(p)] = p
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 20_000):
        x, y = table_[a[lo:lo + 20_000]], table_[b[lo:lo + 20_000]]
        shared = (x[:, :, None] == y[:, None, :]).any(2)
        out[lo:lo + 20_000] = np.where(shared, x, none).min(1)
    return out


def _node_task(every: bool, once: bool):
    """Candidate pairs of the nodes in a partition sorted by path: a spanning forest of each node, or ``every`` pair
    across its components.  With ``once`` a pair comes from the smallest of the paths that its members share."""
    def node(rows: pa.Table) -> list[tuple[int, int]]:
        n, component = rows.column("n").to_numpy(), rows.column("component").to_numpy()
        bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
        blocks = differences(bits, n, component)
        if not every:
            return _forest(np.concatenate([cost for _, cost in blocks]))
        found = []
        for lo, cost in blocks:
            a, b = np.nonzero(cost != NONE)
            found.append(np.stack([a + lo, b])[:, a + lo < b])
        a, b = np.concatenate(found, 1)
        if once and len(a):
            first = _first_shared(rows.column("paths").to_pylist(), a, b) == rows.column("path")[0].as_py()
            a, b = a[first], b[first]
        return list(zip(a.tolist(), b.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not len(held):
                continue
            path = held.column("path").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
            done = len(edge) - 1 if batch is None else len(edge) - 2  # the last node may go on in the next batch
            left, right = [], []
            for lo, hi in zip(edge[:done].tolist(), edge[1:done + 1].tolist()):
                for a, b in node(held.slice(lo, hi - lo)):
                    left.append(lo + a)
                    right.append(lo + b)
            ends = [held.take(pa.array(x, pa.int64())).select(["cls", "rep"]).combine_chunks() for x in (left, right)]
            held = held.slice(int(edge[done]))
            if left:
                yield pa.RecordBatch.from_arrays(
                    [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for t in ends for c in t.columns],
                    names=["a_cls", "a_rep", "b_cls", "b_rep"])
    return run


def _candidates(members: DataFrame, every: bool = False, once: bool = False) -> DataFrame:
    """Distinct candidate pairs of nodes of bounded size."""
    rows = members.select("path", "cls", "rep", "n", "sketch", "paths", "component")
    rows = rows.repartition("path").sortWithinPartitions("path")
    return rows.mapInArrow(tidy(_node_task(every, once)), _PAIR).distinct()


def _in_company(members: DataFrame) -> DataFrame:
    """Members of nodes with at least two classes, with the node's size."""
    nodes = members.groupBy("path").agg(F.count("*").alias("size"))
    return members.join(nodes.filter("size > 1"), "path")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of (a_cls, a_rep, b_cls, b_rep), by exact intersection of full sets."""
    a = sets.select(F.col("cls").alias("a_cls"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("cls").alias("b_cls"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(b, "b_cls").join(a, "a_cls")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - common
    return both.filter(common * DENOMINATOR >= union * NUMERATOR).select(F.col("a_rep").alias("a"),
                                                                         F.col("b_rep").alias("b"))


def _with_pivots(members: DataFrame, level: int) -> DataFrame:
    """Distinct pairs of members with their node's pivots: its smallest member and some drawn by a hash."""
    keys = [F.col("rep"), *[F.xxhash64("cls", "path", F.lit(level * PIVOTS + i)) for i in range(1, PIVOTS)]]
    row = F.struct("cls", "rep", "n")
    best = members.groupBy("path").agg(*[F.min(F.struct(k.alias("k"), row.alias("m"))).alias(f"p{i}")
                                         for i, k in enumerate(keys)])
    pivots = best.select("path", F.explode(F.array(*[F.col(f"p{i}.m") for i in range(len(keys))])).alias("p"))
    met = members.join(pivots, "path").filter(
        (F.col("cls") != F.col("p.cls"))
        & (F.least("n", "p.n") * DENOMINATOR >= F.greatest("n", "p.n") * NUMERATOR))
    return met.select(F.col("p.cls").alias("a_cls"), F.col("p.rep").alias("a_rep"), F.col("cls").alias("b_cls"),
                      F.col("rep").alias("b_rep")).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """Large nodes as nodes of about ``SMALL`` members: one for each pair of blocks."""
    k = F.ceil(F.col("size") * 3 / SMALL).cast("int")
    own = F.pmod(F.xxhash64("cls"), k).cast("int")
    other = F.explode(F.sequence(F.lit(0), k - 1)).alias("other")
    rows = members.select("*", own.alias("own"), other)
    return rows.withColumn("path", F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))).drop(
        "own", "other")


def signatures(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, cls, paths) of every row: set size, class of equal sets, leaves of all trees."""
    pairs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return pairs.mapInArrow(tidy(_signature_task(size)), "doc_id long, n long, cls binary, paths array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (rep): broadcast behind a check of the count, else a shuffle join."""
    wanted = ids.select(F.col("rep").alias("_rep")).distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = F.broadcast(wanted) if few else wanted.hint("merge")
    return docs.join(wanted, F.col("doc_id") == F.col("_rep"), "left_semi")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``, by shingles of ``size`` words."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sig = materialize(signatures(docs, size), "signatures")
    live = sig.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(live.groupBy("cls").agg(F.min(F.struct("doc_id", "n", "paths")).alias("s"))
                          .select("cls", F.col("s.doc_id").alias("rep"), F.col("s.n").alias("n"),
                                  F.col("s.paths").alias("paths")), "classes")
    by_id = live.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("cls").alias("x"), F.max("cls").alias("y"))
    repeated = not by_id.filter("rows > 1").isEmpty()
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    if repeated:  # rows that share an id belong together whatever their sets are
        twins = by_id.filter("x <> y").select("doc_id")
        links = materialize(live.select("doc_id", "cls").join(twins, "doc_id").join(classes.select("cls", "rep"), "cls")
                            .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "links")

    found = classes.select(F.explode(F.array_distinct("paths")).alias("path"), "cls", "rep", "n", "paths")
    members = materialize(_in_company(found), "nodes")
    sets = _texts_of(docs, members).select("text").mapInArrow(
        tidy(_set_task(size)), "cls binary, sketch binary, tokens array<long>")
    sets = materialize(sets.dropDuplicates(["cls"]) if repeated else sets, "sets")
    members = materialize(members.join(sets.select("cls", "sketch"), "cls").withColumn("component", F.col("rep")),
                          "nodes")
    for level in range(MAX_ROUNDS + 1):
        small, large = members.filter(F.col("size") <= SMALL), members.filter(F.col("size") > SMALL)
        pairs, any_large = _candidates(small), not large.isEmpty()
        if any_large:
            pairs = pairs.unionByName(_with_pivots(large, level))
        links = materialize(links.unionByName(_confirm(pairs, sets)), "links")
        linked = components(links)
        if level == 0 and any_large:  # a pair's node must be one of those that give pairs
            own = small.groupBy("cls").agg(F.collect_set("path").alias("paths"))  # at most the leaves of a class
            small = small.drop("paths").join(own, "cls")
        pairs = _candidates(_mixed(small, linked), every=True, once=level == 0)
        if any_large:
            large = materialize(_mixed(large, linked), "nodes")
            any_large = not large.isEmpty()
        if any_large and level == MAX_ROUNDS:
            pairs = pairs.unionByName(_candidates(_blocks(large), every=True))
        links = materialize(links.unionByName(_confirm(pairs, sets)), "links")
        if not any_large:
            break
        children = large.drop("component", "size").join(sets.select("cls", "tokens"), "cls").select(
            "path", "cls", "rep", "n", "sketch", "paths", "tokens").mapInArrow(tidy(_deeper_task), _MEMBER)
        members = _mixed(_in_company(materialize(children, "nodes")), linked)
        members = materialize(members, "nodes")
    linked = components(links)

    named = classes.select("cls", "rep").join(linked, F.col("rep") == F.col("node"), "left").select(
        "cls", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"))
    out = out.join(named, "cls", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _mixed(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of nodes that hold more than one component, with their component."""
    named = members.drop("component").join(linked, F.col("rep") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "rep")).drop("node")
    several = named.groupBy("path").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return named.join(several.select("path"), "path", "left_semi")


def keep_first(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each component (that of its smallest id, once); rows with a null id stay as they are."""
    name, place = unused(docs, "_kept"), unused(docs, "_place")
    kept = link(docs, size=size).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(name), "left_semi")
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        order = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        named = named.withColumn(place, F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
        named = named.filter(F.col(place) == 1).drop(place)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``, by the contract's shingles of four words."""
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=QUERY_SHINGLE)
