"""Exact Euclidean silhouettes over all rows, from sums of distances by cluster.

A row needs its mean distance to its own cluster (a) and to the nearest other one (b); nothing else of the n^2 distances is
kept.  Rows meet the members of a cluster in bounded blocks (a matrix product each, cancelled distances recomputed), a block
returns one sum per row, and Spark adds the blocks.

For one labelling, most clusters need not be met: the mean distance of x to a cluster with centroid c and variance v lies
between ``|x - c|`` and ``sqrt(|x - c|^2 + v)``, so only those whose lower bound is not above the smallest upper bound can be
the nearest.  For several labellings of the same rows (the k's of a search), every distance is computed once and added to all
of them.  In one or two dimensions the sums of many rows come from a quadtree (``far_field``), in n log n.  In more the work is
quadratic in the rows; a caller with too many passes a sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.operators.far_field import MAX_DIM, hot, sums_by_leaf
from loomstat.operators.knn import MAX_PIVOT_BYTES, QUERY_CHUNK, _block_join, _by_pairs, _by_rows, _distances, _slack
from loomstat.session import cut_lineage, sized

#: Rows from which, in few dimensions, a quadtree takes the place of all pairs (``far_field``), and the most clusters for it.
TREE_ROWS, TREE_CLUSTERS = 50_000, 64


def exact_distances(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Distances by a matrix product; those that rounding could blur are computed term by term."""
    d = _distances(Q, R)
    i, j = np.nonzero(d <= 1e3 * _slack(Q, R))
    for at in range(0, len(i), 1 << 18):
        s = slice(at, at + (1 << 18))
        d[i[s], j[s]] = np.sqrt(((Q[i[s]] - R[j[s]]) ** 2).sum(1))
    return d


def mean_silhouette(points: DataFrame, key: str, label: str, tree_rows: int = TREE_ROWS) -> float | None:
    """Mean silhouette of ``(key, vec, label)``; None below two clusters.  Centroids of all clusters must fit
    ``MAX_PIVOT_BYTES`` (checked)."""
    coded = points.select(F.col(key).alias("qid"), "vec", F.col(label).alias("_l")).where("_l IS NOT NULL")
    head = coded.select(F.size("vec").alias("d")).first()
    if head is None:
        return None
    dim = head["d"]
    most = MAX_PIVOT_BYTES // (8 * (dim + 2))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    stats = coded.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("q"),
                                    F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("c")).limit(most + 1).collect()
    if len(stats) > most:
        raise ValueError(f"more than {most} clusters; their centroids do not fit a broadcast")
    if len(stats) < 2:
        return None
    spark = points.sparkSession
    stats.sort(key=lambda r: r["_l"])
    numbers = spark.createDataFrame([(r["_l"], i, r["n"]) for i, r in enumerate(stats)],
                                    T.StructType([T.StructField("_l", coded.schema["_l"].dataType), T.StructField("cell", T.IntegerType()),
                                                  T.StructField("n", T.LongType())]))
    numbers = F.broadcast(numbers)
    if dim <= MAX_DIM and len(stats) <= TREE_CLUSTERS and sum(r["n"] for r in stats) > tree_rows:
        numbered = coded.join(numbers, "_l").select("qid", "vec", F.array("cell").alias("labels"))
        return silhouettes_of_labellings(numbered, "qid", [{i: r["n"] for i, r in enumerate(stats)}], tree_rows)[0]
    C = np.array([r["c"] for r in stats])
    V = np.maximum(np.array([r["q"] for r in stats]) - (C * C).sum(1), 0.0)
    shared = spark.sparkContext.broadcast((C, V))
    members = cut_lineage(coded.join(numbers, "_l").select("qid", "vec", "cell", "n"))
    sizes = numbers.select("cell", "n")
    key_type = coded.schema["qid"].dataType

    def candidates(it):
        centre, spread = shared.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            everything, own_all = np.stack(pdf["vec"].to_numpy()), pdf["cell"].to_numpy()
            for s in _by_rows(len(everything), len(centre)):
                X, own = everything[s], own_all[s]
                rows = np.arange(len(X))
                d2 = _distances(X, centre) ** 2
                slack = 1e-6 * (1 + np.sqrt((X * X).sum(1) + (centre * centre).sum(1).max()))
                upper = np.sqrt(d2 + spread)
                upper[rows, own] = np.inf
                meet = np.sqrt(d2) <= (upper.min(1) + slack)[:, None]
                meet[rows, own] = True
                i, c = np.nonzero(meet)
                names = pdf["qid"].to_numpy()[s]
                for at in _by_pairs(len(i), dim):
                    yield pd.DataFrame({"qid": names[i[at]], "cell": c[at].astype("int32"), "_u": 0.0, "_qv": list(X[i[at]])})
    cand = members.select("qid", "vec", "cell").mapInPandas(candidates, T.StructType([
        T.StructField("qid", key_type), T.StructField("cell", T.IntegerType()), T.StructField("_u", T.DoubleType()),
        T.StructField("_qv", T.ArrayType(T.DoubleType()))]))

    def emit(qpdf, Q, rpdf, R):
        return pd.DataFrame({"qid": qpdf["qid"], "cell": qpdf["cell"], "s": exact_distances(Q, R).sum(1)})
    out = T.StructType([T.StructField("qid", key_type), T.StructField("cell", T.IntegerType()), T.StructField("s", T.DoubleType())])
    refs = members.select(F.col("qid").alias("rid"), "vec", "cell")
    sums = _block_join(cand, refs, sizes, "qid", emit, out).groupBy("qid", "cell").agg(F.sum("s").alias("s"))
    own = members.select(F.col("qid").alias("_q"), F.col("cell").alias("_own"))
    met = sums.join(sizes, "cell").join(own, F.col("qid") == F.col("_q"))
    mine = F.col("cell") == F.col("_own")
    per = met.groupBy("qid").agg(F.max(F.when(mine, F.col("n"))).alias("n"),
                                 F.max(F.when(mine, F.expr("try_divide(s, n - 1)"))).alias("a"),
                                 F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    s = F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(F.expr("try_divide(b - a, greatest(a, b))"), F.lit(0.0)))
    return float(per.agg(F.avg(s)).first()[0])


def _scores(S: np.ndarray, L: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """(k, v, n): sum of the silhouettes of some rows and their number, by labelling; ``S`` holds the rows' sums of distances."""
    out, rows = [], np.arange(len(L))
    for k, lo in enumerate(starts[:-1]):
        if np.count_nonzero(counts[lo:starts[k + 1]]) < 2:
            out.append(0.0)  # one cluster has no silhouette
            continue
        n, s = counts[lo:starts[k + 1]], S[:, lo:starts[k + 1]]
        own = L[:, k]
        a = s[rows, own] / np.maximum(n[own] - 1, 1)
        mean = np.where(n > 0, s / np.maximum(n, 1), np.inf)
        mean[rows, own] = np.inf
        b = mean.min(1)
        top = np.maximum(a, b)
        out.append(np.where((n[own] <= 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top)).sum())
    return pd.DataFrame({"k": np.arange(len(out), dtype="int32"), "v": out, "n": len(L)})


def _sums_by_block(points: DataFrame, dim: int, n: int, starts: np.ndarray, width: int, use, schema: str) -> DataFrame:
    """``use`` of the rows of each block and their sums of distances to each cluster, from all pairs of blocks.

    A block is one packed row; blocks meet in Spark's cartesian product, which writes no copies of them, and a task adds up
    what its blocks met before it hands on a sum."""
    blocks, m = max(1, -(-n // QUERY_CHUNK)), len(starts) - 1
    parts = max(1, min(blocks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    side = math.isqrt(4 * parts - 1) + 1  # partitions of each side: a few pairs for every slot
    dealt = points.select("vec", "labels", F.pmod(F.xxhash64("vec", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "code")

    def pack(key, pdf):
        X, L = np.stack(pdf["vec"].to_numpy()).astype(float), np.stack(pdf["labels"].to_numpy()).astype("int32")
        return pd.DataFrame({"block": [key[0]], "x": [X.tobytes()], "l": [L.tobytes()], "c": [pdf["code"].to_numpy("int64").tobytes()]})
    packed = cut_lineage(cut_lineage(dealt).groupBy("block").applyInPandas(pack, "block int, x binary, l binary, c binary"))
    spread = cut_lineage(packed.repartition(min(side, blocks), "block"))
    pairs = spread.crossJoin(spread.select(F.col("x").alias("rx"), F.col("l").alias("rl")))

    def meet(it):
        held: dict[int, np.ndarray] = {}
        for pdf in it:
            for b, x, rx, rl in zip(pdf["block"], pdf["x"], pdf["rx"], pdf["rl"]):
                s = exact_distances(np.frombuffer(x).reshape(-1, dim), np.frombuffer(rx).reshape(-1, dim)) @ hot(
                    np.frombuffer(rl, "int32").reshape(-1, m), starts[:-1], width)
                held[b] = held[b] + s if b in held else s
        for b, s in held.items():
            yield pd.DataFrame({"block": [b], "s": [s.tobytes()]})
    sums = pairs.select("block", "x", "rx", "rl").mapInPandas(meet, "block int, s binary")

    def finish(key, mine, got):
        S = sum((np.frombuffer(s).reshape(-1, width) for s in got["s"]), np.zeros(1))
        return use(S, np.frombuffer(mine["l"].iloc[0], "int32").reshape(-1, m), np.frombuffer(mine["c"].iloc[0], "int64"))
    return packed.select("block", "l", "c").groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(finish, schema)


def silhouettes_of_labellings(points: DataFrame, key: str, sizes: list[dict[int, int]], tree_rows: int = TREE_ROWS) -> list[float | None]:
    """Mean silhouette of each labelling in ``labels`` (array column next to ``key`` and ``vec``); ``sizes`` holds the rows of
    each cluster of each labelling.  One set of block pairs for all of them, or in up to ``far_field.MAX_DIM`` dimensions and
    beyond ``tree_rows`` rows one quadtree.  Rows that share a key count once, with the sum of their distances."""
    starts = np.cumsum([0] + [max(s) + 1 for s in sizes])
    width, n = int(starts[-1]), sum(sizes[0].values())
    counts = np.zeros(width)
    for lo, s in zip(starts, sizes):
        for c, size in s.items():
            counts[lo + c] = size
    dim = points.select(F.size("vec").alias("d")).first()["d"]

    shared = points.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = cut_lineage(shared.select("_key", F.monotonically_increasing_id().alias("code")))
    points = points.join(sized(shared), F.col(key).eqNullSafe(F.col("_key")), "left").select(
        "vec", "labels", F.coalesce("code", F.lit(-1).cast("long")).alias("code"))

    def use(S: np.ndarray, L: np.ndarray, codes: np.ndarray) -> pd.DataFrame:
        alone = codes < 0
        out = _scores(S[alone], L[alone], starts, counts).assign(code=-1, labels=None, s=None)
        if alone.all():
            return out
        rest = pd.DataFrame({"k": -1, "v": 0.0, "n": 0, "code": codes[~alone], "labels": list(L[~alone]), "s": list(S[~alone])})
        return pd.concat([out, rest], ignore_index=True)

    def score_shared(it):
        for pdf in it:
            if len(pdf):
                yield _scores(np.stack(pdf["s"].to_numpy()), np.stack(pdf["labels"].to_numpy()), starts, counts)
    schema = "k int, v double, n long, code long, labels array<int>, s array<double>"
    if dim <= MAX_DIM and n > tree_rows:
        each = sums_by_leaf(points, dim, n, starts[:-1], width, use, schema)
    else:
        each = _sums_by_block(points, dim, n, starts, width, use, schema)
    each = cut_lineage(each)
    together = each.where("k < 0").groupBy("code").agg(F.first("labels").alias("labels"),
                                                       F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    each = each.where("k >= 0").select("k", "v", "n").unionByName(together.select("labels", "s").mapInPandas(score_shared, "k int, v double, n long"))
    found = {r["k"]: r for r in each.groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    return [found[k]["v"] / found[k]["n"] if len(s) >= 2 else None for k, s in enumerate(sizes)]
