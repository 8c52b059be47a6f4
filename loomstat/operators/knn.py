"""Exact k-nearest-neighbour and range joins, and the k-NN classifier.

No all-pairs join: reference points are grouped into cells around pivots
(a hash-ordered sample of the references, sqrt(n) of them).  A k-NN query works in
two phases.  First it meets the references of its own cell, which gives a true
bound ``u_q`` on its k-th neighbour distance; then only the cells with
``d(q, p_c) - r_c <= u_q`` (``r_c`` = cell radius), the others of which cannot hold a
neighbour by the triangle inequality.  In few dimensions that is a handful of cells; in
many dimensions distances concentrate, cells overlap and an exact search has to
look at most of them - ``mean_cells`` reports how many.  ``knn_join(approximate=c)`` is the
named way out: the second phase then looks only at the c cells whose pivots are nearest, and
``recall_of`` measures what that costs on a sample of queries.

In more than ``MANY_DIMS`` dimensions there are fewer, larger cells (``_pivots``), and pairs leave a task in bounded slices.

Pivots form a tree of two levels (``PivotTree``): about sqrt(m) groups of about sqrt(m) pivots, each group with a centre
and a radius.  The tree is one Spark broadcast of at most ``MAX_PIVOT_BYTES`` (beyond that there are fewer, larger cells),
and a point looks at the groups first, so finding its cell takes n^(1/4) distances instead of n^(1/2).  What is known of
a cell (rows, chunks) is a table and joined; no plan has a literal per pivot.

Pivot distances are matrix products in blocks of bounded size inside
``mapInPandas``.  Candidate queries meet the references of a cell in a ``cogroup``
keyed by (cell, reference chunk, query chunk): every group is bounded, distances
are matrix products (the ones that decide are recomputed exactly), and only each
block's result leaves the task.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.operators.split import hash_order
from loomstat.operators.stages import Stored, load_json, store_json
from loomstat.session import cut_lineage

#: Numbers in the largest distance array of a task (64 MB of doubles).
MAX_BLOCK = 8_000_000


def euclid(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _distances(X: np.ndarray, P: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of X to all rows of P, by a matrix product."""
    d = (X * X).sum(1)[:, None] + (P * P).sum(1)[None, :] - 2.0 * (X @ P.T)
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


def _slack(X: np.ndarray, P: np.ndarray) -> float:
    """Bound on the error of a matrix-product distance."""
    return 4e-7 * (1.0 + float(np.sqrt(max((X * X).sum(1).max(initial=0), (P * P).sum(1).max(initial=0)))))


def _by_rows(n: int, width: int):
    """Slices of rows whose distance array stays below ``MAX_BLOCK``."""
    step = max(1, MAX_BLOCK // max(width, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def _by_pairs(n: int, dim: int):
    """Slices of (query, cell) pairs that leave a task together: in many dimensions a query meets most cells, and each pair
    has the query's vector."""
    step = max(1, MAX_BLOCK // 4 // max(dim, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


#: Dimensions beyond which a query meets most cells, and the fewest cells there: more would only copy it more often.
MANY_DIMS, MANY_DIM_CELLS = 16, 64
#: Bytes of the largest pivot broadcast.
MAX_PIVOT_BYTES = 64 << 20


class PivotTree:
    """Pivots in groups around the first of them; cells are numbered by group."""

    def __init__(self, P: np.ndarray):
        n_tops = max(1, math.isqrt(len(P)))
        top = np.concatenate([_distances(P[s], P[:n_tops]).argmin(1) for s in _by_rows(len(P), n_tops)]) if len(P) else np.zeros(0, int)
        order = np.argsort(top, kind="stable")
        self.P, used = P[order], np.unique(top)
        self.tops = P[used]
        self.starts = np.r_[np.searchsorted(top[order], used), len(P)]
        self.radii = np.full(len(P), -np.inf)  # of cells; -inf: no reference
        self.top_radii = np.full(len(used), -np.inf)

    def parts(self) -> tuple[np.ndarray, ...]:
        """What is broadcast: arrays only, so that executors need no class to read them."""
        return self.P, self.tops, self.starts, self.radii, self.top_radii

    @classmethod
    def of(cls, parts: tuple[np.ndarray, ...]) -> PivotTree:
        tree = cls.__new__(cls)
        tree.P, tree.tops, tree.starts, tree.radii, tree.top_radii = parts
        return tree

    def learn_radii(self, cells: np.ndarray, radii: np.ndarray) -> None:
        """Radii of the cells that hold references; a group reaches as far as its farthest cell."""
        self.radii[cells] = radii
        for t, (a, b) in enumerate(zip(self.starts, self.starts[1:])):
            reach = np.sqrt(((self.P[a:b] - self.tops[t]) ** 2).sum(1)) + self.radii[a:b]
            self.top_radii[t] = reach.max() if b > a else -np.inf

    def nearest(self, X: np.ndarray) -> np.ndarray:
        """The cell of each row: nearest pivot of the nearest group that has a reference (or, before radii are known, of
        any group)."""
        dead = np.isneginf(self.top_radii) & ~np.isneginf(self.top_radii).all()
        empty = np.isneginf(self.radii) & ~np.isneginf(self.radii).all()
        out = np.zeros(len(X), np.int64)
        for s in _by_rows(len(X), len(self.tops)):
            d = _distances(X[s], self.tops)
            d[:, dead] = np.inf
            top = d.argmin(1)
            for t in np.unique(top):
                rows = np.flatnonzero(top == t) + s.start
                a, b = self.starts[t], self.starts[t + 1]
                for r in _by_rows(len(rows), b - a):
                    near = _distances(X[rows[r]], self.P[a:b])
                    near[:, empty[a:b]] = np.inf
                    out[rows[r]] = a + near.argmin(1)
        return out

    def reach(self, X: np.ndarray, u: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold a point within ``u`` of the row; ``most``: of the nearest pivots only."""
        rows, cells = [], []
        slack = _slack(X, self.P)
        limit = u * (1 + 1e-9) + slack
        for s in _by_rows(len(X), len(self.tops)):
            open_ = _distances(X[s], self.tops) - self.top_radii <= (limit[s] + slack)[:, None]
            for t in np.flatnonzero(open_.any(0)):
                mine = np.flatnonzero(open_[:, t]) + s.start
                a, b = self.starts[t], self.starts[t + 1]
                for r in _by_rows(len(mine), b - a):
                    i, c = np.nonzero(_distances(X[mine[r]], self.P[a:b]) - self.radii[a:b] <= limit[mine[r]][:, None])
                    rows.append(mine[r][i])
                    cells.append(a + c)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, cell = np.concatenate(rows), np.concatenate(cells)
        if most is not None:
            d = ((X[row] - self.P[cell]) ** 2).sum(1)
            order = np.lexsort((cell, d, row))
            row, cell = row[order], cell[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < most
            row, cell = row[keep], cell[keep]
        return row, cell


    def inside(self, X: np.ndarray, row: np.ndarray, cell: np.ndarray, eps: float) -> np.ndarray:
        """Of (row, cell) pairs, those whose cell lies within ``eps`` of the row as a whole."""
        return _distances(X, self.P)[row, cell] + self.radii[cell] <= eps * (1 - 1e-9) - _slack(X, self.P)


@dataclass
class Cells:
    """References with their cells (a checkpointed table), the broadcast tree, rows a cell (a table) and the dimension."""

    refs: DataFrame
    tree: Broadcast
    sizes: DataFrame
    dim: int


def _pivots(n: int, dim: int) -> int:
    """About sqrt(n); in many dimensions cells of ``REF_CHUNK`` rows, as a query is copied for every cell that it meets."""
    root = math.isqrt(max(n, 1))
    return root if dim <= MANY_DIMS else min(root, max(MANY_DIM_CELLS, n // REF_CHUNK))


def assign_cells(refs: DataFrame, rid: str = "rid", vec: str = "vec", n_pivots: int | None = None,
                 extra: list[str] | None = None) -> Cells:
    """Cell of every reference point, frozen by a reliable checkpoint.  ``extra`` columns are carried along."""
    spark = refs.sparkSession
    head = refs.select(F.size(vec).alias("d")).first()
    dim = head["d"] if head else 1
    m = n_pivots or _pivots(refs.count(), dim)
    m = max(1, min(m, MAX_PIVOT_BYTES // (8 * max(dim, 1))))
    rows = refs.select(vec, hash_order(rid, 17).alias("_h"), rid).orderBy("_h", rid).limit(m).collect()
    tree = PivotTree(np.array([r[vec] for r in rows], float).reshape(len(rows), dim))
    first = spark.sparkContext.broadcast(tree.parts())
    extra = extra or []

    def assign(it):
        for pdf in it:
            if len(pdf):
                X, own = np.stack(pdf[vec].to_numpy()), PivotTree.of(first.value)
                c = own.nearest(X)
                yield pdf.assign(cell=c.astype("int32"), dpiv=np.sqrt(((X - own.P[c]) ** 2).sum(1)))
    ref_schema = T.StructType([refs.schema[rid], refs.schema[vec], *[refs.schema[e] for e in extra],
                               T.StructField("cell", T.IntegerType()), T.StructField("dpiv", T.DoubleType())])
    cells = cut_lineage(refs.select(rid, vec, *extra).mapInPandas(assign, ref_schema))
    sizes = cut_lineage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dpiv").alias("r")))
    known = sizes.select("cell", "r").toPandas()  # at most a row per pivot
    tree.learn_radii(known["cell"].to_numpy(), known["r"].to_numpy())
    return Cells(cells, spark.sparkContext.broadcast(tree.parts()), sizes.select("cell", "n"), dim)


REF_CHUNK = 2048     # reference rows per block
QUERY_CHUNK = 2048   # query rows per block


def _block_join(cand: DataFrame, cells: DataFrame, sizes: DataFrame, qid: str, emit, out_schema: T.StructType,
                extra: list[str] | None = None):
    """Cogroup candidate queries with the reference rows of their cells.

    ``cand``: ``(qid, cell, _u, _qv)``; ``cells``: ``(rid, vec, cell)``; ``sizes``: ``(cell, n)``, a row per cell.  A cell
    with many references or many queries is cut into fixed-size chunks on
    both sides (references replicated over query chunks and vice versa), so
    no group exceeds REF_CHUNK x QUERY_CHUNK rows however hot a cell is.
    ``emit(queries, Q, references, R)`` returns the rows of one block.
    """
    cand = cut_lineage(cand)
    asked = cand.groupBy("cell").agg(F.count(F.lit(1)).alias("_nq"))
    chunks = cut_lineage(sizes.join(asked, "cell").select(
        "cell", F.ceil(F.col("n") / REF_CHUNK).cast("int").alias("_sr"), F.ceil(F.col("_nq") / QUERY_CHUNK).cast("int").alias("_sq")))
    chunks = F.broadcast(chunks)  # a row per cell, bounded by the pivots that fit MAX_PIVOT_BYTES
    left = cand.join(chunks, "cell").select(
        qid, "cell", "_u", "_qv", F.explode(F.sequence(F.lit(0), F.col("_sr") - 1)).alias("_rc"),
        F.pmod(F.xxhash64(F.col(qid)), F.col("_sq")).cast("int").alias("_qc"))
    right = cells.join(chunks, "cell").select(
        F.col("rid").alias("_rid"), F.col("vec").alias("_rv"), "cell", *(extra or []),
        F.pmod(F.xxhash64(F.col("rid")), F.col("_sr")).cast("int").alias("_rc"),
        F.explode(F.sequence(F.lit(0), F.col("_sq") - 1)).alias("_qc"))

    def block(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in out_schema.fields})
        return emit(qpdf, np.stack(qpdf["_qv"].to_numpy()), rpdf, np.stack(rpdf["_rv"].to_numpy()))
    return left.groupBy("cell", "_rc", "_qc").cogroup(right.groupBy("cell", "_rc", "_qc")) \
               .applyInPandas(block, out_schema)


def _candidates(queries: DataFrame, qid: str, vec: str, state: Cells, own: bool, eps: float | None = None,
                most: int | None = None, undecided: bool = False) -> DataFrame:
    """``(qid, cell, _u, _qv)``: cells that a query has to look at.

    ``own``: its nearest cell alone, without a bound.  Otherwise the cells with ``d(q, p_c) - r_c <= _u``, where ``_u``
    is ``eps`` or the query's column ``_bound`` (null: unbounded), and, after a first phase, not its nearest cell.
    ``undecided`` leaves out the cells that lie within ``eps`` as a whole (``_of_whole_cells``)."""
    second = eps is None and not own
    shared = state.tree

    def cand(it):
        tree = PivotTree.of(shared.value)
        for pdf in it:
            if len(pdf) == 0:
                continue
            everything = np.stack(pdf[vec].to_numpy())
            for s in _by_rows(len(everything), max(len(tree.P), 1)):
                X = everything[s]
                if own:
                    qi, ci, u = np.arange(len(X)), tree.nearest(X), np.full(len(X), np.inf)
                else:
                    u = pdf["_bound"].to_numpy(float)[s] if second else np.full(len(X), float(eps))
                    u = np.where(np.isnan(u), np.inf, u)
                    qi, ci = tree.reach(X, u, None if most is None else most + 1)
                    if undecided:
                        open_ = ~tree.inside(X, qi, ci, eps)
                        qi, ci = qi[open_], ci[open_]
                    if second:
                        other = ci != tree.nearest(X)[qi]
                        qi, ci = qi[other], ci[other]
                names = pdf[qid].to_numpy()[s]
                for a in _by_pairs(len(qi), X.shape[1]):
                    yield pd.DataFrame({qid: names[qi[a]], "cell": ci[a].astype("int32"), "_u": u[qi[a]], "_qv": list(X[qi[a]])})
    schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField("cell", T.IntegerType()),
                           T.StructField("_u", T.DoubleType()),
                           T.StructField("_qv", T.ArrayType(T.DoubleType()))])
    return queries.select(qid, vec, *(["_bound"] if second else [])).mapInPandas(cand, schema)


def _exact(q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Distances of one point to rows, term by term (the value that decides and is returned)."""
    return np.sqrt(((q[None, :] - R) ** 2).sum(1))


def knn_join(queries: DataFrame, refs: DataFrame, k: int, qid: str = "qid", rid: str = "rid", vec: str = "vec",
             exclude_self: bool = False, n_pivots: int | None = None, stats: dict | None = None,
             approximate: int | None = None) -> DataFrame:
    """``(qid, rid, dist, rank)``: the k nearest references of every query
    (ties by ``rid``).  ``exclude_self`` drops the pair ``qid == rid``.  ``stats`` gets ``mean_cells``, the number of
    cells that a query met, and ``cells``, their number.

    ``approximate`` = c looks only at the query's own cell and the c others with the nearest pivots, whatever the bound:
    distances are exact, but neighbours in farther cells are missed (see ``recall_of``)."""
    state = assign_cells(refs.select(F.col(rid).alias("rid"), F.col(vec).alias("vec")), "rid", "vec", n_pivots)
    cells = state.refs
    rid_type = cells.schema["rid"].dataType
    out_schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField("rid", rid_type),
                               T.StructField("dist", T.DoubleType())])

    def emit(qpdf, Q, rpdf, R):
        qids, rids, U = qpdf[qid].to_numpy(), rpdf["_rid"].to_numpy(), qpdf["_u"].to_numpy()
        order = np.argsort(rids, kind="stable")
        rids, R = rids[order], R[order]
        near, slack = _distances(Q, R), _slack(Q, R)
        if exclude_self:
            near[qids[:, None] == rids[None, :]] = np.inf
        take = min(k, len(rids)) - 1
        limit = np.minimum(np.partition(near, take, axis=1)[:, take], U) + slack
        hit = (near <= limit[:, None]) & np.isfinite(near)
        upto = np.cumsum(hit.sum(1)) * Q.shape[1]
        parts = []
        for few in np.split(np.arange(len(Q)), np.flatnonzero(np.diff(upto // MAX_BLOCK)) + 1):  # bounded differences at a time
            i, j = np.nonzero(hit[few])
            i += few[0]
            d = np.sqrt(((Q[i] - R[j]) ** 2).sum(1))
            order = np.lexsort((j, d, i))  # rows stand in rid order, so ties go to the smaller rid
            i, j, d = i[order], j[order], d[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            parts.append((qids[i[best]], rids[j[best]], d[best]))
        oq, orr, od = zip(*parts)
        return pd.DataFrame({qid: np.concatenate(oq), "rid": np.concatenate(orr), "dist": np.concatenate(od)})

    w = Window.partitionBy(qid).orderBy("dist", "rid")
    q = queries.select(F.col(qid), F.col(vec).alias("_v"))
    first = _block_join(_candidates(q, qid, "_v", state, own=True), cells, state.sizes, qid, emit, out_schema)
    first = cut_lineage(first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    bound = first.where(F.col("rank") == k).select(F.col(qid).alias("_q"), F.col("dist").alias("_bound"))
    bounded = q.join(bound, F.col(qid) == F.col("_q"), "left").drop("_q")
    cand = _candidates(bounded, qid, "_v", state, own=False, most=approximate)
    packed = state.dim > MANY_DIMS and approximate is None
    if stats is not None:
        cand = cand if packed else cut_lineage(cand)
        stats |= {"mean_cells": 1 + cand.count() / max(q.count(), 1), "cells": len(state.tree.value[0])}
    rest = _nearest_by_packs(bounded, qid, state, k, exclude_self, out_schema) if packed else _block_join(cand, cells, state.sizes, qid, emit, out_schema)
    both = first.drop("rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bytes of the references that a task holds at a time.
PACK_BYTES = 64 << 20


def _nearest_by_packs(bounded: DataFrame, qid: str, state: Cells, k: int, exclude_self: bool, out_schema: T.StructType) -> DataFrame:
    """The second phase in many dimensions, where a query meets most cells: the k nearest references of all cells but its nearest.

    Queries and the references of a cell are packed, a block a row, and blocks meet in Spark's cartesian product, which writes
    no copies of them.  A task goes through all references for its queries and keeps their k best, whose last one narrows
    the bound; so what is written has k rows a query, whatever the number of cells."""
    chunks = F.broadcast(state.sizes.select("cell", F.ceil(F.col("n") / REF_CHUNK).cast("int").alias("_s")))  # a row per pivot
    rows = state.refs.join(chunks, "cell").select("rid", "vec", "cell", F.pmod(F.xxhash64("rid"), F.col("_s")).alias("_c"))

    def pack_refs(key, pdf):
        return pd.DataFrame({"cell": [key[0]], "r": [pickle.dumps((pdf["rid"].to_numpy(), np.stack(pdf["vec"].to_numpy())))]})

    def pack_queries(it):
        for pdf in it:
            for a in range(0, len(pdf), QUERY_CHUNK):
                part = pdf.iloc[a:a + QUERY_CHUNK]
                yield pd.DataFrame({"q": [pickle.dumps((part[qid].to_numpy(), np.stack(part["_v"].to_numpy()), part["_bound"].to_numpy(float)))]})
    total, slots = state.sizes.agg(F.sum("n")).first()[0] or 0, int(bounded.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    n_left = max(1, min(-(-bounded.count() // QUERY_CHUNK), 4 * slots))
    left = bounded.select(qid, "_v", "_bound").mapInPandas(pack_queries, "q binary").withColumn("b", F.monotonically_increasing_id())
    left = cut_lineage(left.repartition(n_left, "b"))
    right = rows.groupBy("cell", "_c").applyInPandas(pack_refs, "cell int, r binary")
    right = cut_lineage(right.repartition(max(1, -(-total * 8 * state.dim // PACK_BYTES))))
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl")).coalesce(n_left)
    shared = state.tree

    def meet(it):
        tree, held = PivotTree.of(shared.value), {}
        for pdf in it:
            for b, q, cell, r in zip(pdf["b"], pdf["q"], pdf["cell"], pdf["r"]):
                if b not in held:
                    names, Q, u = pickle.loads(q)
                    u = np.where(np.isnan(u), np.inf, u)
                    held[b] = [names, Q, u, tree.nearest(Q), np.zeros(0, np.int64), pickle.loads(r)[0][:0], np.zeros(0)]
                names, Q, u, own, i0, r0, d0 = held[b]
                pivot = tree.P[cell:cell + 1]
                far = _distances(Q, pivot)[:, 0] - tree.radii[cell]
                mine = np.flatnonzero((own != cell) & (far <= u * (1 + 1e-9) + _slack(Q, pivot)))
                if not len(mine):
                    continue
                rids, R = pickle.loads(r)
                X, limit, slack = Q[mine], u[mine], _slack(Q[mine], R)
                loose = np.flatnonzero(~np.isfinite(limit))
                if len(loose) and len(rids) > k + 1:  # nothing bounds these yet; one place more, for the query itself
                    limit[loose] = np.partition(_distances(X[loose], R), k, axis=1)[:, k]
                near = X @ (-2.0 * R.T)
                near += (R * R).sum(1)
                i, j = np.nonzero(near <= ((limit + slack) ** 2 - (X * X).sum(1))[:, None])
                if exclude_self:
                    other = names[mine[i]] != rids[j]
                    i, j = i[other], j[other]
                d = np.concatenate([np.sqrt(((X[i[a]] - R[j[a]]) ** 2).sum(1)) for a in _by_pairs(len(i), X.shape[1])] or [np.zeros(0)])
                good = d <= limit[i]
                i, ids, d = np.r_[i0, mine[i[good]]], np.concatenate([r0, rids[j[good]]]), np.r_[d0, d[good]]
                order = np.lexsort((np.unique(ids, return_inverse=True)[1], d, i))
                order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
                i, ids, d = i[order], ids[order], d[order]
                last = np.flatnonzero(np.bincount(i, minlength=len(Q)) == k)
                u[last] = np.minimum(u[last], d[np.searchsorted(i, last, side="right") - 1])
                held[b][4:] = i, ids, d
        for names, _, _, _, i, ids, d in held.values():
            yield pd.DataFrame({qid: names[i], "rid": ids, "dist": d})
    return pairs.mapInPandas(meet, out_schema)


def recall_of(found: DataFrame, queries: DataFrame, refs: DataFrame, k: int, qid: str = "qid", rid: str = "rid",
              vec: str = "vec", sample: int = 200, exclude_self: bool = False) -> float:
    """Share of the true k nearest references that ``found`` (a result of ``knn_join``) holds, for a hash sample of queries
    (``sample`` of them, each compared with every reference)."""
    few = queries.orderBy(hash_order(qid, 29), qid).limit(sample)
    rows = [(r[qid], np.array(r[vec], float)) for r in few.select(qid, vec).collect()]
    Q, ids = np.array([v for _, v in rows]).reshape(len(rows), -1), [i for i, _ in rows]
    rt, qt = refs.schema[rid].dataType, queries.schema[qid].dataType

    def best(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            names, R = pdf[rid].to_numpy(), np.stack(pdf[vec].to_numpy())
            for i, q in zip(ids, Q):
                d = _exact(q, R)
                if exclude_self:
                    d = np.where(names == i, np.inf, d)
                near = np.lexsort((names, d))[:k]
                yield pd.DataFrame({"q": i, "r": names[near], "d": d[near]})
    schema = T.StructType([T.StructField("q", qt), T.StructField("r", rt), T.StructField("d", T.DoubleType())])
    w = Window.partitionBy("q").orderBy("d", "r")
    true = refs.select(rid, vec).mapInPandas(best, schema).where(F.col("d") < float("inf"))
    true = true.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("q", "r")
    n = true.count()
    hit = true.join(found, (F.col("q") == F.col(qid)) & (F.col("r") == F.col("rid")), "left_semi").count()
    return hit / n if n else 1.0


def _by_cell(state: Cells, values: DataFrame) -> np.ndarray:
    """The value ``v`` of each cell (a row per pivot at most)."""
    got = values.toPandas()
    out = np.zeros(len(state.tree.value[0]), got["v"].to_numpy().dtype)
    out[got["cell"].to_numpy()] = got["v"].to_numpy()
    return out


def _of_whole_cells(queries: DataFrame, qid: str, vec: str, state: Cells, eps: float, begin, schema) -> DataFrame:
    """What ``begin()``, called once a task, makes of (names, row, cell): the cells that lie within ``eps`` of a query as a
    whole.  Their references are met without a distance or a copy of the query."""
    shared = state.tree

    def run(it):
        tree, use = PivotTree.of(shared.value), begin()
        for pdf in it:
            if len(pdf) == 0:
                continue
            everything = np.stack(pdf[vec].to_numpy())
            for s in _by_rows(len(everything), max(len(tree.P), 1)):
                X = everything[s]
                row, cell = tree.reach(X, np.full(len(X), float(eps)))
                sure = tree.inside(X, row, cell, eps)
                yield from use(pdf[qid].to_numpy()[s], row[sure], cell[sure])
    return queries.select(qid, vec).mapInPandas(run, schema)


def range_sums(queries: DataFrame, qid: str, cells_state, eps: float, vec: str = "vec",
               sums: bool = True) -> DataFrame:
    """``(qid, n, s)``: count and (unless ``sums`` is off) vector sum of the references within ``eps`` of each query.

    ``cells_state`` is the result of :func:`assign_cells` (reused across
    iterations); every block returns one partial (n, sum) per query."""
    cand = _candidates(queries, qid, vec, cells_state, own=False, eps=eps, undecided=not sums)
    out_schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField("n", T.LongType())]
                              + [T.StructField("s", T.ArrayType(T.DoubleType()))] * sums)

    def emit(qpdf, Q, rpdf, R):
        near = within(Q, R, eps)
        return pd.DataFrame({qid: qpdf[qid], "n": near.sum(1)} | ({"s": (near @ R).tolist()} if sums else {}))
    parts = _block_join(cand, cells_state.refs, cells_state.sizes, qid, emit, out_schema)
    if not sums:
        size = _by_cell(cells_state, cells_state.sizes.select("cell", F.col("n").alias("v")))

        def count(names, row, cell):
            n = np.bincount(row, size[cell].astype(float), len(names)).astype(np.int64)
            yield pd.DataFrame({qid: names[n > 0], "n": n[n > 0]})
        parts = parts.unionByName(_of_whole_cells(queries, qid, vec, cells_state, eps, lambda: count, out_schema))
    totals = [F.array(*[F.sum(F.col("s")[i]) for i in range(cells_state.dim)]).alias("s")] if sums else []
    return parts.groupBy(qid).agg(F.sum("n").alias("n"), *totals)


def within(Q: np.ndarray, R: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs are at most ``eps`` apart; pairs that a matrix product cannot decide are computed exactly."""
    d, slack = _distances(Q, R), _slack(Q, R)
    near = d <= eps - slack
    for i, j in np.argwhere(~near & (d <= eps + slack)):
        near[i, j] = np.sqrt(((Q[i] - R[j]) ** 2).sum()) <= eps
    return near


def range_forest(points: DataFrame, key: str, cells_state, eps: float, vec: str = "vec") -> DataFrame:
    """Links ``(a, b)`` that connect whatever points are at most ``eps`` apart: a spanning forest of each block, so a
    block of q queries and r references gives at most q + r links however dense it is."""
    cand = _candidates(points.select(F.col(key).alias("qid"), vec), "qid", vec, cells_state, own=False, eps=eps, undecided=True)
    kt = points.schema[key].dataType

    def emit(qpdf, Q, rpdf, R):
        near = within(Q, R, eps)
        qids, rids = qpdf["qid"].to_numpy(), rpdf["_rid"].to_numpy()
        out, free_q, free_r = [], near.any(1), near.any(0)
        while free_q.any():  # one component at a time: its rows join up through the columns that they reach
            front = np.zeros(len(Q), bool)
            front[np.argmax(free_q)] = True
            free_q &= ~front
            root = qids[np.argmax(front)]
            while front.any():
                cols = free_r & near[front].any(0)
                free_r &= ~cols
                out += [(root, x) for x in rids[cols]]
                front = free_q & near[:, cols].any(1) if cols.any() else np.zeros(len(Q), bool)
                free_q &= ~front
                out += [(root, x) for x in qids[front]]
        a, b = zip(*out) if out else ((), ())
        return pd.DataFrame({"a": list(a), "b": list(b)})
    schema = T.StructType([T.StructField("a", kt), T.StructField("b", kt)])
    links = _block_join(cand, cells_state.refs, cells_state.sizes, "qid", emit, schema)
    # All rows of a cell within reach of a point are joined with it: by the cell's first row, and cells by a forest of each task.
    heads = cut_lineage(cells_state.refs.groupBy("cell").agg(F.min("rid").alias("v")))
    head = _by_cell(cells_state, heads)

    def begin():
        group, met = np.arange(len(head)), np.zeros(len(head), bool)

        def join(names, row, cell):
            order = np.lexsort((cell, row))
            row, cell = row[order], cell[order]
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
            first = cell[start]
            a, b = np.divmod(np.unique(np.repeat(first, np.diff(np.r_[start, len(row)])) * len(head) + cell), len(head))
            out = [(names[row[start]], head[first], np.full(len(first), -1))]
            while len(a):
                apart = group[a] != group[b]
                a, b = a[apart], b[apart]
                if len(a):
                    group[group == group[b[0]]] = group[a[0]]
                    out.append((head[a[:1]], head[b[:1]], np.full(1, -1)))
            fresh = np.unique(cell)
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            out.append((head[fresh], head[fresh], fresh))
            yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(("a", "b", "cell"), zip(*out))})
        return join
    named = points.select(F.col(key).alias("qid"), vec)
    whole = cut_lineage(_of_whole_cells(named, "qid", vec, cells_state, eps, begin, T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])))
    reached = F.broadcast(whole.where("cell >= 0").select("cell").distinct().join(F.broadcast(heads), "cell"))  # a row per pivot at most
    members = cells_state.refs.join(reached, "cell").select(F.col("rid").alias("a"), F.col("v").alias("b"))
    return links.unionByName(whole.select("a", "b")).unionByName(members).where("a <> b").distinct()


def range_min(queries: DataFrame, qid: str, cells_state, eps: float, value: str, vec: str = "vec") -> DataFrame:
    """``(qid, m)``: the smallest ``value`` among the references within ``eps`` of each query that has one."""
    cand = _candidates(queries, qid, vec, cells_state, own=False, eps=eps)

    def emit(qpdf, Q, rpdf, R):
        order = np.argsort(rpdf[value].to_numpy(), kind="stable")
        near = within(Q, R[order], eps)
        hit = near.any(1)
        return pd.DataFrame({qid: qpdf[qid].to_numpy()[hit],
                             "m": rpdf[value].to_numpy()[order][near[hit].argmax(1)]})
    schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType),
                           T.StructField("m", cells_state.refs.schema[value].dataType)])
    return _block_join(cand, cells_state.refs, cells_state.sizes, qid, emit, schema, [value]).groupBy(qid).agg(F.min("m").alias("m"))


def range_join(points: DataFrame, key: str, eps: float, vec: str = "vec") -> DataFrame:
    """All ``(a, b, dist)`` with ``dist <= eps`` among ``points`` (self pairs included): the answer itself, as large as
    it is.  Clustering does not need it (see ``range_forest``)."""
    state = assign_cells(points.select(F.col(key).alias("rid"), F.col(vec).alias("vec")), "rid", "vec")
    q = points.select(F.col(key).alias("qid"), F.col(vec).alias("vec"))
    cand = _candidates(q, "qid", "vec", state, own=False, eps=eps)
    kt = points.schema[key].dataType
    out_schema = T.StructType([T.StructField("qid", kt), T.StructField("rid", kt), T.StructField("dist", T.DoubleType())])

    def emit(qpdf, Q, rpdf, R):
        qi, ri = np.nonzero(within(Q, R, eps))
        return pd.DataFrame({"qid": qpdf["qid"].to_numpy()[qi], "rid": rpdf["_rid"].to_numpy()[ri],
                             "dist": np.sqrt(((Q[qi] - R[ri]) ** 2).sum(1))})
    blocks = _block_join(cand, state.refs, state.sizes, "qid", emit, out_schema)
    return blocks.select(F.col("qid").alias("a"), F.col("rid").alias("b"), "dist")


def vote(neighbours: DataFrame, ref_labels: DataFrame, n_classes: int, k: int,
         qid: str = "qid", label: str = "label") -> DataFrame:
    """Majority class of the neighbours (smallest class on ties) and class shares."""
    j = neighbours.join(ref_labels, "rid")
    c = j.groupBy(qid, label).agg(F.count(F.lit(1)).alias("cnt"))
    agg = c.groupBy(qid).agg(F.min(F.struct((-F.col("cnt")).alias("n"), F.col(label).alias("l"))).alias("best"),
                             F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("int"), "cnt"))).alias("m"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(max(n_classes, 1) - 1)),
                        lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double") / k)
    return agg.select(qid, F.col("best.l").cast("double").alias("prediction"), probs.alias("_proba"))


class KnnModel(Model, Stored):
    def __init__(self, refs: DataFrame, featuresCol: str, k: int, n_classes: int):
        super().__init__()
        self.refs, self.featuresCol, self.k, self.n_classes = refs, featuresCol, k, n_classes

    def _store(self, spark: SparkSession, path: str) -> None:
        store_json(spark, path, "state", {"featuresCol": self.featuresCol, "k": self.k, "n_classes": self.n_classes})
        self.refs.write.parquet(f"{path}/refs")

    @classmethod
    def _restore(cls, spark: SparkSession, path: str) -> KnnModel:
        s = load_json(spark, path, "state")
        return cls(spark.read.parquet(f"{path}/refs"), s["featuresCol"], s["k"], s["n_classes"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        d = cut_lineage(dataset.withColumn("_qid", F.monotonically_increasing_id()))
        q = d.select(F.col("_qid").alias("qid"), vector_to_array(self.featuresCol).alias("vec"))
        nb = knn_join(q, self.refs.select("rid", "vec"), self.k)
        v = vote(nb, self.refs.select("rid", "label"), self.n_classes, self.k)
        out = d.join(v.withColumnRenamed("qid", "_qid"), "_qid", "left")
        return out.withColumn("probability", array_to_vector("_proba")).drop("_proba", "_qid")


class KnnClassifier(Estimator):
    """k-NN with uniform weights on the (already standardised) feature vector."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", k: int = 5):
        super().__init__()
        self.featuresCol, self.labelCol, self.k = featuresCol, labelCol, k

    def _fit(self, dataset: DataFrame) -> KnnModel:
        refs = cut_lineage(dataset.select(F.monotonically_increasing_id().alias("rid"),
                                          vector_to_array(self.featuresCol).alias("vec"),
                                          F.col(self.labelCol).alias("label")))
        n_classes = int(refs.agg(F.max("label")).first()[0] or 0) + 1
        return KnnModel(refs, self.featuresCol, self.k, n_classes)
