"""Clustering: k-means (MLlib), DBSCAN, exact Euclidean silhouette, best-k
search and the per-cluster report.

Inputs are prepared once: numeric feature columns (nulls handled by
``nulls=`` error / zero / drop), standardised with the population std, as a
``vec`` array column next to a row key.
"""

from __future__ import annotations

import itertools
import warnings

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.exprs import col_of, numeric_columns
from loomstat.functions.ordered import dense_positions
from loomstat.operators.clean import scale
from loomstat.operators.knn import _by_rows, assign_cells, knn_join, range_forest, range_join, range_min, range_sums
from loomstat.operators.silhouette import exact_distances, mean_silhouette, silhouettes_of_labellings
from loomstat.operators.split import sample_n
from loomstat.session import FEW_ROWS, cut_lineage, rewritten, sized


def prepare_matrix(df: DataFrame, key: str, features: list[str] | None = None, nulls: str = "error",
                   standardize: bool = True) -> DataFrame:
    """``(key, vec)`` with standardised numeric features."""
    feats = features or [c for c in numeric_columns(df) if c != key]
    d = df.select(col_of(key), *[col_of(c).cast("double").alias(c) for c in feats])
    if nulls == "drop":
        d = d.dropna(subset=feats)
    elif nulls == "zero":
        d = d.fillna(0.0, subset=feats)
    elif d.where(" OR ".join(f"`{c}` IS NULL" for c in feats)).limit(1).count():
        raise ValueError("feature columns hold nulls; pass nulls='zero' or 'drop'")
    if standardize:
        d, _ = scale(d, feats, "standard")
    return d.select(col_of(key), F.array(*[col_of(c).cast("double") for c in feats]).alias("vec"))


def array_column(df: DataFrame, column: str, key: str) -> DataFrame:
    """``(key, vec)`` from an array column (e.g. embeddings), as doubles."""
    return df.select(col_of(key), F.transform(col_of(column), lambda x: x.cast("double")).alias("vec"))


# ------------------------------------------------------------------ k-means
def kmeans(mat: DataFrame, key: str, k: int = 3, seed: int = 42, max_iter: int = 100):
    """Labels ``(key, cluster)``, centres and inertia (sum of squared distances)."""
    d = mat.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(d)
    labels = model.transform(d).select(col_of(key), F.col("cluster").cast("int").alias("cluster"))
    return labels, [c.tolist() for c in model.clusterCenters()], float(model.summary.trainingCost)


# ------------------------------------------------------------------ silhouette, number of clusters
def silhouette(labelled: DataFrame, key: str, label: str = "cluster", sample: int | None = None, seed: int = 42,
               squared: bool = False) -> float | None:
    """Mean Euclidean silhouette (noise label −1 removed) of all rows, or of a hash sample of ``sample`` of them.

    Exact and quadratic in the rows (``operators.silhouette``); ``squared`` takes squared distances instead, which a sum and a
    sum of squares a cluster give in one pass."""
    d = labelled.where(F.col(label) != -1)
    if sample is not None:
        d = sample_n(d.select(key, "vec", label), key, sample, seed)
    if squared:
        if d.select(label).distinct().limit(2).count() < 2:
            return None
        points = d.select(array_to_vector("vec").alias("features"), F.col(label).cast("double").alias("prediction"))
        return float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(points))
    return mean_silhouette(d, key, label)


#: Rows that starting centres are drawn from.
START_ROWS = 10_000


def _spread_out(X: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """``most`` starting centres, each drawn with probability in proportion to its squared distance from those before."""
    picked = [int(rng.integers(len(X)))]
    d = ((X - X[picked[0]]) ** 2).sum(1)
    while len(picked) < most:
        p = d / d.sum() if d.sum() > 0 else np.full(len(X), 1 / len(X))
        tries = rng.choice(len(X), size=2 + int(np.log(most)), p=p)
        gain = [np.minimum(d, ((X - X[t]) ** 2).sum(1)) for t in tries]
        best = int(np.argmin([g.sum() for g in gain]))
        picked.append(int(tries[best]))
        d = gain[best]
    return X[picked]


def kmeans_of_sizes(mat: DataFrame, key: str, ks: list[int], seed: int = 42, max_iter: int = 100,
                    tol: float = 1e-4) -> tuple[list[np.ndarray], list[float]]:
    """Centres and inertia of k-means for every k in ``ks``: an iteration moves the centres of all of them in one pass, so
    passes do not grow with the number of k's.

    Starting centres are spread out over a hash sample of ``START_ROWS`` rows; a k is done when its centres move by less than
    ``tol`` times the mean variance (squared)."""
    few = sample_n(mat.select(key, "vec"), key, START_ROWS, seed)
    X = np.array([r["vec"] for r in few.collect()], float)
    rng = np.random.default_rng(seed)
    centres = [_spread_out(X, k, rng) for k in ks]
    limit = tol * float(X.var(0).mean()) if len(X) else 0.0
    live, dim, cost = set(range(len(ks))), X.shape[1], [0.0] * len(ks)
    sc = mat.sparkSession.sparkContext
    for i in range(max_iter + 1):
        shared, now = sc.broadcast(centres), sorted(live)

        def move(it):
            sums = [np.zeros((len(C), dim + 2)) for C in shared.value]  # count, cost, vector
            for pdf in it:
                if len(pdf):
                    V = np.stack(pdf["vec"].to_numpy())
                    for w in now:
                        C = shared.value[w]
                        d = ((V * V).sum(1)[:, None] + (C * C).sum(1) - 2 * V @ C.T)
                        own = d.argmin(1)
                        np.add.at(sums[w], own, np.c_[np.ones(len(V)), ((V - C[own]) ** 2).sum(1), V])
            for w in now:
                used = np.flatnonzero(sums[w][:, 0])
                if len(used):
                    yield pd.DataFrame({"w": w, "c": used, "s": list(sums[w][used])})
        cols = [F.sum(F.col("s")[j]) for j in range(dim + 2)]
        rows = mat.select("vec").mapInPandas(move, "w int, c int, s array<double>").groupBy("w", "c").agg(F.array(*cols).alias("s")).collect()
        fresh = [C.copy() for C in centres]
        found = {w: 0.0 for w in now}
        for r in rows:
            fresh[r["w"]][r["c"]] = np.array(r["s"][2:]) / r["s"][0]
            found[r["w"]] += r["s"][1]
        for w in now:
            cost[w] = found[w]
            if ((fresh[w] - centres[w]) ** 2).sum() <= limit or i == max_iter:
                live.discard(w)  # its cost belongs to the centres that it keeps
            else:
                centres[w] = fresh[w]
        shared.unpersist()
        if not live:
            break
    return centres, cost


def best_k(mat: DataFrame, key: str, max_k: int = 10, seed: int = 42, sample: int | None = None) -> DataFrame:
    """k = 2 … min(max_k, n−1): inertia and mean Euclidean silhouette (of a hash sample of ``sample`` rows if given);
    ``best`` marks the first k with the highest silhouette.

    All k are fitted in the same passes, and share the distances of the silhouettes."""
    spark = mat.sparkSession
    schema = "k int, inertia double, silhouette double, best boolean"
    m = mat.select(col_of(key), "vec").persist(StorageLevel.MEMORY_AND_DISK)
    ks = list(range(2, min(max_k, m.count() - 1) + 1))
    if not ks:
        m.unpersist()
        return spark.createDataFrame([], schema)
    centres, cost = kmeans_of_sizes(m, key, ks, seed)
    shared = spark.sparkContext.broadcast(centres)

    def label(it):
        for pdf in it:
            if len(pdf):
                V = np.stack(pdf["vec"].to_numpy())
                own = [((C * C).sum(1) - 2 * V @ C.T).argmin(1) for C in shared.value]
                yield pdf.assign(labels=np.stack(own, 1).astype("int32").tolist())
    few = m if sample is None else sample_n(m, key, sample, seed)
    schema_in = T.StructType([*m.schema.fields, T.StructField("labels", T.ArrayType(T.IntegerType()))])
    labelled = cut_lineage(few.mapInPandas(label, schema_in))
    each = labelled.select(F.posexplode("labels").alias("w", "c")).groupBy("w", "c").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes: list[dict[int, int]] = [{} for _ in ks]
    for r in each:
        sizes[r["w"]][r["c"]] = r["n"]
    found = silhouettes_of_labellings(labelled, key, sizes)
    m.unpersist()
    rows = [(k, round(i, 4), None if v is None else round(v, 4)) for k, i, v in zip(ks, cost, found)]
    best = max(rows, key=lambda r: (-1e9 if r[2] is None else r[2], -r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], schema)


# ------------------------------------------------------------------ DBSCAN
def dbscan(mat: DataFrame, key: str, eps: float = 3.0, min_samples: int = 5) -> DataFrame:
    """``(key, cluster)``; −1 is noise.

    Core points have ≥ ``min_samples`` neighbours within ``eps`` (itself
    included); a border point joins the
    adjacent cluster with the smallest label; clusters are numbered by their
    smallest key.  In at most ``GRID_DIMS`` dimensions cells of a grid whose points are all within ``eps`` stand for them
    (``_grid_cores``), so a dense group costs no more than its rows.  In more, core points are
    joined up through the spanning forest of each bounded block, never through a list of all
    close pairs.  Labels spread by min-label propagation with pointer jumping until nothing
    changes (each round is written and read again).
    """
    points = mat.select(F.col(key).alias("v"), "vec")
    side = _grid_side(points, eps)
    marked, lab = _pivot_cores(points, eps, min_samples) if side is None else _grid_cores(points, eps, min_samples, side)
    lab = cut_lineage(lab)
    if lab.isEmpty():
        return mat.select(key, F.lit(-1).alias("cluster"))
    rest, all_lab = marked.where("NOT core").select("v", "vec"), lab
    if not rest.isEmpty():
        labelled = marked.where("core").join(lab.hint("merge"), "v").select(F.col("v").alias("rid"), "vec", "lab")
        near = range_min(rest, "v", assign_cells(labelled, "rid", "vec", extra=["lab"]), eps, "lab")
        all_lab = lab.unionByName(near.select("v", F.col("m").alias("lab")))
    ids, _n = dense_positions(all_lab.select("lab"), "lab")
    named = all_lab.join(sized(ids), "lab").select(F.col("v").alias(key), F.col("pos").cast("int").alias("cluster"))
    return cut_lineage(mat.select(key).join(named.hint("merge"), key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster")))


def _spread_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(v, lab)``: the smallest of the ``nodes`` (column v) that ``links`` (a, b) connect each one with."""
    edges = rewritten(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = rewritten(nodes.select("v", F.col("v").alias("lab")))
    few = lab.count() <= FEW_ROWS

    def side(df: DataFrame) -> DataFrame:  # at most a row per node
        return F.broadcast(df) if few else df.hint("merge")
    while True:
        prop = edges.join(side(lab.withColumnRenamed("v", "b").withColumnRenamed("lab", "lb")), "b") \
                    .groupBy("a").agg(F.min("lb").alias("m"))
        new = rewritten(lab.join(side(prop.withColumnRenamed("a", "v")), "v", "left")
                        .select("v", F.col("lab").alias("old"), F.least("lab", F.coalesce("m", "lab")).alias("lab")))
        if new.where(F.col("lab") != F.col("old")).isEmpty():
            return lab
        # pointer jumping: a label is itself a node, so take its label too, twice (log-depth convergence)
        for _ in range(2):
            hop = new.select(F.col("v").alias("lab"), F.col("lab").alias("lab2"))
            new = new.select("v", "lab").join(side(hop), "lab", "left").select("v", F.least("lab", F.coalesce("lab2", "lab")).alias("lab"))
            new = rewritten(new)
        lab = new


def _pivot_cores(points: DataFrame, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """``(v, vec, core)`` and ``(v, lab)`` of the core points, from partial counts and spanning forests of bounded blocks."""
    state = assign_cells(points.select(F.col("v").alias("rid"), "vec"), "rid", "vec")
    deg = range_sums(points, "v", state, eps, sums=False)
    marked = cut_lineage(points.join(deg.hint("merge"), "v", "left").select("v", "vec", F.coalesce(F.col("n") >= min_samples, F.lit(False)).alias("core")))
    core = marked.where("core").select("v", "vec")
    if core.isEmpty():
        return marked, core.select("v", F.col("v").alias("lab"))
    core_cells = assign_cells(core.select(F.col("v").alias("rid"), "vec"), "rid", "vec")
    return marked, _spread_labels(core.select("v").distinct(), range_forest(core, "v", core_cells, eps))


#: Dimensions up to which DBSCAN works on a grid, and how far (in eps) from 0 its cells are still told apart safely.
GRID_DIMS, GRID_REACH = 3, 1e6


def _grid_side(points: DataFrame, eps: float) -> float | None:
    """The side of cells whose points are all within ``eps`` of each other; None where a grid does not serve."""
    far = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    r = points.agg(F.min(F.size("vec")).alias("d"), F.max(F.size("vec")).alias("e"), F.max(far).alias("far")).first()
    if r["d"] is None or r["d"] != r["e"] or not 1 <= r["d"] <= GRID_DIMS or not eps > 0 or r["far"] is None or not r["far"] <= GRID_REACH * eps:
        return None
    return eps / r["d"] ** 0.5 * (1 - 1e-9)


def _box(dim: int) -> list:
    """Corners of a group's points, and its first and last point."""
    v = F.col("vec")
    return [F.array(*[F.min(v[i]) for i in range(dim)]).alias("lo"), F.array(*[F.max(v[i]) for i in range(dim)]).alias("hi"),
            F.min(v).alias("p"), F.max(v).alias("q")]


def _length(parts) -> Column:
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x))


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs of boxes (columns of a and, with 2, of b) that may be within ``eps``, and whether they surely are: ``sure``.

    A box's points lie between the smallest and the largest distance of the corners, also in rounded arithmetic, as the
    distance of a pair is the same sum of squares."""
    def minus(x, y):
        return F.zip_with(x, y, lambda a, b: a - b)
    apart = F.zip_with(minus("lo2", "hi"), minus("lo", "hi2"), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    across = F.zip_with(minus("hi2", "lo"), minus("hi", "lo2"), lambda a, b: F.greatest(a, b))
    sure = _length(across) <= eps
    for x in ("p", "q"):
        for y in ("p2", "q2"):
            sure = sure | (_length(minus(x, y)) <= eps)
    return pairs.where(_length(apart) <= eps).withColumn("sure", sure)


def _second(boxes: DataFrame) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{c}2") for c in boxes.columns])


def _grid_cores(points: DataFrame, eps: float, min_samples: int, side: float) -> tuple[DataFrame, DataFrame]:
    """``(v, vec, core)`` and ``(v, lab)`` of the core points.

    A cell with ``min_samples`` rows has core points only, so neighbours are counted for the rows of other cells alone.  Core
    points of a cell are linked.  Cells near one another are linked if two of their core points are within ``eps``: decided
    by the boxes around them where these are near or far enough, else by those of the boxes' parts, and so on down to single
    points; only pairs of cells that nothing else has linked yet go down."""
    dim = points.select(F.size("vec")).first()[0]
    d = points.withColumn("cell", F.transform("vec", lambda x: F.floor(x / F.lit(side))))
    full = d.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("cell", F.lit(True).alias("dense"))
    d = cut_lineage(d.join(sized(cut_lineage(full)), "cell", "left").withColumn("dense", F.coalesce("dense", F.lit(False))))
    found, few = d.where("dense").select("v"), d.where("NOT dense").select("v", "vec")
    if not few.isEmpty():
        state = assign_cells(points.select(F.col("v").alias("rid"), "vec"), "rid", "vec")
        found = found.unionByName(range_sums(few, "v", state, eps, sums=False).where(F.col("n") >= min_samples).select("v"))
    found = found.distinct().withColumn("core", F.lit(True))
    marked = cut_lineage(d.join(found.hint("merge"), "v", "left").select("v", "vec", "cell", F.coalesce("core", F.lit(False)).alias("core")))
    core = marked.where("core").select("v", "vec", "cell")
    boxes = cut_lineage(core.groupBy("cell").agg(F.min("v").alias("first"), *_box(dim)).withColumn("node", F.col("cell")))
    cells = boxes.select("cell", F.col("first").alias("lab"))
    boxes = boxes.drop("first")
    # Rows that share a key are one point.
    same = core.groupBy("v").agg(F.min("cell").alias("cell"), F.max("cell").alias("_last"), F.collect_set("cell").alias("_all")) \
               .where(F.col("cell") != F.col("_last")).select("cell", F.explode("_all").alias("cell2"))
    steps = [o for o in itertools.product(range(-2, 3), repeat=dim) if o > (0,) * dim]
    steps = F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in steps]))
    near = boxes.withColumn("_o", steps).withColumn("cell2", F.zip_with("cell", "_o", lambda a, b: a + b)).drop("_o")
    pairs = cut_lineage(_judged(near.join(sized(_second(boxes)), "cell2"), eps))
    links, parts = pairs.where("sure").select("cell", "cell2").unionByName(same), 4 if dim < 3 else 2
    rows = core.select("vec", "cell", F.col("cell").alias("node"))
    while True:
        labels = cells.select(F.col("cell").alias("cell2"), F.col("lab").alias("lab2"))
        joined = links.join(sized(cells), "cell").join(sized(labels), "cell2").where("lab <> lab2").select(F.col("lab").alias("a"), F.col("lab2").alias("b"))
        joined = cut_lineage(joined.distinct())
        if not joined.isEmpty():
            lowest = _spread_labels(cells.select(F.col("lab").alias("v")).distinct(), joined).withColumnRenamed("lab", "_new")
            cells = rewritten(cells.join(sized(lowest), F.col("lab") == F.col("v")).select("cell", F.col("_new").alias("lab")))
            labels = cells.select(F.col("cell").alias("cell2"), F.col("lab").alias("lab2"))
        open_ = pairs.where("NOT sure").select("node", "node2", "cell", "cell2", "lo", "hi", "lo2", "hi2")
        open_ = rewritten(open_.join(sized(cells), "cell").join(sized(labels), "cell2").where("lab <> lab2").drop("lab", "lab2"))
        if open_.isEmpty():
            break
        ends = open_.select("node", "lo", "hi").unionByName(open_.select(F.col("node2").alias("node"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))).distinct()
        place = F.array(*[F.when(F.col("hi")[i] > F.col("lo")[i], F.least(F.floor((F.col("vec")[i] - F.col("lo")[i]) / (F.col("hi")[i] - F.col("lo")[i]) * parts),
                                                                            F.lit(parts - 1))).otherwise(F.lit(0)).cast("long") for i in range(dim)])
        rows = rewritten(rows.join(sized(ends), "node").select("vec", "cell", F.col("node").alias("up"), F.concat("node", place).alias("node")))
        boxes = cut_lineage(rows.groupBy("cell", "up", "node").agg(*_box(dim)))
        rows = rows.drop("up")
        down = open_.select(F.col("node").alias("up"), F.col("node2").alias("up2"))
        pairs = cut_lineage(_judged(down.join(sized(boxes), "up").join(sized(_second(boxes)), "up2"), eps))
        links = pairs.where("sure").select("cell", "cell2").distinct()
    lab = core.join(sized(cells), "cell").groupBy("v").agg(F.min("lab").alias("lab"))
    return marked.select("v", "vec", "core"), lab


# ------------------------------------------------------------------ mean-shift
HISTOGRAM_BINS, HISTOGRAM_PASSES = 64, 5


def estimate_bandwidth(mat: DataFrame, key: str, quantile: float = 0.3, queries: int = 1000, seed: int = 0) -> float:
    """Mean distance from a row to its ``quantile·n``-th nearest row (itself included) among all n rows, over all rows or, where
    there are more, ``queries`` of them (by hash).

    The distance is a rank among n, found without sorting them: every task bins the distances of its rows to each query, Spark
    adds the histograms, and the bin that holds the rank is cut again (``HISTOGRAM_PASSES`` passes of ``HISTOGRAM_BINS``)."""
    few = sample_n(mat.select(key, "vec"), key, queries, seed)
    Q = np.array([r["vec"] for r in few.collect()], float)
    n, m = mat.count(), len(Q)
    if not m:
        return 0.0
    rank = max(1, int(n * quantile))
    sc = mat.sparkSession.sparkContext
    top = sc.broadcast(Q)

    def farthest(it):
        far = np.zeros(m)
        for pdf in it:
            if len(pdf):
                V = np.stack(pdf["vec"].to_numpy())
                for s in _by_rows(len(V), m):
                    far = np.maximum(far, exact_distances(V[s], top.value).max(0))
        yield pd.DataFrame({"q": np.arange(m), "d": far})
    hi = np.zeros(m)
    for r in mat.select("vec").mapInPandas(farthest, "q long, d double").groupBy("q").agg(F.max("d").alias("d")).collect():
        hi[r["q"]] = r["d"]
    lo, hi = np.zeros(m), np.nextafter(hi, np.inf) + 1e-300
    below = np.zeros(m, np.int64)
    for _ in range(HISTOGRAM_PASSES):
        shared = sc.broadcast((lo, hi))

        def count(it):
            a, b = shared.value
            hist = np.zeros(m * HISTOGRAM_BINS, np.int64)
            for pdf in it:
                if len(pdf):
                    V = np.stack(pdf["vec"].to_numpy())
                    for s in _by_rows(len(V), m):
                        d = exact_distances(V[s], top.value)
                        r, q = np.nonzero((d >= a) & (d < b))
                        at = np.minimum(((d[r, q] - a[q]) / (b - a)[q] * HISTOGRAM_BINS).astype(int), HISTOGRAM_BINS - 1)
                        hist += np.bincount(q * HISTOGRAM_BINS + at, minlength=len(hist))
            used = np.flatnonzero(hist)
            yield pd.DataFrame({"at": used, "n": hist[used]})
        rows = mat.select("vec").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        hist = np.zeros(m * HISTOGRAM_BINS, np.int64)
        hist[rows["at"].to_numpy()] = rows["n"].to_numpy()
        upto = below[:, None] + hist.reshape(m, -1).cumsum(1)
        cell = (upto < rank).sum(1).clip(max=HISTOGRAM_BINS - 1)
        width = (hi - lo) / HISTOGRAM_BINS
        below = np.where(cell > 0, upto[np.arange(m), np.maximum(cell - 1, 0)], below)
        lo, hi = lo + cell * width, np.where(cell == HISTOGRAM_BINS - 1, hi, lo + (cell + 1) * width)
        shared.unpersist()
    return float(((lo + hi) / 2).mean())


def merge_modes(modes: DataFrame, bw: float) -> DataFrame:
    """``(cluster, vec, n)``: modes ``(sid, vec, n)`` that have no kept mode of more points (then smaller vector) within ``bw``.

    Rounds in Spark: an open mode without an open or kept better neighbour is kept, one with a kept better neighbour goes."""
    modes = cut_lineage(modes.select("sid", "vec", F.struct((-F.col("n")).alias("n"), "vec", "sid").alias("p")))
    near = range_join(modes, "sid", bw).where(f"a <> b AND dist < {bw!r}").select("a", "b")
    better = near.join(modes.select(F.col("sid").alias("a"), F.col("p").alias("pa")), "a") \
                 .join(modes.select(F.col("sid").alias("b"), F.col("p").alias("pb")), "b").where("pb < pa")
    better = cut_lineage(better.select("a", "b"))
    open_, kept = modes.select("sid"), modes.select("sid").limit(0)
    while not open_.isEmpty():
        blocked = better.join(open_.withColumnRenamed("sid", "b"), "b", "left_semi").select(F.col("a").alias("sid"))
        fresh = cut_lineage(open_.join(blocked, "sid", "left_anti"))
        kept = cut_lineage(kept.unionByName(fresh))
        gone = better.join(fresh.withColumnRenamed("sid", "b"), "b", "left_semi").select(F.col("a").alias("sid"))
        open_ = cut_lineage(open_.join(fresh, "sid", "left_anti").join(gone, "sid", "left_anti"))
    centres = modes.join(kept, "sid")
    numbers, _ = dense_positions(centres.select("p"), "p")
    return centres.join(numbers, "p").select(F.col("pos").cast("int").alias("cluster"), "vec", (-F.col("p.n")).alias("n"))


def mean_shift(mat: DataFrame, key: str, bandwidth: float | None = None, max_iter: int = 300,
               min_bin_freq: int = 1) -> tuple[DataFrame, DataFrame]:
    """Flat-kernel mean-shift with grid-binned seeds: ``(key, cluster)`` and the centres ``(cluster, vec, n)``.

    Each iteration moves every seed to the mean of the points within the
    bandwidth (one bounded block join over pivot cells, reused between
    iterations); a seed stops when it moves less than 1e-3·bandwidth.
    Converged centres closer than the bandwidth are merged in Spark, most populated
    first; every point takes its nearest centre by a neighbour join."""
    bw = bandwidth or estimate_bandwidth(mat, key)
    if bw <= 1e-100:
        raise ValueError("the bandwidth is 0: more than the quantile of the rows are equal; pass one")
    grid = F.transform("vec", lambda x: F.round(x / F.lit(bw)))
    seeds = mat.groupBy(grid.alias("g")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_bin_freq) \
               .select(F.transform("g", lambda x: x * F.lit(bw)).alias("vec"))
    seeds = cut_lineage(seeds.withColumn("sid", F.monotonically_increasing_id()))
    state = assign_cells(mat.select(F.col(key).alias("rid"), "vec"), "rid", "vec")
    cur = seeds.select("sid", "vec")
    last = cur.withColumn("n", F.lit(0).cast("long"))
    for _ in range(max_iter):
        sums = range_sums(cur, "sid", state, bw)
        new = cur.join(sums, "sid", "left").select(
            "sid", F.when(F.col("n") > 0, F.transform("s", lambda x: x / F.col("n"))).otherwise(F.col("vec")).alias("vec"),
            F.coalesce("n", F.lit(0)).alias("n"), F.col("vec").alias("_old"))
        new = cut_lineage(new)
        moved = new.select(F.sqrt(F.aggregate(F.zip_with("vec", "_old", lambda a, b: (a - b) * (a - b)),
                                              F.lit(0.0), lambda a, x: a + x)).alias("m")) \
                   .where(F.col("m") >= 1e-3 * bw).limit(1).count()
        cur, last = new.select("sid", "vec"), new.select("sid", "vec", "n")
        if not moved:
            break
    else:
        warnings.warn(f"mean-shift stopped after {max_iter} rounds with seeds still moving", stacklevel=2)
    # Converged seeds sit on a few modes: one of each grid cell of 1e-3·bw goes on.
    cell = F.transform("vec", lambda x: F.round(x / F.lit(bw * 1e-3)))
    modes = last.where(F.col("n") > 0).groupBy(cell.alias("_m")).agg(F.min(F.struct((-F.col("n")).alias("n"), "vec", "sid")).alias("p")) \
                .select("p.sid", "p.vec", (-F.col("p.n")).alias("n"))
    centres = cut_lineage(merge_modes(modes, bw))
    near = knn_join(mat.select(F.col(key).alias("qid"), "vec"), centres.select(F.col("cluster").alias("rid"), "vec"), 1)
    return near.select(F.col("qid").alias(key), F.col("rid").cast("int").alias("cluster")), centres


# ------------------------------------------------------------------ reports
def cluster_sizes(labels: DataFrame, label: str = "cluster") -> DataFrame:
    c = labels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    tot = labels.count()
    return c.withColumn("pct", F.round(F.col("size") * 100.0 / F.lit(tot), 2))


def cluster_report(df: DataFrame, features: list[str], label: str, dp: int = 3) -> DataFrame:
    """Size, share (%, 2 dp) and feature means per cluster."""
    total = df.count()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"),
                                 F.round(F.count(F.lit(1)) * 100.0 / max(total, 1), 2).alias("pct"),
                                 *[F.round(F.avg(col_of(c)), dp).alias(f"mean_{c}") for c in features])


def cluster_points(mat: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, list[float]]:
    """``(key, cluster, component_1, component_2)`` for plotting, and the two explained-variance ratios."""
    from loomstat.operators.reduce import pca
    flat, variance = pca(mat, key, 2)
    return flat.join(labels, key), variance


def run_clustering(df: DataFrame, key: str, features: list[str] | None = None, algorithm: str = "kmeans",
                   n_clusters: int = 3, eps: float = 3.0, min_samples: int = 5, seed: int = 42,
                   nulls: str = "error", reduce_dims: str | None = None, n_components: int = 2,
                   save_labels: bool = False, silhouette_sample: int | None = None) -> tuple[DataFrame, dict]:
    """Prepare, optionally reduce (``pca`` or ``ica``), cluster and score (all rows, or a hash sample of
    ``silhouette_sample``: the silhouette is quadratic).

    Returns ``(key, cluster)``, or with ``save_labels`` the input with a ``cluster`` column, and a summary."""
    mat = prepare_matrix(df, key, features, nulls)
    info: dict = {"algorithm": algorithm}
    if reduce_dims:
        from loomstat.operators import reduce as R
        flat, told = {"pca": R.pca, "ica": R.ica}[reduce_dims](mat, key, n_components)
        parts = [c for c in flat.columns if c != key]
        info |= {"reduced": reduce_dims, "components": len(parts)} | ({"variance": told} if reduce_dims == "pca" else {})
        mat = cut_lineage(flat.select(col_of(key), F.array(*[col_of(c) for c in parts]).alias("vec")))
    if algorithm == "kmeans":
        lab, centres, inertia = kmeans(mat, key, n_clusters, seed)
        info.update(inertia=round(inertia, 4), centres=centres)
    elif algorithm == "dbscan":
        lab = dbscan(mat, key, eps, min_samples)
    elif algorithm == "meanshift":
        lab, centres = mean_shift(mat, key)
        info.update(n_clusters=centres.count())
    else:
        raise ValueError(f"Unknown algorithm '{algorithm}'")
    info["silhouette"] = silhouette(lab.join(mat.hint("merge"), key), key, sample=silhouette_sample)
    return (df.join(lab.hint("merge"), key, "left") if save_labels else lab), info

