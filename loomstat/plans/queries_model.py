"""Registered model queries: training, CV, comparison, tuning, scoring, clustering,
reduction and anomaly detection.

Deterministic results carry a DuckDB oracle (exact k-NN join, LOF, OLS and ridge
coefficients, Gaussian NB moments); stochastic learners (forests, boosting,
k-means, isolation forest, FastICA) are registered without one and get the
rows-only check.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.operators import anomaly as AN
from loomstat.operators import cluster as CL
from loomstat.operators import reduce as RD
from loomstat.operators import train as TR
from loomstat.operators.boosting import NewtonBoost
from loomstat.operators.knn import knn_join
from loomstat.plans.catalog import T as TBL
from loomstat.plans.catalog import register


def _orders(spark, sf):
    return TBL(spark, sf, "orders").drop("o_orderdate")


def _docs_labelled(spark, sf):
    lab, doc = TBL(spark, sf, "labels"), TBL(spark, sf, "documents")
    return lab.join(doc.select("doc_id", "n_chars", "lang", "source"), "doc_id").drop("toxic")


# ------------------------------------------------------------------ exact neighbours
EMB = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@register("knn_embeddings",
          f"SELECT qid, rid, round(d, 6) AS dist, rk AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS rid, "
          f"list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), "
          f"b.vec_id) AS rk FROM {EMB} a JOIN {EMB} b ON a.vec_id <> b.vec_id) WHERE rk <= 5")
def _q_knn(spark, sf):
    emb = CL.array_column(TBL(spark, sf, "embeddings"), "embedding", "vec_id")
    nb = knn_join(emb.withColumnRenamed("vec_id", "qid"), emb.withColumnRenamed("vec_id", "rid"), 5,
                  exclude_self=True)
    return nb.select("qid", "rid", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


_STD_PART = ("(SELECT p_partkey AS id, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) "
             "AS x, (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) "
             "FROM part) AS y FROM part)")


@register("ano_lof",
          f"WITH s AS {_STD_PART}, pr AS (SELECT a.id AS q, b.id AS r, sqrt((a.x - b.x) * (a.x - b.x) + "
          f"(a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.id <> b.id), "
          f"nb AS (SELECT * FROM (SELECT q, r, d, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rk FROM pr) "
          f"WHERE rk <= 20), kd AS (SELECT q AS r, d AS kd FROM nb WHERE rk = 20), "
          f"lrd AS (SELECT nb.q, 1 / (avg(greatest(nb.d, kd.kd)) + 1e-10) AS lrd FROM nb JOIN kd ON nb.r = kd.r "
          f"GROUP BY nb.q), lof AS (SELECT nb.q, -(avg(l2.lrd) / any_value(l1.lrd)) AS sc FROM nb "
          f"JOIN lrd l2 ON nb.r = l2.q JOIN lrd l1 ON nb.q = l1.q GROUP BY nb.q) "
          f"SELECT q AS p_partkey, round(sc, 6) AS anomaly_score, sc < (SELECT quantile_cont(sc, 0.05) FROM lof) "
          f"AS is_anomaly FROM lof")
def _q_lof(spark, sf):
    mat = CL.prepare_matrix(TBL(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])
    r = AN.local_outlier_factor(mat, "p_partkey", 20, 0.05)
    return r.select("p_partkey", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


# ------------------------------------------------------------------ linear / NB closed forms
@register("reg_lir_coef",
          "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem "
          "UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem")
def _q_lir(spark, sf):
    c = TR.fit_coefficients(TBL(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "lir")
    return c.select("term", F.round("coefficient", 4).alias("coefficient"))


@register("reg_rr_coef",
          "WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) "
          "AS my, sum((x - (SELECT avg(x) FROM t)) * (y - (SELECT avg(y) FROM t))) AS sxy, sum((x - (SELECT avg(x) "
          "FROM t)) * (x - (SELECT avg(x) FROM t))) AS sxx FROM t) SELECT 'l_quantity' AS term, round(sxy / (sxx + 1e6), 4) "
          "AS coefficient FROM m UNION ALL SELECT 'intercept', round(my - sxy / (sxx + 1e6) * mx, 4) FROM m")
def _q_rr(spark, sf):
    # ridge with alpha = 1e6 (large enough to move the slope): slope = Sxy / (Sxx + alpha) on
    # centred data, intercept unpenalised
    c = TR.fit_coefficients(TBL(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "rr", alpha=1e6)
    return c.select("term", F.round("coefficient", 4).alias("coefficient"))


@register("clf_nb_stats",
          "SELECT l_returnflag AS class, 'l_discount' AS feature, round(avg(l_discount), 4) AS mean, "
          "round(var_pop(l_discount), 4) AS var FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', "
          "round(avg(l_tax), 4), round(var_pop(l_tax), 4) FROM lineitem GROUP BY 1")
def _q_nb(spark, sf):
    s = TR.naive_bayes_stats(TBL(spark, sf, "lineitem"), "l_returnflag", ["l_discount", "l_tax"])
    return s.select("class", "feature", F.round("mean", 4).alias("mean"), F.round("var", 4).alias("var"))


# ------------------------------------------------------------------ one Newton tree, by SQL
def _stumps(model, classes, features):
    """(class, feature, threshold, left, right, gain) of the single split of each tree."""
    rows = []
    for c, tree in zip(classes, model.trees[0]):
        rows.append((c, features[int(tree.feature[0])], float(tree.threshold[0]), round(float(tree.value[1]), 6),
                     round(float(tree.value[2]), 6), round(float(tree.gain[0]), 3)))
    return rows


_STUMP = "class string, feature string, threshold double, left_leaf double, right_leaf double, gain double"


def _stump_sql(table: str, g: str, h: str, classes: str, features: list[str]) -> str:
    """The best split of gradients ``g`` and curvatures ``h`` (SQL over ``table`` joined with ``classes``)."""
    cells = " UNION ALL ".join(f"SELECT class, '{f}' AS feature, {i} AS i, CAST({f} AS DOUBLE) AS x, g, h FROM s"
                               for i, f in enumerate(features))
    return (f"WITH s AS (SELECT class, t.*, {g} AS g, {h} AS h FROM {table} t, {classes}), c AS ({cells}), "
            "v AS (SELECT class, feature, i, x, sum(g) AS g, sum(h) AS h FROM c GROUP BY ALL), "
            "l AS (SELECT class, feature, i, lead(x) OVER w AS threshold, sum(g) OVER w AS gl, sum(h) OVER w AS hl, "
            "sum(g) OVER (PARTITION BY class, feature) AS gt, sum(h) OVER (PARTITION BY class, feature) AS ht FROM v "
            "WINDOW w AS (PARTITION BY class, feature ORDER BY x)), "
            "k AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM l "
            "WHERE threshold IS NOT NULL AND hl >= 1 AND ht - hl >= 1), "
            "b AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY gain DESC, i, threshold) AS r FROM k) "
            "SELECT class, feature, threshold, round(-0.3 * gl / (hl + 1), 6) AS left_leaf, "
            "round(-0.3 * (gt - gl) / (ht - hl + 1), 6) AS right_leaf, round(gain, 3) AS gain FROM b WHERE r = 1")


_STUMP_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _stump_rows(spark, sf, label, n_classes):
    li = TBL(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _STUMP_FEATURES], label.alias("label"))
    rows = VectorAssembler(inputCols=_STUMP_FEATURES, outputCol="features").transform(li)
    return NewtonBoost(n_classes=n_classes, max_depth=1, rounds=1).fit(rows)


@register("reg_xgb_stump", _stump_sql("lineitem", "(SELECT avg(l_extendedprice) FROM lineitem) - l_extendedprice", "1.0",
                                      "(SELECT 'all' AS class)", _STUMP_FEATURES))
def _q_reg_stump(spark, sf):
    m = _stump_rows(spark, sf, F.col("l_extendedprice"), 0)
    return spark.createDataFrame(_stumps(m, ["all"], _STUMP_FEATURES), _STUMP)


@register("clf_xgb_stump", _stump_sql("lineitem", "1.0 / 3 - CASE WHEN l_returnflag = class THEN 1 ELSE 0 END", "4.0 / 9",
                                      "(SELECT DISTINCT l_returnflag AS class FROM lineitem) k", _STUMP_FEATURES))
def _q_clf_stump(spark, sf):
    flags = ["A", "N", "R"]
    label = F.array_position(F.array(*[F.lit(x) for x in flags]), F.col("l_returnflag")).cast("double") - 1
    return spark.createDataFrame(_stumps(_stump_rows(spark, sf, label, 3), flags, _STUMP_FEATURES), _STUMP)


@register("clf_xgb_logistic_stump", _stump_sql(
    "lineitem", "(SELECT avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) FROM lineitem) - CASE WHEN l_linestatus = 'O' "
    "THEN 1 ELSE 0 END", "(SELECT avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) * (1 - avg(CASE WHEN l_linestatus = 'O' "
    "THEN 1 ELSE 0 END)) FROM lineitem)", "(SELECT 'O' AS class)", _STUMP_FEATURES))
def _q_logistic_stump(spark, sf):
    m = _stump_rows(spark, sf, (F.col("l_linestatus") == "O").cast("double"), 2)
    return spark.createDataFrame(_stumps(m, ["O"], _STUMP_FEATURES), _STUMP)


# ------------------------------------------------------------------ training (rows-only)
def _metrics(r, spark):
    return r.metrics_frame(spark)


for _m in ("lr", "rf", "dtc", "nb", "xgb", "svm", "knn"):
    register(f"train_clf_{_m}")(
        (lambda m: lambda spark, sf: _metrics(TR.train_model(_orders(spark, sf), "o_orderstatus", m,
                                                             "classification", key="o_orderkey"), spark))(_m))
for _m in ("lir", "pr", "lar", "rr", "dtr", "rfr", "xgb"):
    register(f"train_reg_{_m}")(
        (lambda m: lambda spark, sf: _metrics(TR.train_model(
            TBL(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                              "l_returnflag", "l_extendedprice")
            .drop("l_orderkey", "l_linenumber"),
            "l_extendedprice", m, "regression", degree=2), spark))(_m))  # lineitem has no unique key: content hash


@register("train_clf_binary_balanced")
def _q_train_bin(spark, sf):
    r = TR.train_model(_docs_labelled(spark, sf), "quality", "lr", "classification", key="doc_id",
                       class_weight="balanced", return_train_score=True)
    return r.metrics_frame(spark)


@register("train_cv")
def _q_cv(spark, sf):
    table, _, _ = TR.cross_validate(_orders(spark, sf), "o_orderstatus", "nb", "classification", 5, "o_orderkey")
    return table


@register("compare_models")
def _q_compare(spark, sf):
    return TR.compare_models(_docs_labelled(spark, sf), "quality", "classification", key="doc_id")[0]


@register("tune_grid")
def _q_tune(spark, sf):
    return TR.tune(_docs_labelled(spark, sf), "quality", "dtc", "classification", "grid", cv=3, key="doc_id").table


@register("tune_random")
def _q_tune_random(spark, sf):
    return TR.tune(_docs_labelled(spark, sf), "quality", "lr", "classification", "random", cv=3, n_iter=3,
                   key="doc_id").table


@register("learn_curve")
def _q_lc(spark, sf):
    return TR.learning_curve(_docs_labelled(spark, sf), "quality", "nb", "classification", cv=3, key="doc_id")


@register("score_all")
def _q_score_all(spark, sf):
    o = _orders(spark, sf)
    r = TR.train_model(o, "o_orderstatus", "dtc", "classification", key="o_orderkey")
    return TR.prediction_distribution(TR.score(r.model, o), "classification")


@register("score_json")
def _q_score_json(spark, sf):
    ev = TBL(spark, sf, "events")
    schema = T.StructType([T.StructField("k", T.DoubleType())])
    train = ev.select("event_id", F.from_json("props", schema)["k"].alias("k"), "value")
    r = TR.train_model(train, "value", "lir", "regression", key="event_id")
    scored = TR.score_json(r.model, ev.select("event_id", "props"), "props", schema)
    return scored.select("event_id", "k", F.round("prediction", 4).alias("prediction"))


@register("feat_importance")
def _q_fi(spark, sf):
    r = TR.train_model(_orders(spark, sf), "o_orderstatus", "dtc", "classification", key="o_orderkey")
    return spark.createDataFrame(TR.feature_importance(r.model, r.plan), "feature string, importance double")


# ------------------------------------------------------------------ clustering / reduction / anomaly (rows-only)
def _part_mat(spark, sf):
    return CL.prepare_matrix(TBL(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


@register("clu_kmeans")
def _q_kmeans(spark, sf):
    lab, _, _ = CL.kmeans(_part_mat(spark, sf), "p_partkey", 3)
    return CL.cluster_sizes(lab)


@register("clu_dbscan")
def _q_dbscan(spark, sf):
    emb = CL.array_column(TBL(spark, sf, "embeddings"), "embedding", "vec_id")
    return CL.cluster_sizes(CL.dbscan(emb, "vec_id", eps=3.0, min_samples=5))


@register("clu_silhouette")
def _q_sil(spark, sf):
    mat = _part_mat(spark, sf)
    lab, _, _ = CL.kmeans(mat, "p_partkey", 3)
    return spark.createDataFrame([(CL.silhouette(lab.join(mat, "p_partkey"), "p_partkey"),)], "silhouette double")


@register("clu_best_k")
def _q_bestk(spark, sf):
    emb = CL.array_column(TBL(spark, sf, "embeddings"), "embedding", "vec_id")
    return CL.best_k(emb, "vec_id", 5)


@register("clu_report")
def _q_report(spark, sf):
    part = TBL(spark, sf, "part")
    lab, _, _ = CL.kmeans(_part_mat(spark, sf), "p_partkey", 3)
    return CL.cluster_report(part.join(lab, "p_partkey"), ["p_size", "p_retailprice"], "cluster")


@register("red_pca")
def _q_pca(spark, sf):
    li = TBL(spark, sf, "lineitem")
    li = li.withColumn("_k", F.xxhash64(*li.columns))  # lineitem has no unique key: content hash
    mat = CL.prepare_matrix(li, "_k", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    out, _ = RD.pca(mat, "_k", 2)
    return out


@register("red_ica")
def _q_ica(spark, sf):
    out, _ = RD.ica(_part_mat(spark, sf), "p_partkey", 2)
    return out


@register("ano_iforest")
def _q_iforest(spark, sf):
    ev = TBL(spark, sf, "events")
    mat = CL.prepare_matrix(ev, "event_id", ["value", "user_id"], nulls="zero")
    return AN.isolation_forest(mat, "event_id", contamination=0.05)


@register("ano_top")
def _q_ano_top(spark, sf):
    ev = TBL(spark, sf, "events")
    mat = CL.prepare_matrix(ev, "event_id", ["value", "user_id"], nulls="zero")
    return AN.top_anomalies(AN.isolation_forest(mat, "event_id"), "event_id", 10)


@register("clu_meanshift")
def _q_meanshift(spark, sf):
    emb = CL.array_column(TBL(spark, sf, "embeddings"), "embedding", "vec_id")
    lab, _ = CL.mean_shift(emb, "vec_id")
    return CL.cluster_sizes(lab)


# ------------------------------------------------------------------ encoding reuse, dry run, evaluation
@register("apply_encoding",
          "WITH m AS (SELECT p_type AS value, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM "
          "(SELECT DISTINCT coalesce(p_type, 'nan') AS p_type FROM part WHERE p_size <= 10)) "
          "SELECT p.p_partkey, coalesce(m.code, -1) AS p_type FROM part p LEFT JOIN m ON coalesce(p.p_type, 'nan') = m.value")
def _q_apply_enc(spark, sf):
    from loomstat.operators import clean as C
    part = TBL(spark, sf, "part")
    mapping, n = C.label_mapping(part.where(F.col("p_size") <= 10), "p_type")
    return C.apply_mapping(part.select("p_partkey", "p_type"), "p_type", mapping, n, unseen=-1)


@register("train_dry_run",
          " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS position, (SELECT count(*) FROM orders WHERE "
                             f"o_orderstatus IS NOT NULL) AS rows" for i, c in
                             enumerate(["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])))
def _q_dry(spark, sf):
    return TR.train_dry_run(_orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                      "o_orderpriority"), "o_orderstatus")


@register("score_head")
def _q_score_head(spark, sf):
    o = _orders(spark, sf)
    r = TR.train_model(o, "o_orderstatus", "nb", "classification", key="o_orderkey")
    return TR.score_head(r.model, o.drop("o_orderstatus"), "o_orderkey", 20)


@register("eval_model")
def _q_eval(spark, sf):
    d = _docs_labelled(spark, sf)
    r = TR.train_model(d, "quality", "lr", "classification", key="doc_id")
    return TR.evaluate_model(r.model, d, "quality")


@register("train_confusion")
def _q_confusion_of_training(spark, sf):
    r = TR.train_model(_orders(spark, sf), "o_orderstatus", "nb", "classification", key="o_orderkey")
    return r.extra["confusion"]


@register("roc_by_class")
def _q_roc_by_class(spark, sf):
    o = _orders(spark, sf)
    r = TR.train_model(o, "o_orderstatus", "nb", "classification", key="o_orderkey")
    return TR.roc_by_class(r.model, o, "o_orderstatus")[1]


@register("pred_actual")
def _q_pred_actual(spark, sf):
    li = TBL(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    li = li.withColumn("_k", F.xxhash64(*li.columns))
    r = TR.train_model(li, "l_extendedprice", "lir", "regression", key="_k")
    _, pts = TR.predictions_vs_actual(r.model, li, "l_extendedprice", "_k")
    return pts


@register("ano_labels")
def _q_ano_labels(spark, sf):
    ev = TBL(spark, sf, "events").drop("ts")
    return AN.anomaly_detection(ev, "event_id", ["value", "user_id"], "isolation_forest", 0.05, save_labels=True)


@register("algo_registry")
def _q_registry(spark, sf):
    from pyspark.ml.classification import LinearSVC
    TR.register_estimator("lsvc", "classification",
                          lambda fc, lc, n, k, **p: LinearSVC(featuresCol=fc, labelCol=lc, regParam=0.01))
    r = TR.train_model(_docs_labelled(spark, sf), "quality", "lsvc", "classification", key="doc_id")
    return r.metrics_frame(spark)
