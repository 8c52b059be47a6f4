"""Registered cases whose data make a wrong implementation show: fences that remove rows, joins with gaps on both
sides, one fixture for each quality alert, NaN as a missing value, awkward CSV files, and models whose result SQL
can state (linear fits, neighbours, density clusters, silhouettes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import clean as C
from loomstat.operators import cluster as CL
from loomstat.operators import joins as J
from loomstat.operators import profile as P
from loomstat.operators import quality as Q
from loomstat.operators import reduce as RD
from loomstat.operators import train as TR
from loomstat.plans.catalog import T, register
from loomstat.plans.queries_ml import _strat_sql
from loomstat.plans.queries_profile import sql_quality_alerts
from loomstat.plans.queries_sources import scratch
from loomstat.sources import csv as CSV

EV = "(SELECT event_id, user_id, event_type, value FROM events)"


def events(spark, sf):
    return T(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


# ------------------------------------------------------------------ outliers
@register("drop_outliers_iqr_events",
          f"SELECT t.* FROM {EV} t, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) "
          f"WHERE value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a)")
def _q_iqr(spark, sf):
    return C.drop_outliers(events(spark, sf), "value", "iqr")[0]


@register("drop_outliers_std_events",
          f"SELECT t.* FROM {EV} t, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) "
          f"WHERE value >= m - 3 * s AND value <= m + 3 * s")
def _q_std(spark, sf):
    return C.drop_outliers(events(spark, sf), "value", "std")[0]


@register("outlier_samples_events",
          "SELECT 'value' AS column_name, event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS a, "
          "quantile_cont(value, 0.75) AS b FROM events) WHERE value > b + 1.5 * (b - a) OR value < a - 1.5 * (b - a) "
          "ORDER BY event_id LIMIT 5")
def _q_samples(spark, sf):
    return P.outlier_samples(events(spark, sf), "event_id", ["value"])


# ------------------------------------------------------------------ joins with unmatched rows on both sides
_L = "(SELECT o_custkey + 400 AS k, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0)"
_R = "(SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 <> 0)"


def _sides(spark, sf):
    o, c = T(spark, sf, "orders"), T(spark, sf, "customer")
    return (o.where("o_orderkey % 5 = 0").select((F.col("o_custkey") + 400).alias("k"), "o_orderkey", "o_totalprice"),
            c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_name"))


for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    register(f"join_{_how}_gaps", f"SELECT coalesce(l.k, r.k) AS k, o_orderkey, o_totalprice, c_name FROM {_L} l {_word} "
                                  f"{_R} r ON l.k = r.k")(
        (lambda how: lambda spark, sf: J.merge(*_sides(spark, sf), "k", how))(_how))


# ------------------------------------------------------------------ one fixture for each alert
_ALERT_SQL = ("(SELECT event_id, 'x' AS same, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS mostly_zero, "
              "CASE WHEN event_id % 4 <> 0 THEN user_id END AS gaps, value * value * value AS skewed, value AS base, "
              "2 * value + 1 AS line, CASE WHEN event_id % 20 = 0 THEN 'rare' ELSE 'usual' END AS kind, "
              "'u' || CAST(event_id AS VARCHAR) AS name FROM events)")
_ALERT_SCHEMA = [("event_id", "num"), ("same", "cat"), ("mostly_zero", "num"), ("gaps", "num"), ("skewed", "num"),
                 ("base", "num"), ("line", "num"), ("kind", "cat"), ("name", "cat")]
_DUP_SQL = "(SELECT o_orderstatus, o_orderpriority, CAST(round(o_totalprice / 1000) AS BIGINT) AS price FROM orders)"
_DUP_SCHEMA = [("o_orderstatus", "cat"), ("o_orderpriority", "cat"), ("price", "num")]


def _alert_table(spark, sf):
    return T(spark, sf, "events").selectExpr(
        "event_id", "'x' AS same", "CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS mostly_zero",
        "CASE WHEN event_id % 4 <> 0 THEN user_id END AS gaps", "value * value * value AS skewed", "value AS base",
        "2 * value + 1 AS line", "CASE WHEN event_id % 20 = 0 THEN 'rare' ELSE 'usual' END AS kind",
        "concat('u', event_id) AS name")


def _dup_table(spark, sf):
    return T(spark, sf, "orders").selectExpr("o_orderstatus", "o_orderpriority",
                                             "CAST(round(o_totalprice / 1000) AS BIGINT) AS price")


for _mode, _target in (("check", None), ("eda", "kind")):
    register(f"quality_alerts_each_{_mode}", sql_quality_alerts(_ALERT_SQL, _ALERT_SCHEMA, _mode, _target))(
        (lambda m, t: lambda spark, sf: Q.quality_alerts(_alert_table(spark, sf), t, m))(_mode, _target))
    register(f"quality_alerts_dups_{_mode}", sql_quality_alerts(_DUP_SQL, _DUP_SCHEMA, _mode, None))(
        (lambda m: lambda spark, sf: Q.quality_alerts(_dup_table(spark, sf), None, m))(_mode))


# ------------------------------------------------------------------ missing values
_GAPS = "(SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def _nan_events(spark, sf):
    return T(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value"))
                                         .otherwise(F.lit(float("nan"))).alias("value"))


for _s, _e in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)"), ("zero", "0")):
    register(f"fill_{_s}_nan", f"SELECT event_id, user_id, coalesce(value, (SELECT max(f) FROM (SELECT {_e} AS f FROM {_GAPS}))) AS value "
                               f"FROM {_GAPS}")(
        (lambda s: lambda spark, sf: C.fill_nulls(_nan_events(spark, sf), "value", s)[0])(_s))


@register("null_summary_nan",
          f"SELECT 'value' AS column_name, 2 AS position, count(*) - count(value) AS null_count, "
          f"round(CAST(count(*) - count(value) AS DOUBLE) * 100 / count(*), 2) AS null_pct FROM {_GAPS}")
def _q_null_nan(spark, sf):
    return P.null_summary(_nan_events(spark, sf))


def _ranked(a: str, b: str) -> str:
    def rank(x: str) -> str:
        return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 4) AS r FROM (SELECT {rank(a)} AS ra, {rank(b)} "
            f"AS rb FROM {_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@register("corr_spearman_nulls", _ranked("user_id", "value"))
def _q_spearman(spark, sf):
    return P.spearman_pairs(_nan_events(spark, sf), ["user_id", "value"], "event_id")


# ------------------------------------------------------------------ CSV files
@register("src_csv_typed", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, "
                           "CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS c_nationkey FROM customer")
def _q_typed(spark, sf):
    path = scratch(spark, "typed")
    c = T(spark, sf, "customer")
    c.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal").cast("string")).otherwise("N/A")
             .alias("c_acctbal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string"))
             .otherwise("null").alias("c_nationkey")).write.option("header", True).csv(path)
    d = CSV.read_csv(spark, path)
    if dict(d.dtypes) != {"c_custkey": "bigint", "c_acctbal": "double", "c_nationkey": "bigint"}:
        raise TypeError(f"types inferred: {d.dtypes}")
    return d.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@register("src_csv_quoted", "SELECT c_custkey, c_name || chr(10) || 'second, \"line\"' AS note FROM customer")
def _q_quoted(spark, sf):
    path = scratch(spark, "quoted")
    c = T(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit('\nsecond, "line"')).alias("note"))
    c.write.option("header", True).option("escape", '"').csv(path)
    return CSV.read_csv(spark, path)


@register("src_csv_cp1252", "SELECT c_custkey, c_name || ' “€” – œ' AS note FROM customer")
def _q_cp1252(spark, sf):
    path = scratch(spark, "cp1252")
    # The bytes of cp1252, written as the ISO-8859-1 characters that have them.
    tail = " “€” – œ".encode("cp1252").decode("iso-8859-1")
    T(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(tail)).alias("note")).write.option(
        "header", True).option("encoding", "ISO-8859-1").csv(path)
    return CSV.read_csv(spark, path)


@register("src_csv_first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 120")
def _q_first_rows(spark, sf):
    path = scratch(spark, "first")
    T(spark, sf, "customer").select("c_custkey", "c_name").repartitionByRange(4, "c_custkey").sortWithinPartitions(
        "c_custkey").write.option("header", True).csv(path)
    return CSV.read_csv(spark, path, max_rows=120)


# ------------------------------------------------------------------ models that SQL can state
_LIN = "(SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"


def _line(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    p = TR.prepare(li.select("l_quantity", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
                             .alias("k")), "l_extendedprice", "regression", "k", 42)
    return p, p.fit(p.data, "lir", p.n)


@register("score_all_linear", f"SELECT l_orderkey * 10 + l_linenumber AS k, round(a + b * l_quantity, 2) AS prediction "
                              f"FROM lineitem, {_LIN}")
def _q_score_linear(spark, sf):
    p, model = _line(spark, sf)
    return TR.score(model, p.data.select("k", "l_quantity"), ["k"]).select("k", F.round("prediction", 2).alias("prediction"))


@register("pred_actual_linear", f"SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice AS actual, "
                                f"round(a + b * l_quantity, 2) AS predicted FROM lineitem, {_LIN}")
def _q_pred_linear(spark, sf):
    p, model = _line(spark, sf)
    pts = TR.predictions_vs_actual(model, p.data.drop("label"), "l_extendedprice", "k")[1]
    return pts.withColumn("predicted", F.round("predicted", 2))


@register("eval_model_linear",
          f"SELECT round(avg(e * e) / 1e4, 2) AS mse, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, "
          f"round(1 - avg(e * e) / var_pop(y), 4) AS r2, count(*) AS n FROM (SELECT l_extendedprice - (a + b * l_quantity) "
          f"AS e, l_extendedprice AS y FROM lineitem, {_LIN})")
def _q_eval_linear(spark, sf):
    p, model = _line(spark, sf)
    m = TR.evaluate_model(model, p.data.drop("label"), "l_extendedprice")
    return m.select(F.round(F.col("mse") / 1e4, 2).alias("mse"), F.round("rmse", 2).alias("rmse"),
                    F.round("mae", 2).alias("mae"), "r2", "n")


@register("reg_lar_coef",
          "WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT covar_pop(y, x) AS sxy, "
          "var_pop(x) AS sxx, avg(x) AS mx, avg(y) AS my FROM t), w AS (SELECT sign(sxy) * greatest(abs(sxy) - 50000, 0) "
          "/ sxx AS w, mx, my FROM m) SELECT 'l_quantity' AS term, round(w, 2) AS coefficient FROM w "
          "UNION ALL SELECT 'intercept', round(my - w * mx, 0) FROM w")
def _q_lasso(spark, sf):
    c = TR.fit_coefficients(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "lar", alpha=50000.0,
                            max_iter=1000)
    return c.select("term", F.when(F.col("term") == "intercept", F.round("coefficient", 0))
                    .otherwise(F.round("coefficient", 2)).alias("coefficient"))


_CUST = "(SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer)"
_KNN_SPLIT = _strat_sql(_CUST, "c_custkey", "c_mktsegment", 0.2)


@register("clf_knn",
          f"WITH s AS ({_KNN_SPLIT}), z AS (SELECT avg(c_acctbal) AS ma, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS mn, "
          f"stddev_samp(c_nationkey) AS sn FROM s WHERE split = 'train'), v AS (SELECT c_custkey, c_mktsegment, split, "
          f"(c_acctbal - ma) / sa AS x, (c_nationkey - mn) / sn AS y FROM s, z), d AS (SELECT a.c_custkey AS q, "
          f"b.c_mktsegment AS c, row_number() OVER (PARTITION BY a.c_custkey ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2) "
          f"AS rk FROM v a JOIN v b ON a.split = 'test' AND b.split = 'train'), n AS (SELECT q, c, count(*) AS m FROM d "
          f"WHERE rk <= 5 GROUP BY 1, 2) SELECT q AS c_custkey, c AS predicted_label FROM (SELECT q, c, row_number() OVER "
          f"(PARTITION BY q ORDER BY m DESC, c) AS r FROM n) WHERE r = 1")
def _q_clf_knn(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    r = TR.train_model(c, "c_mktsegment", "knn", key="c_custkey")
    return r.predictions.select("c_custkey", "predicted_label")


# ------------------------------------------------------------------ clusters
_STD_CUST = ("(SELECT c_custkey AS v, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) "
             "FROM customer) AS x, (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT "
             "stddev_pop(c_nationkey) FROM customer) AS y, c_nationkey % 3 AS g FROM customer)")


def _cust_mat(spark, sf):
    return CL.prepare_matrix(T(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


@register("clu_dbscan_customer",
          f"WITH RECURSIVE s AS MATERIALIZED {_STD_CUST}, e AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM s a JOIN s b ON "
          f"sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1), core AS MATERIALIZED (SELECT a AS v FROM e GROUP BY a HAVING "
          f"count(*) >= 5), ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT v FROM core) AND b IN (SELECT v FROM "
          f"core)), reach AS (SELECT v AS root, v FROM core UNION SELECT r.root, ce.b FROM reach r JOIN ce ON r.v = ce.a), "
          f"lab AS (SELECT v, min(root) AS lab FROM reach GROUP BY v), every AS (SELECT v, lab FROM lab UNION ALL SELECT e.a, "
          f"min(lab.lab) FROM e JOIN lab ON e.b = lab.v WHERE e.a NOT IN (SELECT v FROM core) GROUP BY e.a), "
          f"num AS (SELECT lab, CAST(row_number() OVER (ORDER BY lab) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT lab FROM lab)) "
          f"SELECT s.v AS c_custkey, coalesce(num.n, -1) AS cluster FROM s LEFT JOIN every ON s.v = every.v "
          f"LEFT JOIN num ON every.lab = num.lab")
def _q_dbscan(spark, sf):
    return CL.dbscan(_cust_mat(spark, sf), "c_custkey", eps=0.1, min_samples=5)


def _silhouette_sql(points: str, power: str = "sqrt") -> str:
    """Mean silhouette of ``points`` (v, x, y, g) from all pairs; ``power`` is sqrt or nothing (squared distances)."""
    return (f"(WITH d AS (SELECT a.v, a.g, b.g AS h, sum({power}((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS t, count(*) AS n "
            f"FROM {points} a, {points} b GROUP BY 1, 2, 3), ab AS (SELECT v, max(t / nullif(n - 1, 0)) FILTER (WHERE g = h) AS a, "
            "min(t / n) FILTER (WHERE g <> h) AS b FROM d GROUP BY v) SELECT round(avg((b - a) / greatest(a, b)), 4) FROM ab)")


def _groups(spark, sf):
    mat = _cust_mat(spark, sf)
    return T(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("cluster")).join(mat, "c_custkey")


@register("clu_silhouette_groups", f"WITH s AS {_STD_CUST} SELECT {_silhouette_sql('s')} AS silhouette")
def _q_silhouette(spark, sf):
    return spark.createDataFrame([(round(CL.silhouette(_groups(spark, sf), "c_custkey"), 4),)], "silhouette double")


@register("clu_silhouette_squared", f"WITH s AS {_STD_CUST} SELECT {_silhouette_sql('s', '')} AS silhouette")
def _q_silhouette_squared(spark, sf):
    return spark.createDataFrame([(round(CL.silhouette(_groups(spark, sf), "c_custkey", squared=True), 4),)], "silhouette double")


# Three groups far apart, so that every algorithm has one right answer.
_BLOB = ("(SELECT p_partkey AS v, p_partkey % 3 AS g, (p_partkey % 3) * 100 + p_size / 10.0 AS a, p_retailprice / 1000 - "
         "(p_partkey % 3) * (p_partkey % 3) * 70 AS b FROM part)")
_STD_BLOB = (f"(SELECT v, g, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS y "
             f"FROM {_BLOB})")
_BLOB_COST = "(SELECT round(sum(var_x + var_y), 4) FROM (SELECT var_pop(x) * count(*) AS var_x, var_pop(y) * count(*) AS var_y FROM s GROUP BY g))"


def _blobs(spark, sf):
    g = F.col("p_partkey") % 3
    return T(spark, sf, "part").select("p_partkey", (g * 100 + F.col("p_size") / 10).alias("a"),
                                       (F.col("p_retailprice") / 1000 - g * g * 70).alias("b"))


def _run_blobs(spark, sf, algorithm):
    return CL.run_clustering(_blobs(spark, sf), "p_partkey", ["a", "b"], algorithm, n_clusters=3, eps=0.3)


for _alg in ("kmeans", "dbscan", "meanshift"):
    @register(f"clu_run_{_alg}", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey % 3) AS first_of_cluster FROM part")
    def _q_run_labels(spark, sf, alg=_alg):
        labels, _ = _run_blobs(spark, sf, alg)
        firsts = labels.where("cluster >= 0").groupBy("cluster").agg(F.min("p_partkey").alias("first_of_cluster"))
        return labels.join(firsts, "cluster").select("p_partkey", "first_of_cluster")


@register("clu_run_summary",
          f"WITH s AS MATERIALIZED {_STD_BLOB}, t AS (SELECT {_silhouette_sql('s')} AS silhouette, {_BLOB_COST} AS cost) "
          "SELECT 'kmeans' AS algorithm, silhouette, cost AS inertia FROM t UNION ALL SELECT 'dbscan', silhouette, NULL FROM t "
          "UNION ALL SELECT 'meanshift', silhouette, NULL FROM t")
def _q_run_summary(spark, sf):
    rows = []
    for alg in ("kmeans", "dbscan", "meanshift"):
        _, info = _run_blobs(spark, sf, alg)
        rows.append((alg, round(info["silhouette"], 4), info.get("inertia")))
    return spark.createDataFrame(rows, "algorithm string, silhouette double, inertia double")


@register("clu_best_k_groups", f"WITH s AS MATERIALIZED {_STD_BLOB} SELECT 3 AS k, {_BLOB_COST} AS inertia, "
                               f"{_silhouette_sql('s')} AS silhouette, true AS best")
def _q_best_k_groups(spark, sf):
    return CL.best_k(CL.prepare_matrix(_blobs(spark, sf), "p_partkey", ["a", "b"]), "p_partkey", 6).where("best")


@register("clu_bandwidth",
          "WITH s AS (SELECT s_suppkey AS v, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x, "
          "(s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS y FROM supplier), d AS (SELECT a.v, "
          "row_number() OVER (PARTITION BY a.v ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS r, "
          "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM s a, s b) SELECT round(avg(d), 4) AS bandwidth FROM d "
          "WHERE r = (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM supplier)")
def _q_bandwidth(spark, sf):
    mat = CL.prepare_matrix(T(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])
    return spark.createDataFrame([(round(CL.estimate_bandwidth(mat, "s_suppkey"), 4),)], "bandwidth double")


@register("clu_report_groups",
          "SELECT c_nationkey AS g, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 2) AS pct, "
          "round(avg(c_acctbal), 3) AS mean_c_acctbal FROM customer GROUP BY 1")
def _q_report(spark, sf):
    return CL.cluster_report(T(spark, sf, "customer").withColumn("g", F.col("c_nationkey")), ["c_acctbal"], "g")


@register("clu_run")
def _q_run(spark, sf):
    labelled, _ = CL.run_clustering(T(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], "kmeans",
                                    n_clusters=4, reduce_dims="pca", save_labels=True)
    return labelled.select("c_custkey", "c_name", "cluster")


@register("red_pca_variance",
          "SELECT round((1 + abs(corr(c_acctbal, c_nationkey))) / 2, 4) AS first, round((1 - abs(corr(c_acctbal, c_nationkey))) / 2, "
          "4) AS second FROM customer")
def _q_pca_variance(spark, sf):
    _, variance = RD.pca(_cust_mat(spark, sf), "c_custkey", 2)
    return spark.createDataFrame([tuple(variance)], "first double, second double")
