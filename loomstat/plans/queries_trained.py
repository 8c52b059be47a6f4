"""Trained models whose results SQL can state: Gaussian naive Bayes over the md5 split and folds, one-column least squares with
its evaluation, search and learning curve, saved models, JSON scoring, report parts, neighbour anomalies."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from loomstat.operators import anomaly as AN
from loomstat.operators import train as TR
from loomstat.operators.trees import ExactTree
from loomstat.plans.catalog import ORACLE, T, cols, register
from loomstat.plans.queries_ml import _h, _strat_sql
from loomstat.plans.queries_profile import CUSTOMER_N_SQL, customer_n, sql_box, sql_describe, sql_histogram, sql_pearson
from loomstat.plans.queries_sources import scratch

# ------------------------------------------------------------------ Gaussian naive Bayes
ORD = ("(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) "
       "- 1 AS code FROM orders)")
FEATS = ["o_custkey", "o_totalprice", "code"]


def _bayes(train: str, test: str, group: str = "1") -> str:
    """CTEs after ``s`` (rows with o_orderstatus): ``p`` with class scores of the ``test`` rows, fitted on the ``train`` rows;
    both are conditions, ``group`` an expression that tells several fits apart (folds)."""
    fits = f"(SELECT DISTINCT {group} AS g FROM s)"
    moments = ", ".join(f"avg({f}) AS m{i}, var_pop({f}) AS v{i}" for i, f in enumerate(FEATS))
    wide = ", ".join(f"var_pop({f})" for f in FEATS)
    score = " + ".join(f"-0.5 * ln(2 * pi() * (v{i} + e)) - ({f} - m{i}) ** 2 / (2 * (v{i} + e))" for i, f in enumerate(FEATS))
    return (f"eps AS (SELECT f.g, 1e-9 * greatest({wide}) AS e, count(*) AS n FROM s, {fits} f WHERE {train} GROUP BY f.g), "
            f"st AS (SELECT f.g, o_orderstatus AS c, count(*) AS nc, {moments} FROM s, {fits} f WHERE {train} GROUP BY 1, 2), "
            f"sc AS (SELECT st.g, s.o_orderkey AS k, s.o_orderstatus AS actual, st.c, ln(nc * 1.0 / n) + {score} AS score FROM s, {fits} f "
            f"JOIN st ON st.g = f.g JOIN eps ON eps.g = f.g WHERE {test}), "
            "p AS (SELECT g, k, actual, c AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY score DESC) AS r "
            "FROM sc) WHERE r = 1)")


def _scores(by: str) -> str:
    """Accuracy and weighted F1 of ``p`` by ``by``."""
    return (f"(SELECT {by}, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END), 4) AS accuracy FROM p GROUP BY {by}) a JOIN "
            f"(SELECT {by}, round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM (SELECT {by}, c, "
            "sum(CASE WHEN actual = c THEN 1 ELSE 0 END) AS support, 2.0 * sum(CASE WHEN actual = c AND predicted = c THEN 1 ELSE 0 END) / "
            "nullif(sum(CASE WHEN actual = c THEN 1 ELSE 0 END) + sum(CASE WHEN predicted = c THEN 1 ELSE 0 END), 0) AS f1 "
            f"FROM p, (SELECT DISTINCT actual AS c FROM p) GROUP BY {by}, c) GROUP BY {by}) b USING ({by})")


_SPLIT = _strat_sql(ORD, "o_orderkey", "o_orderstatus", 0.2)
_HELD = _bayes("split = 'train'", "split = 'test'")
ORACLE["train_clf_nb"] = (
    f"WITH s AS ({_SPLIT}), {_HELD} SELECT accuracy, f1_weighted, 'nb' AS model, (SELECT count(*) FROM s WHERE split = 'test') AS n_test, "
    f"(SELECT count(*) FROM s WHERE split = 'train') AS n_train, 'classification' AS task FROM {_scores('g')}")
ORACLE["train_confusion"] = f"WITH s AS ({_SPLIT}), {_HELD} SELECT actual, predicted, count(*) AS cnt FROM p GROUP BY 1, 2"
_FOLDS = (f"(SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM {ORD})")
ORACLE["train_cv"] = (f"WITH s AS {_FOLDS}, {_bayes('fold <> f.g', 'fold = f.g', 'fold')} SELECT g AS fold, accuracy, f1_weighted "
                      f"FROM {_scores('g')}")
ORACLE["mdl_save"] = (f"WITH s AS ({_SPLIT}), {_bayes('split = ' + chr(39) + 'train' + chr(39), 'true')} SELECT predicted AS predicted_label, "
                      "count(*) AS cnt FROM p GROUP BY 1")
_PROBS = "[" + ", ".join(f"round(sum(CASE WHEN c = '{c}' THEN e END) / sum(e), 4)" for c in "FOP") + "]"
ORACLE["score_head"] = (
    f"WITH s AS ({_SPLIT}), {_bayes('split = ' + chr(39) + 'train' + chr(39), 'true')}, h AS (SELECT k, {_PROBS} AS probability FROM "
    "(SELECT k, c, exp(score - max(score) OVER (PARTITION BY k)) AS e FROM sc) GROUP BY k) SELECT o_orderkey, o_custkey, o_totalprice, "
    "o_orderpriority, CAST(strpos('FOP', predicted) - 1 AS DOUBLE) AS prediction, predicted AS predicted_label, probability FROM s "
    "JOIN p ON p.k = s.o_orderkey JOIN h ON h.k = s.o_orderkey ORDER BY o_orderkey LIMIT 20")

# ------------------------------------------------------------------ the first split of an exact tree
_CUT_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def _cut_sql(stat: str, columns: list[str], score: str) -> str:
    """The best midpoint: ``stat`` lists the statistics of a row (s0, s1, ...), ``score`` what a side of them is worth ({0}: prefix)."""
    names = [x.split(" AS ")[1] for x in stat.split(", ")]
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS i, CAST({c} AS DOUBLE) AS x, {stat} FROM lineitem" for i, c in enumerate(columns))
    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    runs = ", ".join(f"sum({n}) OVER w AS l_{n}, sum({n}) OVER (PARTITION BY feature) AS t_{n}" for n in names)
    rest = ", ".join(f"t_{n} - l_{n} AS r_{n}" for n in names)
    return (f"WITH v AS (SELECT feature, i, x, {sums} FROM ({cells}) GROUP BY 1, 2, 3), r AS (SELECT feature, i, (x + lead(x) OVER w) / 2 AS "
            f"threshold, {runs} FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)), k AS (SELECT *, {rest} FROM r WHERE threshold IS NOT NULL) "
            f"SELECT feature, round(threshold, 6) AS threshold, round(gain, 3) AS gain FROM (SELECT feature, i, threshold, {score.format('l_')} + "
            f"{score.format('r_')} - {score.format('t_')} AS gain FROM k) ORDER BY gain DESC, i, threshold LIMIT 1")


def _first_cut(spark, sf, label, classes):
    """(feature, threshold, gain) of the root, the threshold as the midpoint of the values on either side of it (a large node's
    cut is a histogram's)."""
    li = T(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _CUT_COLUMNS], label.alias("label"))
    m = ExactTree(n_classes=classes, max_depth=1).fit(VectorAssembler(inputCols=_CUT_COLUMNS, outputCol="features").transform(li))
    f, t = F.col(_CUT_COLUMNS[m.tree["feature"][0]]), float(m.tree["threshold"][0])
    ends = li.agg(F.max(F.when(f <= t, f)).alias("a"), F.min(F.when(f > t, f)).alias("b")).first()
    cut = (_CUT_COLUMNS[m.tree["feature"][0]], round((ends["a"] + ends["b"]) / 2, 6), round(float(m.tree["gain"][0]), 3))
    return spark.createDataFrame([cut], "feature string, threshold double, gain double")


@register("clf_dtc_split", _cut_sql(", ".join(f"CASE WHEN l_returnflag = '{c}' THEN 1.0 ELSE 0.0 END AS s{i}" for i, c in enumerate("ANR")),
                                    _CUT_COLUMNS, "({0}s0 * {0}s0 + {0}s1 * {0}s1 + {0}s2 * {0}s2) / ({0}s0 + {0}s1 + {0}s2)"))
def _q_first_cut_class(spark, sf):
    label = F.array_position(F.array(*[F.lit(x) for x in "ANR"]), F.col("l_returnflag")).cast("double") - 1
    return _first_cut(spark, sf, label, 3)


@register("reg_dtr_split", _cut_sql("1.0 AS s0, l_tax * 1000 + l_discount AS s1", _CUT_COLUMNS, "{0}s1 * {0}s1 / {0}s0"))
def _q_first_cut_number(spark, sf):
    return _first_cut(spark, sf, F.col("l_tax") * 1000 + F.col("l_discount"), 0)


# ------------------------------------------------------------------ one column, least squares
_LI = "(SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x, o_totalprice / 1000 + o_custkey / 10.0 AS y FROM orders)"


def _line(spark, sf):
    return T(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("double").alias("x"),
                                         (F.col("o_totalprice") / 1000 + F.col("o_custkey") / 10).alias("y"))


_LI_SPLIT = (f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY {_h('k')}, k) - 1 < (SELECT ceil(count(*) * 0.2) FROM orders) "
             f"THEN 'test' ELSE 'train' END AS split FROM {_LI})")
_HELD_OUT = (f"WITH s AS {_LI_SPLIT}, m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE split = 'train'), "
             "e AS (SELECT y - (a + b * x) AS e, y FROM s, m WHERE split = 'test') SELECT round(avg(e * e), 2) AS mse, "
             "round(sqrt(avg(e * e)), 2) AS rmse, round(1 - avg(e * e) / var_pop(y), 4) AS r2 FROM e")


def _held_out(spark, sf, model, **params):
    m = TR.train_model(_line(spark, sf), "y", model, "regression", key="k", **params).metrics
    return spark.createDataFrame([(round(m["mse"], 2), round(m["rmse"], 2), m["r2"])], "mse double, rmse double, r2 double")


@register("train_reg_lir_line", _HELD_OUT)
def _q_train_line(spark, sf):
    return _held_out(spark, sf, "lir")


@register("train_reg_pr_line", _HELD_OUT)
def _q_train_line_qr(spark, sf):
    return _held_out(spark, sf, "pr", degree=1)


@register("algo_registry_line", _HELD_OUT)
def _q_registered_line(spark, sf):
    from pyspark.ml.regression import LinearRegression
    TR.register_estimator("own_line", "regression", lambda fc, lc, n, k, **p: LinearRegression(featuresCol=fc, labelCol=lc, solver="normal"))
    return _held_out(spark, sf, "own_line")


@register("reg_pr_degree5",
          # A polynomial of degree 5 has no error on values that are one: the fit must give them back.
          "SELECT p_partkey, round((power(p_size / 10.0, 5) - 3 * power(p_size / 10.0, 2) + 1) / 7, 4) AS prediction FROM part")
def _q_degree5(spark, sf):
    s = F.col("p_size") / 10.0
    df = T(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), ((F.pow(s, 5) - 3 * F.pow(s, 2) + 1) / 7).alias("y"))
    r = TR.train_model(df, "y", "pr", "regression", key="p_partkey")
    return TR.score(r.model, df, ["p_partkey"]).select("p_partkey", (F.round("prediction", 4) + 0.0).alias("prediction"))


def _blocks(n: str, k: int) -> str:
    """The plain fold of a row at position ``pos``."""
    return (f"CASE WHEN pos < ({n} // {k} + 1) * ({n} % {k}) THEN pos // ({n} // {k} + 1) ELSE ({n} % {k}) + (pos - ({n} // {k} + 1) * "
            f"({n} % {k})) // ({n} // {k}) END")


_LI_FOLDS = (f"(SELECT k, x, y, {_blocks('n', 3)} AS fold, (CAST('0x' || {_h('k', 43)} AS BIGINT) % 1000000) / 1e6 AS u FROM (SELECT *, "
             f"row_number() OVER (ORDER BY {_h('k')}, k) - 1 AS pos, count(*) OVER () AS n FROM {_LI}))")
ALPHAS = [0.1, 100000000.0, 3000000000.0]


@register("tune_grid_ridge",
          f"WITH s AS {_LI_FOLDS}, g AS (SELECT unnest([0, 1, 2]) AS f), a AS (SELECT unnest({ALPHAS}) AS alpha), m AS (SELECT f, alpha, "
          "avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + alpha) AS w FROM s, g, a WHERE fold <> f "
          "GROUP BY f, alpha), r AS (SELECT f, alpha, round(1 - sum((y - my - w * (x - mx)) ** 2) / (var_pop(y) * count(*)), 4) AS r2 "
          "FROM s JOIN m ON s.fold = m.f GROUP BY f, alpha) SELECT '{''alpha'': ' || CAST(alpha AS VARCHAR) || '}' AS params, "
          "round(avg(r2), 4) AS mean_score, round(stddev_pop(r2), 4) AS std_score FROM r GROUP BY alpha")
def _q_tune_ridge(spark, sf):
    return TR.tune(_line(spark, sf), "y", "rr", "regression", "grid", {"alpha": ALPHAS}, cv=3, key="k").table


SIZES = (0.05, 0.3, 1.0)


@register("learn_curve_line",
          f"WITH s AS {_LI_FOLDS}, g AS (SELECT unnest([0, 1, 2]) AS f), z AS (SELECT unnest({list(SIZES)}) AS size), m AS (SELECT f, size, "
          "regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s, g, z WHERE fold <> f AND u < size GROUP BY f, size), "
          "r AS (SELECT f, size, fold = f AS val, round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 4) AS r2 FROM s, m "
          "WHERE fold = f OR u < size GROUP BY f, size, fold = f) SELECT CAST(size AS DOUBLE) AS train_fraction, "
          "round(avg(r2) FILTER (WHERE NOT val), 4) AS train_mean, round(stddev_pop(r2) FILTER (WHERE NOT val), 4) AS train_std, "
          "round(avg(r2) FILTER (WHERE val), 4) AS val_mean, round(stddev_pop(r2) FILTER (WHERE val), 4) AS val_std FROM r GROUP BY size")
def _q_learning_line(spark, sf):
    return TR.learning_curve(_line(spark, sf), "y", "lir", "regression", cv=3, key="k", sizes=SIZES)


@register("compare_models_line",
          "WITH t AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM s WHERE "
          "split = 'train'), w AS (SELECT 'lir' AS model, sxy / sxx AS w, mx, my FROM t UNION ALL SELECT 'rr', sxy / (sxx + "
          "(SELECT 3 * var_pop(x) * count(*) FROM s)), mx, my FROM t), e AS (SELECT model, avg((y - my - w * (x - mx)) ** 2) AS mse, "
          "var_pop(y) AS v FROM s, w WHERE split = 'test' GROUP BY model) SELECT model, 'ok' AS status, round(1 - mse / v, 4) AS r2, "
          "CAST(row_number() OVER (ORDER BY mse) AS INTEGER) AS rank FROM e".replace("WITH t", f"WITH s AS {_LI_SPLIT}, t", 1))
def _q_compare_line(spark, sf):
    """A heavily damped ridge, registered under a name of its own, against plain least squares."""
    from pyspark.ml.regression import LinearRegression
    line = _line(spark, sf)
    st = line.agg((F.var_pop("x") * F.count("x")).alias("sxx"), F.stddev_pop("x").alias("sx")).first()

    def damped(fc, lc, n, k, **p):
        y = TR.prepare(line, "y", "regression", "k", 42)
        both, train, _ = TR._split(y, 0.2)
        spread = train.agg(F.stddev_pop("y")).first()[0]
        both.unpersist()
        return LinearRegression(featuresCol=fc, labelCol=lc, solver="normal", standardization=False, elasticNetParam=0.0,
                                regParam=3 * st["sxx"] * spread / train.count())
    TR.register_estimator("damped", "regression", damped)
    table, best = TR.compare_models(line, "y", "regression", ["damped", "lir"], key="k")
    if best.metrics["model"] != "lir":
        raise ValueError("the better model is not first")
    return table.select(F.regexp_replace("model", "damped", "rr").alias("model"), "status", F.col("primary").alias("r2"), "rank")


@register("score_json_line",
          "WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value FROM events), m AS (SELECT regr_slope(value, "
          "k) AS b, regr_intercept(value, k) AS a FROM e) SELECT event_id, k, round(a + b * k, 4) AS prediction FROM e, m")
def _q_json_line(spark, sf):
    ev, schema = T(spark, sf, "events"), T_.StructType([T_.StructField("k", T_.DoubleType())])
    p = TR.prepare(ev.select("event_id", F.from_json("props", schema)["k"].alias("k"), "value"), "value", "regression", "event_id", 42)
    out = TR.score_json(p.fit(p.data, "lir", p.n), ev.select("event_id", "props"), "props", schema)
    return out.select("event_id", "k", F.round("prediction", 4).alias("prediction"))


@register("feat_importance_linear",
          "WITH m AS (SELECT var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd, "
          "covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy FROM lineitem) "
          "SELECT 'l_quantity' AS feature, round(abs((dd * qy - qd * dy) / (qq * dd - qd * qd)), 2) AS importance FROM m UNION ALL "
          "SELECT 'l_discount', round(abs((qq * dy - qd * qy) / (qq * dd - qd * qd)), 2) FROM m")
def _q_importance_linear(spark, sf):
    li = T(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_discount",
                                         "l_extendedprice")
    p = TR.prepare(li, "l_extendedprice", "regression", "k", 42)
    rows = TR.feature_importance(p.fit(p.data, "lir", p.n), p.plan)
    return spark.createDataFrame(rows, "feature string, importance double").withColumn("importance", F.round("importance", 2))


# ------------------------------------------------------------------ report parts
_NUM = [c for c in cols("customer", "num")]


def _eda(spark, sf, part):
    from loomstat.plans.eda import eda_report
    return eda_report(customer_n(spark, sf), target="c_mktsegment", key="c_custkey")[part]


_PLAIN = [c for c in _NUM if c != "c_custkey"]
for _part, _sql in {"describe": sql_describe(CUSTOMER_N_SQL, _PLAIN), "histograms": sql_histogram(CUSTOMER_N_SQL, _PLAIN, 20),
                    "box": sql_box(CUSTOMER_N_SQL, _PLAIN), "pearson": sql_pearson(CUSTOMER_N_SQL, _PLAIN)}.items():
    register(f"eda_report_{_part}", _sql)((lambda p: lambda spark, sf: _eda(spark, sf, p))(_part))


@register("profile_report_histograms", sql_histogram("orders", cols("orders", "num"), 20))
def _q_profile_histograms(spark, sf):
    from loomstat.plans.eda import profile_report
    return profile_report(T(spark, sf, "orders"))["histograms"]


# ------------------------------------------------------------------ neighbour anomalies
_LOF = ORACLE["ano_lof"]


@register("ano_top_lof", f"SELECT * FROM ({_LOF}) ORDER BY anomaly_score, p_partkey LIMIT 10")
def _q_top_lof(spark, sf):
    flagged = AN.anomaly_detection(T(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey",
                                   ["p_size", "p_retailprice"], "lof", 0.05)
    return AN.top_anomalies(flagged, "p_partkey", 10).withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("ano_labels_lof", f"SELECT p.p_partkey, p.p_name, l.anomaly_score, l.is_anomaly FROM part p JOIN ({_LOF}) l ON l.p_partkey = p.p_partkey")
def _q_labels_lof(spark, sf):
    part = T(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    out = AN.anomaly_detection(part, "p_partkey", ["p_size", "p_retailprice"], "lof", 0.05, save_labels=True)
    return out.select("p_partkey", "p_name", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")
