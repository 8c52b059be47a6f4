"""Registered split / metric queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import metrics as M
from loomstat.operators import split as S
from loomstat.plans.catalog import T, register

ORD = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)"


def orders_nodate(spark, sf):
    return T(spark, sf, "orders").drop("o_orderdate")


def _h(key: str, seed: int = 42) -> str:
    return f"substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 13)"


# ------------------------------------------------------------------ splits
@register("split_random",
          f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {_h('o_orderkey')}, o_orderkey) - 1 < "
          f"(SELECT ceil(count(*) * 0.2) FROM orders) THEN 'test' ELSE 'train' END AS split FROM {ORD}")
def _q_split(spark, sf):
    return S.split_dataset(orders_nodate(spark, sf), "o_orderkey", 0.2, 42)


def _strat_sql(src: str, key: str, cls: str, ts: float, seed: int = 42) -> str:
    return (f"WITH t AS (SELECT * FROM {src}), cc AS (SELECT {cls} AS cls, count(*) AS nc FROM t GROUP BY 1), "
            f"tot AS (SELECT sum(nc) AS n, CAST(ceil(sum(nc) * {ts}) AS BIGINT) AS nt FROM cc), "
            f"al AS (SELECT cls, floor(nc * nt / n) AS fl, nc * nt / n - floor(nc * nt / n) AS rem, nt FROM cc, tot), "
            f"al2 AS (SELECT cls, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, CAST(cls AS VARCHAR)) <= "
            f"nt - (SELECT sum(fl) FROM al) THEN 1 ELSE 0 END AS m FROM al) "
            f"SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY t.{cls} ORDER BY {_h('t.' + key, seed)}, t.{key}) "
            f"- 1 < al2.m THEN 'test' ELSE 'train' END AS split FROM t JOIN al2 ON t.{cls} = al2.cls")


@register("split_strat", _strat_sql(ORD, "o_orderkey", "o_orderstatus", 0.25))
def _q_split_strat(spark, sf):
    return S.split_dataset(orders_nodate(spark, sf), "o_orderkey", 0.25, 42, stratify="o_orderstatus")


@register("split_strat_imbalanced", _strat_sql("labels", "doc_id", "toxic", 0.2, 7))
def _q_split_strat2(spark, sf):
    return S.split_dataset(T(spark, sf, "labels"), "doc_id", 0.2, 7, stratify="toxic")


@register("kfold",
          f"WITH t AS (SELECT *, row_number() OVER (ORDER BY {_h('o_orderkey')}, o_orderkey) - 1 AS pos FROM {ORD}), "
          f"z AS (SELECT count(*) AS n FROM t) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
          f"o_orderpriority, CAST(CASE WHEN pos < (n // 5 + 1) * (n % 5) THEN pos // (n // 5 + 1) "
          f"ELSE (n % 5) + (pos - (n // 5 + 1) * (n % 5)) // (n // 5) END AS INTEGER) AS fold FROM t, z")
def _q_kfold(spark, sf):
    return S.kfold(orders_nodate(spark, sf), "o_orderkey", 5, 42)


@register("kfold_strat",
          f"SELECT *, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {_h('doc_id')}, doc_id) - 1) % 5 AS INTEGER) "
          f"AS fold FROM labels")
def _q_kfold_strat(spark, sf):
    return S.kfold(T(spark, sf, "labels"), "doc_id", 5, 42, stratify="toxic")


@register("class_weight",
          "SELECT toxic, round(CAST((SELECT count(*) FROM labels) AS DOUBLE) / ((SELECT count(DISTINCT toxic) FROM "
          "labels) * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def _q_cw(spark, sf):
    return S.class_weights(T(spark, sf, "labels"), "toxic").withColumn("weight", F.round("weight", 6))


@register("sample_n",
          f"SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY {_h('c_custkey', 42)}, c_custkey LIMIT 100")
def _q_sample(spark, sf):
    return S.sample_n(T(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 100)


# ------------------------------------------------------------------ metrics over rule-scored tables
# A fixed scoring rule stands in for a model so metrics can be checked by SQL on whole tables.
PRED_RULE = ("CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END")
SCORED_ORDERS = f"(SELECT o_orderstatus AS y, {PRED_RULE} AS p FROM orders)"
DOCS_SCORED = ("(SELECT l.quality AS y, l.toxic AS toxic, CAST(d.n_chars AS DOUBLE) / 1000 AS s, "
               "CASE WHEN d.n_chars > 3000 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")
LI_SCORED = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


def scored_orders(spark, sf):
    o = T(spark, sf, "orders")
    p = (F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_totalprice") > 100000, "O").otherwise("P"))
    return o.select(F.col("o_orderstatus").alias("y"), p.alias("p"))


def docs_scored(spark, sf):
    lab, doc = T(spark, sf, "labels"), T(spark, sf, "documents")
    j = lab.join(doc, "doc_id")
    return j.select(F.col("quality").alias("y"), "toxic", (F.col("n_chars").cast("double") / 1000).alias("s"),
                    F.when(F.col("n_chars") > 3000, 1).otherwise(0).alias("p"))


def li_scored(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


_PER_CLASS = (f"WITH t AS {SCORED_ORDERS}, cls AS (SELECT y AS c FROM t UNION SELECT p FROM t), "
              f"pc AS (SELECT c, (SELECT count(*) FROM t WHERE y = c) AS support, "
              f"(SELECT count(*) FROM t WHERE y = c AND p = c) AS tp, (SELECT count(*) FROM t WHERE p = c) AS pr "
              f"FROM cls), m AS (SELECT c, support, tp, coalesce(CAST(tp AS DOUBLE) / nullif(pr, 0), 0) AS pp, "
              f"coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS rr FROM pc), "
              f"f AS (SELECT *, CASE WHEN pp + rr = 0 THEN 0 ELSE 2 * pp * rr / (pp + rr) END AS ff FROM m) ")


@register("m_accuracy_f1w",
          _PER_CLASS + "SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(sum(pp * support) / sum(support), 4) "
          "AS precision_weighted, round(sum(rr * support) / sum(support), 4) AS recall_weighted, "
          "round(sum(ff * support) / sum(support), 4) AS f1_weighted, CAST(sum(support) AS BIGINT) AS n FROM f")
def _q_acc(spark, sf):
    return M.classification_metrics(scored_orders(spark, sf), "y", "p")


@register("m_confusion",
          _PER_CLASS + "SELECT c AS class, round(pp, 4) AS precision, round(rr, 4) AS recall, round(ff, 4) AS f1, "
          "CAST(support AS BIGINT) AS support FROM f")
def _q_conf(spark, sf):
    return M.per_class_report(scored_orders(spark, sf), "y", "p")


@register("m_confusion_counts", f"SELECT y AS label, p AS prediction, count(*) AS cnt FROM {SCORED_ORDERS} GROUP BY 1, 2")
def _q_conf_counts(spark, sf):
    return M.confusion_counts(scored_orders(spark, sf), "y", "p")


@register("m_binary_confusion",
          f"SELECT count_if(y = 1 AND p = 1) AS tp, count_if(y <> 1 AND p = 1) AS fp, count_if(y = 1 AND p <> 1) AS fn, "
          f"count_if(y <> 1 AND p <> 1) AS tn FROM {DOCS_SCORED}")
def _q_bin_conf(spark, sf):
    return M.binary_confusion(docs_scored(spark, sf), "y", "p", 1)


def _auc_sql(label: str) -> str:
    return (f"WITH t AS (SELECT {label} AS y, s FROM {DOCS_SCORED}), r AS (SELECT y, rank() OVER (ORDER BY s) + "
            f"(count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM t), a AS (SELECT sum(rk) FILTER (WHERE y = 1) AS rs,"
            f" CAST(count_if(y = 1) AS DOUBLE) AS P, CAST(count_if(y <> 1) AS DOUBLE) AS N FROM r) "
            f"SELECT round((rs - P * (P + 1) / 2) / (P * N), 6) AS auc, CAST(P AS BIGINT) AS n_pos, "
            f"CAST(N AS BIGINT) AS n_neg FROM a")


@register("m_auc", _auc_sql("y"))
def _q_auc(spark, sf):
    return M.auc_exact(docs_scored(spark, sf), "y", "s")


@register("m_auc_imbalanced", _auc_sql("toxic"))
def _q_auc2(spark, sf):
    return M.auc_exact(docs_scored(spark, sf), "toxic", "s")


_ROC_BASE = (f"WITH t AS {DOCS_SCORED}, sc AS (SELECT s, sum(y) AS np, sum(1 - y) AS nn FROM t GROUP BY s), "
             f"c AS (SELECT s, np, nn, sum(np) OVER (ORDER BY s DESC) AS tp, sum(nn) OVER (ORDER BY s DESC) AS fp, "
             f"lead(np) OVER (ORDER BY s DESC) AS np2, lead(nn) OVER (ORDER BY s DESC) AS nn2, "
             f"row_number() OVER (ORDER BY s DESC) AS rn FROM sc), "
             f"z AS (SELECT CAST(sum(y) AS DOUBLE) AS P, CAST(sum(1 - y) AS DOUBLE) AS N FROM t) "
             f"SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
             f"SELECT s, round(fp / N, 6), round(tp / P, 6) FROM c, z")


@register("roc_points", _ROC_BASE + " WHERE rn = 1 OR np2 IS NULL OR np2 <> np OR nn2 <> nn")
def _q_roc(spark, sf):
    return M.roc_points(docs_scored(spark, sf), "y", "s")


@register("roc_points_all", _ROC_BASE)
def _q_roc_all(spark, sf):
    return M.roc_points(docs_scored(spark, sf), "y", "s", drop_intermediate=False)


@register("m_regression",
          f"SELECT round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, "
          f"round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2, "
          f"count(*) AS n FROM {LI_SCORED}")
def _q_reg(spark, sf):
    return M.regression_metrics(li_scored(spark, sf), "y", "p")
