"""Registered filter / join / preprocessing queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import clean as C
from loomstat.operators import filters as FL
from loomstat.operators import joins as J
from loomstat.plans.catalog import T, register
from loomstat.plans.pipeline import run_preprocessing
from loomstat.plans.queries_profile import CUSTOMER_N_SQL, customer_n

# ------------------------------------------------------------------ sources
PART_COLS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
LI_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
           "l_returnflag, l_linestatus")
EVENTS_N_SQL = ("(SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END "
                "AS value FROM events)")


def events_n(spark, sf):
    e = T(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type",
                    F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"))


def lineitem_nodate(spark, sf):
    return T(spark, sf, "lineitem").drop("l_shipdate")


# ------------------------------------------------------------------ filters
def _flt(name, table_fn, column, operator, value, sql):
    @register(name, sql)
    def q(spark, sf):
        return FL.filter_rows(table_fn(spark, sf), column, operator, value)
    return q


_part = lambda s, sf: T(s, sf, "part")
_li = lineitem_nodate
_flt("flt_eq", customer_n, "c_mktsegment", "eq", "BUILDING",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE coalesce(c_mktsegment, 'nan') = 'BUILDING'")
_flt("flt_eq_nan", customer_n, "c_name", "eq", "nan",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE coalesce(c_name, 'nan') = 'nan'")
_flt("flt_eq_int", _part, "p_size", "eq", "7", "SELECT * FROM part WHERE CAST(p_size AS VARCHAR) = '7'")
_flt("flt_eq_double", _li, "l_quantity", "eq", "5.0",
     f"SELECT {LI_COLS} FROM lineitem WHERE CAST(l_quantity AS VARCHAR) = '5.0'")
_flt("flt_eq_double_noncanonical", _li, "l_quantity", "eq", "5",
     f"SELECT {LI_COLS} FROM lineitem WHERE CAST(l_quantity AS VARCHAR) = '5'")
_flt("flt_ne", customer_n, "c_name", "ne", "Customer#000000001",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE coalesce(c_name, 'nan') <> 'Customer#000000001'")
_flt("flt_ne_double", customer_n, "c_acctbal", "ne", "0.0",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE coalesce(CAST(c_acctbal AS VARCHAR), 'nan') <> '0.0'")
_flt("flt_gt", _part, "p_retailprice", "gt", 950, "SELECT * FROM part WHERE p_retailprice > 950")
_flt("flt_lt", customer_n, "c_acctbal", "lt", 0, f"SELECT * FROM {CUSTOMER_N_SQL} WHERE c_acctbal < 0")
_flt("flt_gte", _part, "p_size", "gte", 25, "SELECT * FROM part WHERE p_size >= 25")
_flt("flt_lte", customer_n, "c_nationkey", "lte", 5, f"SELECT * FROM {CUSTOMER_N_SQL} WHERE c_nationkey <= 5")
_flt("flt_gt_text", _part, "p_brand", "gt", 0,
     "SELECT * FROM part WHERE TRY_CAST(trim(p_brand) AS DOUBLE) > 0")
_flt("flt_contains", _part, "p_type", "contains", "BRASS$|^SMALL",
     "SELECT * FROM part WHERE regexp_matches(coalesce(p_type, 'nan'), 'BRASS$|^SMALL')")
_flt("flt_contains_nulltext", customer_n, "c_name", "contains", "an",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE regexp_matches(coalesce(c_name, 'nan'), 'an')")
_flt("flt_not_contains", customer_n, "c_name", "not_contains", "0000000[0-4]",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE NOT regexp_matches(coalesce(c_name, 'nan'), '0000000[0-4]')")
_flt("flt_is_null", customer_n, "c_acctbal", "is_null", None,
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE c_acctbal IS NULL")
_flt("flt_not_null", customer_n, "c_acctbal", "not_null", None,
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE c_acctbal IS NOT NULL")
_flt("flt_starts", _part, "p_brand", "starts_with", "Brand#1",
     "SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1')")
_flt("flt_starts_nulltext", customer_n, "c_name", "starts_with", "na",
     f"SELECT * FROM {CUSTOMER_N_SQL} WHERE starts_with(coalesce(c_name, 'nan'), 'na')")
_flt("flt_ends", _part, "p_type", "ends_with", "ARD", "SELECT * FROM part WHERE ends_with(p_type, 'ARD')")


@register("flt_dry_run", f"SELECT count(*) AS original, count_if(c_acctbal < 0) AS kept, "
                         f"count(*) - count_if(c_acctbal < 0) AS removed FROM {CUSTOMER_N_SQL}")
def _q_flt_dry(spark, sf):
    return FL.filter_counts(customer_n(spark, sf), "c_acctbal", "lt", 0)


# ------------------------------------------------------------------ joins
def _orders_k(spark, sf):
    return T(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderstatus",
                                         "o_totalprice")


def _cust_k(spark, sf):
    # customers of nations 0-12 only, so left/right/outer differ
    return T(spark, sf, "customer").where(F.col("c_nationkey") < 13) \
        .select(F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal")


ORD_K = "(SELECT o_custkey AS custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders)"
CUST_K = "(SELECT c_custkey AS custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 13)"
for _how, _sqlhow, _key in [("inner", "INNER", "o.custkey"), ("left", "LEFT", "o.custkey"),
                            ("right", "RIGHT", "c.custkey"), ("outer", "FULL OUTER", "coalesce(o.custkey, c.custkey)")]:
    register(f"join_{_how}",
             f"SELECT {_key} AS custkey, o.o_orderkey, o.o_orderstatus, o.o_totalprice, c.c_name, c.c_acctbal "
             f"FROM {ORD_K} o {_sqlhow} JOIN {CUST_K} c ON o.custkey IS NOT DISTINCT FROM c.custkey")(
        (lambda h: lambda spark, sf: J.merge(_orders_k(spark, sf), _cust_k(spark, sf), "custkey", h))(_how))


@register("join_suffix",
          "SELECT n.nationkey, n.name, n.n_regionkey, s.s_suppkey, s.name AS name_right, s.s_acctbal FROM "
          "(SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey FROM nation) n LEFT JOIN "
          "(SELECT s_nationkey AS nationkey, s_name AS name, s_suppkey, s_acctbal FROM supplier) s "
          "ON n.nationkey IS NOT DISTINCT FROM s.nationkey")
def _q_join_suffix(spark, sf):
    n = T(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"),
                                      "n_regionkey")
    s = T(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"),
                                        "s_suppkey", "s_acctbal")
    return J.merge(n, s, "nationkey", "left")


@register("join_multikey",
          "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_extendedprice FROM "
          "(SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem) a LEFT JOIN "
          "(SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R') b "
          "ON a.l_orderkey IS NOT DISTINCT FROM b.l_orderkey AND a.l_linenumber IS NOT DISTINCT FROM b.l_linenumber")
def _q_join_multi(spark, sf):
    li = T(spark, sf, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_quantity")
    b = li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return J.merge(a, b, " l_orderkey , l_linenumber ", "left")


@register("join_nullkeys",
          f"SELECT a.c_name, a.c_custkey, b.n_rows FROM (SELECT c_name, c_custkey FROM {CUSTOMER_N_SQL}) a "
          f"INNER JOIN (SELECT c_name, count(*) AS n_rows FROM {CUSTOMER_N_SQL} GROUP BY c_name) b "
          f"ON a.c_name IS NOT DISTINCT FROM b.c_name")
def _q_join_nulls(spark, sf):
    c = customer_n(spark, sf)
    b = c.groupBy("c_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return J.merge(c.select("c_name", "c_custkey"), b, "c_name", "inner")


@register("join_dry", f"SELECT (SELECT count(*) FROM {ORD_K}) AS left_rows, (SELECT count(*) FROM {CUST_K}) "
                      f"AS right_rows, 'custkey' AS join_keys, 'outer' AS how")
def _q_join_dry(spark, sf):
    return J.merge_dry_run(_orders_k(spark, sf), _cust_k(spark, sf), "custkey", "outer")


# ------------------------------------------------------------------ preprocessing ops
CN_COLS = "c_custkey, c_name, c_nationkey, c_mktsegment"


def _op(name, sql):
    def deco(fn):
        register(name, sql)(fn)
        return fn
    return deco


@_op("fill_mean", f"WITH t AS (SELECT * FROM {CUSTOMER_N_SQL}) SELECT {CN_COLS}, round(coalesce(c_acctbal, "
                  f"(SELECT avg(c_acctbal) FROM t)), 4) AS c_acctbal FROM t")
def _q_fill_mean(spark, sf):
    d, _ = C.fill_nulls(customer_n(spark, sf), "c_acctbal", "mean")
    return d.withColumn("c_acctbal", F.round("c_acctbal", 4))


@_op("fill_median", f"WITH t AS (SELECT * FROM {CUSTOMER_N_SQL}) SELECT {CN_COLS}, round(coalesce(c_acctbal, "
                    f"(SELECT quantile_cont(c_acctbal, 0.5) FROM t)), 4) AS c_acctbal FROM t")
def _q_fill_median(spark, sf):
    d, _ = C.fill_nulls(customer_n(spark, sf), "c_acctbal", "median")
    return d.withColumn("c_acctbal", F.round("c_acctbal", 4))


@_op("fill_mode", f"WITH t AS (SELECT * FROM {CUSTOMER_N_SQL}) SELECT c_custkey, coalesce(c_name, (SELECT c_name "
                  f"FROM t WHERE c_name IS NOT NULL GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1)) AS c_name, "
                  f"c_nationkey, c_acctbal, c_mktsegment FROM t")
def _q_fill_mode(spark, sf):
    return C.fill_nulls(customer_n(spark, sf), "c_name", "mode")[0]


@_op("fill_zero", f"SELECT {CN_COLS}, coalesce(c_acctbal, 0) AS c_acctbal FROM {CUSTOMER_N_SQL}")
def _q_fill_zero(spark, sf):
    return C.fill_nulls(customer_n(spark, sf), "c_acctbal", "zero")[0]


@_op("fill_ffill", f"SELECT event_id, user_id, event_type, last_value(value IGNORE NULLS) OVER (ORDER BY event_id "
                   f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EVENTS_N_SQL}")
def _q_ffill(spark, sf):
    return C.fill_nulls(events_n(spark, sf), "value", "ffill", order_by="event_id")[0]


@_op("fill_bfill", f"SELECT event_id, user_id, event_type, first_value(value IGNORE NULLS) OVER (ORDER BY event_id "
                   f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EVENTS_N_SQL}")
def _q_bfill(spark, sf):
    return C.fill_nulls(events_n(spark, sf), "value", "bfill", order_by="event_id")[0]


# A key with three values: each holds a third of the rows, ordered by a second column.
@_op("fill_ffill_hot_key", f"SELECT event_id, user_id, event_type, last_value(value IGNORE NULLS) OVER (ORDER BY event_id % 3, event_id "
                           f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EVENTS_N_SQL}")
def _q_ffill_hot(spark, sf):
    df = events_n(spark, sf).withColumn("k", F.col("event_id") % 3)
    return C.fill_nulls(df, "value", "ffill", order_by=["k", "event_id"])[0].drop("k")


@_op("fill_bfill_hot_key", f"SELECT event_id, user_id, event_type, first_value(value IGNORE NULLS) OVER (ORDER BY event_type, event_id "
                           f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EVENTS_N_SQL}")
def _q_bfill_hot(spark, sf):
    return C.fill_nulls(events_n(spark, sf), "value", "bfill", order_by=["event_type", "event_id"])[0]


@_op("drop_outliers_iqr",
     f"SELECT {LI_COLS} FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, "
     f"quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1) "
     f"AND l_extendedprice <= q3 + 1.5 * (q3 - q1)")
def _q_drop_iqr(spark, sf):
    return C.drop_outliers(lineitem_nodate(spark, sf), "l_extendedprice", "iqr")[0]


@_op("drop_outliers_std",
     f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {CUSTOMER_N_SQL}, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM "
     f"{CUSTOMER_N_SQL}) WHERE c_acctbal >= m - 3 * s AND c_acctbal <= m + 3 * s")
def _q_drop_std(spark, sf):
    return C.drop_outliers(customer_n(spark, sf), "c_acctbal", "std")[0]


@_op("label_encode", f"SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, p_type, p_size, "
                     f"p_retailprice FROM part")
def _q_label(spark, sf):
    return C.label_encode(T(spark, sf, "part"), "p_brand")[0]


@_op("label_encode_nulls", f"SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_name, 'nan')) - 1 AS c_name, "
                           f"c_nationkey, c_acctbal, c_mktsegment FROM {CUSTOMER_N_SQL}")
def _q_label_n(spark, sf):
    return C.label_encode(customer_n(spark, sf), "c_name")[0]


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@_op("onehot_encode", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
    f"coalesce(c_mktsegment = '{s}', false) AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def _q_onehot(spark, sf):
    return C.onehot_encode(T(spark, sf, "customer"), "c_mktsegment")[0]


@_op("onehot_encode_int", "SELECT o_orderkey, " + ", ".join(
    f"coalesce(n = {k}, false) AS n_{k}" for k in range(1, 8)) +
    " FROM (SELECT l_orderkey AS o_orderkey, l_linenumber AS n FROM lineitem)")
def _q_onehot_int(spark, sf):
    li = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"))
    return C.onehot_encode(li, "n")[0]


@_op("scale_standard",
     f"SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / "
     f"(SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity, round((l_extendedprice - (SELECT "
     f"avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice "
     f"FROM lineitem")
def _q_scale_std(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    d, _ = C.scale(d, ["l_quantity", "l_extendedprice"], "standard")
    return d.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
                    F.round("l_extendedprice", 6).alias("l_extendedprice"))


@_op("scale_minmax",
     f"WITH t AS (SELECT * FROM {CUSTOMER_N_SQL}) SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM t)) "
     f"/ ((SELECT max(c_acctbal) FROM t) - (SELECT min(c_acctbal) FROM t)), 6) AS c_acctbal, "
     f"round((c_nationkey - 0.0) / 24, 6) AS c_nationkey FROM t")
def _q_scale_mm(spark, sf):
    d = customer_n(spark, sf).select("c_custkey", "c_acctbal", "c_nationkey")
    d, _ = C.scale(d, ["c_acctbal", "c_nationkey"], "minmax")
    return d.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"),
                    F.round("c_nationkey", 6).alias("c_nationkey"))


@_op("drop_duplicates",
     "SELECT o_orderstatus, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT o_orderstatus, o_orderpriority, "
     "o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) "
     "AS rn FROM orders) WHERE rn = 1")
def _q_dedupe(spark, sf):
    o = T(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice")
    return C.drop_duplicates(o, ["o_orderstatus", "o_orderpriority"], order_by="o_orderkey")[0]


@_op("drop_duplicates_all", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _q_dedupe_all(spark, sf):
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return C.drop_duplicates(li)[0]


@_op("drop_column", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def _q_drop_col(spark, sf):
    return C.drop_column(T(spark, sf, "part"), "p_name")[0]


@_op("rename_column", "SELECT p_partkey, p_name AS part_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _q_rename(spark, sf):
    d, _ = C.rename_column(T(spark, sf, "part"), "p_name", "part_name")
    return C.rename_column(d, "not_there", "x")[0]


@_op("to_datetime", "SELECT o_orderkey, year(d) AS y, month(d) AS m, day(d) AS dd FROM (SELECT o_orderkey, "
                    "CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS d FROM orders)")
def _q_to_dt(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d"))
    d, _ = C.convert_dtype(o, "d", "datetime")
    return d.select("o_orderkey", F.year("d").alias("y"), F.month("d").alias("m"), F.dayofmonth("d").alias("dd"))


@_op("to_numeric", "SELECT p_partkey, TRY_CAST(trim(CAST(p_size AS VARCHAR)) AS DOUBLE) AS s, "
                   "TRY_CAST(trim(p_brand) AS DOUBLE) AS p_brand FROM part")
def _q_to_num(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), "p_brand")
    d, _ = C.convert_dtype(p, "s", "numeric")
    return C.convert_dtype(d, "p_brand", "numeric")[0]


@_op("to_string", f"SELECT c_custkey, coalesce(CAST(c_acctbal AS VARCHAR), 'nan') AS c_acctbal FROM {CUSTOMER_N_SQL}")
def _q_to_str(spark, sf):
    return C.convert_dtype(customer_n(spark, sf).select("c_custkey", "c_acctbal"), "c_acctbal", "str")[0]


@_op("to_other", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_brand FROM part")
def _q_to_other(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    d, _ = run_preprocessing(p, [{"op": "convert_dtype", "column": "p_size", "to": "float"},
                                 {"op": "convert_dtype", "column": "p_brand", "to": "int"}])
    return d


def _bin_sql(src: str, c: str, bins: int) -> str:
    edge = lambda i: f"(lo + {i} * ((hi - lo) / {bins}))"
    e = [f"(lo - (hi - lo) * 0.001)"] + [edge(i) for i in range(1, bins)] + ["hi"]
    lab = lambda x: (f"CAST(round({x}, 3) AS VARCHAR)")
    cases = " ".join(f"WHEN {c} > {e[i]} AND {c} <= {e[i + 1]} THEN '(' || {lab(e[i])} || ', ' || {lab(e[i + 1])} || ']'"
                     for i in range(bins))
    return (f"SELECT p_partkey, {c}, CASE {cases} END AS {c}_bin FROM {src}, "
            f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {src})")


@_op("bin_numeric", _bin_sql("part", "p_retailprice", 5))
def _q_bin(spark, sf):
    return C.bin_numeric(T(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 5)[0]


@_op("bin_numeric_edges",
     "SELECT p_partkey, p_size, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 "
     "THEN 'medium' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS size_class FROM part")
def _q_bin_edges(spark, sf):
    return C.bin_numeric(T(spark, sf, "part").select("p_partkey", "p_size"), "p_size", [0, 10, 30, 50],
                         ["small", "medium", "large"], "size_class")[0]


@_op("add_date_parts",
     "SELECT o_orderkey, o_orderdate, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, "
     "day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek, "
     "quarter(o_orderdate) AS o_orderdate_quarter, dayofyear(o_orderdate) AS o_orderdate_dayofyear FROM orders")
def _q_date_parts(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return C.add_date_parts(o, "o_orderdate", ["year", "month", "day", "dayofweek", "quarter", "dayofyear"])[0]


def _off(c: str, t: str) -> str:
    return f"(SELECT CASE WHEN min({c}) <= 0 THEN 1 - min({c}) ELSE 0 END FROM {t})"


@_op("log_transform",
     f"SELECT c_custkey, c_acctbal, round(ln(1 + c_acctbal + {_off('c_acctbal', 'customer')}), 6) AS c_acctbal_log, "
     f"round(log2(c_acctbal + {_off('c_acctbal', 'customer')}), 6) AS a2, "
     f"round(log10(c_custkey + {_off('c_custkey', 'customer')}), 6) AS k10 FROM customer")
def _q_log(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_acctbal")
    d, _ = C.log_transform(c, "c_acctbal")
    d, _ = C.log_transform(d, "c_acctbal", "log2", "a2")
    d, _ = C.log_transform(d, "c_custkey", "log10", "k10")
    return d.select("c_custkey", "c_acctbal", F.round("c_acctbal_log", 6).alias("c_acctbal_log"),
                    F.round("a2", 6).alias("a2"), F.round("k10", 6).alias("k10"))


@_op("drop_null_rows", f"SELECT * FROM {CUSTOMER_N_SQL} WHERE c_acctbal IS NOT NULL")
def _q_dropna(spark, sf):
    return C.drop_null_rows(customer_n(spark, sf), "c_acctbal")[0]


@_op("drop_null_rows_all", f"SELECT * FROM {CUSTOMER_N_SQL} WHERE c_acctbal IS NOT NULL AND c_name IS NOT NULL")
def _q_dropna_all(spark, sf):
    return C.drop_null_rows(customer_n(spark, sf))[0]


@_op("clip_column", "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 1000.0 WHEN p_retailprice > 1800 THEN 1800.0 "
                    "ELSE p_retailprice END AS p_retailprice FROM part")
def _q_clip(spark, sf):
    return C.clip_column(T(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1000, 1800)[0]


@_op("auto_prep",
     "WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders) "
     "SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, o_totalprice, "
     "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM t")
def _q_auto(spark, sf):
    o = T(spark, sf, "orders").drop("o_orderdate")
    return C.auto_preprocess(o, "o_orderstatus")[0]


@_op("auto_prep_nulls",
     f"WITH t AS (SELECT * FROM {CUSTOMER_N_SQL}) SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_name, 'nan')) "
     f"- 1 AS c_name, c_nationkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM t)), 4) "
     f"AS c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM t")
def _q_auto_n(spark, sf):
    d = C.auto_preprocess(customer_n(spark, sf), "c_mktsegment")[0]
    return d.withColumn("c_acctbal", F.round("c_acctbal", 4))


@_op("pp_pipeline",
     f"WITH t AS (SELECT * FROM {CUSTOMER_N_SQL}), f AS (SELECT c_custkey, c_nationkey, dense_rank() OVER "
     f"(ORDER BY c_mktsegment) - 1 AS segment, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM t)) AS "
     f"c_acctbal FROM t) SELECT c_custkey, c_nationkey, segment, round((c_acctbal - (SELECT "
     f"min(c_acctbal) FROM f)) / ((SELECT max(c_acctbal) FROM f) - (SELECT min(c_acctbal) FROM f)), 6) AS c_acctbal "
     f"FROM f")
def _q_pipeline(spark, sf):
    ops = [{"op": "fillna", "col": "c_acctbal", "method": "median"},
           {"operation": "label_encode", "column": "c_mktsegment"},
           {"op": "drop_column", "column": "c_name"},
           {"op": "drop_column", "column": "no_such_column"},
           {"op": "rename_column", "from": "c_mktsegment", "to": "segment"}]
    d, _ = run_preprocessing(customer_n(spark, sf), ops)
    d, _ = run_preprocessing(d, [{"op": "scale", "columns": ["c_acctbal"], "method": "minmax"}])
    return d.withColumn("c_acctbal", F.round("c_acctbal", 6))
