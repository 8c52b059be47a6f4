"""Registered queries: each name maps to a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is SQL-expressible, an equivalent DuckDB query over the
same tables.  ``__spark_entry__`` exposes both dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstat.sources.tables import load_table

# Column kinds of the driver tables (numeric / categorical / datetime / array).
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "customer": [("c_custkey", "num"), ("c_name", "cat"), ("c_nationkey", "num"), ("c_acctbal", "num"),
                 ("c_mktsegment", "cat")],
    "part": [("p_partkey", "num"), ("p_name", "cat"), ("p_brand", "cat"), ("p_type", "cat"), ("p_size", "num"),
             ("p_retailprice", "num")],
    "supplier": [("s_suppkey", "num"), ("s_name", "cat"), ("s_nationkey", "num"), ("s_acctbal", "num")],
    "orders": [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "cat"), ("o_totalprice", "num"),
               ("o_orderdate", "dt"), ("o_orderpriority", "cat")],
    "lineitem": [("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"),
                 ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"), ("l_tax", "num"),
                 ("l_returnflag", "cat"), ("l_linestatus", "cat"), ("l_shipdate", "dt")],
    "events": [("event_id", "num"), ("ts", "dt"), ("user_id", "num"), ("event_type", "cat"), ("value", "num"),
               ("props", "cat")],
    "labels": [("doc_id", "num"), ("quality", "num"), ("toxic", "num")],
    "nation": [("n_nationkey", "num"), ("n_name", "cat"), ("n_regionkey", "num")],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


def cols(table: str, kind: str | None = None) -> list[str]:
    return [c for c, k in SCHEMAS[table] if kind is None or k == kind]


def load_all() -> None:
    """Import the modules that register queries."""
    from loomstat.plans import (queries_cases, queries_clean, queries_ml, queries_model,  # noqa: F401
                                queries_profile, queries_sources, queries_trained)
