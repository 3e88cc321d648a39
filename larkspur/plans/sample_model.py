"""The relationship model of the sample tables. Their keys start at 0, so that no key value means "none"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import Session
from .registry import Collection, Entity, KeyArray, Reference, Registry, SharedKey

LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
MODEL = Registry(
    {
        "region": Entity("region", "r_regionkey", navigations={"nations": Collection("nation", "n_regionkey")}),
        "nation": Entity("nation", "n_nationkey", navigations={"region": Reference("region", "n_regionkey"), "customers": Collection("customer", "c_nationkey"), "suppliers": Collection("supplier", "s_nationkey")}),
        "customer": Entity("customer", "c_custkey", navigations={"nation": Reference("nation", "c_nationkey"), "orders": Collection("orders", "o_custkey")}),
        "supplier": Entity("supplier", "s_suppkey", navigations={"nation": Reference("nation", "s_nationkey")}),
        "part": Entity("part", "p_partkey"),
        "orders": Entity("orders", "o_orderkey", navigations={
            "customer": Reference("customer", "o_custkey"), "customer_or_none": Reference("customer", "o_custkey", sentinel=0), "lines": Collection("lineitem", "l_orderkey"),
        }),
        # No column of lineitem is unique: its order of rows takes all of them.
        "lineitem": Entity("lineitem", "l_orderkey", navigations={"order": Reference("orders", "l_orderkey"), "part": Reference("part", "l_partkey")}, order=LINE_COLUMNS),
        "order_parts": Entity("order_parts", "o_orderkey", navigations={"parts": KeyArray("part", "part_keys")}),
        "documents": Entity("documents", "doc_id", navigations={"labels": SharedKey("labels")}),
        "labels": Entity("labels", "doc_id", navigations={"document": SharedKey("documents", required=True)}),
        "events": Entity("events", "event_id"),
        "embeddings": Entity("embeddings", "vec_id"),
    }
)


def session(spark: SparkSession, sf_dir: str, **options) -> Session:
    def read(table: str) -> DataFrame:
        if table != "order_parts":
            return spark.read.parquet(f"{sf_dir}/{table}.parquet")
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey")
        listed = lines.agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("part_keys"))
        return listed.withColumnRenamed("l_orderkey", "o_orderkey")

    return Session(spark, MODEL, read, **options)
