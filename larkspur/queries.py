"""The registered queries over the sample tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as t
from .operators.index import EqualityIndex
from .operators.query import Query, Session
from .plans.sample_model import session
from .plans.registry import Registry
from .sources.definitions import parse_definition, resolve
from .sources.files import application_folder, write_bytes
from .sources.options import export_keys
from .sources.session import binary_session
from .sources.store_writer import write_store
from .sources.writer import Part, write_table
from .streaming.windows import sessions, sliding, tumbling

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[Session], DataFrame | Query]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(session(spark, sf_dir))
            return out.to_df() if isinstance(out, Query) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def listed(column: str, value: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(column, lambda x: value(x).cast("string")), ",")


# ---- scans, lookups and filters
@query("SELECT n_nationkey, n_name FROM nation")
def scan_select(s):
    return s.table("nation").select("n_nationkey", "n_name")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup(s):
    return s.find_df("orders", 42)


@query("SELECT * FROM orders WHERE o_orderkey IN (3, 1, 4, 1, 5, 99999999)")
def batch_lookup(s):
    return s.find_many("orders", [3, 1, 4, 1, 5, 99999999])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT * FROM range(0, 5000, 2)) ORDER BY o_orderkey LIMIT 500")
def batch_lookup_large(s):
    return s.find_many("orders", list(range(0, 5000, 2)), take=500).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM part WHERE p_size > 5 AND p_size >= 6 AND p_size < 40 AND p_size <= 39 AND p_brand <> 'Brand#11' AND p_partkey = p_partkey")
def filter_cmp_all(s):
    return s.table("part").where((c("p_size") > 5) & (c("p_size") >= 6)).where((c("p_size") < 40) & (c("p_size") <= 39)).where(c("p_brand") != "Brand#11").where(c("p_partkey") == c("p_partkey"))


@query("SELECT p_partkey FROM part WHERE 25 < p_size")
def filter_swapped(s):
    return s.table("part").where(F.lit(25) < c("p_size")).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE NOT ((p_size < 10 OR p_size > 40) AND p_retailprice > 1000)")
def filter_bool(s):
    return s.table("part").where(~(((c("p_size") < 10) | (c("p_size") > 40)) & (c("p_retailprice") > 1000))).select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(s):
    return s.table("customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'part 1')")
def str_startswith(s):
    return s.table("part").where(t.starts_with(c("p_name"), "part 1")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type FROM part WHERE ends_with(p_type, 'EL')")
def str_endswith(s):
    return s.table("part").where(t.ends_with(c("p_type"), "EL")).select("p_partkey", "p_type")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00')")
def str_contains(s):
    return s.table("customer").where(t.contains(c("c_name"), "00")).select("c_custkey", "c_name")


@query("SELECT count(*) AS n FROM customer WHERE starts_with(lower(c_mktsegment), lower('bUiL')) OR contains(lower(c_mktsegment), lower('HINE')) OR ends_with(lower(c_mktsegment), lower('hold'))")
def str_ignorecase(s):
    seg = c("c_mktsegment")
    return s.table("customer").where(t.starts_with(seg, "bUiL", True) | t.contains(seg, "HINE", True) | t.ends_with(seg, "hold", True)).count_df(name="n")


@query("SELECT n_nationkey FROM nation WHERE starts_with(n_name, substr(n_name, 1, 1)) AND NOT contains(n_name, n_name || 'x')")
def str_row_dependent(s):
    name = c("n_name")
    return s.table("nation").where(t.starts_with(name, F.substring(name, 1, 1)) & ~t.contains(name, F.concat(name, F.lit("x")))).select("n_nationkey")


@query("SELECT n_nationkey, length(n_name) AS n FROM nation WHERE NOT (n_name IS NULL OR regexp_full_match(n_name, '\\s*'))")
def str_length_blank(s):
    return s.table("nation").where(~t.is_blank(c("n_name"))).select("n_nationkey", n=F.length("n_name"))


@query("SELECT * FROM (SELECT p_partkey, p_retailprice * 2 AS doubled FROM part) WHERE doubled > 2500")
def where_after_select(s):
    return s.table("part").select("p_partkey", doubled=c("p_retailprice") * 2).where(c("doubled") > 2500)


# ---- ordering, paging, element operators
@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 7")
def order_then_take(s):
    return s.table("customer").order_by("c_mktsegment").then_by("c_acctbal", desc=True).take(7).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def order_replaced(s):
    return s.table("customer").order_by("c_name").order_by("c_acctbal", desc=True).take(5).select("c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
def page(s):
    return s.table("orders").order_by("o_totalprice").skip(20).take(10).select("o_orderkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 3")
def skip_cumulative(s):
    return s.table("nation").skip(1).skip(2).select("n_nationkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4")
def take_min(s):
    return s.table("nation").take(10).take(4).select("n_nationkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1")
def first_ordered(s):
    return s.table("customer").order_by("c_acctbal").first_df().select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def single(s):
    row = s.table("nation").single(c("n_nationkey") == 7)
    return s.spark.createDataFrame([(row.n_nationkey, row.n_name)], "n_nationkey int, n_name string")


@query("SELECT c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey DESC LIMIT 1")
def last_ordered(s):
    return s.table("customer").order_by("c_mktsegment").last_df().select("c_custkey")


@query("SELECT max(n_nationkey) AS n_nationkey FROM nation")
def last_unordered(s):
    return s.table("nation").last_df().select("n_nationkey")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 1000")
def any_pred(s):
    return s.table("orders").any_df(c("o_totalprice") > 1000, "found")


@query("SELECT count(*) FILTER (WHERE NOT coalesce(o_totalprice >= 0, false)) = 0 AS fits FROM orders")
def all_pred(s):
    return s.table("orders").all_df(c("o_totalprice") >= 0, "fits")


@query("SELECT true AS fits")
def all_empty(s):
    return s.table("orders").where(F.lit(False)).all_df(c("o_totalprice") > 1e12, "fits")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_pred(s):
    return s.table("orders").count_df(c("o_orderstatus") == "F", "n")


@query("SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 12 OFFSET 3)")
def count_after_take(s):
    return s.table("customer").skip(3).take(12).count_df(name="n")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 2 OFFSET 1")
def legacy_flat_composition(s):
    s.legacy_composition = True
    return s.table("nation").take(2).skip(1).where(c("n_regionkey") == 1).select("n_nationkey", "n_regionkey").to_df().select("n_nationkey")


# ---- joins and navigation
@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def inner_join(s):
    return s.table("orders").where(c("o_totalprice") > 300000).join(s.table("customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def left_join_filtered_child(s):
    return s.table("customer").left_join(s.table("orders").where(c("o_totalprice") > 400000), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def left_deep_3(s):
    return s.table("supplier").join(s.table("nation"), "s_nationkey", "n_nationkey").join(s.table("region"), "n_regionkey", "r_regionkey").select("s_suppkey", "n_name", "r_name")


@query("SELECT n_nationkey, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(s):
    return s.table("supplier").right_join(s.table("nation"), "s_nationkey", "n_nationkey").select("n_nationkey", "s_suppkey")


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def nav_select(s):
    return s.table("customer").select("c_custkey", nation=lambda x: x["nation.n_name"], region=lambda x: x["nation.region.r_name"])


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def nav_null_check(s):
    return s.table("documents").where(lambda x: x["labels"].isNotNull() & (x["labels.quality"] == 1)).select("doc_id")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE starts_with(n_name, 'NATION_1') AND c_acctbal > 0")
def nav_string_pred(s):
    return s.table("customer").where(lambda x: t.starts_with(x["nation.n_name"], "NATION_1") & (x["c_acctbal"] > 0)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def nav_any(s):
    return s.table("customer").where_any("orders", c("o_totalprice") > 400000).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def nav_none(s):
    return s.table("orders").where_none("lines").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def nav_any_in_or(s):
    return s.table("customer").where(lambda x: (x["c_acctbal"] < 0) | x.any("orders", c("o_totalprice") > 450000)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 12")
def nav_count_ge(s):
    return s.table("customer").where(lambda x: x.count("orders") >= 12).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) = 0")
def nav_count_zero(s):
    return s.table("orders").where(lambda x: x.count("lines") == 0).select("o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 20")
def order_by_nav_count(s):
    return s.table("customer").order_by(lambda x: x.count("orders"), desc=True).take(20).select("c_custkey")


# ---- includes
@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def include_reference(s):
    return s.table("supplier").include("nation").to_df().select("s_suppkey", c("nation.n_name").alias("nation"))


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def include_shared_key(s):
    return s.table("documents").include("labels").to_df().select("doc_id", "labels.quality", "labels.toxic")


@query("SELECT n_nationkey, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey), '') AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def include_collection(s):
    return s.table("nation").include("customers", ["c_custkey"]).to_df().select("n_nationkey", listed("customers", lambda x: x["c_custkey"]).alias("customers"))


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def include_collection_empty(s):
    return s.table("orders").include("lines", ["l_linenumber"]).to_df().select("o_orderkey", F.size("lines").cast("long").alias("n"))


@query("SELECT l_orderkey AS o_orderkey, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def include_key_array(s):
    return s.table("order_parts").include("parts", ["p_brand"]).to_df().select("o_orderkey", listed("parts", lambda x: x["p_brand"]).alias("brands"))


@query("""SELECT r_regionkey, string_agg(n_nationkey || ':' || n, ',' ORDER BY n_nationkey) AS nations FROM region JOIN
  (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def then_include(s):
    df = s.table("region").include("nations", ["n_nationkey"]).then_include("customers", ["c_custkey"]).to_df()
    return df.select("r_regionkey", listed("nations", lambda x: F.concat_ws(":", x["n_nationkey"], F.size(x["customers"]))).alias("nations"))


@query("""WITH p AS (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5)
  SELECT c_custkey, n_name AS nation, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM p LEFT JOIN nation ON c_nationkey = n_nationkey""")
def include_after_page(s):
    df = s.table("customer").order_by("c_acctbal", desc=True).skip(5).take(10).include("nation").include("orders", ["o_orderkey"]).to_df()
    return df.select("c_custkey", c("nation.n_name").alias("nation"), F.size("orders").cast("long").alias("orders"))


@query("SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON nullif(o_custkey, 0) = c_custkey")
def sentinel_zero(s):
    return s.table("orders").include("customer_or_none").to_df().select("o_orderkey", c("customer_or_none.c_name").alias("customer"))


@query("""WITH p AS (SELECT * FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) >= 5 ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10)
  SELECT c_custkey, n_name AS nation, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM p LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name""")
def flagship(s):
    q = s.table("customer").where(lambda x: x.count("orders", c("o_totalprice") > 100000) >= 5).order_by("c_acctbal", desc=True).skip(10).take(10)
    return q.include("nation").include("orders", ["o_orderkey"]).to_df().select("c_custkey", c("nation.n_name").alias("nation"), listed("orders", lambda x: x["o_orderkey"]).alias("orders"))


# ---- beyond the core set
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, round(avg(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL")
def group_agg(s):
    return s.table("lineitem").group_by("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.avg("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(s):
    return s.table("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def group_cube(s):
    return s.table("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(p_size) AS least, max(p_size) AS most, sum(p_size) AS total, round(avg(p_size), 6) AS mean, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part")
def scalar_aggregates(s):
    return s.table("part").aggregate(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.sum("p_size").alias("total"), F.round(F.avg("p_size"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT DISTINCT p_brand FROM part")
def distinct_rows(s):
    return s.table("part").select("p_brand").distinct()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(s):
    return s.table("customer").select(k="c_nationkey").union(s.table("supplier").select(k="s_nationkey"))


@query("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def set_concat(s):
    return s.table("nation").select(k="n_regionkey").concat(s.table("region").select(k="r_regionkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(s):
    return s.table("customer").select(k="c_nationkey").intersect(s.table("supplier").select(k="s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(s):
    return s.table("nation").select(k="n_nationkey").except_(s.table("supplier").where(c("s_acctbal") > 5000).select(k="s_nationkey"))


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4")
def element_at(s):
    return s.table("nation").element_at(4).select("n_nationkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 3")
def reverse_take(s):
    return s.table("nation").reverse().take(3).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey < (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)")
def take_while(s):
    return s.table("nation").take_while(c("n_regionkey") != 3).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)")
def skip_while(s):
    return s.table("nation").skip_while(c("n_regionkey") != 3).select("n_nationkey")


@query("SELECT NULL::INTEGER AS n_nationkey")
def default_if_empty(s):
    return s.table("nation").where(c("n_nationkey") < 0).select("n_nationkey").default_if_empty()


@query("SELECT count(*) > 0 AS found FROM nation WHERE n_name = 'NATION_3'")
def contains_item(s):
    return s.table("nation").any_df(c("n_name") == "NATION_3", "found")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def of_type(s):
    return s.table("events").of_type("event_type", "click").select("event_id", "event_type")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_size::BIGINT AS p_size FROM part")
def cast_columns(s):
    return s.table("part").cast(p_partkey="string", p_size="bigint").select("p_partkey", "p_size")


@query("SELECT l_orderkey AS o_orderkey, l_partkey AS part FROM lineitem")
def select_many(s):
    return s.table("order_parts").select_many("part_keys", "part").select("o_orderkey", "part")


@query("SELECT r_regionkey, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 4 GROUP BY r_regionkey")
def group_join(s):
    q = s.table("region").group_join(s.table("nation").where(c("n_nationkey") > 4), "r_regionkey", "n_regionkey", "nations")
    return q.to_df().select("r_regionkey", listed("nations", lambda x: x["n_name"]).alias("names"))


@query("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)::INT AS place FROM customer QUALIFY place <= 3")
def window_rank(s):
    place = F.rank().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal")))
    return s.table("customer").to_df().select("c_custkey", "c_nationkey", place.alias("place")).where("place <= 3")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def window_running(s):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return s.table("orders").to_df().select("o_orderkey", F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("n"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE embedding[2] > 0")
def array_element(s):
    return s.table("embeddings").where(F.element_at("embedding", 2) > 0).select("vec_id", first=F.round(F.element_at("embedding", 1).cast("double"), 6))


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_partkey = 7")
def array_any_match(s):
    return s.table("order_parts").where(F.array_contains("part_keys", F.lit(7).cast("long"))).select("o_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_prop(s):
    return s.table("events").select("event_id", k=F.get_json_object("props", "$.k"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(s):
    return tumbling(s.table("events").to_df(), "ts", "1 hour", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 17")
def equality_index(s):
    index = EqualityIndex.build(s.rows(s.registry["orders"]), "orders", "o_custkey", ["o_orderkey"], version="sample")
    return index.find(s.rows(s.registry["orders"]), 17).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def equality_index_range(s):
    index = EqualityIndex.build(s.rows(s.registry["part"]), "part", "p_size", ["p_partkey"], version="sample")
    return index.find_range(s.rows(s.registry["part"]), 10, 12).select("p_partkey", "p_size")


# ---- further joins
@query("SELECT s_suppkey, r_name FROM supplier JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') ON s_nationkey = n_nationkey")
def join_inner_side(s):
    inner = s.table("nation").join(s.table("region"), "n_regionkey", "r_regionkey").where(c("r_name") != "ASIA")
    return s.table("supplier").join(inner, "s_nationkey", "n_nationkey").select("s_suppkey", "r_name")


@query("""SELECT o.o_orderkey FROM orders o JOIN (SELECT o_custkey, o_orderstatus, max(o_orderdate) AS latest FROM orders GROUP BY ALL) l
  ON o.o_custkey = l.o_custkey AND o.o_orderstatus = l.o_orderstatus AND o.o_orderdate = l.latest""")
def join_composite(s):
    latest = s.of(s.table("orders").group_by("o_custkey", "o_orderstatus").agg(F.max("o_orderdate").alias("latest")))
    return s.table("orders").join(latest, ["o_custkey", "o_orderstatus", "o_orderdate"], ["o_custkey", "o_orderstatus", "latest"], prefix="l_").select("o_orderkey")


@query("SELECT c_custkey, r_name FROM customer JOIN region ON c_nationkey % 5 = r_regionkey AND upper(substr(c_mktsegment, 1, 1)) > 'D'")
def join_computed(s):
    left = s.table("customer").where(F.upper(F.substring("c_mktsegment", 1, 1)) > "D")
    return left.join(s.table("region"), c("c_nationkey") % 5, lambda x: x["r_regionkey"], hint="broadcast").select("c_custkey", "r_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(s):
    q = s.table("nation").join_where(s.table("nation"), lambda a, b: (a("n_regionkey") == b("n_regionkey")) & (a("n_nationkey") < b("n_nationkey")), prefix="o_")
    return q.select(a="n_nationkey", b="o_n_nationkey")


@query("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def join_cross(s):
    return s.table("nation").cross_join(s.table("region")).select("n_nationkey", "r_regionkey")


@query("""SELECT p_partkey, grade FROM part LEFT JOIN (VALUES (900.0, 1000.0, 'low'), (1000.0, 1200.5, 'middle'), (1200.0, 1500.0, 'high')) AS g(least, most, grade)
  ON p_retailprice BETWEEN least AND most""")
def join_range(s):
    grades = s.spark.createDataFrame([(900.0, 1000.0, "low"), (1000.0, 1200.5, "middle"), (1200.0, 1500.0, "high")], "least double, most double, grade string")
    return s.table("part").join_range(s.of(grades), "p_retailprice", "least", "most", width=100, how="left").select("p_partkey", "grade")


_AS_OF = """SELECT event_id, (SELECT max(v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts) AS seen FROM events e WHERE event_type = 'purchase'"""


@query(_AS_OF)
def join_as_of(s):
    kind = lambda k: s.table("events").where(c("event_type") == k)
    return kind("purchase").join_as_of(kind("view"), "ts", "ts", {"user_id": "user_id"}, prefix="v_").select("event_id", seen="v_ts")


@query(_AS_OF)
def join_as_of_in_steps(s):
    kind = lambda k: s.table("events").where(c("event_type") == k)
    return kind("purchase").join_as_of(kind("view"), "ts", "ts", {"user_id": "user_id"}, prefix="v_", width=86_400).select("event_id", seen="v_ts")


# ---- more of the query layer
@query("SELECT c_custkey FROM customer ORDER BY lower(c_mktsegment) DESC, c_custkey LIMIT 7 OFFSET 2")
def order_by_collation(s):
    return s.table("customer").order_by("c_mktsegment", desc=True, collation="UNICODE_CI").skip(2).take(7).select("c_custkey")


@query("SELECT n_nationkey FROM nation")
def include_after_projection(s):
    return s.table("nation").select("n_nationkey").include("customers")


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def auto_include(s):
    eager = replace(s.registry["supplier"], auto_include=("nation",))
    own = Session(s.spark, Registry({**s.registry.entities, "supplier": eager}), s.read)
    return own.table("supplier").to_df().select("s_suppkey", c("nation.n_name").alias("nation"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 40")
def skip_ordered(s):
    return s.table("orders").order_by("o_totalprice", desc=True).skip(40).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 2000 OR o_orderkey < 0 ORDER BY o_totalprice")
def take_while_ordered(s):
    return s.table("orders").order_by("o_totalprice").take_while(c("o_totalprice") < 2000).select("o_orderkey")


@query("""SELECT l_orderkey AS o_orderkey, l_partkey AS part FROM lineitem WHERE l_partkey > 150
  UNION ALL SELECT l_orderkey, NULL FROM lineitem GROUP BY l_orderkey HAVING max(l_partkey) <= 150""")
def select_many_outer(s):
    q = s.table("order_parts").select("o_orderkey", large=F.filter("part_keys", lambda k: k > 150))
    return q.select_many("large", "part", outer=True).select("o_orderkey", "part")


@query("SELECT n_nationkey, hex(n_name) AS code FROM nation")
def hex_text(s):
    return s.table("nation").select("n_nationkey", code=t.hex_of(c("n_name")))


@query("SELECT hex(n_name) || ' ' || hex(r_name) AS line FROM nation JOIN region ON n_nationkey = r_regionkey")
def key_export(s):
    value = lambda name, key, text: s.table(name).to_df().select(c(key).alias("id"), F.encode(text, "UTF-8").alias("value"))
    return export_keys(value("nation", "n_nationkey", "n_name"), value("region", "r_regionkey", "r_name"))


@query("SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL")
def sliding_windows(s):
    return sliding(s.table("events").to_df(), "ts", "3 hours", "1 hour", "event_type")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
  SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(s):
    return sessions(s.table("events").to_df(), "ts", "1 hour", "user_id")


# ---- the binary source: nation and region, written as files of it and read back
_BINARY = {
    "Nation": "COLUMNS\nint ID\nstring Name\nint<Region::ID> RegionID\n\nBUILD 1.0.0.1\n$noninline,id$ID<32>\nName\nRegionID<8>\n",
    "Region": "COLUMNS\nint ID\nstring Name\n\nBUILD 1.0.0.1\n$noninline,id$ID<32>\nName\n",
}


def _binary(s: Session, key: bytes | None = None, with_key: bool = True, archive: bool = False) -> Session:
    """Both tables have a fixed number of rows at every scale. Ids are keys plus 1, as 0 names nothing there. With a key, every second nation is encrypted."""
    folder = f"{application_folder(s.spark)}/binary-{uuid.uuid4().hex}"
    rows = {
        "Nation": [(r.n_nationkey + 1, [r.n_name, r.n_regionkey + 1]) for r in s.table("nation").to_df().orderBy("n_nationkey").collect()],
        "Region": [(r.r_regionkey + 1, [r.r_name]) for r in s.table("region").to_df().orderBy("r_regionkey").collect()],
    }
    tables = {}
    for name, text in _BINARY.items():
        fields = list(resolve(name, parse_definition(text), "1.0.0.1").fields)
        part = lambda own, **more: Part([i for i, _ in own], [v for _, v in own], **more)
        parts = [part(rows[name][::2]), part(rows[name][1::2], key_lookup=0xABC, key=key)] if key and name == "Nation" else [part(rows[name])]
        tables[name] = write_table(fields, parts)
        write_bytes(f"{folder}/{name}.dbd", text.encode())
    if archive:
        options = write_store(folder, tables)
    else:
        options = {"path": folder}
        for name, content in tables.items():
            write_bytes(f"{folder}/{name}.db2", content)
    if key and with_key:
        write_bytes(f"{folder}/keys.txt", f"{0xABC:016X} {key.hex()}\n".encode())
        options["keys"] = f"{folder}/keys.txt"
    return binary_session(s.spark, ";".join(f"{k}={v}" for k, v in {**options, "definitions": folder, "version": "1.0.0.1"}.items()))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def binary_roundtrip(s):
    return _binary(s).table("Nation").select("Name", Id="Id", RegionID="RegionID").to_df().select((c("Id") - 1).alias("n_nationkey"), c("Name").alias("n_name"), (c("RegionID") - 1).alias("n_regionkey"))


@query("SELECT n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT n_name FROM nation WHERE n_nationkey IN (3, 11)")
def binary_lookup(s):
    own = _binary(s)
    return own.find_df("Nation", 8).select(c("Name").alias("n_name")).unionByName(own.find_many("Nation", [12, 4, 99]).select(c("Name").alias("n_name")))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 4")
def binary_include(s):
    return _binary(s).table("Nation").where(c("Id") > 5).include("Region").to_df().select(c("Name").alias("n_name"), c("Region.Name").alias("r_name"))


@query("SELECT n_nationkey, n_name, n_nationkey % 2 = 0 AS plain FROM nation")
def binary_encrypted(s):
    key = bytes(range(16))
    shown = lambda own: own.table("Nation").to_df().select((c("Id") - 1).alias("n_nationkey"), c("Name").alias("n_name"))
    plain = shown(_binary(s, key, with_key=False)).select("n_nationkey", F.lit(True).alias("plain"))
    return shown(_binary(s, key)).join(plain, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("plain", F.lit(False)).alias("plain"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def binary_archive(s):
    """The same tables out of a content store: manifest, ROOT, ENCODING, indexes and block containers."""
    df = _binary(s, bytes(range(16)), archive=True).table("Nation").include("Region", ["Name"]).to_df()
    return df.select((c("Id") - 1).alias("n_nationkey"), c("Name").alias("n_name"), c("Region.Name").alias("r_name"))
