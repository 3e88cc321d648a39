"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Each source's share is its weight; a source is clamped at ``max_epochs`` times its size and the excess goes to the others by
weight, until no target is above its cap. With the sources in order of cap / weight the clamped ones come first, so running
sums find the water level in one pass over one row per source.

A source's target is a number of whole repetitions of all its documents and a rest of under one. The rest is filled in the
order of a seeded hash of the document id: bucket sums locate the bucket in which the running total passes the rest, and a
window over that bucket alone finds the last document that fits. What is still missing is filled in the same way from the
smaller documents behind that cut, ``passes`` times in all. Reruns give the same rows, however the table is partitioned.

Defined results: a null text has size 0. A null source is a source of its own, last in order. Rows that repeat a document
are taken or left together in each pass. A null id is hashed like the others. Sources of size 0 have target 0. A table
without rows gives no rows. Columns other than those named are not looked at. Sources must be few enough for one task to
sort one row of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS, MAX_EPOCHS, SEED, PASSES = (5, 2, 1), 3, "mix-1", 3
#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets a source.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, rest) of each source; sizes has (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    every = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    leveled = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    leveled = leveled.withColumn("level", F.col("cap").cast("double") / F.col("weight"))
    #: The water level if all sources before this one are clamped.
    water = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    level = F.first(F.when(F.col("water") <= F.col("level"), F.col("water")), ignorenulls=True).over(every)
    filled = leveled.withColumn("water", water).withColumn("at", level)
    filled = filled.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")), F.lit(0.0)))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole)
    rest = F.when(F.col("whole") >= max_epochs, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    return filled.select("source", "source_size", "target", "whole", rest.alias("rest"))


def _cut(docs: DataFrame) -> DataFrame:
    """(key, cut, sum): documents up to hash ``cut`` fit the key's rest, and sum up to ``sum``. docs: (key, bucket, hash, size, rest)."""
    sums = docs.groupBy("key", "bucket").agg(F.sum("size").alias("own"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("own").over(W.partitionBy("key").orderBy("bucket")))
    passing = F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("own")).alias("base")))
    total = sums.groupBy("key").agg(F.max("upto").alias("total"), F.min(passing).alias("over")).select("key", "total", "over.*")
    inside = docs.join(total.where("bucket IS NOT NULL"), ["key", "bucket"]).select("key", "hash", "size", "base", "rest")
    # Rows of equal hash repeat one document; the window's frame takes them together.
    inside = inside.withColumn("upto", F.sum("size").over(W.partitionBy("key").orderBy("hash")) + F.col("base")).where("upto <= rest")
    last = inside.groupBy("key").agg(F.max("hash").alias("hash"), F.max("upto").alias("upto"))
    # "g" is behind every hexadecimal string: no bucket passes the rest.
    return total.join(last, "key", "left").select("key", F.coalesce("hash", "bucket", F.lit("g")).alias("cut"), F.coalesce("upto", "base", "total").alias("sum"))


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, passes: int = PASSES) -> DataFrame:
    """docs: (doc_id, source, size). Adds source_size, target, and times, the repetitions that the mix takes."""
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # joins on it find a null source, too
    slim = docs.select("doc_id", "source", "size", key.alias("key"), hashed.alias("hash"), F.substring(hashed, 1, DIGITS).alias("bucket"))
    slim = written(slim, "mix-sizes")
    none = F.expr("CAST(array() AS array<struct<most:double,cut:string>>)")
    plan = written(source_targets(slim, weights, max_epochs).select(key.alias("key"), "source_size", "target", "whole", "rest", none.alias("cuts")), "mix-plan")
    taken = F.exists("cuts", lambda c: (F.col("size") <= c["most"]) & (F.col("hash") <= c["cut"]))
    for _ in range(passes):
        free = slim.join(plan, "key").where((F.col("size") > 0) & (F.col("size") <= F.col("rest")) & ~taken)
        cut = _cut(free.select("key", "bucket", "hash", "size", "rest"))
        cuts = F.when(F.col("cut").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(F.struct(F.col("rest").alias("most"), F.col("cut")))))
        rest = F.col("rest") - F.coalesce("sum", F.lit(0))
        plan = written(plan.join(cut, "key", "left").select("key", "source_size", "target", "whole", rest.alias("rest"), cuts.alias("cuts")), "mix-plan")
    times = F.col("whole") + F.when((F.col("size") > 0) & taken, 1).otherwise(0)
    return slim.join(plan, "key").select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, source and more), each as often as the mix takes it. Documents without a word go."""
    times = mixed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), **options).where("size > 0 AND times > 0")
    # Rows that repeat a document have one row of ``times`` each, all alike.
    times = times.groupBy("doc_id", "source", "size").agg(F.max("times").alias("times"))
    # Columns of docs lie in a struct: names of their own don't meet those used here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").alias("id"), F.col("source").alias("of"), n_words(F.col("text")).alias("words"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return own.join(times, same).select("own", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("own.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _pass_sql(n: int) -> str:
    taken = " OR ".join(f"(d.size <= p{i}.rest AND d.hash <= p{i}.cut)" for i in range(1, n)) or "false"
    joins = "".join(f" LEFT JOIN p{i} ON d.source IS NOT DISTINCT FROM p{i}.source" for i in range(1, n))
    now = f"p{n - 1}.left_over" if n > 1 else "t.rest"
    return f"""
o{n} AS (SELECT d.source, d.hash, d.size, {now} AS rest FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source{joins}
  WHERE d.size > 0 AND d.size <= {now} AND NOT coalesce({taken}, false)),
r{n} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM o{n}),
p{n} AS (SELECT t.source, coalesce({now}, 0) AS rest, coalesce(max(r.hash) FILTER (WHERE r.upto <= r.rest), '') AS cut,
  coalesce({now}, 0) - coalesce(max(r.upto) FILTER (WHERE r.upto <= r.rest), 0) AS left_over
  FROM t {f"JOIN p{n - 1} ON t.source IS NOT DISTINCT FROM p{n - 1}.source" if n > 1 else ""} LEFT JOIN r{n} r ON t.source IS NOT DISTINCT FROM r.source
  GROUP BY t.source, {now})"""


ORACLE = (
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || doc_id) AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, cap::DOUBLE / weight AS level FROM w),
v AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS water
  FROM l WINDOW o AS (ORDER BY level, source NULLS LAST), b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT arg_min(water, place) AS lambda_ FROM v WHERE water <= level),
g AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, lambda_ * weight), 0) AS target FROM v, a),
t AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole,
  CASE WHEN source_size = 0 OR floor(target / source_size) >= 3 THEN 0 ELSE target - floor(target / source_size)::BIGINT * source_size END AS rest FROM g),"""
    + ",".join(map(_pass_sql, range(1, PASSES + 1)))
    + r"""
SELECT d.doc_id, d.size, t.source_size, t.target,
  d.size * (t.whole + CASE WHEN """
    + " OR ".join(f"(d.size <= p{i}.rest AND d.hash <= p{i}.cut)" for i in range(1, PASSES + 1))
    + r""" THEN 1 ELSE 0 END) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
    + "".join(f" JOIN p{i} ON d.source IS NOT DISTINCT FROM p{i}.source" for i in range(1, PASSES + 1))
)
