"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors are dealt to partitions by length, the longest first, and written once; no vector is copied.
2. Each query meets the longest vectors of its dimension, ``HEAD`` numbers in all: its k-th best product there is a level that
   its final list can't fall under.
3. Queries go out in blocks of ``BLOCK`` numbers, each to all partitions. A partition's vectors come in order of length and are
   cut into buckets. A query's level, over its own length and the bucket's longest, is the cosine that a vector must reach:
   above 1 the bucket and all shorter ones are skipped; from ``COORDINATE_FROM`` on the bucket is pruned by the query's
   largest coordinates, whose feasible range the cosine bounds; below that by length. The products of what is left are
   verified, raise the level, and each partition returns its k best that reach the level. They are ranked together.

A task holds one block of queries, k results for each, and one bucket. Vectors are shuffled once, results k a query and
partition at most.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part, and rows without an id
neither. Only vectors of equal dimension meet. A candidate row that repeats is ranked as often as it is there; rows that
repeat a query's id are one query. A query's own id is no candidate of it. Products are exact, and those beyond 64 bits count
as the largest or smallest such number; a component that ``scale`` makes larger than any double counts as the largest double.
Where lengths or bounds are beyond doubles nothing is pruned. A table without rows gives no rows. Columns other than the id
and the vector are not looked at. Dimensions must be few enough for the driver to hold one number for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, table, written

K, SCALE, EVERY = 10, 1024, 100
#: Numbers in a block of queries and in the longest vectors that give the first levels; vectors in a bucket.
BLOCK, HEAD, BUCKET = 1 << 22, 1 << 17, 1024
COORDINATE_FROM, COORDINATES = 0.75, 4
KIND = "place long, id long, dim int, length double, v array<double>"


def _scaled(scale: int):
    """Keeps what takes part: v = floor(scale * x) as whole doubles, and its length."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        largest = np.finfo(float).max
        for batch in batches:
            place, ids, lists = batch.columns
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN here
            row = np.repeat(np.arange(len(sizes)), sizes)
            takes = pc.and_(pc.is_valid(ids), pc.is_valid(lists)).to_numpy(zero_copy_only=False) & (np.bincount(row, weights=~np.isfinite(flat), minlength=len(sizes)) == 0)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(scale * flat[takes[row]]), -largest, largest)
            sizes = sizes[takes]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            long_ = np.zeros(len(sizes))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                long_[at] = lengths(v[bounds[at][:, None] + np.arange(dim)])
            mask = pa.array(takes)
            columns = [place.filter(mask), ids.filter(mask), pa.array(sizes.astype(np.int32)), pa.array(long_), pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), pa.array(v))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "id", "dim", "length", "v"])

    return run


def lengths(v):
    """Lengths of vectors; their largest components are taken out first, as squares of doubles may be too large for one."""
    import numpy as np

    most = np.abs(v).max(axis=1, initial=0)
    unit = np.where(most > 0, most, 1)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((v / unit[:, None]) ** 2).sum(axis=1))


def products(a, b):
    """Exact inner products of whole numbers: in doubles where they hold every sum, else in 64-bit or Python integers."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.int64)
    if not out.size or not a.shape[1]:
        return out
    most_a, most_b = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
    # A single large vector doesn't make the others slow.
    wide_a, wide_b = (np.flatnonzero(m * a.shape[1] >= 2.0**26) for m in (most_a, most_b))
    slim_a, slim_b = (np.flatnonzero(m * a.shape[1] < 2.0**26) for m in (most_a, most_b))
    if len(slim_a) and len(slim_b):
        out[np.ix_(slim_a, slim_b)] = (a[slim_a] @ b[slim_b].T).astype(np.int64)
    for left, right in ((wide_a, np.arange(len(b))), (slim_a, wide_b)):
        if len(left) and len(right):
            out[np.ix_(left, right)] = _wide(a[left], b[right])
    return out


def _wide(a, b):
    import numpy as np

    with np.errstate(over="ignore"):
        most = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -(2**63), 2**63 - 1).astype(np.int64)


class Search:
    """A block of queries of one dimension, which meets vectors in order of length."""

    def __init__(self, ids, vectors, level=None, k: int = K):
        import numpy as np

        self.ids, self.vectors, self.k = np.asarray(ids), vectors, k
        self.own = lengths(vectors)
        #: What a product must reach: the k-th best so far, here or elsewhere.
        self.level = np.full(len(self.ids), -np.inf) if level is None else np.array(level, float)
        self.scores = [np.zeros(0, np.int64)] * len(self.ids)
        self.found = [np.zeros(0, np.int64)] * len(self.ids)
        self.focus = np.argsort(-np.abs(vectors), axis=1, kind="stable")[:, :COORDINATES]

    def _offer(self, q: int, ids, scores) -> None:
        import numpy as np

        keep = (ids != self.ids[q]) & (scores >= self.level[q])
        if not keep.any():
            return
        ids, scores = np.concatenate([self.found[q], ids[keep]]), np.concatenate([self.scores[q], scores[keep]])
        top = np.lexsort((ids, ~scores))[: self.k]
        self.found[q], self.scores[q] = ids[top], scores[top]
        if len(top) == self.k:
            self.level[q] = max(self.level[q], float(scores[top[-1]]))

    def meet(self, ids, vectors) -> None:
        """Vectors in any order; the longer come first, the more is skipped."""
        import numpy as np

        sizes = lengths(vectors)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), BUCKET):
            own = order[at : at + BUCKET]
            for q in range(0, len(self.ids), BUCKET):
                self._bucket(np.arange(q, min(len(self.ids), q + BUCKET)), ids[own], vectors[own], sizes[own])

    def _bucket(self, block, ids, part, long_) -> None:
        import numpy as np

        # A little slack keeps rounding of lengths from losing a tie; products decide.
        need, own = self.level[block] - 1e-6 * np.abs(self.level[block]) - 1e-6, self.own[block]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            reach = own * long_[0]
            cosine = np.where(reach > 0, need / reach, np.where(need <= 0, -np.inf, np.inf))
        # What isn't known prunes nothing.
        cosine = np.where(np.isfinite(need) & np.isfinite(reach), cosine, -np.inf)
        whole = np.flatnonzero(cosine < COORDINATE_FROM)
        if len(whole):
            scores = products(self.vectors[block[whole]], part)
            for i in np.flatnonzero((scores >= self.level[block[whole], None]).any(axis=1)).tolist():
                q = block[whole[i]]
                n = len(long_)
                if np.isfinite(cosine[whole[i]]) and need[whole[i]] > 0 and own[whole[i]] > 0:
                    n = int(np.searchsorted(-long_, -need[whole[i]] / own[whole[i]], side="right"))
                places = np.flatnonzero(scores[i, :n] >= self.level[q])
                self._offer(q, ids[places], scores[i, places])
        some = np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1))
        if len(some):
            unit = np.where(long_[:, None] > 0, part / np.where(long_ > 0, long_, 1)[:, None], 0)
        for i in some.tolist():
            q = block[i]
            focus = self.focus[q]
            angle, spread = np.arccos(np.clip(self.vectors[q, focus] / own[i], -1, 1)), np.arccos(cosine[i])
            high, low = np.cos(np.maximum(0, angle - spread)), np.cos(np.minimum(np.pi, angle + spread))
            values = unit[:, focus]
            places = np.flatnonzero(((values <= high + 1e-9) & (values >= low - 1e-9)).all(axis=1))
            if len(places):
                self._offer(q, ids[places], products(self.vectors[q : q + 1], part[places])[0])

    def rows(self) -> list[tuple[int, int, int]]:
        """(query id, id, score) of the best found."""
        return [(int(q), int(i), int(s)) for q, ids, scores in zip(self.ids, self.found, self.scores, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


def _matrix(column, dim: int):
    import numpy as np

    chunk = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(chunk.flatten()).reshape(len(chunk), dim) if len(chunk) else np.zeros((0, dim))


def _by_dimension(rows) -> dict:
    """For each dimension ids, vectors and, where it is there, level; rows is an Arrow table or batch."""
    import numpy as np
    import pyarrow.compute as pc

    out = {}
    for dim in pc.unique(rows.column("dim")).to_pylist():
        own = rows.filter(pc.equal(rows.column("dim"), dim))
        level = own.column("level").to_numpy(zero_copy_only=False) if "level" in rows.schema.names else None
        out[dim] = np.asarray(own.column("id")), _matrix(own.column("v"), dim), level
    return out


def _levels(head, k: int):
    """Adds to queries the k-th best product with the longest vectors."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        long_ = head.value
        for batch in batches:
            for dim, (ids, v, _) in _by_dimension(batch).items():
                search = Search(ids, v, k=k)
                if dim in long_:
                    search.meet(*long_[dim][:2])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype="i4") * dim), pa.array(v.ravel()))
                columns = [pa.array(ids), pa.array(np.full(len(ids), dim, np.int32)), flat, pa.array(search.level)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "dim", "v", "level"])

    return run


def _found(block, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        searches = {dim: Search(ids, v, level, k) for dim, (ids, v, level) in block.value.items()}
        for batch in batches:
            for dim, (ids, v, _) in _by_dimension(batch).items():
                if dim in searches:
                    searches[dim].meet(ids, v)
        rows = [r for s in searches.values() for r in s.rows()]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """(query_id, rank, vec_id, score); both tables hold an id and an array of numbers, in this order."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    ship(spark)

    def own(df: DataFrame) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id(), F.col(f"`{df.columns[0]}`").cast("long"), F.col(f"`{df.columns[1]}`").cast("array<double>"))
        return rows.mapInArrow(_scaled(scale), KIND)

    # Ties of length are told apart by place, so that many equal vectors don't meet in one partition.
    order = ["dim", F.desc("length"), "place"]
    base = own(vectors).repartitionByRange(*order).sortWithinPartitions(*order)
    base = written(base.select("id", "dim", "length", "v", F.spark_partition_id().alias("part")), "vectors")
    # The longest vectors of a dimension lie in the first partition that has it.
    first = base.groupBy("dim").agg(F.min("part").alias("part")).collect()
    most = max(1, head // max(1, sum(r.dim for r in first)))
    longest = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("length"), "id"))
    starts = reduce(lambda a, r: a | ((F.col("dim") == r.dim) & (F.col("part") == r.part)), first, F.lit(False))
    long_ = sc.broadcast(_by_dimension(base.where(starts).withColumn("n", longest).where(F.col("n") <= most).select("id", "dim", "v").toArrow()))
    asked = own(queries).where(F.col("dim").isin([r.dim for r in first])).groupBy("id", "dim").agg(F.min("v").alias("v"))
    asked = written(asked.mapInArrow(_levels(long_, k), "id long, dim int, v array<double>, level double"), "queries")
    numbers = asked.agg(F.sum(F.col("dim") + 1)).first()[0] or 0
    blocks = -(-numbers // block) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "dim"), F.lit(blocks)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = []
    for b in range(blocks):
        # About ``block`` numbers come to the driver and go out again; the results stay in the shared folder.
        own_block = sc.broadcast(_by_dimension(asked.where(F.col("block") == b).drop("block").toArrow()))
        found = base.mapInArrow(_found(own_block, k), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out.append(written(ranked, "found") if blocks > 1 else ranked)
        if blocks > 1:
            own_block.unpersist()
    return reduce(DataFrame.unionByName, out)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
