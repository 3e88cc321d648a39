"""True links among candidates: sets of shingles are compared in tasks of bounded size.

A cluster (documents strung together by shared buckets) that fits into a task goes there whole. In a larger one only documents
that share a bucket are compared. Every bucket has a representative, that of its documents which shares buckets with most others:
each document is compared with the representatives of its buckets, whose text goes to as many tasks as their documents need.
Representatives have met everyone then and leave their buckets. A bucket whose other documents are linked, by whatever way, is
done, which is what becomes of near copies of one text, however many. What is left, mostly documents that share a bucket without
being near, is compared as small clusters or, where these are large again, bucket by bucket; large buckets are cut into blocks
that meet pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import HOT_LINKS, HOT_NODES, components, spread_join, with_roots

LINKS = "a long, b long"


def reached(sets: list, percent: int) -> list[int]:
    """For each set the place of the one from which it was first reached, or its own: links that keep components whole."""
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    origin, open_ = np.arange(n), np.arange(n)
    mark = np.zeros(len(vocabulary), bool)
    elements, bounds = flat, starts[:-1]
    for root in range(n):
        if origin[root] != root or root not in open_:
            continue
        queue = [root]
        open_, elements, bounds = _without(open_, np.array([root]), flat, starts)
        while queue and len(open_):
            at = queue.pop()
            own = flat[starts[at] : starts[at + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[elements], bounds, dtype=np.int64)
            mark[own] = False
            found = open_[100 * common >= percent * (sizes[open_] + sizes[at] - common)]
            if len(found):
                origin[found] = at
                queue.extend(found.tolist())
                open_, elements, bounds = _without(open_, found, flat, starts)
    return origin.tolist()


def _without(open_, gone, flat, starts):
    """The places that are left, with their elements and where each one's begin."""
    import numpy as np

    left = np.setdiff1d(open_, gone, assume_unique=True)
    if not len(left):
        return left, flat[:0], left
    sizes = starts[left + 1] - starts[left]
    ends = np.cumsum(sizes)
    return left, flat[np.repeat(starts[left] - (ends - sizes), sizes) + np.arange(ends[-1])], ends - sizes


def near(one, other, percent: int) -> bool:
    """one, other: sorted arrays of distinct hashes."""
    import numpy as np

    common = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def _pairs(pairs: list):
    import pyarrow as pa

    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _together(shingler, percent: int):
    """Links among all documents of a task."""

    def run(group):
        make = shingler()
        once = dict(zip(group.column("node").to_pylist(), group.column("text").to_pylist(), strict=True))
        nodes = sorted(once)
        origin = reached([make(once[x]) for x in nodes], percent)
        return _pairs([(nodes[i], nodes[o]) for i, o in enumerate(origin) if i != o])

    return run


def _with_head(shingler, percent: int):
    """Links of a task's documents with its head."""

    def run(group):
        make = shingler()
        head, node, text = (group.column(c).to_pylist() for c in ("head", "node", "text"))
        at = head.index(True)
        own = make(text[at])
        return _pairs([(n, node[at]) for h, n, t in zip(head, node, text, strict=True) if not h and near(own, make(t), percent)])

    return run


def cuts(docs, shingles, block_docs: int, block_shingles: int):
    return F.ceil(F.greatest(F.col(docs) / block_docs, F.col(shingles) / block_shingles)).cast("int")


def _sent(texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks: (node, task, head). Each text goes to its tasks."""
    listed = tasks.groupBy("node").agg(F.collect_list(F.struct("task", "head")).alias("tasks"))
    return texts.select("node", "text").join(listed.hint("merge"), "node").select("node", "text", F.inline("tasks"))


def _blocks(rows: DataFrame, sizes: DataFrame, group: str, hot, block_docs: int, block_shingles: int) -> DataFrame:
    """rows: (group, node); sizes: (group, docs, shingles). Tasks of one block, or of each two blocks of a group that needs several."""
    sized = spread_join(rows, sizes.select(group, "docs", cuts("docs", "shingles", block_docs, block_shingles).alias("cuts")), group, hot)
    placed = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    # Two blocks meet once; a block alone meets itself.
    others = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: (F.col("cuts") == 1) | (o != F.col("own")))
    placed = placed.select("node", group, "own", F.explode(others).alias("other"))
    task = F.struct(F.col(group).alias("group"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return placed.select("node", task.alias("task"), F.lit(False).alias("head"))


def small_links(texts: DataFrame, shingler, percent: int) -> DataFrame:
    """texts: (root, node, text) of clusters that fit into a task."""
    return texts.groupBy("root").applyInArrow(_together(shingler, percent), LINKS)


def large_links(texts: DataFrame, bands: DataFrame, shingler, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """texts: (node, n, text) of large clusters, n the size of a text's set; bands: (node, bands), the keys of its buckets."""
    nodes = written(texts.select("node", "n").join(bands, "node"), "large")
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    hot = F.col("docs") > max(HOT_LINKS, 2 * total // HOT_NODES)  # HOT_NODES buckets or representatives at most
    own = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    shared = spread_join(own, sizes, "key", hot).groupBy("node", "n").agg(F.collect_list("key").alias("keys"), F.sum("docs").alias("degree"))
    shared = written(shared, "shared").select("node", "n", "degree", F.explode("keys").alias("key"))
    heads = shared.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("head"), F.count(F.lit(1)).alias("docs"))
    met = written(spread_join(shared, heads, "key", hot).where("node <> head").select("key", "node", "n", "head"), "met")

    # Documents with their representatives.
    pairs = met.select("head", "node", "n").distinct()
    weights = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    weights = written(weights.select("head", "docs", cuts("docs", "shingles", block_docs, block_shingles).alias("cuts")), "heads")
    task = lambda part: F.struct(F.col("head").alias("group"), part.cast("int").alias("i"))
    members = spread_join(pairs, weights, "head", hot).select("node", task(F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("task"), F.lit(False).alias("head"))
    parts = weights.select("head", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
    tasks = members.unionByName(parts.select(F.col("head").alias("node"), task(F.col("part")).alias("task"), F.lit(True).alias("head")))
    links = written(_sent(texts, tasks).groupBy("task").applyInArrow(_with_head(shingler, percent), LINKS), "links")

    # Buckets whose other documents don't hang together by now.
    roots = with_roots(components(links)).withColumnRenamed("root", "found")
    rest = met.groupBy("node", "n").agg(F.collect_list("key").alias("keys")).join(roots, "node", "left")
    rest = rest.select("node", "n", F.coalesce("found", "node").alias("root"), F.explode("keys").alias("key"))
    open_ = rest.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.min("node").alias("least"), F.count(F.lit(1)).alias("docs"))
    left = written(spread_join(rest, open_.where("one <> other").select("key", "least", "docs"), "key", hot).select("key", "node", "n", "least"), "left")
    if not left.take(1):
        return links
    clusters = with_roots(components(left.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))))
    clusters = clusters.join(left.select("node", "n").distinct(), "node")
    weights = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    weights = weights.select("root", "docs", cuts("docs", "shingles", block_docs, block_shingles).alias("cuts"))
    clusters = written(spread_join(clusters, weights, "root", hot).select("node", "root", "cuts"), "clusters")
    whole = clusters.where("cuts = 1").select("node", F.struct("root").alias("task"), F.lit(False).alias("head"))
    links = links.unionByName(_sent(texts, whole).groupBy("task").applyInArrow(_together(shingler, percent), LINKS))
    if clusters.where("cuts > 1").take(1):
        # Bucket by bucket; those of the same documents count once.
        rest = left.join(clusters.where("cuts > 1").select("node"), "node")
        sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
        sizes = sizes.groupBy("docs", "shingles", "sum").agg(F.min("key").alias("key")).select("key", "docs", "shingles")
        tasks = _blocks(rest.select("key", "node"), sizes, "key", hot, block_docs, block_shingles)
        links = links.unionByName(_sent(texts, tasks).groupBy("task").applyInArrow(_together(shingler, percent), LINKS))
    return links
