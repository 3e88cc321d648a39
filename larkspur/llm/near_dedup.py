"""Near-duplicate documents by min-max hashing.

1. Each text becomes its set of distinct word shingles, as 64-bit hashes. Every permutation gives its minimum and its
   maximum over the set, so ``PERMUTATIONS`` hash evaluations a shingle give twice as many signature values. ``BANDS`` bands
   of ``ROWS`` values each make the bucket keys. Two sets of similarity 0.8 miss each other in all bands once in 150,000.
2. Documents of equal sets are one class (128-bit hash of the set), which gets a number of its own: the node of all graphs
   here. Its least id stands for it. Copies go no further.
3. Classes that share a bucket are strung to the bucket's least class, and connected components of these strings are
   clusters: all candidate pairs lie within clusters, and no pairs are listed.
4. The links are found by comparing full sets. A cluster that fits into a task is one: breadth first, a member is compared with
   those not reached yet, which finds the same components as all pairs would. In a larger one documents are compared with
   representatives of their buckets first, and those that share a bucket and aren't linked by then with each other (linking).
5. Components of the true links give each document the least id that it reaches.

Defined results: a null or empty text has an empty set and is linked with nothing. Each row without an id is a document of
its own, after all that have one: it goes where a near copy has an id, and of a group of such rows alone one stays (that of
the least class), with a null component_id. Rows that repeat an id are one document: their texts are linked. A table without
rows gives no rows. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ship, table, written
from .components import components, with_roots
from .linking import cuts, large_links, small_links

PERMUTATIONS, BANDS, ROWS = 75, 30, 5
SHINGLE, PERCENT = 4, 80
#: What a task of step 4 holds, in documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000
NO_ID = -(2**63)


class Shingler:
    """Sorted arrays of distinct 64-bit shingle hashes; hashes of words are kept for the task, up to a bound."""

    def __init__(self, size: int = SHINGLE, most: int = 500_000):
        import numpy as np

        self.size, self.most, self.known = size, most, {}
        self.factors = np.random.default_rng(20240601).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # A-Z alone, as these are bytes
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.size + 1)
        k = min(self.size, len(words))
        mixed = np.full(n, k, np.uint64)
        for i in range(k):
            mixed = _mix((mixed ^ hashes[i : i + n]) * self.factors[i])
        return np.unique(mixed)


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinMax:
    """Band keys of a set: minima and maxima under each permutation x -> a x + b modulo 2^64."""

    def __init__(self, permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS):
        import numpy as np

        if 2 * permutations != bands * rows:
            raise ValueError("bands x rows must be twice the number of permutations")
        r = np.random.default_rng(7)
        self.a = r.integers(0, 2**63, (permutations, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, (permutations, 1), dtype=np.uint64)
        self.shape, self.row = (bands, rows), r.integers(0, 2**63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = np.arange(bands, dtype=np.uint64)

    def signature(self, hashes):
        import numpy as np

        low, high = [], []
        for at in range(0, len(hashes), 4096):
            v = hashes[None, at : at + 4096] * self.a
            v += self.b
            low.append(v.min(axis=1))
            high.append(v.max(axis=1))
        return np.concatenate([np.min(low, axis=0), np.max(high, axis=0)])

    def keys(self, hashes):
        import numpy as np

        values = _mix(self.signature(hashes)).reshape(self.shape) * self.row
        return _mix(_mix(values).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


SIGNED = "doc long, version long, row long, n long, h1 long, h2 long, bands array<long>"


def _signed(shingle: int, permutations: int, bands: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingler, minmax = Shingler(shingle), MinMax(permutations, bands, rows)
        for batch in batches:
            n, first, second, keys = [], [], [], []
            for text in batch.column("text"):
                hashes = shingler(text.as_py())
                n.append(len(hashes))
                digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
                first.append(int(digest[0]))
                second.append(int(digest[1]))
                keys.append(minmax.keys(hashes) if len(hashes) else np.zeros(0, np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("i4")
            listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch.column("doc"), batch.column("version"), batch.column("row"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "version", "row", "n", "h1", "h2", "bands"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    found = _judged(docs, id_col, text_col, shingle, percent, permutations, bands, rows, block_docs, block_shingles)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row of docs: doc, version (a hash of the text), n, component, kept."""
    ship(docs.sparkSession)
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    slim = docs.select(doc.alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    # A row without an id is told from others by its number.
    numbered = slim.select("doc", "version", F.when(F.col("doc").isNull(), F.monotonically_increasing_id()).alias("row"), "text")
    signed = written(numbered.mapInArrow(_signed(shingle, permutations, bands, rows), SIGNED), "signatures")
    some = signed.where("n > 0")
    # Copies meet here as one row per task and class.
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "version", "row", "n")).alias("first")
    classes = some.groupBy("h1", "h2").agg(first, F.any_value("bands").alias("bands"))
    classes = written(classes.select("h1", "h2", F.monotonically_increasing_id().alias("node"), "first.doc", "first.version", "first.row", "first.n", "bands"), "classes")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    strung = keyed.join(buckets, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    members = with_roots(components(strung)).join(classes.select("node", _known("doc"), "version", "n"), "node")
    weights = members.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    whole = cuts("docs", "shingles", block_docs, block_shingles) == 1
    members = written(members.join(weights.select("root", whole.alias("whole")), "root"), "members")
    # Rows that repeat a text of one id would all be sent.
    once = slim.select(_known("doc"), "version", "text")
    if some.groupBy(_known("doc"), "version").count().where("count > 1").take(1):
        once = once.dropDuplicates(["doc", "version"])
    # Merged at any size: texts of a small table would be read with the members broadcast, those of a large one shuffled.
    texts = once.join(members.hint("merge"), ["doc", "version"]).select("node", "root", "whole", "n", "text")
    shingler = partial(Shingler, shingle)
    if members.where("NOT whole").take(1):
        texts = written(texts, "member-texts")
        links = small_links(texts.where("whole"), shingler, percent)
        links = links.unionByName(large_links(texts.where("NOT whole"), classes.select("node", "bands"), shingler, percent, block_docs, block_shingles))
    else:
        links = small_links(texts, shingler, percent)

    # Texts of one id are linked.
    vertices = some.where("doc IS NOT NULL").select("doc", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    vertices = written(vertices, "vertices")
    same = vertices.groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("doc", "b")
    same = vertices.join(same, "doc").select(F.col("node").alias("a"), "b")
    roots = with_roots(components(links.unionByName(same)))
    # A component is named by its least id; where it has none, one row stays for it.
    own = classes.select("h1", "h2", "node", "doc", "row")
    alone = F.min(F.when(F.col("doc").isNull(), F.struct("h1", "h2", "row")))["row"]
    heads = roots.join(own, "node").groupBy("root").agg(F.min("doc").alias("least"), alone.alias("alone"))
    linked = roots.join(heads, "root").select("node", F.lit(True).alias("linked"), "least", "alone")
    of_head = lambda c, head: F.when(F.col("linked"), F.col(head)).otherwise(F.col(c)).alias(head)
    named = own.join(linked, "node", "left").select("h1", "h2", of_head("doc", "least"), of_head("row", "alone"))
    out = signed.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    stays = (F.col("n") == 0) | F.col("least").isNull() & (F.col("row") == F.col("alone"))
    kept = F.when(F.col("doc").isNull(), stays).otherwise(F.col("doc") == component)
    return out.select("doc", "version", "n", component.alias("component"), kept.alias("kept"))


def _known(doc: str) -> Column:
    """An id to join by; rows without one are told apart by their texts."""
    return F.coalesce(doc, F.lit(NO_ID)).alias(doc)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text and more) whose document stays for its group, one row for each."""
    # Rows without an id are found by their text.
    key = lambda doc, version: (doc.isNull().alias("none"), F.when(doc.isNull(), version).otherwise(doc).alias("key"))
    found = _judged(docs.select("doc_id", "text"), **options).where("kept AND (doc IS NOT NULL OR n > 0)")
    kept = found.select(*key(F.col("doc"), F.col("version"))).distinct()
    # Columns of docs lie in a struct: names of their own don't meet those used here.
    doc, own = F.col("doc_id").cast("long"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    once = docs.select(own, *key(doc, F.xxhash64("text"))).dropDuplicates(["none", "key"])
    # Without an id and without a word: each stays.
    empty = docs.where(doc.isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD))
    return once.join(kept, ["none", "key"]).select("own.*").unionByName(empty)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.a, c.root FROM c JOIN e ON e.b = c.node)
SELECT n.doc_id, n.n AS n_shingles, min(c.root) AS component_id, n.doc_id = min(c.root) AS kept FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n
"""
