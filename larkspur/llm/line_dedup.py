"""Line deduplication over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, last_doc), one row per distinct line key, dealt into buckets by the 128-bit hash of the key
and sorted by it. No key lies in two runs: a new batch's keys are merge-anti-joined with every run, and what is left is the
batch's own run at level 0. Keys that a run has already are merged into a tally of further holders. ``fanout`` runs of a level are
compacted into one of the next. Buckets stay what they are, so that these joins deal no rows anew. When all batches are in,
lines meet the keys that runs and tally say are frequent: counts go over all documents, later ones too, and the largest of
them keeps the line.

Defined results: a null or empty text is one empty line and stays as it is. A null doc_id counts as one document, smaller
than all others. Rows that repeat a doc_id count as one document. Lines whose key has under ``min_chars`` code points
always stay. A table without rows gives no rows. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, bucketed, new_path, removed, table, written

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 5, 4
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, pos, h1, h2) of each line whose key has ``min_chars`` code points; docs has (doc, text, version)."""
    lines = docs.select("doc", "version", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc", "version", "pos", F.btrim("line", F.lit(WS)).alias("k")).where(F.char_length("k") >= min_chars)
    low = ascii_lower(F.col("k"))
    return keyed.select("doc", "version", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(7919), low).alias("h2"))


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        #: For each level its (path, table), oldest first.
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.tally: tuple[str, DataFrame] | None = None

    def _kept(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = new_path(self.spark, name)
        return path, bucketed(df, name, "h1", "h2", path=path, sort=True)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (doc, h1, h2). No document may lie in two batches."""
        # The first grouping splits a line that a third of all documents hold by document; only sums per task meet.
        once = lines.select("h1", "h2", "doc").distinct()
        batch = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        if not self._runs():
            self._put(0, self._kept(batch, "lines-L0"))
            return
        path, batch = self._kept(batch, "lines-batch")
        own = self._kept(self.fresh(batch), "lines-L0")
        more, done = self._kept(_anti(batch, own[1]), "lines-more"), [path]
        if self.tally:
            done += [self.tally[0], more[0]]
            more = self._kept(_added(self.tally[1], more[1], "full"), "lines-more")
        self.tally = more
        removed(self.spark, done)
        self._put(0, own)

    def _put(self, level: int, run: tuple[str, DataFrame]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # No key lies in two of them: their sorted buckets are laid together.
            self._put(level + 1, self._kept(reduce(DataFrame.unionByName, (t for _, t in full)), f"lines-L{level + 1}"))
            removed(self.spark, [p for p, _ in full])

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def all(self) -> DataFrame:
        """One row per key, over all runs and the tally."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        # Each run by itself: what Spark says of a union's partitions doesn't hold for columnar scans of buckets.
        return reduce(DataFrame.unionByName, (_added(r, self.tally[1], "left") if self.tally else r for r in runs))

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The rows of a new batch whose key is in no run yet."""
        return reduce(_anti, self._runs(), lines)

    def marked(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """The lines whose key at least ``min_docs`` documents hold, but for those of the largest of these documents."""
        frequent = written(self.all().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), "lines-frequent")
        return lines.join(frequent, ["h1", "h2"]).where("doc <> last_doc")


def _anti(lines: DataFrame, run: DataFrame) -> DataFrame:
    return lines.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")


def _added(runs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    joined = runs.join(more.select("h1", "h2", F.col("n_docs").alias("n"), F.col("last_doc").alias("last")).hint("merge"), ["h1", "h2"], how)
    n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
    return joined.select("h1", "h2", n_docs.alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """All columns of docs with the text that is left, plus n_lines and n_dropped (an earlier column of that name goes)."""
    return _rebuilt(docs, id_col, text_col, min_chars, min_docs, batches, fanout)


def _rebuilt(docs, id_col, text_col, min_chars, min_docs, batches, fanout) -> DataFrame:
    spark = docs.sparkSession
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.col(f"`{text_col}`")
    # Rows that share an id may differ in their text; positions hold for one text only.
    version = F.xxhash64(text)
    slim = docs.select(doc.alias("doc"), version.alias("version"), text.alias("text"))
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches))
    lines = written(hashed_lines(slim, min_chars).withColumn("batch", batch.cast("int")), "lines", by="batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    gone = runs.marked(lines, min_docs).groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))
    kept_columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {text_col.lower(), "n_lines", "n_dropped"}]
    whole = docs.select(F.struct(*kept_columns).alias("own"), text.alias("text"), doc.alias("doc"), version.alias("version"))
    joined = whole.join(gone, ["doc", "version"], "left").select("own", "text", lines_of(F.col("text")).alias("lines"), "gone")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = joined.select("own", "text", "lines", F.when(F.col("gone").isNotNull(), places).alias("places"))
    rest = F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n")
    return left.select(
        "own.*",
        F.when(F.col("places").isNull(), F.col("text")).otherwise(rest).alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("places")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), E'\n')) AS line,
                                    generate_subscripts(string_split(coalesce(d.text, ''), E'\n'), 1) AS pos) u),
f AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.last_doc AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
