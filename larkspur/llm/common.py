"""What the text operators share: white space, words, and tables written in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
#: A word: a longest run without such white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their Python need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_larkspur_shipped", False):
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="larkspur-")  # served from here as long as the context lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        sc._larkspur_shipped = True


def shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        set_to = sc._jsc.sc().getCheckpointDir()
        set_to = set_to.get() if set_to.isDefined() else None
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="larkspur-")
        sc.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder among those of this application, which go when it ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/larkspur-{sc.applicationId}"
    if getattr(sc, "_larkspur_folder", None) != folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._larkspur_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nothing reads any more."""
    sc = spark.sparkContext
    for name in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """The same rows, written as Parquet in the shared folder (in a folder for each value of ``by``) and read again: lineage ends here."""
    path = path or new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *by: str, path: str | None = None, sort: bool = False) -> DataFrame:
    """Like ``written``, dealt into buckets by columns: joins and groupings by these need no exchange. The catalog forgets it at once."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    entry = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    (writer.sortBy(*by) if sort else writer).option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # its files stay
    return out


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs under names that meet no others, the new names of some columns, and how a result gets all the old ones back."""
    own = docs.columns
    new = [f"own_{i}" for i in range(len(own))]
    return docs.toDF(*new), [new[own.index(n)] for n in names], lambda out: out.select(*new).toDF(*own)


def within(sizes: list[int], bound: int) -> list[int]:
    """Places of the sizes that are taken, one after the other, if a bound on their sum takes each that still fits."""
    taken, left = [], bound
    for i, size in enumerate(sizes):
        if size <= left:
            taken.append(i)
            left -= size
    return taken


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes are split at the same white space, and much faster."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain lower() where every character is ASCII, which is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(*cols: Column) -> Column:
    """Two 64-bit hashes; equal values have equal hashes, and others collide once in 2^128 pairs."""
    return F.struct(F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(7919), *cols).alias("h2"))
