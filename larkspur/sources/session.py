"""A session over a folder of binary tables, its entities made from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.query import Session
from ..plans.generate import from_definitions
from ..plans.registry import NameFilter, Registry
from .datasource import BinaryTables
from .options import parse_connection


def binary_session(spark: SparkSession, connection: str | dict, registry: Registry | None = None, filters: NameFilter | None = None, **options) -> Session:
    """connection: a connection string or reader options with path, definitions and version. Other options go to Session."""
    own = parse_connection(connection) if isinstance(connection, str) else dict(connection)
    if not own.get("version"):
        raise ValueError("a build version is needed")
    spark.dataSource.register(BinaryTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    made = registry or from_definitions(own["definitions"], own["version"], filters, own.pop("direction", "at_least"))

    def read(table: str) -> DataFrame:
        return spark.read.format("binary-table").options(**own, table=table, resolve_copies="true").load()

    return Session(spark, made, read, **options)


def stored_keys(lookups: DataFrame, keys: DataFrame) -> dict[int, bytes]:
    """Keys that are themselves kept in two tables (id, bytes): lookup and key of the same id. Tables that fail give none.

    Key tables hold a few hundred rows; they come to the driver, as readers need them there.
    """
    try:
        rows = lookups.toDF("id", "lookup").join(keys.toDF("id", "key"), "id").collect()
    except Exception:  # noqa: BLE001  without key tables there are no keys
        return {}
    whole = lambda x: bytes(v & 0xFF for v in x) if isinstance(x, list) else bytes(x)
    return {int.from_bytes(whole(r["lookup"]), "little"): whole(r["key"]) for r in rows}


def composite_keys(*providers) -> dict[int, bytes]:
    """Keys of several providers, dictionaries or functions; the first that has a key counts."""
    out: dict[int, bytes] = {}
    for p in providers:
        for lookup, key in (p() if callable(p) else p).items():
            out.setdefault(lookup, key)
    return out
