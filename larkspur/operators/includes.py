"""Loading related rows as nested columns: those of the page's keys, aggregated leaf first before they meet their parents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Collection, Entity, KeyArray, Reference, Registry, SharedKey


def without(key: Column, sentinel) -> Column:
    return key if sentinel is None else F.when(key != F.lit(sentinel), key)


#: Pages of so many rows are broadcast as keys.
FEW = 10_000


@dataclass
class Wanted:
    """What nested rows hold: their columns (all if None), and navigations of their own."""

    columns: tuple[str, ...] | None = None
    deeper: dict[str, Wanted] = field(default_factory=dict)


def tree(paths: list[tuple[str, tuple[str, ...] | None]]) -> dict[str, Wanted]:
    """[("a.b", None), ("a.c", ("x",))] as {"a": {"b", "c" with the column x}}."""
    out: dict[str, Wanted] = {}
    for path, columns in paths:
        at, node = out, Wanted()
        for step in path.split("."):
            node = at.setdefault(step, Wanted())
            at = node.deeper
        node.columns = columns if columns is not None else node.columns
    return out


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _of(rows: DataFrame, key: str, keys: DataFrame, bound: str) -> DataFrame:
    """The rows whose key is among a page's; all of them where the page is the whole table."""
    if not bound:
        return rows
    wanted = keys.toDF("__wanted").where("__wanted IS NOT NULL")
    return rows.join(F.broadcast(wanted) if bound == "few" else wanted, rows[key] == F.col("__wanted"), "left_semi")


def load(registry: Registry, read: Callable[[Entity], DataFrame], entity: Entity, df: DataFrame, wanted: dict[str, Wanted], bound: str = "") -> DataFrame:
    """df with one nested column for each navigation in ``wanted``: a struct or null, or a list that may be empty.

    bound: "few" if df has at most ``FEW`` rows, "some" if it is a part of its table: related rows are then those of its keys
    before anything is done with them.
    """
    page = df
    for name, nested in wanted.items():
        nav = registry.navigation(entity, name)
        if name.lower() in (c.lower() for c in df.columns):
            raise ValueError(f"{entity.table} has a column and a navigation {name}: names differ by more than case")
        target = registry[nav.target]
        held = lambda rows, nested=nested: _row(rows if nested.columns is None else rows.select(*[f"`{c}`" for c in (*nested.columns, *nested.deeper)]))
        deeper = lambda rows, bound, nested=nested, target=target: load(registry, read, target, rows, nested.deeper, bound)
        if isinstance(nav, (Reference, SharedKey)):
            key = entity.key if isinstance(nav, SharedKey) else nav.key
            sentinel = None if isinstance(nav, SharedKey) else nav.sentinel
            rows = deeper(_of(read(target), target.key, page.select(without(F.col(f"`{key}`"), sentinel)), bound), bound)
            found = rows.select(F.col(f"`{target.key}`").alias("__key"), held(rows).alias(name))
            df = df.join(found, without(df[key], sentinel) == found["__key"], "left").drop("__key")
        elif isinstance(nav, Collection):
            rows = _of(read(target).where(without(F.col(f"`{nav.key}`"), nav.sentinel).isNotNull()), nav.key, page.select(f"`{entity.key}`"), bound)
            rows = deeper(rows, "some" if bound else "")
            order = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(target.file_order)]
            listed = rows.groupBy(F.col(f"`{nav.key}`").alias("__key"))
            listed = listed.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, held(rows).alias("row")))), lambda x: x["row"]).alias(name))
            df = df.join(listed, df[entity.key] == listed["__key"], "left").drop("__key")
            df = df.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
        else:
            assert isinstance(nav, KeyArray)
            # Only keys travel: each source key with its array, then the rows they name.
            keys = page.select(F.col(f"`{entity.key}`").alias("__key"), F.posexplode(nav.keys).alias("__at", "__id"))
            some = "some" if bound else ""
            rows = deeper(_of(read(target), target.key, keys.select(without(F.col("__id"), nav.sentinel)), some), some)
            found = rows.select(F.col(f"`{target.key}`").alias("__target"), held(rows).alias("row"))
            listed = keys.join(found, without(F.col("__id"), nav.sentinel) == F.col("__target")).groupBy("__key")
            listed = listed.agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "row"))), lambda x: x["row"]).alias(name))
            df = df.join(listed, df[entity.key] == listed["__key"], "left").drop("__key")
            df = df.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return df
