"""Queries over registered entities: a thin layer that knows relationships and leaves planning to Catalyst.

Operators compose in written order; skips and takes are kept as one window of places until another operator needs its rows, and
become one top-k. With ``legacy_composition`` a query is a flat bag instead: all filters, then the
ordering, then all skips, then the smallest take. With ``parity`` operators outside the core set raise NotSupported.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import Collection, Entity, Reference, Registry, SharedKey
from .errors import MoreThanOneRow, NoRows, NotSupported
from .includes import FEW, load, tree, without
from .order import sort_columns, split_at_first, without_first

log = logging.getLogger(__name__)
Predicate = Column | str | Callable[["Scope"], Column]
Key = str | Column | Callable[["Scope"], Column]


class Session:
    """Entities of a registry, each read by ``read(table)``."""

    def __init__(self, spark: SparkSession, registry: Registry, read: Callable[[str], DataFrame], parity: bool = False, legacy_composition: bool = False):
        self.spark, self.registry, self.read = spark, registry, read
        self.parity, self.legacy_composition = parity, legacy_composition

    def rows(self, entity: Entity) -> DataFrame:
        df = self.read(entity.table)
        return df.select([F.col(f"`{entity.columns.get(c, c)}`").alias(c) for c in dict.fromkeys([*entity.columns, *(c for c in df.columns if c not in entity.columns.values())])]) if entity.columns else df

    def table(self, name: str) -> Query:
        entity = self.registry[name]
        return Query(self, entity, self.rows(entity), includes=tuple((name, None) for name in sorted(entity.auto_include)))

    def of(self, df: DataFrame) -> Query:
        """A query over any rows; they have no entity, and so no navigations."""
        return Query(self, None, df)

    def find_df(self, name: str, key) -> DataFrame:
        """The row of a key, as an equality that reaches the scan."""
        entity = self.registry[name]
        return self.rows(entity).where(F.col(f"`{entity.key}`") == F.lit(key)).limit(1)

    def find(self, name: str, key) -> Row | None:
        return next(iter(self.find_df(name, key).head(1)), None)

    def find_many(self, name: str, ids: list, take: int | None = None) -> DataFrame:
        """The rows of the keys that exist, in file order; a short list becomes an IN filter, a long one a semi join."""
        if take is not None and take < 0:
            raise ValueError("take must not be negative")
        entity = self.registry[name]
        rows, key = self.rows(entity), F.col(f"`{entity.key}`")
        if len(ids) <= 1000:
            found = rows.where(key.isin(list(ids)) if ids else F.lit(False))
        else:
            wanted = self.spark.createDataFrame([(i,) for i in set(ids)], f"{entity.key} {rows.schema[entity.key].dataType.simpleString()}")
            found = rows.join(wanted, entity.key, "left_semi")
        found = found.orderBy(*entity.file_order)
        return found if take is None else found.limit(take)


class Scope:
    """What a predicate sees of a row: its columns, and columns of rows that it refers to."""

    def __init__(self, query: Query):
        self._query, self._joins, self._counts = query, [], []

    def __getitem__(self, path: str) -> Column:
        """A column, or ``navigation.column`` through references; a navigation alone is the referred row, null if none."""
        entity, steps, at = self._query.entity, path.split("."), 0
        while at < len(steps) and entity is not None and steps[at] in entity.navigations and isinstance(entity.navigations[steps[at]], (Reference, SharedKey)):
            self._joins.append(tuple(steps[: at + 1]))
            entity = self._query.session.registry[entity.navigations[steps[at]].target]
            at += 1
        if not at:
            return F.col(path)
        whole = F.col("__" + "_".join(steps[:at]))
        return whole.getField(steps[at]) if at < len(steps) else whole

    __getattr__ = __getitem__

    def count(self, nav: str, predicate: Predicate | None = None) -> Column:
        """How many rows of a collection (fit the predicate); 0 where there is none."""
        name = f"__count_{len(self._query.counts) + len(self._counts)}"
        self._counts.append((name, nav, predicate))
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    def any(self, nav: str, predicate: Predicate | None = None) -> Column:
        return self.count(nav, predicate) > 0


@dataclass(frozen=True)
class Query:
    session: Session
    entity: Entity | None
    df: DataFrame
    order: tuple[tuple[Column, bool], ...] = ()
    includes: tuple[tuple[str, tuple[str, ...] | None], ...] = ()
    joined: tuple[tuple[str, ...], ...] = ()
    counts: tuple[str, ...] = ()
    skipped: int = 0
    taken: int | None = None
    #: How many rows there are at most, where that is known; whether rows have been left out.
    most: int | None = None
    narrow: bool = False

    # ---- building blocks
    def _settled(self) -> Query:
        """The query with its window of places applied, for operators that come after it."""
        if self.session.legacy_composition or not self.skipped and self.taken is None:
            return self
        bounds = [n for n in (self.taken, self.most) if n is not None]
        return replace(self, df=self._paged(), skipped=0, taken=None, most=min(bounds, default=None), narrow=True)

    def _scoped(self, expression) -> tuple[Query, Column]:
        """The expression as a column, on a query that has the joins it needs."""
        self = self._settled()
        if isinstance(expression, str):
            return self, F.expr(expression)
        if isinstance(expression, Column):
            return self, expression
        scope = Scope(self)
        column = expression(scope)
        q = self
        for path in scope._joins:
            q = q._with_reference(path)
        for name, nav, predicate in scope._counts:
            q = replace(q, df=q._counted(name, nav, predicate), counts=(*q.counts, name))
        return q, column

    def _with_reference(self, path: tuple[str, ...]) -> Query:
        if path in self.joined:
            return self
        registry, entity = self.session.registry, self.entity
        for step in path[:-1]:
            entity = registry[entity.navigations[step].target]
        nav = registry.navigation(entity, path[-1])
        target = registry[nav.target]
        key = entity.key if isinstance(nav, SharedKey) else nav.key
        source = self.df[key] if len(path) == 1 else F.col("__" + "_".join(path[:-1])).getField(key)
        rows = self.session.rows(target)
        found = rows.select(F.col(f"`{target.key}`").alias("__key"), F.struct(*rows.columns).alias("__" + "_".join(path)))
        df = self.df.join(found, without(source, getattr(nav, "sentinel", None)) == F.col("__key"), "left").drop("__key")
        return replace(self, df=df, joined=(*self.joined, path))

    def _children(self, nav_name: str, predicate: Predicate | None) -> tuple[DataFrame, Collection]:
        nav = self.session.registry.navigation(self.entity, nav_name)
        if not isinstance(nav, Collection):
            raise TypeError(f"{nav_name} is not a collection")
        child = self.session.table(nav.target)
        child = child.where(predicate) if predicate is not None else child
        return child.df.where(without(F.col(f"`{nav.key}`"), nav.sentinel).isNotNull()), nav

    def _counted(self, name: str, nav_name: str, predicate: Predicate | None) -> DataFrame:
        rows, nav = self._children(nav_name, predicate)
        counts = rows.groupBy(F.col(f"`{nav.key}`").alias("__key")).agg(F.count(F.lit(1)).alias(name))
        return self.df.join(counts, self.df[self.entity.key] == counts["__key"], "left").drop("__key")

    def _columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def _keys(self) -> list[tuple[Column, bool]]:
        """The ordering, ties in file order."""
        return [*self.order, *((F.col(f"`{c}`"), False) for c in (self.entity.file_order if self.entity else ()) if c in self.df.columns)]

    def _sorted(self) -> DataFrame:
        keys = sort_columns(self._keys())
        return self.df.orderBy(*keys) if keys else self.df

    def _reject(self, what: str) -> None:
        if self.session.parity:
            raise NotSupported(f"{what} is not part of the core set")

    # ---- filters and projections
    def where(self, predicate: Predicate) -> Query:
        q, column = self._scoped(predicate)
        return replace(q, df=q.df.where(column), narrow=True)

    def where_any(self, nav: str, predicate: Predicate | None = None) -> Query:
        """Rows with a child (that fits): a semi join."""
        rows, n = self._children(nav, predicate)
        keys, q = rows.select(F.col(f"`{n.key}`").alias("__key")), self._settled()
        return replace(q, df=q.df.join(keys, q.df[q.entity.key] == keys["__key"], "left_semi"), narrow=True)

    def where_none(self, nav: str, predicate: Predicate | None = None) -> Query:
        """Rows without a child (that fits): an anti join."""
        rows, n = self._children(nav, predicate)
        keys, q = rows.select(F.col(f"`{n.key}`").alias("__key")), self._settled()
        return replace(q, df=q.df.join(keys, q.df[q.entity.key] == keys["__key"], "left_anti"), narrow=True)

    def select(self, *columns: Column | str, **named) -> Query:
        """Columns, and named expressions that may navigate. The result has no entity: includes end here."""
        q, out = self._settled(), [F.col(c) if isinstance(c, str) else c for c in columns]
        for name, expression in named.items():
            q, column = q._scoped(F.col(expression) if isinstance(expression, str) else expression)
            out.append(column.alias(name))
        if q.order:
            # The ordering goes on over the projected rows.
            keys = [F.struct(c.alias("k")).alias(f"__order_{i}") for i, (c, _) in enumerate(q.order)]
            order = tuple((F.col(f"__order_{i}.k"), d) for i, (_, d) in enumerate(q.order))
            return replace(q, df=q.df.select(*out, *keys), entity=None, order=order, includes=())
        return replace(q, df=q.df.select(*out), entity=None, includes=())

    # ---- joins
    def _side(self, other: Query, prefix: str, hint: str | None) -> DataFrame:
        right = other.to_df()
        right = right.select([F.col(f"`{c}`").alias(prefix + c) for c in right.columns])
        return right.hint(hint) if hint else right

    def _with_keys(self, keys, name: str) -> Query:
        """The query with its keys, names or expressions that may navigate, as columns of their own."""
        q, found = self, []
        for k in keys:
            q, column = q._scoped(F.col(f"`{k}`") if isinstance(k, str) else k)
            found.append(column)
        return replace(q, df=q.df.select("*", *[c.alias(f"__{name}_{i}") for i, c in enumerate(found)]))

    def join(self, other: Query, left_key: Key | list[Key], right_key: Key | list[Key], how: str = "inner", prefix: str = "", hint: str | None = None) -> Query:
        """An equi-join on one key or several, names or expressions; the other side's filters hold; its columns get the prefix.

        Null keys never match. hint: how Spark is to join (broadcast, merge, shuffle_hash), for the other side.
        """
        left_keys, right_keys = (list(k) if isinstance(k, (list, tuple)) else [k] for k in (left_key, right_key))
        if len(left_keys) != len(right_keys) or not left_keys:
            raise ValueError("both sides need the same number of keys")
        if all(isinstance(k, str) for k in left_keys + right_keys):
            q, right = self._settled(), self._side(other, prefix, hint)
            on = [q.df[a] == right[prefix + b] for a, b in zip(left_keys, right_keys, strict=True)]
            return replace(q, df=q.df.join(right, on, how), includes=(), narrow=True, most=None)
        q, inner = self._with_keys(left_keys, "left"), other._with_keys(right_keys, "right")
        names = [c for c in inner.df.columns if not c.startswith("__")]
        right = inner._paged().select(*[F.col(f"`{c}`").alias(prefix + c) for c in names], *[F.col(f"__right_{i}") for i in range(len(right_keys))])
        right = right.hint(hint) if hint else right
        on = [F.col(f"__left_{i}") == F.col(f"__right_{i}") for i in range(len(left_keys))]
        df = q.df.join(right, on, how).drop(*[f"__{side}_{i}" for side in ("left", "right") for i in range(len(left_keys))])
        return replace(q, df=df, includes=(), narrow=True, most=None)

    def left_join(self, other: Query, left_key, right_key, prefix: str = "", hint: str | None = None) -> Query:
        return self.join(other, left_key, right_key, "left", prefix, hint)

    def right_join(self, other: Query, left_key, right_key, prefix: str = "", hint: str | None = None) -> Query:
        self._reject("right_join")
        return self.join(other, left_key, right_key, "right", prefix, hint)

    def join_where(self, other: Query, condition: Callable[[Callable, Callable], Column], how: str = "inner", prefix: str = "", hint: str | None = None) -> Query:
        """A join by any condition of left and right columns: ``lambda a, b: a("x") < b("y")``. Equalities in it are found by Spark;
        without any, every two rows are looked at."""
        self._reject("join_where")
        q, right = self._settled(), self._side(other, prefix, hint)
        return replace(q, df=q.df.join(right, condition(lambda c: q.df[c], lambda c: right[prefix + c]), how), includes=(), narrow=True, most=None)

    def cross_join(self, other: Query, prefix: str = "") -> Query:
        self._reject("cross_join")
        q = self._settled()
        return replace(q, df=q.df.crossJoin(self._side(other, prefix, None)), includes=(), narrow=True, most=None)

    def join_range(self, other: Query, point: str, low: str, high: str, width: float, by: dict[str, str] | None = None, how: str = "inner", prefix: str = "") -> Query:
        """Rows whose point lies in the other side's range, low and high included. ``by``: columns that must be equal.

        Points and ranges are cut into steps of ``width`` and meet by step, so that only near ones are compared; a range is copied
        once for each step that it touches. Nulls never match.
        """
        self._reject("join_range")
        if how not in ("inner", "left"):
            raise ValueError(how)
        q, right = self._settled(), self._side(other, prefix, None)
        step = lambda c: F.floor(c.cast("double") / width).cast("long")
        steps = F.explode(F.sequence(step(F.col(f"`{prefix + low}`")), step(F.col(f"`{prefix + high}`"))))
        right = right.where(F.col(f"`{prefix + low}`") <= F.col(f"`{prefix + high}`")).select("*", steps.alias("__right_step"))
        left = q.df.withColumn("__left_step", step(F.col(f"`{point}`")))
        on = [F.col("__left_step") == F.col("__right_step"), left[point].between(right[prefix + low], right[prefix + high])]
        on += [left[a] == right[prefix + b] for a, b in (by or {}).items()]
        return replace(q, df=left.join(right, on, how).drop("__left_step", "__right_step"), includes=(), narrow=True, most=None)

    def join_as_of(self, other: Query, left_time: str, right_time: str, by: dict[str, str], prefix: str = "", width: float | None = None) -> Query:
        """Each row with the other side's latest row of the same ``by`` at or before its time; nulls where there is none.

        Both sides are laid together in order of time, and each row looks back to the last one of the other side: one shuffle, no
        pairs. ``width``: a key with very many rows is cut into steps of so many units of time, and steps hand on their last row.
        Rows of the other side with equal key and time: the one that is greatest, column by column, counts.
        """
        self._reject("join_as_of")
        q, right = self._settled(), self._side(other, prefix, None)
        names = q.df.columns
        own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]
        others = [F.col(f"`{prefix + c}`").alias(f"k{i}") for i, c in enumerate(by.values())]
        keys = [f"k{i}" for i in range(len(by))]
        kind = right.select(F.struct("*").alias("r")).schema["r"].dataType
        left = q.df.select(*own, F.col(f"`{left_time}`").alias("at"), F.lit(1).alias("side"), F.struct("*").alias("l"), F.lit(None).cast(kind).alias("r"))
        back = right.where(F.col(f"`{prefix + right_time}`").isNotNull()).select(*others, F.col(f"`{prefix + right_time}`").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(left.schema["l"].dataType).alias("l"), F.struct("*").alias("r"))
        both = left.unionByName(back)
        step = F.floor(F.col("at").cast("timestamp").cast("double") / width if dict(both.dtypes)["at"] in ("date", "timestamp", "timestamp_ntz") else F.col("at").cast("double") / width) if width else F.lit(0)
        both = both.withColumn("step", step.cast("long"))
        order = [F.col("at").asc_nulls_first(), F.col("side"), F.col("r")]
        seen = F.last("r", ignorenulls=True).over(W.partitionBy(*keys, "step").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        out = both.withColumn("r", seen).where("side = 1")
        if width:
            lasts = back.withColumn("step", step.cast("long")).groupBy(*keys, "step").agg(F.max_by("r", F.struct("at", "r")).alias("r"))
            # What a step that has none of its own looks back to: steps of the left side are laid among them.
            steps = lasts.unionByName(left.withColumn("step", step.cast("long")).select(*keys, "step", F.lit(None).cast(kind).alias("r")).distinct())
            steps = steps.groupBy(*keys, "step").agg(F.max("r").alias("r"))
            handed = F.last("r", ignorenulls=True).over(W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, -1))
            steps = steps.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("step").alias("s_step"), handed.alias("handed"))
            on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys] + [F.col("step").eqNullSafe(F.col("s_step"))]
            out = out.join(steps, on, "left").withColumn("r", F.coalesce("r", "handed"))
        # Null keys and null times match nothing.
        known = F.lit(True)
        for k in [*keys, "at"]:
            known = known & F.col(k).isNotNull()
        out = out.withColumn("r", F.when(known, F.col("r"))).select("l.*", *[F.col("r").getField(c).alias(c) for c in right.columns])
        return replace(q, df=out.select(*names, *right.columns), includes=(), most=None)

    # ---- ordering and paging
    def order_by(self, key, desc: bool = False, collation: str | None = None) -> Query:
        """Replaces earlier orderings. collation: how texts compare, as Spark names it (UNICODE, UNICODE_CI, de); by code otherwise."""
        q, column = self._scoped(F.col(key) if isinstance(key, str) else key)
        return replace(q, order=((F.collate(column, collation) if collation else column, desc),))

    def then_by(self, key, desc: bool = False, collation: str | None = None) -> Query:
        if not self.order:
            raise ValueError("then_by needs order_by")
        q, column = self._scoped(F.col(key) if isinstance(key, str) else key)
        return replace(q, order=(*q.order, (F.collate(column, collation) if collation else column, desc)))

    def skip(self, n: int) -> Query:
        """Without the first n rows; a negative n is 0."""
        n = max(0, n)
        left = self.taken if self.taken is None or self.session.legacy_composition else max(0, self.taken - n)
        return replace(self, skipped=self.skipped + n, taken=left)

    def take(self, n: int) -> Query:
        """The first n rows; none for a negative n."""
        return replace(self, taken=max(0, n) if self.taken is None else min(self.taken, max(0, n)))

    # ---- loading related rows
    def include(self, path: str, columns: list[str] | None = None) -> Query:
        """Nested rows of a navigation, or of a path of them; loaded for the rows of the page only.

        columns: what the nested rows at the path's end hold, all columns if not given.
        """
        if self.entity is None:
            log.warning("include(%r) after a projection: there is nothing to load into", path)
            return self
        at = self.entity
        for step in path.split("."):
            at = self.session.registry[self.session.registry.navigation(at, step).target]
        return replace(self, includes=(*self.includes, (path, tuple(columns) if columns is not None else None)))

    def then_include(self, path: str, columns: list[str] | None = None) -> Query:
        if not self.includes:
            raise ValueError("then_include needs include")
        return self.include(f"{self.includes[-1][0]}.{path}", columns)

    # ---- results
    def _paged(self) -> DataFrame:
        if self.taken is not None:
            df = self._sorted()
            return (df.offset(self.skipped) if self.skipped else df).limit(self.taken)
        return without_first(self.df, self._keys(), self.skipped) if self.skipped else self.df

    def to_df(self) -> DataFrame:
        """The rows; an ordering without a take is that of ``to_list`` alone, as tables have none."""
        q = self._settled() if not self.session.legacy_composition else replace(self, df=self._paged(), skipped=0, taken=None, most=self.taken, narrow=True)
        kept, df = self._columns(), q.df
        if q.includes and q.entity is not None:
            wanted = tree(list(q.includes))
            bound = "few" if q.most is not None and q.most <= FEW else "some" if q.narrow else ""
            df = load(q.session.registry, q.session.rows, q.entity, df.select(*kept), wanted, bound)
            kept = [*kept, *wanted]
        return df.select(*[f"`{c}`" for c in kept])

    def to_list(self) -> list[Row]:
        """All rows, in order where the query has one. For results that a driver can hold."""
        q = self if self.session.legacy_composition and self.taken is not None else self._settled()
        if self.session.legacy_composition and self.taken is None and self.skipped:
            q = replace(self, df=self._paged(), skipped=0)
        return (replace(q, df=q._sorted()) if q.order and q.taken is None else q).to_df().collect()

    def first_df(self, predicate: Predicate | None = None) -> DataFrame:
        return (self.where(predicate) if predicate is not None else self).take(1).to_df()

    def first_or_none(self, predicate: Predicate | None = None) -> Row | None:
        return next(iter(self.first_df(predicate).head(1)), None)

    def first(self, predicate: Predicate | None = None) -> Row:
        row = self.first_or_none(predicate)
        if row is None:
            raise NoRows("the query has no rows")
        return row

    def single_or_none(self, predicate: Predicate | None = None) -> Row | None:
        rows = (self.where(predicate) if predicate is not None else self).take(2).to_df().head(2)
        if len(rows) > 1:
            raise MoreThanOneRow("the query has more than one row")
        return rows[0] if rows else None

    def single(self, predicate: Predicate | None = None) -> Row:
        row = self.single_or_none(predicate)
        if row is None:
            raise NoRows("the query has no rows")
        return row

    def last_df(self, predicate: Predicate | None = None) -> DataFrame:
        """The last row: the ordering reversed, or file order reversed."""
        q = (self.where(predicate) if predicate is not None else self)._settled()
        keys = [(c, not d) for c, d in q._keys()]
        return replace(q, df=q.df.orderBy(*sort_columns(keys)).limit(1), order=(), most=1, narrow=True).to_df()

    def last_or_none(self, predicate: Predicate | None = None) -> Row | None:
        return next(iter(self.last_df(predicate).head(1)), None)

    def last(self, predicate: Predicate | None = None) -> Row:
        row = self.last_or_none(predicate)
        if row is None:
            raise NoRows("the query has no rows")
        return row

    def count_df(self, predicate: Predicate | None = None, name: str = "count") -> DataFrame:
        """How many rows; a window of places needs no order for that."""
        q = self.where(predicate) if predicate is not None else self
        n = F.greatest(F.count(F.lit(1)) - q.skipped, F.lit(0).cast("long"))
        return q.df.agg((n if q.taken is None else F.least(n, F.lit(q.taken).cast("long"))).alias(name))

    def count(self, predicate: Predicate | None = None) -> int:
        return self.count_df(predicate).first()[0]

    def any_df(self, predicate: Predicate | None = None, name: str = "any") -> DataFrame:
        q = self.where(predicate) if predicate is not None else self
        return q.df.limit(q.skipped + 1 if q.taken != 0 else 0).agg((F.count(F.lit(1)) > q.skipped).alias(name))

    def any(self, nav: str, predicate: Predicate | None = None) -> Column:
        return self.count(nav, predicate) > 0


@dataclass(frozen=True)
class Query:
    session: Session
    entity: Entity | None
    df: DataFrame
    order: tuple[tuple[Column, bool], ...] = ()
    includes: tuple[tuple[str, tuple[str, ...] | None], ...] = ()
    joined: tuple[tuple[str, ...], ...] = ()
    counts: tuple[str, ...] = ()
    skipped: int = 0
    taken: int | None = None
    #: How many rows there are at most, where that is known; whether rows have been left out.
    most: int | None = None
    narrow: bool = False

    # ---- building blocks
    def _settled(self) -> Query:
        """The query with its window of places applied, for operators that come after it."""
        if self.session.legacy_composition or not self.skipped and self.taken is None:
            return self
        bounds = [n for n in (self.taken, self.most) if n is not None]
        return replace(self, df=self._paged(), skipped=0, taken=None, most=min(bounds, default=None), narrow=True)

    def _scoped(self, expression) -> tuple[Query, Column]:
        """The expression as a column, on a query that has the joins it needs."""
        self = self._settled()
        if isinstance(expression, str):
            return self, F.expr(expression)
        if isinstance(expression, Column):
            return self, expression
        scope = Scope(self)
        column = expression(scope)
        q = self
        for path in scope._joins:
            q = q._with_reference(path)
        for name, nav, predicate in scope._counts:
            q = replace(q, df=q._counted(name, nav, predicate), counts=(*q.counts, name))
        return q, column

    def _with_reference(self, path: tuple[str, ...]) -> Query:
        if path in self.joined:
            return self
        registry, entity = self.session.registry, self.entity
        for step in path[:-1]:
            entity = registry[entity.navigations[step].target]
        nav = registry.navigation(entity, path[-1])
        target = registry[nav.target]
        key = entity.key if isinstance(nav, SharedKey) else nav.key
        source = self.df[key] if len(path) == 1 else F.col("__" + "_".join(path[:-1])).getField(key)
        rows = self.session.rows(target)
        found = rows.select(F.col(f"`{target.key}`").alias("__key"), F.struct(*rows.columns).alias("__" + "_".join(path)))
        df = self.df.join(found, without(source, getattr(nav, "sentinel", None)) == F.col("__key"), "left").drop("__key")
        return replace(self, df=df, joined=(*self.joined, path))

    def _children(self, nav_name: str, predicate: Predicate | None) -> tuple[DataFrame, Collection]:
        nav = self.session.registry.navigation(self.entity, nav_name)
        if not isinstance(nav, Collection):
            raise TypeError(f"{nav_name} is not a collection")
        child = self.session.table(nav.target)
        child = child.where(predicate) if predicate is not None else child
        return child.df.where(without(F.col(f"`{nav.key}`"), nav.sentinel).isNotNull()), nav

    def _counted(self, name: str, nav_name: str, predicate: Predicate | None) -> DataFrame:
        rows, nav = self._children(nav_name, predicate)
        counts = rows.groupBy(F.col(f"`{nav.key}`").alias("__key")).agg(F.count(F.lit(1)).alias(name))
        return self.df.join(counts, self.df[self.entity.key] == counts["__key"], "left").drop("__key")

    def _columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def _keys(self) -> list[tuple[Column, bool]]:
        """The ordering, ties in file order."""
        return [*self.order, *((F.col(f"`{c}`"), False) for c in (self.entity.file_order if self.entity else ()) if c in self.df.columns)]

    def _sorted(self) -> DataFrame:
        keys = sort_columns(self._keys())
        return self.df.orderBy(*keys) if keys else self.df

    def _reject(self, what: str) -> None:
        if self.session.parity:
            raise NotSupported(f"{what} is not part of the core set")

    # ---- filters and projections
    def where(self, predicate: Predicate) -> Query:
        q, column = self._scoped(predicate)
        return replace(q, df=q.df.where(column), narrow=True)

    def where_any(self, nav: str, predicate: Predicate | None = None) -> Query:
        """Rows with a child (that fits): a semi join."""
        rows, n = self._children(nav, predicate)
        keys, q = rows.select(F.col(f"`{n.key}`").alias("__key")), self._settled()
        return replace(q, df=q.df.join(keys, q.df[q.entity.key] == keys["__key"], "left_semi"), narrow=True)

    def where_none(self, nav: str, predicate: Predicate | None = None) -> Query:
        """Rows without a child (that fits): an anti join."""
        rows, n = self._children(nav, predicate)
        keys, q = rows.select(F.col(f"`{n.key}`").alias("__key")), self._settled()
        return replace(q, df=q.df.join(keys, q.df[q.entity.key] == keys["__key"], "left_anti"), narrow=True)

    def select(self, *columns: Column | str, **named) -> Query:
        """Columns, and named expressions that may navigate. The result has no entity: includes end here."""
        q, out = self._settled(), [F.col(c) if isinstance(c, str) else c for c in columns]
        for name, expression in named.items():
            q, column = q._scoped(F.col(expression) if isinstance(expression, str) else expression)
            out.append(column.alias(name))
        if q.order:
            # The ordering goes on over the projected rows.
            keys = [F.struct(c.alias("k")).alias(f"__order_{i}") for i, (c, _) in enumerate(q.order)]
            order = tuple((F.col(f"__order_{i}.k"), d) for i, (_, d) in enumerate(q.order))
            return replace(q, df=q.df.select(*out, *keys), entity=None, order=order, includes=())
        return replace(q, df=q.df.select(*out), entity=None, includes=())

    # ---- joins
    def _side(self, other: Query, prefix: str, hint: str | None) -> DataFrame:
        right = other.to_df()
        right = right.select([F.col(f"`{c}`").alias(prefix + c) for c in right.columns])
        return right.hint(hint) if hint else right

    def _with_keys(self, keys, name: str) -> Query:
        """The query with its keys, names or expressions that may navigate, as columns of their own."""
        q, found = self, []
        for k in keys:
            q, column = q._scoped(F.col(f"`{k}`") if isinstance(k, str) else k)
            found.append(column)
        return replace(q, df=q.df.select("*", *[c.alias(f"__{name}_{i}") for i, c in enumerate(found)]))

    def join(self, other: Query, left_key: Key | list[Key], right_key: Key | list[Key], how: str = "inner", prefix: str = "", hint: str | None = None) -> Query:
        """An equi-join on one key or several, names or expressions; the other side's filters hold; its columns get the prefix.

        Null keys never match. hint: how Spark is to join (broadcast, merge, shuffle_hash), for the other side.
        """
        left_keys, right_keys = (list(k) if isinstance(k, (list, tuple)) else [k] for k in (left_key, right_key))
        if len(left_keys) != len(right_keys) or not left_keys:
            raise ValueError("both sides need the same number of keys")
        if all(isinstance(k, str) for k in left_keys + right_keys):
            q, right = self._settled(), self._side(other, prefix, hint)
            on = [q.df[a] == right[prefix + b] for a, b in zip(left_keys, right_keys, strict=True)]
            return replace(q, df=q.df.join(right, on, how), includes=(), narrow=True, most=None)
        q, inner = self._with_keys(left_keys, "left"), other._with_keys(right_keys, "right")
        names = [c for c in inner.df.columns if not c.startswith("__")]
        right = inner._paged().select(*[F.col(f"`{c}`").alias(prefix + c) for c in names], *[F.col(f"__right_{i}") for i in range(len(right_keys))])
        right = right.hint(hint) if hint else right
        on = [F.col(f"__left_{i}") == F.col(f"__right_{i}") for i in range(len(left_keys))]
        df = q.df.join(right, on, how).drop(*[f"__{side}_{i}" for side in ("left", "right") for i in range(len(left_keys))])
        return replace(q, df=df, includes=(), narrow=True, most=None)

    def left_join(self, other: Query, left_key, right_key, prefix: str = "", hint: str | None = None) -> Query:
        return self.join(other, left_key, right_key, "left", prefix, hint)

    def right_join(self, other: Query, left_key, right_key, prefix: str = "", hint: str | None = None) -> Query:
        self._reject("right_join")
        return self.join(other, left_key, right_key, "right", prefix, hint)

    def join_where(self, other: Query, condition: Callable[[Callable, Callable], Column], how: str = "inner", prefix: str = "", hint: str | None = None) -> Query:
        """A join by any condition of left and right columns: ``lambda a, b: a("x") < b("y")``. Equalities in it are found by Spark;
        without any, every two rows are looked at."""
        self._reject("join_where")
        q, right = self._settled(), self._side(other, prefix, hint)
        return replace(q, df=q.df.join(right, condition(lambda c: q.df[c], lambda c: right[prefix + c]), how), includes=(), narrow=True, most=None)

    def cross_join(self, other: Query, prefix: str = "") -> Query:
        self._reject("cross_join")
        q = self._settled()
        return replace(q, df=q.df.crossJoin(self._side(other, prefix, None)), includes=(), narrow=True, most=None)

    def join_range(self, other: Query, point: str, low: str, high: str, width: float, by: dict[str, str] | None = None, how: str = "inner", prefix: str = "") -> Query:
        """Rows whose point lies in the other side's range, low and high included. ``by``: columns that must be equal.

        Points and ranges are cut into steps of ``width`` and meet by step, so that only near ones are compared; a range is copied
        once for each step that it touches. Nulls never match.
        """
        self._reject("join_range")
        if how not in ("inner", "left"):
            raise ValueError(how)
        q, right = self._settled(), self._side(other, prefix, None)
        step = lambda c: F.floor(c.cast("double") / width).cast("long")
        steps = F.explode(F.sequence(step(F.col(f"`{prefix + low}`")), step(F.col(f"`{prefix + high}`"))))
        right = right.where(F.col(f"`{prefix + low}`") <= F.col(f"`{prefix + high}`")).select("*", steps.alias("__right_step"))
        left = q.df.withColumn("__left_step", step(F.col(f"`{point}`")))
        on = [F.col("__left_step") == F.col("__right_step"), left[point].between(right[prefix + low], right[prefix + high])]
        on += [left[a] == right[prefix + b] for a, b in (by or {}).items()]
        return replace(q, df=left.join(right, on, how).drop("__left_step", "__right_step"), includes=(), narrow=True, most=None)

    def join_as_of(self, other: Query, left_time: str, right_time: str, by: dict[str, str], prefix: str = "", width: float | None = None) -> Query:
        """Each row with the other side's latest row of the same ``by`` at or before its time; nulls where there is none.

        Both sides are laid together in order of time, and each row looks back to the last one of the other side: one shuffle, no
        pairs. ``width``: a key with very many rows is cut into steps of so many units of time, and steps hand on their last row.
        Rows of the other side with equal key and time: the one that is greatest, column by column, counts.
        """
        self._reject("join_as_of")
        q, right = self._settled(), self._side(other, prefix, None)
        names = q.df.columns
        own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]
        others = [F.col(f"`{prefix + c}`").alias(f"k{i}") for i, c in enumerate(by.values())]
        keys = [f"k{i}" for i in range(len(by))]
        kind = right.select(F.struct("*").alias("r")).schema["r"].dataType
        left = q.df.select(*own, F.col(f"`{left_time}`").alias("at"), F.lit(1).alias("side"), F.struct("*").alias("l"), F.lit(None).cast(kind).alias("r"))
        back = right.where(F.col(f"`{prefix + right_time}`").isNotNull()).select(*others, F.col(f"`{prefix + right_time}`").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(left.schema["l"].dataType).alias("l"), F.struct("*").alias("r"))
        both = left.unionByName(back)
        step = F.floor(F.col("at").cast("timestamp").cast("double") / width if dict(both.dtypes)["at"] in ("date", "timestamp", "timestamp_ntz") else F.col("at").cast("double") / width) if width else F.lit(0)
        both = both.withColumn("step", step.cast("long"))
        order = [F.col("at").asc_nulls_first(), F.col("side"), F.col("r")]
        seen = F.last("r", ignorenulls=True).over(W.partitionBy(*keys, "step").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        out = both.withColumn("r", seen).where("side = 1")
        if width:
            lasts = back.withColumn("step", step.cast("long")).groupBy(*keys, "step").agg(F.max_by("r", F.struct("at", "r")).alias("r"))
            # What a step that has none of its own looks back to: steps of the left side are laid among them.
            steps = lasts.unionByName(left.withColumn("step", step.cast("long")).select(*keys, "step", F.lit(None).cast(kind).alias("r")).distinct())
            steps = steps.groupBy(*keys, "step").agg(F.max("r").alias("r"))
            handed = F.last("r", ignorenulls=True).over(W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, -1))
            steps = steps.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("step").alias("s_step"), handed.alias("handed"))
            on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys] + [F.col("step").eqNullSafe(F.col("s_step"))]
            out = out.join(steps, on, "left").withColumn("r", F.coalesce("r", "handed"))
        # Null keys and null times match nothing.
        known = F.lit(True)
        for k in [*keys, "at"]:
            known = known & F.col(k).isNotNull()
        out = out.withColumn("r", F.when(known, F.col("r"))).select("l.*", *[F.col("r").getField(c).alias(c) for c in right.columns])
        return replace(q, df=out.select(*names, *right.columns), includes=(), most=None)

    # ---- ordering and paging
    def order_by(self, key, desc: bool = False, collation: str | None = None) -> Query:
        """Replaces earlier orderings. collation: how texts compare, as Spark names it (UNICODE, UNICODE_CI, de); by code otherwise."""
        q, column = self._scoped(F.col(key) if isinstance(key, str) else key)
        return replace(q, order=((F.collate(column, collation) if collation else column, desc),))

    def then_by(self, key, desc: bool = False, collation: str | None = None) -> Query:
        if not self.order:
            raise ValueError("then_by needs order_by")
        q, column = self._scoped(F.col(key) if isinstance(key, str) else key)
        return replace(q, order=(*q.order, (F.collate(column, collation) if collation else column, desc)))

    def skip(self, n: int) -> Query:
        """Without the first n rows; a negative n is 0."""
        n = max(0, n)
        left = self.taken if self.taken is None or self.session.legacy_composition else max(0, self.taken - n)
        return replace(self, skipped=self.skipped + n, taken=left)

    def take(self, n: int) -> Query:
        """The first n rows; none for a negative n."""
        return replace(self, taken=max(0, n) if self.taken is None else min(self.taken, max(0, n)))

    # ---- loading related rows
    def include(self, path: str, columns: list[str] | None = None) -> Query:
        """Nested rows of a navigation, or of a path of them; loaded for the rows of the page only.

        columns: what the nested rows at the path's end hold, all columns if not given.
        """
        if self.entity is None:
            log.warning("include(%r) after a projection: there is nothing to load into", path)
            return self
        at = self.entity
        for step in path.split("."):
            at = self.session.registry[self.session.registry.navigation(at, step).target]
        return replace(self, includes=(*self.includes, (path, tuple(columns) if columns is not None else None)))

    def then_include(self, path: str, columns: list[str] | None = None) -> Query:
        if not self.includes:
            raise ValueError("then_include needs include")
        return self.include(f"{self.includes[-1][0]}.{path}", columns)

    # ---- results
    def _paged(self) -> DataFrame:
        if self.taken is not None:
            df = self._sorted()
            return (df.offset(self.skipped) if self.skipped else df).limit(self.taken)
        return without_first(self.df, self._keys(), self.skipped) if self.skipped else self.df

    def to_df(self) -> DataFrame:
        """The rows; an ordering without a take is that of ``to_list`` alone, as tables have none."""
        q = self._settled() if not self.session.legacy_composition else replace(self, df=self._paged(), skipped=0, taken=None, most=self.taken, narrow=True)
        kept, df = self._columns(), q.df
        if q.includes and q.entity is not None:
            wanted = tree(list(q.includes))
            bound = "few" if q.most is not None and q.most <= FEW else "some" if q.narrow else ""
            df = load(q.session.registry, q.session.rows, q.entity, df.select(*kept), wanted, bound)
            kept = [*kept, *wanted]
        return df.select(*[f"`{c}`" for c in kept])

    def to_list(self) -> list[Row]:
        """All rows, in order where the query has one. For results that a driver can hold."""
        q = self if self.session.legacy_composition and self.taken is not None else self._settled()
        if self.session.legacy_composition and self.taken is None and self.skipped:
            q = replace(self, df=self._paged(), skipped=0)
        return (replace(q, df=q._sorted()) if q.order and q.taken is None else q).to_df().collect()

    def first_df(self, predicate: Predicate | None = None) -> DataFrame:
        return (self.where(predicate) if predicate is not None else self).take(1).to_df()

    def first_or_none(self, predicate: Predicate | None = None) -> Row | None:
        return next(iter(self.first_df(predicate).head(1)), None)

    def first(self, predicate: Predicate | None = None) -> Row:
        row = self.first_or_none(predicate)
        if row is None:
            raise NoRows("the query has no rows")
        return row

    def single_or_none(self, predicate: Predicate | None = None) -> Row | None:
        rows = (self.where(predicate) if predicate is not None else self).take(2).to_df().head(2)
        if len(rows) > 1:
            raise MoreThanOneRow("the query has more than one row")
        return rows[0] if rows else None

    def single(self, predicate: Predicate | None = None) -> Row:
        row = self.single_or_none(predicate)
        if row is None:
            raise NoRows("the query has no rows")
        return row

    def last_df(self, predicate: Predicate | None = None) -> DataFrame:
        """The last row: the ordering reversed, or file order reversed."""
        q = (self.where(predicate) if predicate is not None else self)._settled()
        keys = [(c, not d) for c, d in q._keys()]
        return replace(q, df=q.df.orderBy(*sort_columns(keys)).limit(1), order=(), most=1, narrow=True).to_df()

    def last_or_none(self, predicate: Predicate | None = None) -> Row | None:
        return next(iter(self.last_df(predicate).head(1)), None)

    def last(self, predicate: Predicate | None = None) -> Row:
        row = self.last_or_none(predicate)
        if row is None:
            raise NoRows("the query has no rows")
        return row

    def count_df(self, predicate: Predicate | None = None, name: str = "count") -> DataFrame:
        q = self.where(predicate) if predicate is not None else self
        return q._paged().agg(F.count(F.lit(1)).alias(name))

    def count(self, predicate: Predicate | None = None) -> int:
        return self.count_df(predicate).first()[0]

    def any_df(self, predicate: Predicate | None = None, name: str = "any") -> DataFrame:
        q = self.where(predicate) if predicate is not None else self
        return q._paged().limit(1).agg((F.count(F.lit(1)) > 0).alias(name))

    def any(self, predicate: Predicate | None = None) -> bool:
        return self.any_df(predicate).first()[0]

    def all_df(self, predicate: Predicate, name: str = "all") -> DataFrame:
        """True if no row fails; a null predicate fails. Stops at the first row that does."""
        q, column = self._scoped(predicate)
        return replace(q, df=q.df.where(~F.coalesce(column, F.lit(False)))).df.limit(1).agg((F.count(F.lit(1)) == 0).alias(name))

    def all(self, predicate: Predicate) -> bool:
        return self.all_df(predicate).first()[0]

    # ---- beyond the core set
    def group_by(self, *keys):
        self._reject("group_by")
        return self._settled().df.groupBy(*keys)

    def rollup(self, *keys):
        self._reject("rollup")
        return self._settled().df.rollup(*keys)

    def cube(self, *keys):
        self._reject("cube")
        return self._settled().df.cube(*keys)

    def aggregate(self, *columns: Column) -> DataFrame:
        self._reject("aggregate")
        return self._paged().agg(*columns)

    def sum(self, column: str, name: str = "sum") -> DataFrame:
        return self.aggregate(F.sum(column).alias(name))

    def min(self, column: str, name: str = "min") -> DataFrame:
        return self.aggregate(F.min(column).alias(name))

    def max(self, column: str, name: str = "max") -> DataFrame:
        return self.aggregate(F.max(column).alias(name))

    def average(self, column: str, name: str = "average") -> DataFrame:
        return self.aggregate(F.avg(column).alias(name))

    def distinct(self) -> Query:
        self._reject("distinct")
        return replace(self._settled(), df=self.to_df().distinct(), includes=())

    def _set(self, other: Query, what: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        self._reject(what)
        return replace(self._settled(), df=make(self.to_df(), other.to_df()), order=(), includes=(), most=None, narrow=True)

    def concat(self, other: Query) -> Query:
        return self._set(other, "concat", DataFrame.unionByName)

    def union(self, other: Query) -> Query:
        return self._set(other, "union", lambda a, b: a.unionByName(b).distinct())

    def intersect(self, other: Query) -> Query:
        return self._set(other, "intersect", DataFrame.intersect)

    def except_(self, other: Query) -> Query:
        return self._set(other, "except", DataFrame.subtract)

    def contains(self, column: str, value: Any) -> bool:
        self._reject("contains")
        return self.any(F.col(column) == F.lit(value))

    def default_if_empty(self) -> Query:
        """The rows, or one row of nulls."""
        self._reject("default_if_empty")
        rows = self.to_df()
        none = rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("__none")).where("__none")
        nulls = none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        return replace(self._settled(), df=rows.unionByName(nulls), order=(), includes=(), most=None)

    def element_at(self, n: int) -> DataFrame:
        self._reject("element_at")
        return self.skip(n).take(1).to_df()

    def reverse(self) -> Query:
        self._reject("reverse")
        q = self._settled()
        keys = q.order or tuple((F.col(f"`{c}`"), False) for c in q.entity.file_order)
        return replace(q, order=tuple((c, not d) for c, d in keys))

    def _running(self, predicate: Predicate, before: bool) -> Query:
        q, column = self._scoped(predicate)
        return replace(q, df=split_at_first(q.df, q._keys(), ~F.coalesce(column, F.lit(False)), before), narrow=True)

    def take_while(self, predicate: Predicate) -> Query:
        self._reject("take_while")
        return self._running(predicate, True)

    def skip_while(self, predicate: Predicate) -> Query:
        self._reject("skip_while")
        return self._running(predicate, False)

    def of_type(self, column: str, value: Any) -> Query:
        """Rows of a kind, told by a discriminator column."""
        self._reject("of_type")
        return self.where(F.col(column) == F.lit(value))

    def cast(self, **types: str) -> Query:
        self._reject("cast")
        q = self._settled()
        return replace(q, df=q.df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}))

    def select_many(self, array: str, name: str, outer: bool = False) -> Query:
        """A row for each element of an array column."""
        self._reject("select_many")
        q = self._settled()
        return replace(q, df=q.df.withColumn(name, (F.explode_outer if outer else F.explode)(array)), most=None)

    def group_join(self, other: Query, left_key: str, right_key: str, name: str) -> Query:
        """Each row with the list of the other side's rows of its key, maybe empty."""
        self._reject("group_join")
        right = other.to_df()
        listed = right.groupBy(F.col(right_key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*right.columns))).alias(name))
        q = self._settled()
        df = q.df.join(listed, q.df[left_key] == listed["__key"], "left").drop("__key")
        return replace(q, df=df.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType))))

    def save(self, *_):
        raise NotSupported("tables are read-only")
