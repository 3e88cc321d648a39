"""The binary tables as a Spark data source.

    spark.dataSource.register(BinaryTables)
    spark.read.format("binary-table").options(path=folder, definitions=folder, version="1.0.0.1").load("Map")

One partition for each section, or for each ``rows_per_partition`` records of it; a partition reads and decodes its own records.
Filters on the id column are evaluated by the reader first, equality with other columns next, and the columns of the records
that are left are decoded. Hidden order columns (_section, _row) come with ``file_order=true``; ``columns=a,b`` decodes these
columns only, as a Python source is not told of a projection.

Folders are paths or addresses of any store that Arrow knows. Stores, definitions, keys and file formats of other kinds come in as
``module:function`` in the options ``store``, ``provider``, ``keys`` and ``decoder``; the module must be there on all executors:

    store(options, table) -> bytes of a table, or a path or address of them
    provider(options, table) -> text of the table's definition
    keys(options) -> {lookup: key}
    decoder(content, keys) -> an object like ``format.TableFile``
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .definitions import TableSchema, parse_definition, resolve
from .files import find_file, read_text
from .format import TableFile
from .options import read_keys


@dataclass
class Records(InputPartition):
    section: int
    first: int
    last: int


def plugged(name: str) -> Callable | None:
    """What ``module:function`` names; None for anything else."""
    module, colon, function = name.partition(":")
    if not colon or not function.isidentifier() or not all(p.isidentifier() for p in module.split(".")):
        return None
    return getattr(importlib.import_module(module), function)


def open_schema(options: dict) -> TableSchema:
    table = options.get("table") or options["path"].rstrip("/").rsplit("/", 1)[-1]
    provider = plugged(options.get("provider", ""))
    text = provider(options, table) if provider else read_text(find_file(options["definitions"], table, ".dbd"))
    return resolve(table, parse_definition(text), options["version"], options.get("direction", "at_least"))


def open_content(options: dict, table: str) -> bytes | str:
    store = options.get("store", "files")
    if own := plugged(store):
        return own(options, table)
    if store == "archive":
        from .archive import Archive

        return Archive.open(options).table(table)
    return find_file(options["path"] if options.get("table") else options["path"].rstrip("/").rsplit("/", 1)[0], table, ".db2")


class BinaryTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary-table"

    def _wanted(self) -> tuple[TableSchema, list]:
        for needed in ("path", "version", *(() if self.options.get("provider") else ("definitions",))):
            if not self.options.get(needed):
                raise ValueError(f"the option {needed} is needed")
        table = open_schema(dict(self.options))
        chosen = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = [table.field(c) for c in chosen] if chosen else list(table.fields)
        return table, [f for f in fields if not (f.kind == "string" and f.count > 1)]

    def schema(self) -> T.StructType:
        _, fields = self._wanted()
        hidden = [T.StructField("_section", T.IntegerType(), False), T.StructField("_row", T.IntegerType(), False)]
        return T.StructType([T.StructField(f.name, f.spark_type, False) for f in fields] + hidden * (self.options.get("file_order") == "true"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema_ = options, schema
        self.ids: set[int] | None = None
        self.equal: dict[str, set] = {}

    def _open(self) -> tuple[TableSchema, TableFile]:
        schema = open_schema(self.options)
        keys, decoder = self.options.get("keys"), plugged(self.options.get("decoder", "")) or TableFile
        own = plugged(keys or "")
        file = decoder(open_content(self.options, schema.name), own(self.options) if own else read_keys(keys))
        if file.left_out and self.options.get("missing_keys", "skip") == "error":
            raise ValueError(f"{schema.name}: {file.left_out} sections are encrypted, and their keys are not known")
        if self.options.get("validate", "true") == "true":
            schema.validate(file.layout_hash, file.field_count)
        return schema, file

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with whole numbers and strings is evaluated here, exactly, and with ids before anything is decoded; all else stays with Spark."""
        table = open_schema(self.options)
        for f in filters:
            path = getattr(f, "attribute", ())
            field = next((x for x in table.fields if len(path) == 1 and x.name.lower() == path[0].lower()), None)
            values = (f.value if isinstance(f, In) else [f.value]) if isinstance(f, (EqualTo, In)) else None
            if field is None or values is None or field.count > 1:
                yield f
                continue
            kind = str if field.kind == "string" else int
            found = {v for v in values if v is not None}
            if field.kind == "float" or field.kind == "uint" and field.bits == 64 or any(type(v) is not kind for v in found):
                yield f
            elif field.is_id:
                self.ids = found if self.ids is None else self.ids & found
            else:
                self.equal[field.name] = self.equal[field.name] & found if field.name in self.equal else found

    def partitions(self) -> list[InputPartition]:
        _, file = self._open()
        step = int(self.options.get("rows_per_partition", 65536))
        return [Records(i, a, min(s.records, a + step)) for i, s in enumerate(file.sections) for a in range(0, s.records, step)] or [Records(-1, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition.section < 0:
            return
        schema, file = self._open()
        s = file.sections[partition.section]
        rows = s.rows(partition.first, partition.last)
        shown = ids = file.ids(rows)
        if self.ids is not None:
            own = np.flatnonzero(np.isin(ids, list(self.ids)))
            shown = ids[own]
            if self.options.get("resolve_copies") == "true":
                # A copied id shows the record that it repeats, under its own id; a copy goes before a record.
                copies = {i: source for i, source in s.copies.items() if i in self.ids}
                places = {int(i): n for n, i in enumerate(ids.tolist())}
                kept = [n for n, i in zip(own.tolist(), shown.tolist(), strict=True) if i not in copies]
                extra = [(places[source], i) for i, source in copies.items() if source in places]
                own = np.array(kept + [n for n, _ in extra], np.int64)
                shown = np.array([int(ids[n]) for n in kept] + [i for _, i in extra], np.int64)
            rows, ids = rows.take(own), ids[own]
        for name, values in self.equal.items():
            column = file.column(rows, schema.field(name), ids)
            own = np.flatnonzero(np.isin(column, list(values)) if isinstance(column, np.ndarray) else np.array([v in values for v in column], bool))
            rows, ids, shown = rows.take(own), ids[own], shown[own]
        columns = []
        for f in self.schema_.fields:
            if f.name == "_section":
                columns.append(pa.array(np.full(len(rows), partition.section, np.int32)))
            elif f.name == "_row":
                columns.append(pa.array(rows.places.astype(np.int32)))
            else:
                columns.append(self._column(file, rows, schema.field(f.name), ids, shown, f.dataType))
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema_.fields])

    @staticmethod
    def _column(file, rows, field, ids, shown, kind: T.DataType) -> pa.Array:
        values = shown if field.is_id else file.column(rows, field, ids)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            values = [Decimal(int(v)) for v in values]
        elif isinstance(values, np.ndarray):
            values = values.tolist()
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(values, to_arrow_type(kind))
