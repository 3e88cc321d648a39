"""Table definitions: text files that list columns and, by build version, the layout of records.

COLUMNS names each column's type and the column that it refers to. A LAYOUT line names layout hashes; BUILD lines name the
versions to which the entries after them apply; blocks before any LAYOUT apply to every layout. ``//`` starts a comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

VIRTUAL_ID, VIRTUAL_RELATION, VIRTUAL_OTHER = -1, -2, -3
_COLUMN = re.compile(r"^(?P<type>\w+)(?:<(?P<table>[^:>]+)::(?P<column>[^>]+)>)?\s+(?P<name>[^\s?]+)(?P<unsure>\?)?$")
_ENTRY = re.compile(r"^(?:\$(?P<mods>[^$\s]*)\$)?(?P<name>[^<\[\s]+)(?:<(?P<token>[^>]*)>)?(?:\[(?P<count>\d+)\])?$")


class DefinitionError(ValueError):
    """A definition that cannot be read or that does not fit the request."""


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    reference: tuple[str, str] | None = None
    verified: bool = True


@dataclass(frozen=True)
class Entry:
    name: str
    token: str | None = None
    count: int = 1
    mods: frozenset[str] = frozenset()


@dataclass
class Block:
    builds: list[str] = field(default_factory=list)
    entries: list[Entry] = field(default_factory=list)
    layouts: tuple[int, ...] | None = None


@dataclass
class Definition:
    columns: dict[str, Column] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


def parse_column(line: str) -> Column:
    m = _COLUMN.match(line)
    if not m:
        raise DefinitionError(f"not a column: {line!r}")
    return Column(m["name"], m["type"].lower(), (m["table"], m["column"]) if m["table"] else None, not m["unsure"])


def parse_entry(line: str) -> Entry:
    m = _ENTRY.match(line)
    if not m:
        raise DefinitionError(f"not an entry: {line!r}")
    return Entry(m["name"], m["token"].lower() if m["token"] else None, int(m["count"] or 1), frozenset(x.strip().lower() for x in (m["mods"] or "").split(",") if x.strip()))


def parse_definition(text: str) -> Definition:
    out, layouts, block, in_columns = Definition(), None, None, False
    for raw in text.lstrip("﻿").splitlines():
        line = raw.split("//", 1)[0].strip()
        word, _, rest = line.partition(" ")
        if not line:
            in_columns = in_columns and not out.columns
        elif word == "COLUMNS":
            in_columns = True
        elif word == "LAYOUT":
            in_columns, block = False, None
            layouts = tuple(int(h.strip(), 16) for h in rest.split(","))
        elif word == "BUILD":
            in_columns = False
            if block is None or block.entries:
                block = Block(layouts=layouts)
                out.blocks.append(block)
            block.builds += [b.strip() for b in rest.split(",") if b.strip()]
        elif word == "COMMENT":
            in_columns = False
        elif in_columns:
            column = parse_column(line)
            out.columns[column.name] = column
        elif block is not None:
            block.entries.append(parse_entry(line))
    return out


def version(text: str) -> tuple[int, ...]:
    """Four numbers; a version of three stands for its last build."""
    parts = text.strip().split(".")
    if len(parts) not in (3, 4) or not all(p.isdigit() for p in parts):
        raise DefinitionError(f"not a version: {text!r}")
    return (*map(int, parts), *[2**31 - 1] * (4 - len(parts)))


def _candidate(build: str, wanted: tuple[int, ...], at_least: bool) -> tuple[int, ...] | None:
    """The version of a build, or of a range of them, that comes nearest to the wanted one from the right side."""
    low, _, high = build.partition("-")
    first, last = version(low), version(high or low)
    if at_least:
        return max(first, wanted) if wanted <= last else None
    return min(last, wanted) if first <= wanted else None


def pick_block(definition: Definition, wanted: str, direction: str = "at_least") -> Block:
    """The block whose build is nearest: the smallest version at or above the wanted one, or the largest at or below it."""
    if direction not in ("at_least", "at_most"):
        raise ValueError(direction)
    target, up = version(wanted), direction == "at_least"
    best: tuple[int, ...] | None = None
    found: list[Block] = []
    ordered = [b for b in definition.blocks if b.layouts is None] + [b for b in definition.blocks if b.layouts is not None]
    for block in ordered:
        for build in block.builds:
            at = _candidate(build, target, up)
            if at is None:
                continue
            if best is None or (at < best if up else at > best):
                best, found = at, [block]
            elif at == best and all(b is not block for b in found):
                found.append(block)
    if not found:
        raise DefinitionError(f"no build fits {wanted}")
    if len(found) > 1:
        raise DefinitionError(f"several layouts fit {wanted}")
    return found[0]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # int, uint, float, string
    bits: int
    count: int
    index: int  # of the physical column; negative for virtual ones
    is_id: bool = False
    is_relation: bool = False
    reference: tuple[str, str] | None = None
    verified: bool = True

    @property
    def scalar_type(self) -> T.DataType:
        if self.kind == "string":
            return T.StringType()
        if self.kind == "float":
            return T.FloatType()
        if self.kind == "uint":  # the next wider type that holds every value
            return {8: T.ShortType(), 16: T.IntegerType(), 64: T.DecimalType(20, 0)}.get(self.bits, T.LongType())
        return {8: T.ByteType(), 16: T.ShortType(), 64: T.LongType()}.get(self.bits, T.IntegerType())

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.scalar_type, False) if self.count > 1 else self.scalar_type


@dataclass(frozen=True)
class TableSchema:
    name: str
    fields: tuple[Field, ...]
    layouts: tuple[int, ...] | None

    @property
    def physical_columns(self) -> int:
        return sum(f.index >= 0 for f in self.fields)

    def field(self, name: str) -> Field:
        """By name exactly, then without regard to case."""
        for same in (lambda f: f.name == name, lambda f: f.name.lower() == name.lower()):
            if found := next((f for f in self.fields if same(f)), None):
                return found
        raise DefinitionError(f"{self.name} has no column {name}")

    @property
    def key(self) -> Field | None:
        """The id field; without a mark the first scalar integer, else a column ID."""
        marked = next((f for f in self.fields if f.is_id), None)
        first = next((f for f in self.fields if f.count == 1 and f.kind in ("int", "uint")), None)
        return marked or first or next((f for f in self.fields if f.name == "ID"), None)

    def struct(self, string_arrays: bool = False) -> T.StructType:
        fields = [f for f in self.fields if string_arrays or not (f.kind == "string" and f.count > 1)]
        meta = lambda f: {k: v for k, v in {"id": f.is_id, "relation": f.is_relation, "physical_index": f.index, "element_count": f.count, "ref": "::".join(f.reference) if f.reference else None}.items() if v is not None}
        return T.StructType([T.StructField(f.name, f.spark_type, False, meta(f)) for f in fields])

    def validate(self, layout_hash: int, column_count: int) -> None:
        if self.layouts is not None and layout_hash not in self.layouts:
            raise DefinitionError(f"{self.name}: layout {layout_hash:08X} is none of those defined")
        if column_count != self.physical_columns:
            raise DefinitionError(f"{self.name}: the file has {column_count} columns, the definition {self.physical_columns}")


def _kind(entry: Entry, column: Column) -> tuple[str, int]:
    token = entry.token
    if token:
        if token.startswith("f"):
            return "float", 32
        digits = token.lstrip("u")
        bits = int(digits) if digits.isdigit() and int(digits) in (8, 16, 32, 64) else 32
        return ("uint" if token.startswith("u") else "int"), bits
    if column.kind in ("string", "locstring"):
        return "string", 32
    return {"float": "float", "uint": "uint"}.get(column.kind, "int"), 32


def resolve(name: str, definition: Definition, wanted: str, direction: str = "at_least") -> TableSchema:
    block = pick_block(definition, wanted, direction)
    fields, at = [], 0
    for entry in block.entries:
        column = definition.columns.get(entry.name)
        if column is None:
            raise DefinitionError(f"{name}: no column {entry.name}")
        kind, bits = _kind(entry, column)
        if "noninline" in entry.mods:
            index = VIRTUAL_ID if "id" in entry.mods else VIRTUAL_RELATION if "relation" in entry.mods else VIRTUAL_OTHER
        else:
            index, at = at, at + 1
        fields.append(Field(entry.name, kind, bits, entry.count, index, "id" in entry.mods, "relation" in entry.mods, column.reference, column.verified))
    return TableSchema(name, tuple(fields), block.layouts)
