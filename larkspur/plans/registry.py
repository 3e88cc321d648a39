"""Relationships as data: entities, their keys and columns, and how to navigate between them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Reference:
    """A foreign key on the source that names one row of the target. A key equal to ``sentinel`` names none."""

    target: str
    key: str
    sentinel: object = None


@dataclass(frozen=True)
class SharedKey:
    """One to one: source and target have the same key; required is kept as metadata."""

    target: str
    required: bool = False


@dataclass(frozen=True)
class Collection:
    """The rows of the target whose foreign key names the source."""

    target: str
    key: str
    sentinel: object = None


@dataclass(frozen=True)
class KeyArray:
    """An array of keys on the source; order and repeats are kept, unknown keys and ``sentinel`` are left out."""

    target: str
    keys: str
    sentinel: object = None


Navigation = Reference | SharedKey | Collection | KeyArray


@dataclass(frozen=True)
class Entity:
    """A table with one key column. order: columns that stand for the order of rows in the file, the key if not given."""

    table: str
    key: str
    columns: dict[str, str] = field(default_factory=dict)
    navigations: dict[str, Navigation] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    auto_include: tuple[str, ...] = ()

    @property
    def file_order(self) -> tuple[str, ...]:
        return self.order or (self.key,)


class Registry:
    """All entities by name. Names are found exactly, then without regard to case."""

    def __init__(self, entities: dict[str, Entity]):
        self.entities = dict(entities)
        for name, entity in self.entities.items():
            if not entity.key:
                raise ValueError(f"entity {name} needs one key column")
            for nav_name, nav in entity.navigations.items():
                if nav.target not in self.entities:
                    raise ValueError(f"{name}.{nav_name}: unknown target {nav.target}")
            for nav_name in entity.auto_include:
                if nav_name not in entity.navigations:
                    raise ValueError(f"{name}: auto-include of unknown navigation {nav_name}")

    def __getitem__(self, name: str) -> Entity:
        if name in self.entities:
            return self.entities[name]
        found = [e for n, e in self.entities.items() if n.lower() == name.lower()]
        if len(found) != 1:
            raise KeyError(f"unknown entity {name}")
        return found[0]

    def navigation(self, entity: Entity, name: str) -> Navigation:
        if name not in entity.navigations:
            raise KeyError(f"{entity.table} has no navigation {name}")
        return entity.navigations[name]


class NameFilter:
    """Which tables are taken: lines ``~regex`` allow, ``!regex`` block, # comments; allow wins; no regard to case."""

    def __init__(self, lines: list[str] = ()):
        self.allow, self.block = [], []
        for line in map(str.strip, lines):
            if line[:1] in "~!" and line:
                (self.allow if line[0] == "~" else self.block).append(re.compile(line[1:], re.IGNORECASE))

    def takes(self, name: str) -> bool:
        return any(p.search(name) for p in self.allow) or not any(p.search(name) for p in self.block)


def type_name(table: str) -> str:
    """An identifier for a table: a hyphen becomes two underscores, other odd characters their code."""
    out = "".join(c if c.isalnum() or c == "_" else "__" if c == "-" else f"__u{ord(c):04X}__" for c in table)
    return "_" + out if out[:1].isdigit() else out


def property_name(column: str, taken: set[str] | None = None) -> str:
    """A property for a column: no _lang at the end, words joined in capitals, Field_* as it is, made unique by a number."""
    base = column[: -len("_lang")] if column.lower().endswith("_lang") else column
    if not base.startswith("Field_"):
        base = "".join(w[:1].upper() + w[1:] for w in base.split("_") if w)
    base = type_name(base or "_")
    name, n = base, 2
    while taken is not None and name in taken:
        name, n = f"{base}{n}", n + 1
    if taken is not None:
        taken.add(name)
    return name


def navigation_name(prop: str, array: bool, taken: set[str]) -> str:
    """A navigation for a key property: without ID at the end; Collection or Entity is added where the name is taken."""
    base = prop[:-2] if len(prop) > 2 and prop[-2:].lower() == "id" else prop
    return base if base not in taken else base + ("Collection" if array else "Entity")
