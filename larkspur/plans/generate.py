"""A registry made at run time from definition files, instead of generated classes."""

from __future__ import annotations

import logging
from pathlib import Path

from ..sources.definitions import DefinitionError, TableSchema, parse_definition, resolve
from .registry import Entity, KeyArray, NameFilter, Navigation, Reference, Registry, SharedKey, navigation_name, property_name, type_name

log = logging.getLogger(__name__)


def read_filters(path: Path) -> NameFilter:
    return NameFilter(path.read_text(encoding="utf-8").splitlines() if path.exists() else [])


def schemas(folder: str, version: str, filters: NameFilter | None = None, direction: str = "at_most") -> dict[str, TableSchema]:
    """Each table's schema for the version; tables that have none, and those that the filters block, are left out."""
    out = {}
    for file in sorted(Path(folder).glob("*.dbd")):
        if filters is not None and not filters.takes(file.stem):
            continue
        try:
            out[file.stem] = resolve(file.stem, parse_definition(file.read_text(encoding="utf-8")), version, direction)
        except DefinitionError as why:
            log.info("%s is left out: %s", file.stem, why)
    return out


def _entity(schema: TableSchema, known: dict[str, TableSchema]) -> Entity | None:
    key = schema.key
    if key is None:
        return None
    taken: set[str] = set()
    fields = [key, *(f for f in schema.fields if f is not key and not (f.kind == "string" and f.count > 1))]
    columns = {("Id" if f is key else property_name(f.name, taken | {"Id"})): f.name for f in fields}
    names = {column: prop for prop, column in columns.items()}
    navigations: dict[str, Navigation] = {}
    for f in fields:
        target = next((t for t in known if f.reference and t.lower() == f.reference[0].lower()), None)
        if target is None or known[target].key is None:
            continue
        if f is key:
            navigations[type_name(target)] = SharedKey(target)
            continue
        prop = names[f.name]
        name = navigation_name(prop, f.count > 1, set(columns) | set(navigations))
        navigations[name] = KeyArray(target, prop, sentinel=0) if f.count > 1 else Reference(target, prop, sentinel=0)
    return Entity(schema.name, "Id", columns, navigations)


def from_definitions(folder: str, version: str, filters: NameFilter | None = None, direction: str = "at_most") -> Registry:
    """Entities with a key, and navigations between those that are there. Key value 0 names nothing."""
    known = {t: s for t, s in schemas(folder, version, filters, direction).items() if s.key is not None}
    entities = {t: e for t, s in known.items() if (e := _entity(s, known)) is not None}
    if not entities:
        log.warning("no entity came out of the definitions in %s for version %s", folder, version)
    return Registry(entities)


def read_version(path: str) -> str:
    """The version that a settings file names: a line NAME_VERSION=a.b.c.d or VERSION=a.b.c.d."""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, equals, value = line.partition("=")
        if equals and name.strip().upper().endswith("VERSION"):
            return value.strip().strip('"')
    raise DefinitionError(f"{path} names no version")
