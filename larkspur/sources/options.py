"""Options of the binary source, also as one connection string, and the key and manifest files that they name."""

from __future__ import annotations

import json
import os

from .files import read_text

#: Fixed names: what a connection string may call each option.
ALIASES = {
    "path": ("path", "db2directory", "db2 directory", "directory"),
    "definitions": ("definitions", "dbddirectory", "dbd directory", "dbddefinitions"),
    "keys": ("keys", "tactkeyfile", "keyfile"),
    "store": ("store",),
    "install": ("install", "wowinstallroot", "installroot"),
    "product": ("product", "wowproduct"),
    "manifest": ("manifest", "manifestpath", "manifestdirectory"),
    "strict_keys": ("strict_keys", "stricttactkeys", "strictkeys"),
    "version": ("version", "wowversion"),
    "decoder": ("decoder",),
    "provider": ("provider",),
}
#: Fixed names: how a manifest may call a table's file id.
FILE_ID_NAMES = ("db2FileDataID", "db2FileDataId", "fileDataID", "fileDataId", "FileDataID", "fdid")


def parse_connection(text: str) -> dict[str, str]:
    """``Name=value;Name=value`` as reader options; unknown names are an error."""
    out = {}
    for part in filter(None, map(str.strip, text.split(";"))):
        name, equals, value = part.partition("=")
        option = next((o for o, names in ALIASES.items() if name.strip().lower() in names), None)
        if not equals or option is None:
            raise ValueError(f"unknown part of a connection string: {part!r}")
        out[option] = value.strip().strip('"')
    return out


def read_keys(path: str | None) -> dict[int, bytes]:
    """Lines of a key's lookup and the key, both in hexadecimal; no path, no keys."""
    keys: dict[int, bytes] = {}
    if path:
        for line in read_text(path).splitlines():
            words = line.split()
            if len(words) >= 2 and not line.startswith("#"):
                keys[int(words[0], 16)] = bytes.fromhex(words[1])
    return keys


def export_keys(lookups, keys):
    """(line) "LOOKUP KEY" in hexadecimal, ordered: an inner join of the key tables, ready for write.text. Both have (id, value)."""
    from pyspark.sql import functions as F

    joined = lookups.select("id", F.hex("value").alias("lookup")).join(keys.select("id", F.hex("value").alias("key")), "id")
    return joined.orderBy("lookup").select(F.concat_ws(" ", "lookup", "key").alias("line"))


class Manifest:
    """Table names and the ids of their files. Paths and .db2 endings don't count, nor does case."""

    def __init__(self, text: str):
        data = json.loads(text)
        rows = data if isinstance(data, list) else data.get("entries", [data])
        self.ids: dict[str, int] = {}
        for row in rows:
            name = row.get("tableName")
            found = next((row[k] for k in FILE_ID_NAMES if row.get(k) not in (None, "")), None)
            if name and found is not None:
                self.ids[self.normal(name)] = int(found)

    @staticmethod
    def normal(name: str) -> str:
        base = os.path.basename(name.replace("\\", "/")).lower()
        return base.removesuffix(".db2")

    def resolve(self, table: str) -> int | None:
        return self.ids.get(self.normal(table))
