"""A local content store: table name -> file id -> content key -> encoded key -> place in an archive -> blocks -> bytes.

Indexes are read with NumPy where they are regular. Everything here works on bytes and dictionaries; ``Archive`` opens the files.
"""

from __future__ import annotations

import bisect
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

from .blocks import SIGNATURE, decode_blocks
from .options import Manifest, read_keys

#: Fixed values of the store's files.
ENGLISH, ON_WINDOWS, IS_ENCRYPTED, NO_NAMES = 0x2, 0x8, 0x0800_0000, 0x1000_0000
ROOT_TAGS, PREFIX_SCAN = (b"TSFM", b"MFST"), 0x84


class ArchiveError(ValueError):
    """A store that cannot be read, or that has no such file."""


# ---- text files
def read_build_info(text: str) -> list[dict[str, str]]:
    """Rows of a table with | between cells; column names carry a type after an exclamation mark."""
    lines = [x for x in text.splitlines() if x.strip()]
    names = [h.split("!", 1)[0].strip() for h in lines[0].split("|")] if lines else []
    return [dict(zip(names, (c.strip() for c in x.split("|")), strict=False)) for x in lines[1:] if not x.startswith("#")]


def read_build_config(text: str) -> dict[str, list[str]]:
    """name = words; what is named twice holds what came last."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        name, equals, value = line.partition("=")
        if equals and not line.startswith("#") and name.strip() and value.strip():
            out[name.strip().lower()] = value.split()
    return out


# ---- index files
@dataclass
class Index:
    """Sorted key prefixes with archive, offset and size of each."""

    prefixes: list[bytes]
    archives: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    bucket: int

    def find(self, key: bytes) -> tuple[int, int, int] | None:
        width = len(self.prefixes[0]) if self.prefixes else 0
        i = bisect.bisect_left(self.prefixes, key[:width])
        if i == len(self.prefixes) or self.prefixes[i] != key[:width]:
            return None
        return int(self.archives[i]), int(self.offsets[i]), int(self.sizes[i])


def _number(columns: np.ndarray, big: bool) -> np.ndarray:
    out = np.zeros(len(columns), np.uint64)
    for i in range(columns.shape[1]):
        out = (out << np.uint64(8)) | columns[:, i if big else columns.shape[1] - 1 - i].astype(np.uint64)
    return out


def read_index(data: bytes) -> Index:
    if len(data) < 0x28:
        raise ArchiveError("an index is too small")
    bucket, size_width, offset_width, key_width, offset_bits = data[0x0A], data[0x0C], data[0x0D], data[0x0E], data[0x0F]
    (total,) = struct.unpack_from("<I", data, 0x20)
    width = size_width + offset_width + key_width
    if not width or total % width or len(data) < 0x28 + total:
        raise ArchiveError("an index has broken records")
    rows = np.frombuffer(data, np.uint8, total, 0x28).reshape(-1, width)
    place = _number(rows[:, key_width : key_width + offset_width], True)
    archive_bits = 8 * offset_width - offset_bits
    return Index(
        [bytes(r) for r in rows[:, :key_width]],
        (place >> np.uint64(offset_bits)) & np.uint64((1 << archive_bits) - 1),
        place & np.uint64((1 << offset_bits) - 1),
        _number(rows[:, key_width + offset_width :], False),
        bucket,
    )


def bucket_of(key: bytes) -> int:
    x = 0
    for b in key[:9]:
        x ^= b
    return (x & 15) ^ (x >> 4)


def read_shared_versions(data: bytes) -> list[int]:
    """The version of each bucket's index, from the end of the shared-memory file's first block."""
    kind, end = struct.unpack_from("<2I", data)
    if kind not in (4, 5) or end < 0x108 or len(data) < end:
        raise ArchiveError("a broken shmem file")
    return list(struct.unpack_from("<16I", data, end - 64)) if end - 0x108 >= 64 else []


def active_indexes(names: list[str], versions: list[int]) -> dict[int, str]:
    """The index file of each bucket: of the version that shmem names, else of the highest."""
    found: dict[int, dict[int, str]] = {}
    for name in sorted(names):
        if m := re.fullmatch(r"([0-9a-f]{2})([0-9a-f]{8})\.idx", name, re.IGNORECASE):
            found.setdefault(int(m[1], 16), {})[int(m[2], 16)] = name
    return {b: own[versions[b]] if b < len(versions) and versions[b] in own else own[max(own)] for b, own in found.items() if b < 16}


# ---- ENCODING and ROOT
@dataclass
class Encoding:
    """Content keys and the encoded keys of each; the page table tells which page to search."""

    firsts: list[bytes]
    pages: list[bytes]

    def find(self, content_key: bytes) -> list[bytes]:
        place = bisect.bisect_right(self.firsts, content_key) - 1
        page = self.pages[place] if place >= 0 else b""
        at = 0
        while at + 22 <= len(page):
            n = page[at]
            if not n:
                at += 1
                continue
            if page[at + 6 : at + 22] == content_key:
                return [page[at + 22 + 16 * i : at + 38 + 16 * i] for i in range(n)]
            at += 22 + 16 * n
        return []


def read_encoding(data: bytes) -> Encoding:
    if data[:2] != b"EN" or len(data) < 0x16:
        raise ArchiveError("no ENCODING file")
    version, content, encoded, page_kb, _, count, _, _, spec = struct.unpack_from(">3B2H2IBI", data, 2)
    if version != 1 or (content, encoded) != (16, 16):
        raise ArchiveError("an unknown kind of ENCODING file")
    size, at = page_kb * 1024, 0x16 + spec + count * 32
    if at + count * size > len(data):
        raise ArchiveError("ENCODING pages break off")
    firsts = [data[0x16 + spec + 32 * i : 0x26 + spec + 32 * i] for i in range(count)]
    return Encoding(firsts, [data[at + i * size : at + (i + 1) * size] for i in range(count)])


def _root_payload(data: bytes) -> bytes:
    if data[:4] in ROOT_TAGS:
        return data
    if data[:4] == b"TVFS":
        raise ArchiveError("ROOT files of the TVFS kind cannot be read")
    at = 0
    while at + 8 <= len(data):
        tag, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        payload = data[at + 8 : at + 8 + size]
        if len(payload) < size:
            break
        if tag == b"MFST" or tag == b"TSFM" and payload[:4] in ROOT_TAGS:
            return payload
        at += 8 + size
    raise ArchiveError("no ROOT file")


def read_root(data: bytes) -> dict[int, bytes]:
    """The content key of each file id. Of several the best counts: not encrypted, then English, then for Windows, then the first."""
    data = _root_payload(data)
    if data[:4] not in ROOT_TAGS or len(data) < 12:
        raise ArchiveError("a broken ROOT file")
    kind, at = 0, 12
    if len(data) >= 20:
        header, version, total, named = struct.unpack_from("<4I", data, 4)
        if version in (1, 2) and named <= total and 4 <= header <= len(data):
            kind, at = version, header
    if at == 12 and kind == 0:
        total, named = struct.unpack_from("<2I", data, 4)
        if named > total:
            raise ArchiveError("a broken ROOT header")
    ids, ranks, keys = [], [], []
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        if not n:
            continue
        if at + (13 if kind == 2 else 8) > len(data):
            break
        if kind == 2:
            locale, first, second, third = struct.unpack_from("<3IB", data, at)
            flags, at = first | second | third << 17, at + 13
        else:
            (flags, locale), at = struct.unpack_from("<2I", data, at), at + 8
        body = n * 20 + (0 if flags & NO_NAMES else n * 8)
        if at + body > len(data):
            break
        # Each id is one more than the one before, plus its delta.
        ids.append(np.cumsum(np.frombuffer(data, "<i4", n, at).astype(np.int64) + 1) - 1)
        keys.append(np.frombuffer(data, np.uint8, n * 16, at + 4 * n).reshape(n, 16))
        ranks.append(np.full(n, 4 * bool(flags & IS_ENCRYPTED) + 2 * (not locale & ENGLISH) + (not flags & ON_WINDOWS)))
        at += body
    if not ids:
        return {}
    all_ids, all_ranks, all_keys = np.concatenate(ids), np.concatenate(ranks), np.concatenate(keys)
    order = np.lexsort((np.arange(len(all_ids)), all_ranks, all_ids))
    first = np.concatenate([[True], np.diff(all_ids[order]) != 0])
    return {int(i): bytes(k) for i, k in zip(all_ids[order][first], all_keys[order][first], strict=True) if i >= 0}


# ---- the store
class Archive:
    """A store in a folder: ``Data/data`` and ``Data/config`` under the product's folder or the root."""

    def __init__(self, install: str, product: str = "wow", manifest: str | None = None, keys: str | None = None, strict_keys: bool = False):
        self.keys, self.strict, self.missing = read_keys(keys), strict_keys, []
        self.manifest = Manifest(Path(manifest).read_text(encoding="utf-8")) if manifest else None
        root = Path(install)
        rows = read_build_info((root / ".build.info").read_text(encoding="utf-8"))
        own = [r for r in rows if r.get("Product", "").lower() == product.lower()] or (rows if len(rows) == 1 and "Product" not in rows[0] else [])
        if not own:
            raise ArchiveError(f"no build of {product}")
        folders = [f.parent / "Data" for f in sorted(root.rglob(".flavor.info")) if product.lower() in f.read_text(encoding="utf-8").lower().split()]
        data = next((f for f in [*folders, root / "Data"] if (f / "data").is_dir() and (f / "config").is_dir()), None)
        if data is None:
            raise ArchiveError("no data folders")
        self.folder = data / "data"
        key = own[0]["Build Key"].lower()
        config = read_build_config((data / "config" / key[:2] / key[2:4] / key).read_text(encoding="utf-8"))
        shared = self.folder / "shmem"
        self.active = active_indexes([p.name for p in self.folder.glob("*.idx")], read_shared_versions(shared.read_bytes()) if shared.exists() else [])
        self.indexes: dict[int, Index] = {}
        if len(config.get("encoding", ())) < 2:
            raise ArchiveError("the build config names no encoded key of ENCODING")
        self.encoding = read_encoding(decode_blocks(self.read(bytes.fromhex(config["encoding"][1]))))
        names = config["root"]
        encoded = [bytes.fromhex(names[1])] if len(names) > 1 else self.encoding.find(bytes.fromhex(names[0]))
        if not encoded:
            raise ArchiveError("ROOT is not in ENCODING")
        self.root = read_root(decode_blocks(self.read(encoded[0])))

    @staticmethod
    @lru_cache(maxsize=4)
    def _opened(options: tuple) -> Archive:
        o = dict(options)
        return Archive(o["install"], o.get("product", "wow"), o.get("manifest"), o.get("keys"), o.get("strict_keys", "false").lower() == "true")

    @staticmethod
    def open(options: dict) -> Archive:
        """By reader options; a store stays open for the tables that follow."""
        wanted = {k: options[k] for k in ("install", "product", "manifest", "keys", "strict_keys") if k in options}
        wanted.setdefault("install", options.get("path", ""))
        return Archive._opened(tuple(sorted(wanted.items())))

    def place(self, key: bytes) -> tuple[int, int, int]:
        bucket = bucket_of(key)
        for b in (bucket, (bucket + 1) % 16):
            if b in self.active:
                if b not in self.indexes:
                    self.indexes[b] = read_index((self.folder / self.active[b]).read_bytes())
                if found := self.indexes[b].find(key):
                    return found
        raise ArchiveError(f"no index has {key.hex()}")

    def read(self, key: bytes) -> bytes:
        """A block container by its encoded key; a small record header may stand before it."""
        archive, offset, size = self.place(key)
        with open(self.folder / f"data.{archive:03d}", "rb") as f:
            f.seek(offset)
            data = f.read(size)
        start = data[:PREFIX_SCAN].find(SIGNATURE)
        if start < 0:
            raise ArchiveError("no block container at its place")
        return data[start:]

    def file(self, file_id: int) -> bytes:
        content = self.root.get(file_id)
        if content is None:
            raise FileNotFoundError(f"the store has no file {file_id}")
        last: Exception | None = None
        for key in self.encoding.find(content):
            try:
                return decode_blocks(self.read(key), self.keys, self.strict, self.missing)
            except ArchiveError as no:  # another encoded key may be there
                last = no
        raise FileNotFoundError(f"file {file_id} is not in the local archives") from last

    def table(self, name: str) -> bytes:
        file_id = self.manifest.resolve(name) if self.manifest else None
        if file_id is None:
            raise FileNotFoundError(f"the manifest has no {name}")
        return self.file(file_id)
