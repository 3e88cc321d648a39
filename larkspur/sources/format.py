"""The bit-packed binary table format: header, sections, and columns decoded into arrays.

A file is read in parts: headers first, a section's lists when they are asked for, and of its records those that are wanted.
Dense columns are decoded by shifts on 64-bit windows over all these records at once. Sparse records have strings inline and are
walked one by one. Records of encrypted sections are decrypted first; a section without its key is left out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .crypto import salsa20
from .definitions import VIRTUAL_ID, VIRTUAL_RELATION, Field
from .files import Source

MAGIC, HEADER = b"WDC5", struct.Struct("<4sI128s4i2I3i2H7i")
SECTION, FIELD_META, COLUMN_META = struct.Struct("<Q8i"), struct.Struct("<2h"), struct.Struct("<2HI4I")
#: Fixed values of the format: table flags, and how a column is stored.
SPARSE, SECONDARY_KEY = 0x1, 0x2
NONE, IMMEDIATE, COMMON, PALLET, PALLET_ARRAY, SIGNED_IMMEDIATE = range(6)


class FormatError(ValueError):
    """Bytes that are no table of this format."""


@dataclass(frozen=True)
class ColumnMeta:
    bits: int  # of an uncompressed value
    offset: int  # in bits, within a record
    size: int
    kind: int
    params: tuple[int, int, int]
    pallet: np.ndarray | None = None
    common: dict[int, int] | None = None

    @property
    def width(self) -> int:
        """Bits of one stored value."""
        if self.kind == NONE and self.bits > 0:
            return self.bits
        return 0 if self.kind == COMMON else self.params[1]


class Section:
    """A section's place in the file; its lists are read when they are asked for."""

    def __init__(self, file: TableFile, header: tuple, first: int, strings_at: int):
        self.file, self.header, self.first, self.strings_at = file, header, first, strings_at
        self.key_lookup, self.begin, self.records = header[:3]
        self.size = file._size(header)
        self.strings_end = strings_at + header[3]
        self.key = file.keys.get(self.key_lookup)

    @cached_property
    def _lists(self) -> tuple:
        return self.file._lists(self)

    ids = property(lambda self: self._lists[0])
    copies = property(lambda self: self._lists[1])
    parents = property(lambda self: self._lists[2])
    #: Start and size of sparse records, from the section's begin on.
    entries = property(lambda self: self._lists[3])

    @cached_property
    def strings(self) -> bytes:
        """The strings of a section without sparse records; places count from those of the sections before."""
        return self.file.source.read(self.begin + self.size, self.header[3])

    def rows(self, first: int = 0, last: int | None = None) -> Rows:
        return Rows(self, first, self.records if last is None else last)


class Rows:
    """Records of a section, from one place to another, or some of them."""

    def __init__(self, section: Section, first: int, last: int):
        self.section, self.places = section, np.arange(first, last)
        self.ids = None if section.ids is None else section.ids[first:last]
        file = section.file
        if file.sparse:
            entries = section.entries[first:last]
            begin = min((a for a, _ in entries), default=0)
            held = file.source.read(section.begin + begin, max((a + n for a, n in entries), default=0) - begin)
            self.data: list[bytes] | np.ndarray = [held[a - begin : a - begin + n] for a, n in entries]
        else:
            width = file.record_size
            self.data = np.frombuffer(file.source.read(section.begin + first * width, (last - first) * width), np.uint8).reshape(-1, width)
        if section.key is not None:
            if self.ids is None:
                raise FormatError("ids of encrypted records must be listed")
            plain = [salsa20(section.key, struct.pack("<Q", int(i) & (2**64 - 1)), bytes(r)) for i, r in zip(self.ids.tolist(), self.data, strict=True)]
            self.data = plain if file.sparse else np.frombuffer(b"".join(plain), np.uint8).reshape(-1, file.record_size)

    def __len__(self) -> int:
        return len(self.places)

    def take(self, at: np.ndarray) -> Rows:
        """Some of these records, any number of times."""
        out = object.__new__(Rows)
        out.section, out.places = self.section, self.places[at]
        out.ids = None if self.ids is None else self.ids[at]
        out.data = [self.data[i] for i in at.tolist()] if isinstance(self.data, list) else self.data[at]
        return out


class TableFile:
    """content: a file's bytes, or its path."""

    def __init__(self, content: bytes | str | Source, keys: dict[int, bytes] | None = None):
        self.source, self.keys = content if isinstance(content, Source) else Source(content), keys or {}
        if self.source.size < HEADER.size:
            raise FormatError("too small to be a table")
        h = HEADER.unpack(self.source.read(0, HEADER.size))
        if h[0] != MAGIC:
            raise FormatError(f"expected {MAGIC.decode()}, found {h[0]!r}")
        (self.records, self.field_count, self.record_size, _, self.table_hash, self.layout_hash, self.min_id, self.max_id, _, self.flags, self.id_index,
         self.total_fields, _, _, _, _, _, self.section_count) = h[3:]
        n_sections, n_fields = self.section_count, self.field_count
        fixed = self.source.read(HEADER.size, n_sections * SECTION.size + n_fields * (FIELD_META.size + COLUMN_META.size))
        headers = [SECTION.unpack_from(fixed, i * SECTION.size) for i in range(n_sections)]
        at = n_sections * SECTION.size
        bits = [FIELD_META.unpack_from(fixed, at + i * FIELD_META.size)[0] for i in range(n_fields)]
        at += n_fields * FIELD_META.size
        metas = [COLUMN_META.unpack_from(fixed, at + i * COLUMN_META.size) for i in range(n_fields)]
        at = HEADER.size + len(fixed)

        def numbers(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.source.read(at, 4 * n), "<u4")
            at += 4 * n
            return out

        pallets = [numbers(m[2] // 4) if m[3] in (PALLET, PALLET_ARRAY) else None for m in metas]
        commons: list[dict[int, int] | None] = []
        for m in metas:
            pairs = numbers(m[2] // 8 * 2).reshape(-1, 2) if m[3] == COMMON else None
            commons.append(None if pairs is None else dict(zip(pairs[:, 0].view("<i4").tolist(), pairs[:, 1].tolist(), strict=True)))
        self.columns = [ColumnMeta(32 - b, m[0], m[1], m[3], m[4:], p, c) for b, m, p, c in zip(bits, metas, pallets, commons, strict=True)]
        self.sections: list[Section] = []
        self.left_out = 0
        # Strings of all sections, those without a key too, lie one behind the other in a single address space, behind all records.
        self.blob = sum(self._size(x) for x in headers)
        first = strings = 0
        for x in headers if self.records else ():
            section = Section(self, x, first, strings)
            if section.key_lookup and section.key is None:
                self.left_out += 1
            else:
                self.sections.append(section)
            first, strings = first + x[2], strings + x[3]
        if self.records and headers and not self.sections:
            raise FormatError("all sections are encrypted, and no key is known")

    @property
    def sparse(self) -> bool:
        return bool(self.flags & SPARSE)

    def _size(self, header: tuple) -> int:
        return header[4] - header[1] if self.sparse else header[2] * self.record_size

    def _lists(self, s: Section) -> tuple:
        _, begin, records, string_size, _, ids_size, parents_size, entries, copies = s.header
        at = begin + s.size + (0 if self.sparse else string_size)

        def taken(n: int) -> bytes:
            nonlocal at
            at += n
            return self.source.read(at - n, n)

        numbers = lambda n: np.frombuffer(taken(4 * n), "<i4")
        ids = numbers(ids_size // 4)
        if len(ids) and not ids.any():
            ids = np.arange(self.min_id + s.first, self.min_id + s.first + records, dtype=np.int32)
        pairs = numbers(2 * copies).reshape(-1, 2).tolist()
        places = [(offset - begin, length) for offset, length in struct.iter_unpack("<IH", taken(6 * entries))]

        def sparse_ids(now: np.ndarray) -> np.ndarray:
            own = numbers(entries)
            if ids_size and len(now) != len(own):
                raise FormatError("ids of sparse records do not match")
            return own

        if entries and self.flags & SECONDARY_KEY:
            ids = sparse_ids(ids)
        parents: dict[int, int] = {}
        if parents_size:
            n = int(numbers(3)[0])
            parents = dict(numbers(2 * n).reshape(-1, 2).tolist())
        if entries and not self.flags & SECONDARY_KEY:
            ids = sparse_ids(ids)
        return ids if len(ids) else None, {a: b for a, b in pairs if a != b}, parents, places

    # ---- records
    def ids(self, rows: Section | Rows) -> np.ndarray:
        """The id of each record: from the list of ids, else from the id column, else its place."""
        rows = rows.rows() if isinstance(rows, Section) else rows
        if rows.ids is not None:
            return rows.ids.astype(np.int64)
        if self.id_index >= self.field_count:
            return rows.section.first + rows.places
        column = self.columns[self.id_index]
        if column.kind == COMMON:
            raise FormatError("an id column cannot hold common values")
        if self.sparse:
            walked = [self._walk(row)[self.id_index] for row in rows.data]
            return np.array([int.from_bytes(v[:4].ljust(4, b"\0"), "little", signed=True) for v, _ in walked], np.int64)
        return self._scalars(self._padded(rows), column, np.zeros(len(rows), np.int64)).astype(np.uint32).view(np.int32).astype(np.int64)

    @staticmethod
    def _padded(rows: Rows) -> np.ndarray:
        return np.pad(rows.data, ((0, 0), (0, 9)))

    @staticmethod
    def bits(records: np.ndarray, offset: int, width: int) -> np.ndarray:
        """``width`` bits of every record, from a bit offset on."""
        if not width or not len(records):
            return np.zeros(len(records), np.uint64)
        at, shift = offset >> 3, offset & 7
        low = np.ascontiguousarray(records[:, at : at + 8]).view("<u8").ravel() >> np.uint64(shift)
        if shift + width > 64:
            low |= records[:, at + 8].astype(np.uint64) << np.uint64(64 - shift)
        return low & np.uint64((1 << width) - 1)

    def _scalars(self, records: np.ndarray, c: ColumnMeta, ids: np.ndarray) -> np.ndarray:
        if c.kind == COMMON:
            return np.array([c.common.get(i, c.params[0]) for i in ids.tolist()], np.uint64)
        raw = self.bits(records, c.offset, c.width)
        if c.kind == SIGNED_IMMEDIATE and 0 < c.width < 64:
            sign = np.uint64(1 << (c.width - 1))
            raw = (raw ^ sign) - sign
        if c.kind == PALLET_ARRAY and c.params[2] != 1:
            raise FormatError("a scalar cannot be read from an array column")
        return c.pallet[raw.astype(np.int64)].astype(np.uint64) if c.kind in (PALLET, PALLET_ARRAY) else raw

    def _arrays(self, records: np.ndarray, c: ColumnMeta) -> np.ndarray:
        if c.kind == PALLET_ARRAY:
            at = self.bits(records, c.offset, c.width).astype(np.int64)
            return c.pallet.reshape(-1, c.params[2])[at].astype(np.uint64)
        if c.kind != NONE:
            raise FormatError("arrays are stored uncompressed or as pallet arrays")
        return np.stack([self.bits(records, c.offset + k * c.width, c.width) for k in range(c.size // c.width)], axis=1)

    @staticmethod
    def _string_at(s: Section, place: int) -> str:
        end = s.strings.find(b"\0", place - s.strings_at) if s.strings_at <= place < s.strings_end else -1
        try:
            return s.strings[place - s.strings_at : end].decode() if end >= 0 else ""
        except UnicodeDecodeError:
            return ""

    def _strings(self, rows: Rows, raw: np.ndarray, byte_offset: int) -> list[str]:
        """A string's offset counts from the field that holds it, as if strings followed all records."""
        offsets = raw.astype(np.uint32).view(np.int32).astype(np.int64)
        base = (rows.section.first + rows.places) * self.record_size - self.blob + byte_offset
        return [self._string_at(rows.section, int(max(0, b + o))) if o > 0 else "" for b, o in zip(base.tolist(), offsets.tolist(), strict=True)]

    def _walk(self, row: bytes) -> list[tuple[bytes, int]]:
        """The stored bytes of each field of a sparse record, and the bit at which they begin."""
        out, at = [], 0
        for c in self.columns:
            width = c.width
            if c.kind == NONE and width == 32 and c.size <= 32 and (end := row.find(b"\0", at >> 3)) >= 0:
                # 32 uncompressed bits count as a string, up to its zero byte.
                out.append((row[at >> 3 : max(end, (at >> 3) + 4)], at))
                at += (end + 1 - (at >> 3)) * 8
                continue
            n = c.size if c.kind == NONE and c.size > width > 0 else width
            value = (int.from_bytes(row, "little") >> at) & ((1 << n) - 1) if n else 0
            out.append((value.to_bytes(max(4, -(-n // 8)), "little"), at))
            at += n
        return out

    def column(self, rows: Section | Rows, f: Field, ids: np.ndarray | None = None) -> list | np.ndarray:
        """The values of a field for records, or for all of a section."""
        rows = rows.rows() if isinstance(rows, Section) else rows
        if f.index == VIRTUAL_ID:
            return self.ids(rows)
        if f.index == VIRTUAL_RELATION:
            keyed, parents = self.ids(rows) if self.flags & SECONDARY_KEY else rows.places, rows.section.parents
            return np.array([parents.get(int(k), 0) for k in keyed], np.int64)
        if f.index < 0:
            raise FormatError(f"{f.name}: this kind of virtual column cannot be read")
        if f.index >= self.field_count:
            raise FormatError(f"{f.name}: the file has {self.field_count} columns")
        ids = self.ids(rows) if ids is None else ids
        c = self.columns[f.index]
        if self.sparse:
            return self._sparse(rows, f, c, ids)
        records = self._padded(rows)
        if f.kind == "string":
            if f.count > 1:
                parts = [self._strings(rows, self.bits(records, c.offset + 32 * k, 32), (c.offset >> 3) + 4 * k) for k in range(f.count)]
                return [list(x) for x in zip(*parts, strict=True)]
            return self._strings(rows, self._scalars(records, c, ids), c.offset >> 3)
        if f.count > 1:
            return [x.tolist() for x in typed(self._arrays(records, c)[:, : f.count].copy(), f)]
        return typed(self._scalars(records, c, ids), f)

    def _sparse(self, rows: Rows, f: Field, c: ColumnMeta, ids: np.ndarray) -> list:
        out = []
        for row, row_id in zip(rows.data, ids.tolist(), strict=True):
            data, at = self._walk(row)[f.index]
            if f.kind == "string":
                end = row.find(b"\0", at >> 3)
                try:
                    out.append(row[at >> 3 : end].decode() if end >= 0 else "")
                except UnicodeDecodeError:
                    out.append("")
                continue
            one = np.pad(np.frombuffer(row, np.uint8), (0, 9))[None, :]
            moved = ColumnMeta(c.bits, at, c.size, c.kind, c.params, c.pallet, c.common)
            raw = self._arrays(one, moved)[:, : f.count].copy() if f.count > 1 else self._scalars(one, moved, np.array([row_id]))
            value = typed(raw, f)[0]
            out.append(value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value)
        return out

    def copies(self) -> dict[int, int]:
        """Copied ids and whose rows they repeat; scans leave them out, lookups by id find them."""
        return {a: b for s in self.sections for a, b in s.copies.items()}


def typed(raw: np.ndarray, f: Field) -> np.ndarray:
    """Stored bits as the field's type; unsigned ones in the next wider type."""
    if f.kind == "float":
        return raw.astype(np.uint32).view(np.float32)
    if f.bits == 64:
        return raw if f.kind == "uint" else raw.view(np.int64)
    kind = {8: "u1", 16: "u2"}.get(f.bits, "u4")
    whole = raw.astype(kind)
    return whole.astype({"u1": np.int16, "u2": np.int32, "u4": np.int64}[kind]) if f.kind == "uint" else whole.view(kind.replace("u", "i"))
