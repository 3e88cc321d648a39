"""Writes tables of the binary format: for tests, and to turn other tables into files of it. Dense or sparse, one or more sections."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .crypto import salsa20
from .definitions import Field
from .format import COLUMN_META, COMMON, FIELD_META, HEADER, IMMEDIATE, MAGIC, NONE, PALLET, PALLET_ARRAY, SECONDARY_KEY, SECTION, SIGNED_IMMEDIATE, SPARSE


@dataclass
class Part:
    """The records of one section: ids, and a list of physical values for each record."""

    ids: list[int]
    rows: list[list]
    copies: dict[int, int] = field(default_factory=dict)
    parents: dict[int, int] = field(default_factory=dict)
    key_lookup: int = 0
    key: bytes | None = None


def _raw(value, f: Field) -> int:
    if f.kind == "float":
        return struct.unpack("<I", struct.pack("<f", value))[0]
    return int(value) & ((1 << f.bits) - 1)


def write_table(fields: list[Field], parts: list[Part], layout_hash: int = 0, table_hash: int = 0, kinds: dict[str, tuple[int, int]] | None = None,
                sparse: bool = False, secondary_key: bool = False, list_ids: bool = True, id_index: int = 0) -> bytes:
    """kinds: for a field name, how it is stored and in how many bits; else uncompressed."""
    stored = [f for f in fields if f.index >= 0]
    kinds = kinds or {}
    ids = [i for p in parts for i in p.ids]
    metas, pallets, commons, at = [], [], [], 0
    for n, f in enumerate(stored):
        kind, width = kinds.get(f.name, (NONE, 32 if f.kind == "string" else f.bits))
        values = [(i, r[n]) for p in parts for i, r in zip(p.ids, p.rows, strict=True)]
        pallet: list = []
        common: dict[int, int] = {}
        if kind == COMMON:
            common = {i: _raw(v, f) for i, v in values if v}
            meta, size = (0, len(common) * 8, (0, 0, 0)), 0
        elif kind in (PALLET, PALLET_ARRAY):
            pallet = sorted({tuple(_raw(x, f) for x in (v if f.count > 1 else [v])) for _, v in values})
            width = max(1, (len(pallet) - 1).bit_length())
            meta, size = (width, 4 * sum(map(len, pallet)), (at, width, f.count if kind == PALLET_ARRAY else 0)), width
        else:
            size = width * f.count
            meta = (size, 0, (at, width, 0))
        metas.append((at, kind, width, *meta))
        pallets.append(pallet)
        commons.append(common)
        at += size
    record_size = -(-at // 8)
    flags = SPARSE * sparse | SECONDARY_KEY * secondary_key

    n_records = sum(len(p.rows) for p in parts)
    head = HEADER.size + SECTION.size * len(parts) + (FIELD_META.size + COLUMN_META.size) * len(stored)
    side = b"".join(struct.pack(f"<{len(x)}I", *x) for pallet in pallets for x in pallet)
    side += b"".join(struct.pack("<iI", i, v) for common in commons for i, v in common.items())
    offset, body, sections, first, strings_before = head + len(side), b"", [], 0, 0
    for p in parts:
        records, table, places = [], b"\0", []
        for place, (row_id, row) in enumerate(zip(p.ids, p.rows, strict=True)):
            if sparse:
                records.append(_sparse(row_id, row, stored, metas, pallets))
                continue
            bits = 0
            for f, (o, kind, width, _, _, params), value, pallet in zip(stored, metas, row, pallets, strict=True):
                if kind == COMMON:
                    continue
                if f.kind == "string":
                    for k, text in enumerate(value if f.count > 1 else [value]):
                        if text:
                            target = strings_before + len(table)
                            table += text.encode() + b"\0" if isinstance(text, str) else bytes(text) + b"\0"
                            own = (first + place) * record_size - n_records * record_size + (o >> 3) + 4 * k
                            bits |= ((target - own) & 0xFFFFFFFF) << (o + 32 * k)
                elif kind in (PALLET, PALLET_ARRAY):
                    bits |= pallet.index(tuple(_raw(x, f) for x in (value if f.count > 1 else [value]))) << params[0]
                else:
                    for k, x in enumerate(value if f.count > 1 else [value]):
                        bits |= (_raw(x, f) & ((1 << width) - 1)) << (o + k * width)
            records.append(bits.to_bytes(record_size, "little"))
        if p.key:
            records = [salsa20(p.key, struct.pack("<Q", i & (2**64 - 1)), r) for i, r in zip(p.ids, records, strict=True)]
        data = b"".join(records)
        begin = offset + len(body)
        for r in records:
            places.append((begin + sum(n for _, n in places), len(r)))
        body += data + (b"" if sparse else table)
        own_ids = struct.pack(f"<{len(p.ids)}i", *p.ids)
        body += own_ids if list_ids else b""
        body += b"".join(struct.pack("<2i", a, b) for a, b in p.copies.items())
        if sparse:
            body += b"".join(struct.pack("<IH", a, n) for a, n in places)
            body += own_ids if secondary_key else b""
        if p.parents:
            body += struct.pack("<3i", len(p.parents), min(p.parents.values()), max(p.parents.values())) + b"".join(struct.pack("<2i", a, b) for a, b in p.parents.items())
        if sparse and not secondary_key:
            body += own_ids
        sections.append((p.key_lookup, begin, len(p.rows), 0 if sparse else len(table), begin + len(data), len(own_ids) if list_ids else 0, 12 + 8 * len(p.parents) if p.parents else 0, len(places) if sparse else 0, len(p.copies)))
        first, strings_before = first + len(p.rows), strings_before + (0 if sparse else len(table))
    header = HEADER.pack(MAGIC, 5, b"", n_records, len(stored), record_size, strings_before, table_hash, layout_hash, min(ids, default=0), max(ids, default=0), 0, flags, id_index,
                         len(stored), 0, 0, COLUMN_META.size * len(stored), sum(8 * len(c) for c in commons), sum(4 * len(x) for p in pallets for x in p), len(parts))
    meta = b"".join(FIELD_META.pack(32 - width if kind == NONE else 0, o >> 3) for o, kind, width, *_ in metas)
    meta += b"".join(COLUMN_META.pack(o, size, extra, kind, *params) for o, kind, _, size, extra, params in metas)
    return header + b"".join(SECTION.pack(*s) for s in sections) + meta + side + body


def _sparse(row_id: int, row: list, fields: list[Field], metas: list, pallets: list) -> bytes:
    """One record: strings inline with their zero byte, numbers one behind the other."""
    bits, at = 0, 0
    for f, (_, kind, width, *_), value, pallet in zip(fields, metas, row, pallets, strict=True):
        if kind == COMMON:
            continue
        if f.kind == "string":
            data = value.encode() + b"\0"
            bits |= int.from_bytes(data, "little") << at
            at += 8 * len(data)
        elif kind in (PALLET, PALLET_ARRAY):
            bits |= pallet.index(tuple(_raw(x, f) for x in (value if f.count > 1 else [value]))) << at
            at += width
        else:
            for x in value if f.count > 1 else [value]:
                bits |= (_raw(x, f) & ((1 << width) - 1)) << at
                at += width
    return bits.to_bytes(-(-at // 8), "little")


__all__ = ["COMMON", "IMMEDIATE", "NONE", "PALLET", "PALLET_ARRAY", "SIGNED_IMMEDIATE", "Part", "write_table"]
