from __future__ import annotations

import struct

import numpy as np
import pytest

from larkspur.sources.crypto import salsa20
from larkspur.sources.definitions import VIRTUAL_ID, VIRTUAL_RELATION, Field
from larkspur.sources.format import COMMON, IMMEDIATE, PALLET, PALLET_ARRAY, SIGNED_IMMEDIATE, FormatError, TableFile
from larkspur.sources.writer import Part, write_table

ID = Field("ID", "int", 32, 1, VIRTUAL_ID, is_id=True)
PARENT = Field("Parent", "int", 32, 1, VIRTUAL_RELATION, is_relation=True)
FIELDS = [
    ID, Field("Name", "string", 32, 1, 0), Field("Small", "int", 8, 1, 1), Field("Big", "uint", 64, 1, 2), Field("Scale", "float", 32, 1, 3),
    Field("Packed", "uint", 16, 1, 4), Field("Signed", "int", 16, 1, 5), Field("Rare", "int", 32, 1, 6), Field("Pal", "int", 32, 1, 7),
    Field("Arr", "int", 16, 3, 8), Field("PalArr", "float", 32, 2, 9), PARENT,
]
KINDS = {"Packed": (IMMEDIATE, 11), "Signed": (SIGNED_IMMEDIATE, 13), "Rare": (COMMON, 0), "Pal": (PALLET, 0), "PalArr": (PALLET_ARRAY, 0)}
ROWS = {
    10: ["one", -5, 2**64 - 1, 1.5, 2047, -4096, 0, 7, [1, -2, 3], [0.5, 1.0]],
    20: ["", 127, 0, -2.25, 0, 4095, -9, 7, [0, 0, 0], [0.5, 1.0]],
    31: ["düe", 0, 12345678901234567890, 0.0, 5, -1, 3, 100000, [32767, -32768, 1], [2.0, 3.0]],
}


def values(file: TableFile, s, name: str) -> list:
    got = file.column(s, next(f for f in FIELDS if f.name == name))
    return got.tolist() if isinstance(got, np.ndarray) else list(got)


def check(data: bytes, order: list[list[int]], keys=None, skip=()):
    file = TableFile(data, keys or {})
    assert [file.ids(s).tolist() for s in file.sections] == order
    for s, ids in zip(file.sections, order, strict=True):
        for n, f in enumerate(f for f in FIELDS if f.index >= 0):
            if f.name not in skip:
                assert values(file, s, f.name) == [ROWS[i][n] for i in ids], f.name
    return file


def test_dense_all_kinds_two_sections():
    parts = [Part([10, 20], [ROWS[10], ROWS[20]], copies={40: 10, 41: 41}, parents={0: 77}), Part([31], [ROWS[31]])]
    file = check(write_table(FIELDS, parts, kinds=KINDS), [[10, 20], [31]])
    assert file.copies() == {40: 10}
    assert values(file, file.sections[0], "Parent") == [77, 0]


def test_secondary_key_parents_go_by_id():
    file = TableFile(write_table(FIELDS, [Part([10, 20], [ROWS[10], ROWS[20]], parents={20: 5})], kinds=KINDS, secondary_key=True))
    assert values(file, file.sections[0], "Parent") == [0, 5]


def test_zero_ids_count_from_the_least():
    data = bytearray(write_table(FIELDS, [Part([10, 20], [ROWS[10], ROWS[20]])], kinds=KINDS))
    data[-8:] = bytes(8)
    assert TableFile(bytes(data)).ids(TableFile(bytes(data)).sections[0]).tolist() == [10, 11]


def test_inline_ids():
    fields = [Field("Key", "int", 32, 1, 0, is_id=True), Field("V", "int", 32, 1, 1)]
    file = TableFile(write_table(fields, [Part([5, 9], [[5, 50], [9, 90]])], list_ids=False))
    assert file.ids(file.sections[0]).tolist() == [5, 9]


def test_sparse_records():
    simple = [ID, Field("Name", "string", 32, 1, 0), Field("Small", "int", 8, 1, 1), Field("Packed", "uint", 16, 1, 2)]
    rows = [[r[0], r[1], r[4]] for r in (ROWS[10], ROWS[20], ROWS[31])]
    file = TableFile(write_table(simple, [Part([10, 20, 31], rows)], sparse=True))
    s = file.sections[0]
    assert file.ids(s).tolist() == [10, 20, 31]
    assert file.column(s, simple[1]) == ["one", "", "düe"] and list(file.column(s, simple[2])) == [-5, 127, 0] and list(file.column(s, simple[3])) == [2047, 0, 5]


def test_encrypted_sections():
    key = bytes(range(16))
    parts = [Part([10, 20], [ROWS[10], ROWS[20]], key_lookup=0xABC, key=key), Part([31], [ROWS[31]])]
    data = write_table(FIELDS, parts, kinds=KINDS)
    check(data, [[10, 20], [31]], {0xABC: key})
    file = check(data, [[31]])
    assert file.left_out == 1
    with pytest.raises(FormatError):
        TableFile(write_table(FIELDS, parts[:1], kinds=KINDS))


def test_bad_files():
    with pytest.raises(FormatError):
        TableFile(b"WDC5")
    with pytest.raises(FormatError):
        TableFile(b"WDC3" + bytes(300))


def test_invalid_utf8_reads_as_empty():
    fields = [ID, Field("Name", "string", 32, 1, 0)]
    data = write_table(fields, [Part([1, 2], [["abc"], ["xyz"]])]).replace(b"abc", b"a\xff\xfe")
    file = TableFile(data)
    assert file.column(file.sections[0], fields[1]) == ["", "xyz"]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200])
@pytest.mark.parametrize("key", [16, 32])
def test_salsa20_against_a_plain_version(size, key):
    def plain(k, nonce, block):
        c = b"expand 32-byte k" if len(k) == 32 else b"expand 16-byte k"
        w = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b))
        x = [w(c)[0], *w(k[:16]), w(c)[1], *w(nonce), block & 0xFFFFFFFF, block >> 32, w(c)[2], *w(k[-16:]), w(c)[3]]
        z, rot = x[:], lambda v, n: ((v << n) | (v >> (32 - n))) & 0xFFFFFFFF
        for _ in range(10):
            for a, b, d, e in ((0, 4, 8, 12), (5, 9, 13, 1), (10, 14, 2, 6), (15, 3, 7, 11), (0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14)):
                z[b] ^= rot((z[a] + z[e]) & 0xFFFFFFFF, 7)
                z[d] ^= rot((z[b] + z[a]) & 0xFFFFFFFF, 9)
                z[e] ^= rot((z[d] + z[b]) & 0xFFFFFFFF, 13)
                z[a] ^= rot((z[e] + z[d]) & 0xFFFFFFFF, 18)
        return struct.pack("<16I", *((p + q) & 0xFFFFFFFF for p, q in zip(x, z, strict=True)))

    k, nonce, data = bytes(range(key)), bytes(range(8)), bytes(i * 7 % 256 for i in range(size))
    stream = b"".join(plain(k, nonce, i) for i in range(-(-size // 64) or 1))
    assert salsa20(k, nonce, data) == bytes(a ^ b for a, b in zip(data, stream[:size], strict=True))
    assert salsa20(k, nonce, salsa20(k, nonce, data)) == data
