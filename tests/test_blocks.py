from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from larkspur.sources.blocks import BlockError, MissingKey, decode_blocks, lz4_block
from larkspur.sources.crypto import salsa20


def container(blocks: list[tuple[bytes, int]], entry: int = 24) -> bytes:
    table = b"".join(struct.pack(">2I", len(b), n) + hashlib.md5(b).digest() + bytes(entry - 24) for b, n in blocks)
    head = struct.pack(">4sIB3s", b"BLTE", 12 + len(table), 0x0F if entry == 24 else 0x10, len(blocks).to_bytes(3, "big"))
    return head + table + b"".join(b for b, _ in blocks)


LZ = bytes([0x52]) + b"abcde" + struct.pack("<H", 5) + bytes([0x30]) + b"xyz"  # abcde, six more from the repeat, xyz


def test_modes():
    assert lz4_block(LZ, 14) == b"abcdeabcdeaxyz"
    lz = b"4" + struct.pack(">BQB", 1, 14, 16) + struct.pack(">I", len(LZ)) + LZ
    for entry in (24, 40):
        data = container([(b"Nhello", 5), (b"Z" + zlib.compress(b"deflated"), 8), (lz, 14)], entry)
        assert decode_blocks(data) == b"hellodeflatedabcdeabcdeaxyz"
    assert decode_blocks(b"BLTE" + bytes(4) + b"Nwhole") == b"whole"


def test_encrypted_blocks():
    key, iv = bytes(range(16)), b"\1\2\3\4"
    nonce = bytearray(iv + bytes(4))
    nonce[0] ^= 1  # the block's place
    block = b"E" + bytes([8]) + bytes(range(8, 0, -1)) + bytes([4]) + iv + b"S" + salsa20(key, bytes(nonce), b"Nsecret")
    data = container([(b"Nopen", 4), (block, 6)])
    for order in ("big", "little"):
        assert decode_blocks(data, {int.from_bytes(bytes(range(8, 0, -1)), order): key}) == b"opensecret"
    missing: list[int] = []
    assert decode_blocks(data, missing=missing) == b"open" and len(missing) == 1
    with pytest.raises(MissingKey):
        decode_blocks(data, strict=True)


def test_damage():
    data = bytearray(container([(b"Nhello", 5)]))
    data[-1] ^= 1
    with pytest.raises(BlockError):
        decode_blocks(bytes(data))
    with pytest.raises(BlockError):
        decode_blocks(b"what")
    with pytest.raises(BlockError):
        decode_blocks(container([(b"Fx", 1)]))
    with pytest.raises(BlockError):
        lz4_block(b"\x10a\x09\x00", 9)
