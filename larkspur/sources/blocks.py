"""Block containers: a table of blocks, each stored raw, deflated, LZ4-compressed, or encrypted around one of these."""

from __future__ import annotations

import hashlib
import struct
import zlib

from .crypto import salsa20

#: Fixed values of the format: the container's signature and its block modes.
SIGNATURE = b"BLTE"
RAW, DEFLATED, LZ4, ENCRYPTED, FRAME = b"N", b"Z", b"4", b"E", b"F"


class BlockError(ValueError):
    """A container that cannot be decoded."""


class MissingKey(BlockError):
    def __init__(self, lookup: int):
        super().__init__(f"no key {lookup:016X}")
        self.lookup = lookup


def lz4_block(data: bytes, size: int) -> bytes:
    """One LZ4 block: literals and matches in turns."""
    out, at = bytearray(), 0

    def length(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                more = data[at]
                at += 1
                n += more
                if more != 255:
                    break
        return n

    try:
        while at < len(data):
            token = data[at]
            at += 1
            n = length(token >> 4)
            out += data[at : at + n]
            at += n
            if at >= len(data):
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            n = length(token & 15) + 4
            if not 0 < back <= len(out):
                raise BlockError("LZ4 match before the beginning")
            if back >= n:
                out += out[-back : len(out) - back + n]
            else:
                piece = bytes(out[-back:])
                out += (piece * (n // back + 1))[:n]
    except IndexError as short:
        raise BlockError("LZ4 data break off") from short
    if len(out) != size:
        raise BlockError("LZ4 data have another size")
    return bytes(out)


def _lz4_stream(data: bytes) -> bytes:
    version, size, shift = struct.unpack_from(">BQB", data)
    if version != 1 or not 5 <= shift <= 16:
        raise BlockError("unknown LZ4 stream")
    out, at = b"", 10
    while len(out) < size:
        (n,) = struct.unpack_from(">I", data, at)
        out += lz4_block(data[at + 4 : at + 4 + n], min(1 << shift, size - len(out)))
        at += 4 + n
    return out


def _block(data: bytes, index: int, keys: dict[int, bytes], nested: bool = False) -> bytes:
    mode, body = data[:1], data[1:]
    if mode == RAW:
        return body
    if mode == DEFLATED:
        try:
            return zlib.decompress(body)
        except zlib.error as bad:
            raise BlockError(str(bad)) from bad
    if mode == LZ4:
        return _lz4_stream(body)
    if mode == ENCRYPTED and not nested:
        name_size = body[0]
        if name_size != 8:
            raise BlockError("key names have 8 bytes")
        name, iv_size = body[1:9], body[9]
        if iv_size not in (4, 8):
            raise BlockError("initial vectors have 4 or 8 bytes")
        iv, kind = body[10 : 10 + iv_size], body[10 + iv_size : 11 + iv_size]
        if kind != b"S":
            raise BlockError(f"unknown cipher {kind!r}")
        key = keys.get(int.from_bytes(name, "big")) or keys.get(int.from_bytes(name, "little"))
        if key is None:
            raise MissingKey(int.from_bytes(name, "little"))
        nonce = bytearray(iv.ljust(8, b"\0"))
        for i, b in enumerate(struct.pack("<I", index)):
            nonce[i] ^= b
        return _block(salsa20(key, bytes(nonce), body[11 + iv_size :]), index, keys, True)
    raise BlockError(f"block mode {mode!r} cannot be read here")


def decode_blocks(data: bytes, keys: dict[int, bytes] | None = None, strict: bool = False, missing: list[int] | None = None, check: bool = True) -> bytes:
    """The bytes of a container. A block without its key is left out, and noted in missing; strict: an error."""
    keys = keys or {}
    if data[:4] != SIGNATURE:
        raise BlockError("no block container")
    (header,) = struct.unpack_from(">I", data, 4)
    if header == 0:
        blocks = [(data[8:], None, None)]
    else:
        kind, count = data[8], int.from_bytes(data[9:12], "big")
        entry = {0x0F: 24, 0x10: 40}.get(kind)
        if entry is None:
            raise BlockError(f"unknown block table {kind:#x}")
        blocks, at = [], header
        for i in range(count):
            raw, size = struct.unpack_from(">2I", data, 12 + i * entry)
            blocks.append((data[at : at + raw], size, data[20 + i * entry : 36 + i * entry]))
            at += raw
    out = []
    for i, (block, size, digest) in enumerate(blocks):
        if check and digest and any(digest) and hashlib.md5(block).digest() != digest:
            raise BlockError(f"block {i} is damaged")
        try:
            part = _block(block, i, keys)
        except MissingKey as no:
            if strict:
                raise
            if missing is not None:
                missing.append(no.lookup)
            continue
        if size is not None and len(part) != size:
            raise BlockError(f"block {i} has another size")
        out.append(part)
    return b"".join(out)
