"""The Salsa20 stream cipher, as published by its author, on whole arrays of blocks."""

from __future__ import annotations

import numpy as np

#: The cipher's constants for keys of 16 and 32 bytes, and the words of a quarter-round, by columns then rows.
TAU, SIGMA = b"expand 16-byte k", b"expand 32-byte k"
QUARTERS = ((0, 4, 8, 12), (5, 9, 13, 1), (10, 14, 2, 6), (15, 3, 7, 11), (0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14))
ROUNDS = 20


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def keystream(key: bytes, nonce: bytes, blocks: int) -> bytes:
    if len(key) not in (16, 32) or len(nonce) != 8:
        raise ValueError("Salsa20 takes a key of 16 or 32 bytes and a nonce of 8")
    words = lambda data: np.frombuffer(data, "<u4")
    c = words(SIGMA if len(key) == 32 else TAU)
    counter = np.arange(blocks, dtype=np.uint64)
    state = np.zeros((16, blocks), np.uint32)
    state[[0, 5, 10, 15]] = c[:, None]
    state[1:5], state[11:15] = words(key[:16])[:, None], words(key[-16:])[:, None]
    state[6:8] = words(nonce)[:, None]
    state[8], state[9] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32)
    x = state.copy()
    with np.errstate(over="ignore"):
        for i in range(ROUNDS // 2 * 8):
            a, b, c_, d = QUARTERS[i % 8]
            x[b] ^= _rotated(x[a] + x[d], 7)
            x[c_] ^= _rotated(x[b] + x[a], 9)
            x[d] ^= _rotated(x[c_] + x[b], 13)
            x[a] ^= _rotated(x[d] + x[c_], 18)
        return (x + state).T.astype("<u4").tobytes()


def salsa20(key: bytes, nonce: bytes, data: bytes) -> bytes:
    """data XOR the key stream: encrypts and decrypts."""
    if not data:
        return b""
    stream = np.frombuffer(keystream(key, nonce, -(-len(data) // 64))[: len(data)], np.uint8)
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()
