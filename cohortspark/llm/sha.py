"""SHA-256 over many rows at once, with hash states that can be copied, stored and resumed.

A state is the eight 32-bit words after a whole number of 64-byte blocks (a row of a uint32
array, 32 bytes as a column).  Hex digests are exactly one block, so the state before each child
of a tree node is such a state.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_bits(p: int, k: int) -> int:
    """First 32 bits of the fractional part of the k-th root (2 or 3) of p."""
    whole = p << (32 * k)
    root = math.isqrt(whole) if k == 2 else round(whole ** (1 / 3))
    while root**k > whole:
        root -= 1
    while (root + 1) ** k <= whole:
        root += 1
    return root & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], U)
ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], U)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U(n)) | (x << U(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16 big-endian words as uint32)."""
    w = [np.ascontiguousarray(block[:, i]) for i in range(16)]
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> U(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> U(10))))
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(state[:, i]) for i in range(8))
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def start(n: int) -> np.ndarray:
    return np.repeat(START[None, :], n, axis=0)


def absorb_where(state: np.ndarray, digests: np.ndarray, rows: np.ndarray) -> None:
    """Absorbs the hex text of ``digests`` (n, 32 bytes) into the states of the ``rows`` mask, in place."""
    if rows.any():
        state[rows] = absorb(state[rows], hex_block(digests[rows]))


def hex_block(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes -> the block of their lowercase hex text."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[digests >> 4], HEX[digests & 15]
    return text.view(">u4").astype(U)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of messages of ``blocks`` whole blocks."""
    pad = np.zeros((len(state), 16), U)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[:, 0], pad[:, 14], pad[:, 15] = U(0x80000000), (bits >> np.uint64(32)).astype(U), (bits & np.uint64(0xFFFFFFFF)).astype(U)
    return absorb(state, pad).astype(">u4").view(np.uint8).reshape(-1, 32) if len(state) else np.empty((0, 32), np.uint8)


def as_bytes(state: np.ndarray) -> np.ndarray:
    """States as (n, 32) bytes, and back with ``as_state``."""
    return np.ascontiguousarray(state.astype("<u4")).view(np.uint8).reshape(-1, 32)


def as_state(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<u4").reshape(-1, 8).astype(U)
