"""SHA-256 with states that can be kept, for messages of digests as hex text (runs inside tasks).

A digest as hex text is 64 bytes, one block of the hash. So the state before each child of a parent
is eight 32-bit words with nothing pending, and it can be stored and resumed. All functions work on
many messages at once, a row each.
"""
from __future__ import annotations

import math

import numpy as np

DIGEST = 32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    c = 2
    while len(found) < n:
        if all(c % p for p in found):
            found.append(c)
        c += 1
    return found


def _cube_root(n: int) -> int:
    x = round(n ** (1 / 3))
    while x**3 > n:
        x -= 1
    while (x + 1) ** 3 <= n:
        x += 1
    return x


# the standard's constants by its rule: fractional bits of square and cube roots of the first primes
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _rotated(x: np.ndarray, *by: int) -> np.ndarray:
    out = (x >> np.uint32(by[0])) | (x << np.uint32(32 - by[0]))
    for r in by[1:]:
        out ^= (x >> np.uint32(r)) | (x << np.uint32(32 - r))
    return out


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """[8, n] states after one block of sixteen words, [16, n], each."""
    w = list(block)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_rotated(x, 7, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_rotated(y, 17, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for k, v in zip(ROUND, w, strict=True):
        t = h + _rotated(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + (v + k)
        s = _rotated(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + s, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_block(digests: np.ndarray) -> np.ndarray:
    """[16, n] words of the hex text of [n, 32] digest bytes."""
    text = np.empty((len(digests), 2 * DIGEST), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[digests >> 4], HEX[digests & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """[n, 32] digests of messages of ``children`` digests each."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = children * 8 * 2 * DIGEST  # bits of the message; far below 2^32
    return raw(absorb(state, last))


def raw(state: np.ndarray) -> np.ndarray:
    """[n, 32] bytes of [8, n] states."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, DIGEST)


def restore(body: np.ndarray) -> np.ndarray:
    """[8, n] states of [n, 32] bytes."""
    return np.ascontiguousarray(np.ascontiguousarray(body).view(">u4").astype(np.uint32).T)


def parents(children: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests [n, 32], states [n, fanout, 32] before each child) of [n, fanout, 32] children.

    ``sizes``: how many of a row's children are there; the rest of a row is never looked at.
    """
    n, fanout, _ = children.shape
    state, kept = start(n), np.zeros((n, fanout, DIGEST), np.uint8)
    for slot in range(fanout):
        on = np.flatnonzero(sizes > slot)
        if not len(on):
            break
        kept[on, slot] = raw(state[:, on])
        state[:, on] = absorb(state[:, on], hex_block(children[on, slot]))
    return finish(state, sizes), kept


def refold(state: np.ndarray, replacement: np.ndarray, right: np.ndarray, n_right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[n, 32] parents' digests with a child replaced, from the [n, 32] state before it.

    ``right``: [n, fanout, 32] siblings after the child, ``n_right`` of them; nothing left of it is read.
    """
    now = absorb(restore(state), hex_block(replacement))
    for k in range(int(n_right.max(initial=0))):
        on = np.flatnonzero(n_right > k)
        now[:, on] = absorb(now[:, on], hex_block(right[on, k]))
    return finish(now, sizes)
