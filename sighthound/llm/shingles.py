"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bytes that are hashed at once, but for a longer word.
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(int(_BASE), _BLOCK), _powers(pow(int(_BASE), -1, 1 << 64), _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(29))) * _BASE
    return x ^ (x >> _U(32))


def _block(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, as differences of running sums modulo 2^64 moved to the same power."""
    global _UP, _DOWN
    if len(data) > len(_UP):
        up, down = _powers(int(_BASE), len(data)), _powers(pow(int(_BASE), -1, 1 << 64), len(data))
    else:
        up, down = _UP, _DOWN
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MIX)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased ASCII-separated bytes begin, and their hashes."""
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~_WHITE[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    parts, i = [], 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _BLOCK, "right")))
        parts.append(_block(raw[begin[i] : end[j - 1]], begin[i:j] - begin[i], end[i:j] - begin[i]))
        i = j
    return begin, np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the k-word shingles of each text, A-Z lower-cased, words between ASCII white space.

    A text of fewer words has the whole sequence as its one shingle; null texts and those without words have none.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= 2 * _BLOCK):
            size += len(texts[j] or b"")
            j += 1
        part = [(t or b"").lower() for t in texts[i:j]]
        begin, words = word_hashes(b" ".join(part))
        starts = np.cumsum([0, *(len(t) + 1 for t in part)])
        cuts = np.searchsorted(begin, starts)
        full = np.full(max(0, len(words) - k + 1), k, np.uint64)
        for s in range(k):
            full = mix(full * _BASE + words[s : s + len(full)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            else:
                one = np.full(min(1, b - a), b - a, np.uint64)
                for s in range(a, b):
                    one = mix(one * _BASE + words[s : s + 1])
                out.append(one)
        i = j
    return out
