"""Word and shingle hashes of whole texts, vectorised over bytes inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: White space of the word pattern ``[^\\x20\\x09-\\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes hashed at a time; a longer text is cut at white space.
SEGMENT = 1 << 20

_seeded = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_seeded.integers(1, 1 << 62)) * 2 + 1
_MIX = _seeded.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segments(buf: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while len(buf) - at > SEGMENT:
        spaces = np.flatnonzero(_IS_SPACE[buf[at : at + SEGMENT]])
        if len(spaces):
            cut = at + int(spaces[-1])
        else:
            later = np.flatnonzero(_IS_SPACE[buf[at + SEGMENT :]])
            cut = at + SEGMENT + int(later[0]) if len(later) else len(buf)
        yield buf[at:cut]
        at = cut
    yield buf[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters lower-cased, in order."""
    out = []
    for seg in _segments(np.frombuffer(text, np.uint8)):
        space = _IS_SPACE[seg]
        edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(starts):
            up, down = _power_tables(len(seg) + 1)
            total = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(_LOWER_BYTE[seg] * up[: len(seg)], out=total[1:])
            value = (total[ends] - total[starts]) * down[starts]
            out.append(mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; all words as one where there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    size = min(width, len(words))
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = (total + words[k : k + n]) * _MIX[k]
    return np.unique(mixed(total))
