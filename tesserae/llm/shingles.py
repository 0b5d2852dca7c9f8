"""Words, word shingles and min-hashes, as numpy arrays of unsigned 64-bit hashes.

Words are the runs of anything but space and \\x09-\\x0D in the text with A-Z in
lower case. A text with fewer words than a shingle has its whole sequence as
its one shingle; without words there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20  # bytes of text hashed at once
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of x over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * _P)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    return space, value


_SPACE, _VALUE = _tables()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0 to n of _P and of its inverse modulo 2^64; made once for each worker, at most for a chunk."""
    if len(_powers[0]) <= n:
        for k, x in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16) + 1, np.uint64(x), np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _chunks(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in stretches of about CHUNK that end at white space."""
    at = 0
    while len(raw) - at > CHUNK:
        stops = np.flatnonzero(_SPACE[raw[at : at + CHUNK]])
        end = at + CHUNK
        if len(stops):
            end = at + int(stops[-1]) + 1
        else:
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in bytes."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1])  # into a word and out of it by turns
    return change[::2], change[1::2]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word in order, all in array operations.

    A word's hash is the polynomial of its bytes' values in _P modulo 2^64,
    as the difference of two prefix sums times an inverse power, then mixed
    with its length.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = []
    for part in _chunks(raw):
        powers, inverses = _power_tables(len(part))
        start, end = _words(part)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * powers[: len(part)], out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64) * _A))
    return out[0] if len(out) == 1 else np.concatenate(out)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end = _words(raw)
    point = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=point[1:])
    return point[start], point[end]


def sequence(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles at each place, repeats included."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))), np.uint64)
    for i in range(min(width, len(h))):
        out = out * _P + h[i : i + n]
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return distinct(sequence(text, width))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def seeds(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _P) | np.uint64(1)


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Signatures (rows: sets, all non-empty; columns: n hash functions)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), np.uint64)
    for j, s in enumerate(seeds(n)):
        y = flat * s
        y ^= y >> np.uint64(32)
        y *= _A
        out[:, j] = np.minimum.reduceat(y, starts)
    return out
