"""Word and shingle hashes of whole texts, for many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words of a shingle.
SHINGLE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ROOT = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))
_PLACE = mixed(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64) * np.uint64(_ROOT)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse mod 2**64."""
    n = 1 << bits
    up, down = np.full(n, _ROOT, np.uint64), np.full(n, pow(_ROOT, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, by default with A-Z in lower case; how many words each text has), in order."""
    raw = [(t or "").encode() for t in texts]
    raw = [r.lower() for r in raw] if lower else raw
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    up, down = _powers(max(18, int(len(data)).bit_length()))
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.cumsum(_BYTE[data] * up[: len(data)])
    words = mixed((sums[ends - 1] - sums[starts - 1]) * down[starts])
    bounds = np.cumsum([1] + [len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A text of fewer words than ``size`` has its whole sequence as its only shingle, one without words none.
    """
    words, counts = word_hashes(texts)
    n = max(0, len(words) - size + 1)
    every = np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        every += words[k : k + n] * _PLACE[k]
    every = mixed(every)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            s = np.sort(every[at : at + c - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mixed((words[at : at + c] * _PLACE[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def slices(batch, column: int, chars: int = 1_000_000):
    """Runs of rows of an Arrow batch whose texts have about so many characters, as (first row, texts)."""
    held, size, first = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py()
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held
