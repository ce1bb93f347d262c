"""Word-shingle sets and fast similarity sketches of batches of texts (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier (golden ratio in 64 bits)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # a public 64-bit finaliser
BATCH_CHARS = 2_000_000  # texts are worked on in groups of about this many characters


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def groups(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of the list with about ``limit`` characters each (one long text may be more)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in one array, and each text's count.

    Words are runs of anything but blanks (space, 09 to 0D), A-Z lower-cased; a text with
    fewer than k words, but not none, has its whole sequence as one shingle.
    """
    import pandas as pd

    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            own = t.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, the six blanks only
            counts[i] = len(own)
            words += own
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    del words
    ends = np.cumsum(counts)
    starts = ends - counts
    acc = h.copy()
    for j in range(1, k):
        acc[: len(h) - j] = acc[: len(h) - j] * STEP + h[j:]
    acc = mix64(acc)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        n = counts[i]
        if n == 0:
            continue
        if n >= k:
            own = np.unique(acc[starts[i]: ends[i] - k + 1])
        else:
            one = np.uint64(n)
            for x in h[starts[i]: ends[i]]:
                one = np.uint64((int(one) * int(STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            own = mix64(np.array([one], np.uint64))
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out), sizes


def sketches(elements: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of each set: (sets, t) values; a coordinate is equal in two
    sets with a probability of their Jaccard similarity.

    Round i places every element in a hashed bin with a hashed value above all of round
    i - 1; a bin keeps its smallest value.  Most sets fill within a few rounds and stop
    there; from round t on, round t + b places all elements in bin b, so that every
    coordinate fills after 2t rounds at most.
    """
    n = len(sizes)
    full = np.full(n * t, MASK, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    values, left = elements, sizes > 0
    for i in range(2 * t):
        if not len(values):
            break
        g = mix64(values + np.uint64((i + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        b = (g % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(full, owner * t + b, (np.uint64(i) << np.uint64(56)) | (g >> np.uint64(8)))
        left = left & (full.reshape(n, t) == MASK).any(axis=1)
        on = left[owner]
        values, owner = values[on], owner[on]
    return full.reshape(n, t)
