"""Word and word-window hashes of whole texts in numpy, in stretches of bounded size."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes of a text worked on at a time.
STRETCH = 1 << 21
U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, U, endpoint=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**n`` modulo 2**64."""
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _stretch(data: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    gap = _SEP[data]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return [np.zeros(0, U) for _ in seeds]
    ends = np.flatnonzero(inside & np.concatenate((gap[1:], [True]))) + 1
    lengths = ends - starts
    # Bytes of words only, each with its place in the word.
    chars = data[inside]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    weight = powers(BASE, int(lengths.max()))[place]
    return [mix(np.add.reduceat(_byte_values(s)[chars] * weight, first)
                + lengths.astype(U) * U(BASE)) for s in seeds]


def word_hashes(text: bytes, seeds: tuple[int, ...] = (1,)) -> list[np.ndarray]:
    """A 64-bit hash of each word, one array per seed."""
    if len(text) <= STRETCH:
        return _stretch(np.frombuffer(text, np.uint8), seeds)
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(at + STRETCH, len(data))
        while end < len(data) and not _SEP[data[end]]:  # whole words only
            end += 1
        parts.append(_stretch(data[at:end], seeds))
        at = end
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    back = powers(INVERSE, len(words))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(words * back[1:], dtype=U)))
    ahead = powers(BASE, n)
    return mix((sums[length:length + n] - sums[:n]) * ahead[:n])


def minimizers(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` consecutive values the place of the least, the first of equals."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Least of blocks read from both ends: two running minima cover any span.
    pad = -len(hashes) % span
    h = np.concatenate((hashes, np.full(pad, np.iinfo(U).max, U)))
    blocks = h.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[span - 1:span - 1 + n])
    # The place: the first index at or after the window's start that holds the least value.
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    lo = np.searchsorted(ranked, least, "left")
    hi = np.searchsorted(ranked, least, "right")
    places = order[lo]
    many = np.flatnonzero((hi - lo > 1) & (places < np.arange(n)))
    for i in many:
        run = order[lo[i]:hi[i]]
        places[i] = run[np.searchsorted(run, i)]
    return places
