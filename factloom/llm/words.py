"""Words and shingles of many texts at once, as numpy arrays.

Words are the maximal runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. Hashes
are 64 bits; whoever links documents by them confirms on the words themselves.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_bytes(text: str) -> list[bytes]:
    """The words of one text; ``bytes.split`` splits at just the bytes that words end at."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def words_of(text: str) -> list[str]:
    """The words of one text, as strings."""
    return [w.decode("utf-8", "surrogatepass") for w in word_bytes(text)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 64
#: A number for each byte at each of the first places of a word; a hash adds up those of its bytes.
_NUMBERS = mix(np.arange(1, 1 + 256 * _PLACES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def plain_word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, of words as they are."""
    return word_hashes(texts, fold=False)


def word_hashes(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in a row, and the number of words of each text; fold: A-Z count as a-z."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    buffer = _FOLD[buffer] if fold else buffer
    solid = ~_SPACE[buffer]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    heads = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    numbers = _NUMBERS[np.minimum(place, _PLACES - 1) << 8 | buffer[solid]]
    hashes = mix(np.add.reduceat(numbers, heads) + sizes.astype(np.uint64))
    for k in np.flatnonzero(sizes > _PLACES).tolist():
        hashes[k] = int.from_bytes(blake2b(buffer[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little")
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, repeats included, and their number by text.

    short: a text of fewer words, but at least one, has its whole sequence as its single shingle.
    """
    n = len(words)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(3) + words[k : k + len(total)] + np.uint64(k + 1))
    ends = np.cumsum(counts)
    sizes = np.maximum(counts - size + 1, 0)
    firsts = ends - counts
    where = np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    full = total[where]
    few = np.flatnonzero((counts > 0) & (counts < size)) if short else np.zeros(0, np.int64)
    if not len(few):
        return full, sizes
    whole = np.zeros(len(few), np.uint64)
    for k in range(size - 1):
        there = counts[few] > k
        whole[there] = mix(whole[there] * np.uint64(5) + words[firsts[few[there]] + k] + np.uint64(101 + k))
    out_sizes = sizes.copy()
    out_sizes[few] = 1
    out = np.empty(int(out_sizes.sum()), np.uint64)
    places = np.cumsum(out_sizes) - out_sizes
    is_whole = np.zeros(len(out), bool)
    is_whole[places[few]] = True
    out[is_whole], out[~is_whole] = whole, full
    return out, out_sizes
