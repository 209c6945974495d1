"""Words and their 64-bit fingerprints, computed on whole byte buffers."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240517))
SEED = _rng.integers(1, 2**63, dtype=np.uint64)
PLACE = _rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROLL = int(_rng.integers(2**60, 2**63)) | 1
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        size = 1 << max(12, (count - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's count of words."""
    inside = ~SPACES[buffer]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)


def lower(buffer: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer + np.uint8(32), buffer)


#: What is kept of eight bytes when only the first 0 to 8 of them belong to a word.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of the buffer on, as one number each."""
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(buffer) + 1, dtype="<u8", buffer=padded, strides=(1,))


def chunks(whole: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut in eights: each eight, its place in its word, and each word's count; whole is eights(buffer)."""
    sizes = ends - starts
    counts = np.maximum((sizes + 7) >> 3, 1)
    if int(counts.max(initial=1)) == 1:
        return whole[starts] & KEPT[sizes], np.zeros(len(starts), np.int64), counts
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(sizes, counts) - 8 * step
    return whole[np.repeat(starts, counts) + 8 * step] & KEPT[np.minimum(left, 8)], step, counts


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of every word: eights mixed by themselves and with their places, summed and mixed with the length.

    Mixing is what no sum of powers does: words of like structure don't cancel out.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    parts, step, counts = chunks(eights(buffer), starts, ends)
    parts = mix(parts ^ SEED)
    if len(parts) > len(starts):
        later = np.flatnonzero(step)
        parts[later] = mix(parts[later] ^ step[later].astype(np.uint64) * PLACE)
        parts = np.add.reduceat(parts, np.cumsum(counts) - counts)
    return mix(parts + (ends - starts).astype(np.uint64) * PLACE)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` words in the buffer, texts not minded."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(ROLL, len(words)), out=sums[1:])
    back = powers(inverse(ROLL), len(words) - width + 1)
    return mix((sums[width:] - sums[:-width]) * back)


def spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of words, in the way of rolling()."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(ROLL, len(words)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(ROLL), len(words) + 1)[starts])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of every ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)
