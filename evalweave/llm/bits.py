"""SimHash majorities over many texts at once, with numpy."""

from collections.abc import Iterator

import numpy as np

# One bit in every byte of a word: eight counters a word, none may pass 255.
_LANES = np.uint64(0x0101010101010101)
_MOST = 255


_LOW = np.uint64(0xFFFFFFFF)


def _totals(counted: Iterator[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Sums over each run of ``n[i]`` words of one counter a byte: a column a byte of each array."""
    if n.max() <= _MOST:
        cuts = np.cumsum(n) - n
        counts = [np.add.reduceat(words, cuts).astype("<u8").view(np.uint8).reshape(-1, 8) for words in counted]
        return np.concatenate(counts, axis=1).astype(np.int16)
    parts = -(-n // _MOST)
    first_part = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first_part, parts)
    cuts = np.repeat(np.cumsum(n) - n, parts) + within * _MOST
    counts = [np.add.reduceat(words, cuts).astype("<u8").view(np.uint8).reshape(-1, 8) for words in counted]
    return np.add.reduceat(np.concatenate(counts, axis=1), first_part, axis=0, dtype=np.int64)


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``sizes[i]`` unsigned 64-bit ``hashes``.

    A bit is set if more than half the run's hashes have it; an empty run gives 0.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    totals = _totals(((hashes >> np.uint64(shift)) & _LANES for shift in range(8)), n)
    over = (2 * totals > n[:, None]).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
    out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def low_majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low 32 bits of ``majorities``, for half the work."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    # Bits 0 to 3 of every byte in the low half of a word, bits 4 to 7 in the high one.
    low = hashes & _LOW
    both = low | (low >> np.uint64(4)) << np.uint64(32)
    totals = _totals(((both >> np.uint64(shift)) & _LANES for shift in range(4)), n)
    over = (2 * totals > n[:, None]).reshape(-1, 4, 2, 4).transpose(0, 3, 2, 1).reshape(-1, 32)
    out[full] = np.packbits(over, axis=1, bitorder="little").view("<u4").reshape(-1)
    return out


def as_signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def as_unsigned(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)
