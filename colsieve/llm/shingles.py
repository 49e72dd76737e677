"""Word shingles as sets of 64-bit hashes, and HyperMinHash registers of them."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Registers to a sketch, the mantissa's bits, and the bits of a hash that its register is not chosen by.
REGISTERS, MANTISSA = 256, 10
_REST = np.uint64(56)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype="u8")


class WordHashes(dict):
    """Hashes of words seen by this process; forgotten when there are many, so that memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, seen: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of five words; fewer words are one shingle, none are no shingle.

    A-Z are lower-cased, words end at ASCII white space: what ``bytes.lower`` and ``bytes.split`` do.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="u8")
    h = np.fromiter(map(seen.__getitem__, words), dtype="u8", count=len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return mix(np.array([np.sum(h * _MULTIPLIERS[: len(h)], dtype="u8") + np.uint64(len(h))], dtype="u8"))
    total = h[:n] * _MULTIPLIERS[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * _MULTIPLIERS[i]
    return np.unique(mix(total))


#: Odd multipliers, a hash function of its own for each register that stays empty, and hashes they meet at once.
_OWN = np.random.default_rng(7).integers(0, 1 << 63, REGISTERS, dtype="u8") * np.uint64(2) + np.uint64(1)
_AT_ONCE = 1024


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash: for each of 256 buckets (the top 8 bits) the least rest of 56 bits, kept as its leading zeros
    plus one (6 bits) and the 10 bits after the leading one. An empty bucket takes the least of all shingles under a
    hash function of its own, so that registers of short texts agree independently of one another too; no shingles are
    all zeros."""
    out = np.zeros(REGISTERS, dtype="<u2")
    if not len(hashes):
        return out
    bucket = (hashes >> _REST).astype("i4")
    first = np.r_[True, bucket[1:] != bucket[:-1]]  # hashes are sorted, so the first of a bucket is its least
    rest = np.full(REGISTERS, (1 << 56) - 1, dtype="u8")
    rest[bucket[first]] = hashes[first] & rest[0]
    empty = np.ones(REGISTERS, dtype=bool)
    empty[bucket[first]] = False
    if empty.any():
        least = [(mixed[:, None] * _OWN[empty]).min(0) for mixed in np.split(hashes ^ (hashes >> np.uint64(32)), range(_AT_ONCE, len(hashes), _AT_ONCE))]
        rest[empty] = np.min(least, axis=0) >> np.uint64(8)
    # frexp of the top 53 bits is exact: rest = fraction * 2**exponent with fraction in [0.5, 1)
    fraction, exponent = np.frexp((rest >> np.uint64(3)).astype("f8"))
    zeros = np.where(rest >> np.uint64(3), 53 - exponent, 53).astype("u4")
    mantissa = np.where(fraction > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype("u4")
    return (((zeros + 1) << MANTISSA) | mantissa).astype("<u2")


def chance_match(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How likely a register of two disjoint sets of these sizes is equal by chance: the sum over leading zeros of
    the chances that both minima lie in one interval of a mantissa, each minimum being exponential."""
    a, b = np.asarray(n_a, "f8") / REGISTERS, np.asarray(n_b, "f8") / REGISTERS
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(40):
        low, width = 2.0 ** -(zeros + 1), 2.0 ** -(zeros + 1 + MANTISSA)
        x = low * 1.5
        total += (a * np.exp(-a * x)) * (b * np.exp(-b * x)) * width * low
    return total


def similarity(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers, corrected for chance matches, and how many draws it rests on."""
    equal = (reg_a == reg_b).mean(-1)
    chance = chance_match(n_a, n_b)
    draws = REGISTERS * -np.expm1(-np.maximum(n_a, n_b) / REGISTERS)
    return np.clip((equal - chance) / (1 - chance), 0, 1), draws


def least_estimate(threshold: float, draws: np.ndarray, sigmas: float = 6.0) -> np.ndarray:
    """What the estimate of a pair at the threshold falls below with a chance of 1e-9."""
    return threshold - sigmas * np.sqrt(threshold * (1 - threshold) / np.maximum(draws, 1))
