"""Word shingles and their parity sketches, in numpy on whole texts.

Words are the runs of bytes other than space and \\x09-\\x0D, with A-Z in lower
case.  A shingle is ``width`` consecutive words, kept as a 64-bit hash; a text
with fewer words has one shingle, the whole sequence; a text without words has
none.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Bits of a segment of the segmented sketch.
SEGMENT_BITS = 16


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit changes half of the output's."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in text order."""
    m = len(words) - width + 1
    h = mix(words[:m] + U(width))
    for j in range(1, width):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[j:j + m])
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(width, len(words))))


def most_apart(total: int, percent: int) -> int:
    """The largest symmetric difference of two sets of ``total`` elements
    together whose Jaccard similarity is ``percent`` per cent or more."""
    return total * (100 - percent) // (100 + percent)


def segments(band: int, percent: int) -> int:
    """Segments of the sketch of a size band: 15 per cent more than pigeonholes
    that a pair with its smaller set in [2**band, 2**(band+1)) can spoil."""
    x = 2 ** (band + 1) - 1
    need = most_apart(x + 100 * x // percent, percent) + 1
    return max(need, need * 115 // 100)


def segment_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each set, and the number of the set that each belongs to: two
    sets with Jaccard >= percent share at least one.

    In the band of the smaller set, each shingle flips one bit of one segment.
    A pair that differs in d shingles has d or fewer segments that differ, so of
    k segments k-d are equal.  Segments are ranked by their number of set bits,
    then by key; the first of the equal ones is among the first d+1 of either
    set, so the first d+1 are enough (d for the largest possible partner).
    """
    owner, band, count = [], [], []
    for at, s in enumerate(sets):
        n = len(s)
        if not n:
            continue
        b = n.bit_length() - 1
        owner.append(at), band.append(b), count.append(most_apart(n + 100 * n // percent, percent) + 1)
        below = 2 ** b - 1  # the largest set of the band below
        if b and -(-percent * n // 100) <= below:
            owner.append(at), band.append(b - 1), count.append(most_apart(n + below, percent) + 1)
    if not owner:
        return np.empty(0, U), np.empty(0, np.int64)
    k = np.array([segments(b, percent) for b in band])
    first = np.cumsum(k) - k  # a sketch is a row of k segments; all rows in one array
    s = np.concatenate([sets[at] for at in owner])
    row = np.repeat(np.arange(len(owner)), [len(sets[at]) for at in owner])
    seg = (s >> U(32)) * k[row].astype(U) >> U(32)
    place = ((first[row].astype(U) + seg) << U(SEGMENT_BITS)) | (mix(s ^ U(0xD6E8FEB86659FD93)) >> U(64 - SEGMENT_BITS))
    place, times = np.unique(place, return_counts=True)
    place = place[times % 2 == 1]
    slot = (place >> U(SEGMENT_BITS)).astype(np.int64)
    total = int(k.sum())
    of = np.repeat(np.arange(len(owner)), k)
    number = np.arange(total) - first[of]
    bits = np.bincount(slot, minlength=total)
    keys = np.zeros(total, U)
    if len(slot):
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        own = place - (first[of[slot]].astype(U) << U(SEGMENT_BITS))  # the place in its own sketch
        keys[slot[starts]] = np.bitwise_xor.reduceat(mix(own + U(1)), starts)
    keys = mix(keys ^ mix(number.astype(U) + ((np.array(band, U) + U(1)) << U(40))[of]))
    order = np.lexsort((keys, -bits, of))
    chosen = order[number < np.array(count)[of]]  # rows stay in their places, so number is the rank as well
    return keys[chosen], np.array(owner)[of[chosen]]


def sketch(s: np.ndarray) -> bytes:
    """The folded parity sketch: 4 * 2**(band+1) bits, at least 64."""
    if not len(s):
        return b""
    width = max(64, 4 << len(s).bit_length())
    place, times = np.unique(s & U(width - 1), return_counts=True)
    bits = np.zeros(width, np.uint8)
    bits[place[times % 2 == 1].astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(b: bytes, size: int) -> np.ndarray:
    """A sketch folded by XOR to ``size`` bytes; still a parity sketch of the set."""
    a = np.frombuffer(b, np.uint8)
    while len(a) > size:
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return a


def may_link(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """False only for pairs that sizes or sketches prove less similar."""
    if not na or not nb or 100 * min(na, nb) < percent * max(na, nb):
        return False
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return apart <= most_apart(na + nb, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
