"""Word shingles of many texts at once, as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD: np.ndarray | None = None


def _word_table() -> np.ndarray:
    global _WORD
    if _WORD is None:
        _WORD = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _WORD


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of letters and digits of the texts in lower case."""
    return word_spans(texts)[:2]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every run of letters and digits; offsets are into the text in lower case."""
    joined = "\0".join(t.lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.r_[False, _word_table()[codes], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power = np.full(len(codes), _BASE)
    if len(power):
        power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.r_[np.uint64(0), np.cumsum((codes + np.uint32(1)).astype(np.uint64) * power)]
    back = np.full(len(codes) + 1, _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    breaks = np.cumsum([len(t.lower()) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(breaks, start, side="right")
    first = np.r_[0, breaks][doc] if len(doc) else doc
    return hashes, doc, start - first, end - first


def shingle_sets(texts: list[str], size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct `size`-word runs of text i are hashes[offsets[i]:offsets[i+1]], sorted.

    A text of fewer words has one shingle, all its words; a text without a word none.
    """
    n = len(texts)
    word, doc = words(texts)
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    value = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        value = mix(value + word[k : len(word) - size + 1 + k] + np.uint64(k + 1)) if len(value) else value
    whole = doc[: len(value)] == doc[size - 1 :] if len(value) else np.zeros(0, bool)
    value, owner = value[whole], doc[: len(value)][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.empty(len(short), np.uint64)
        for i, (f, c) in enumerate(zip(first, count[short], strict=True)):
            h = np.uint64(c)
            for x in word[f : f + c]:
                h = mix(np.array([h + x], np.uint64))[0]
            extra[i] = h
        value, owner = np.r_[value, extra], np.r_[owner, short]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    value, owner = value[keep], owner[keep]
    return value, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int64)


def set_hashes(value: np.ndarray, offsets: np.ndarray, texts: list[str]) -> np.ndarray:
    """One 64-bit number per set (equal sets have equal numbers); wordless texts by their characters."""
    import xxhash

    sums = np.r_[np.uint64(0), np.cumsum(mix(value))]
    out = mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).astype(np.int64)
    for i in np.flatnonzero(np.diff(offsets) == 0):
        out[i] = np.uint64(xxhash.xxh64_intdigest(texts[i])).astype(np.int64)
    return out


def sketches(value: np.ndarray, offsets: np.ndarray, bins: int = 32, bits: int = 4) -> np.ndarray:
    """One-permutation min-hash of each set: `bins` minima of `bits` bits, packed in 64-bit columns."""
    n = len(offsets) - 1
    h = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    cell = np.repeat(np.arange(n), np.diff(offsets)) * bins + (h >> np.uint64(59)).astype(np.int64) % bins
    np.minimum.at(least, cell, (h << np.uint64(5)) >> np.uint64(5))
    small = (mix(least) & np.uint64((1 << bits) - 1)).reshape(n, bins)
    per = 64 // bits
    out = np.zeros((n, bins // per), np.uint64)
    for k in range(bins):
        out[:, k // per] |= small[:, k] << np.uint64(bits * (k % per))
    return out.astype(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray, bits: int = 4) -> np.ndarray:
    """In how many bins two packed sketches (..., columns) agree."""
    x = a.astype(np.uint64) ^ b.astype(np.uint64)
    step = bits // 2
    while step:
        x |= x >> np.uint64(step)
        step //= 2
    ones = int("1".rjust(bits, "0") * (64 // bits), 2)
    return (64 // bits) * a.shape[-1] - np.bitwise_count(x & np.uint64(ones)).sum(-1).astype(np.int64)
