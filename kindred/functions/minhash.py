"""Min-hash signatures of character n-grams and the banding that fits a threshold, by their public definitions."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

PRIME, MAX_HASH = np.uint64((1 << 61) - 1), np.uint64((1 << 32) - 1)


@lru_cache(maxsize=8)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(1)
    pairs = [(r.randint(1, int(PRIME), dtype=np.uint64), r.randint(0, int(PRIME), dtype=np.uint64)) for _ in range(n)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


#: N-grams that are hashed at a time: enough to make calls cheap, few enough for the caches.
GRAMS = 16384


def _sha1(w: np.ndarray) -> np.ndarray:
    """The first word of SHA-1 of messages of one block each; w (16, n) has their words and is overwritten."""
    a, b, c, d, e = (np.full(w.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0))
    t, f = np.empty_like(a), np.empty_like(a)

    def turn(x, n, out):  # may be in place
        np.right_shift(x, np.uint32(32 - n), out=t)
        np.left_shift(x, np.uint32(n), out=out)
        np.bitwise_or(out, t, out=out)

    for i in range(80):
        x = w[i % 16]
        if i >= 16:
            x ^= w[(i - 3) % 16]
            x ^= w[(i - 8) % 16]
            x ^= w[(i - 14) % 16]
            turn(x, 1, x)
        if i < 20:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif 40 <= i < 60:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= np.bitwise_and(b, c, out=t)
        else:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        e += f
        e += x
        e += np.uint32((0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)[i // 20])
        turn(a, 5, f)
        e += f
        turn(b, 30, b)
        a, b, c, d, e = e, a, b, c, d
    return a + np.uint32(0x67452301)


def _hashes(raw: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first four bytes of SHA-1, read as a little-endian number, of the pieces of raw at offsets."""
    longest = int(lengths.max())
    if longest > 55:  # more than a block
        data = raw.tobytes()
        return np.array([int.from_bytes(hashlib.sha1(data[o : o + n]).digest()[:4], "little") for o, n in zip(offsets.tolist(), lengths.tolist())], np.uint64)
    block = np.zeros((len(offsets), 64), np.uint8)
    shortest = int(lengths.min())
    for k in range(longest):
        if k < shortest:
            block[:, k] = raw[offsets + k]
        else:
            rows = np.flatnonzero(lengths > k)
            block[rows, k] = raw[offsets[rows] + k]
    block[np.arange(len(offsets)), lengths] = 0x80
    block[:, 62], block[:, 63] = lengths * 8 >> 8, lengths * 8 & 255
    return _sha1(block.view(">u4").T.astype(np.uint32, order="C")).byteswap().astype(np.uint64)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each permutation (a * h + b, modulo 2^64, then PRIME and 2^32) over hashes."""
    a, b = (x[:, None] for x in permutations(n))
    out = np.full(n, MAX_HASH, np.uint64)
    for at in range(0, len(h), 256):
        y = h[None, at : at + 256] * a
        y += b
        z = y >> np.uint64(61)
        y &= PRIME
        y += z  # at most PRIME + 7
        np.subtract(y, PRIME, out=z)  # wraps to a large number below PRIME
        np.minimum(y, z, out=y)
        y &= MAX_HASH
        np.minimum(out, y.min(axis=1), out=out)
    return out


def signatures(texts: list[str], ngram: int, n: int) -> np.ndarray:
    """A row for each text: the minimum of each permutation over its n-grams; all maximal for a text without any."""
    out = np.full((len(texts), n), MAX_HASH, np.uint64)
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush():
        base = np.cumsum([0, *(len(raw) for _, raw, _, _ in held)])
        h = _hashes(np.concatenate([x[1] for x in held]), np.concatenate([x[2] + o for x, o in zip(held, base)]), np.concatenate([x[3] for x in held]))
        at = 0
        for i, _, own, _ in held:
            np.minimum(out[i], _least(h[at : at + len(own)], n), out=out[i])
            at += len(own)
        held.clear()

    for i, text in enumerate(texts):
        for low in range(0, len(text) - ngram + 1, GRAMS):  # whose n-grams start in this part
            raw = np.frombuffer(text[low : low + GRAMS + ngram - 1].encode("utf-8", "surrogatepass"), np.uint8)
            starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            held.append((i, raw, starts[:-ngram], starts[ngram:] - starts[:-ngram]))
            waiting += len(starts) - ngram
            if waiting >= GRAMS:
                flush()
                waiting = 0
    if held:
        flush()
    return out


def signature(text: str, ngram: int, n: int) -> np.ndarray:
    return signatures([text], ngram, n)[0]


@lru_cache(maxsize=64)
def bands(threshold: float, n: int) -> tuple[int, int]:
    """(bands, rows) with the least mean of the areas of false positives and false negatives."""
    step = 0.001
    low, high = np.arange(0.0, threshold, step) + step / 2, np.arange(threshold, 1.0, step) + step / 2
    best = (np.inf, 1, n)
    for b in range(1, n + 1):
        for r in range(1, n // b + 1):
            false = float((1 - (1 - low**r) ** b).sum() * step)
            missed = float(((1 - high**r) ** b).sum() * step)
            if 0.5 * false + 0.5 * missed < best[0]:
                best = (0.5 * false + 0.5 * missed, b, r)
    return best[1], best[2]
