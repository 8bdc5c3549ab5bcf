"""Words of many texts as arrays of 64-bit names, and names of word sequences."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import xxhash

#: Odd multipliers of the mixes and of the polynomial sums.
ONE, TWO = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

#: Bytes up to which a word is named without XXH64; bytes that part words; masks of the lowest bytes of eight.
SHORT = 32
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""

    def run(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(int(base), 1 << max(16, int(n).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def named(texts: Sequence[bytes | None], seed: int, name: Callable[[bytes, int], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words in order, and each text's first word (one more entry at the end).

    `name` gives a word's name for a seed; without it, all words are named at once.
    """
    if name is None:
        return _named(texts, seed)
    parts, bounds = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.split() if text else ()
        parts.append(np.fromiter(map(name, words, repeat(seed)), dtype=np.uint64, count=len(words)))
        bounds[i + 1] = bounds[i] + len(words)
    return np.concatenate([np.zeros(0, dtype=np.uint64), *parts]), bounds


def _named(texts: Sequence[bytes | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to `SHORT` bytes are mixed eight bytes at a time, in which no two of one length and up to eight bytes share a name; XXH64 names longer ones."""
    joined = b"\n".join([b"", *(t or b"" for t in texts), bytes(8)])
    data = np.frombuffer(joined, dtype=np.uint8)[:-8]
    edges = np.flatnonzero(BLANK[data[1:]] != BLANK[data[:-1]]) + 1  # texts lie between blanks, so edges start and end words in turn
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    first = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    bounds = np.searchsorted(starts, np.concatenate(([0], first)))
    eights = np.ndarray(len(data), dtype="<u8", buffer=joined, strides=(1,))
    own = np.arange(SHORT + 1, dtype=np.uint64) * TWO + mix(np.full(1, seed, dtype=np.uint64) + TWO)
    names = mix((own[np.minimum(lengths, SHORT)] + (eights[starts] & LOWEST[np.minimum(lengths, 8)])) * ONE)
    for k in range(8, SHORT, 8):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        names[more] = mix((names[more] + (eights[starts[more] + k] & LOWEST[np.minimum(lengths[more] - k, 8)])) * ONE)
    for k in np.flatnonzero(lengths > SHORT).tolist():
        names[k] = xxhash.xxh64_intdigest(joined[starts[k] : starts[k] + lengths[k]], seed)
    return names, bounds


def sums(names: np.ndarray, base: np.uint64) -> np.ndarray:
    up, _ = powers(base, len(names) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(names * up[: len(names)], dtype=np.uint64)))


def summed(sums_: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the word sequences from starts to ends by prefix sums.  Long sequences of few words can
    share such a name; it tells where symbols begin and end, never that words are equal."""
    _, down = powers(base, len(sums_))
    return mix((sums_[ends] - sums_[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chained(names: np.ndarray, starts: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Names of the sequences of `length` words from starts, mixed word by word."""
    out = np.full(len(starts), base, dtype=np.uint64)
    for k in range(length):
        out = mix((out + names[starts + k]) * base)
    return out


def digest(names: np.ndarray) -> tuple[int, int]:
    """XXH3 (128 bits) of a sequence of names, as two signed numbers."""
    both = np.frombuffer(xxhash.xxh3_128_digest(names.tobytes()), dtype=np.int64)
    return int(both[0]), int(both[1])


def proof(words: Sequence[bytes]) -> bytes:
    """SHA-256 of words joined by spaces, which none of them holds."""
    return hashlib.sha256(b" ".join(words)).digest()
