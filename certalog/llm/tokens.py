"""Hashes of words and of token n-grams, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text hashed together; the arrays at work stay in cache.
CHUNK = 1 << 19
#: Bytes of spans that a polynomial hashes.
SHORT = 64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and bytes of other scripts, 2 the rest.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    low = np.full(1024, base, dtype=np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full(n // 1024 + 1, pow(base, 1024, 1 << 64), dtype=np.uint64)
    high[0] = 1
    return np.multiply.outer(np.multiply.accumulate(high), low).ravel()[:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end] (uint8).

    Short spans by a polynomial, all at once. Modulo 2 ** 64 there are long texts that collide under any base, so longer ones have their XXH3.
    """
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * powers(BASE, len(buf)), out=total[1:])
    out = mix((total[end] - total[start]) * powers(INVERSE, len(buf) + 1)[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]])
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of about CHUNK bytes; null: empty."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        b = (t.as_py() or "").encode()
        if held and size + len(b) > CHUNK:
            yield first, held
            held, size, first = [], 0, k
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space after each, and where each begins."""
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8), starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word [^\\x20\\x09-\\x0D]+ of all texts in order, index of its text)."""
    buf, starts = joined(texts)
    space = _SPACE[buf]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return span_hashes(buf, begin, end), np.searchsorted(starts, begin, "right") - 1


def indicators(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, sorted: the token unigrams and bigrams that a text has, hashed to bits bits.

    Tokens are runs of letters and digits (ASCII in lower case) or of other signs. A token next to itself also gives one
    feature for the power of two of how often that happens in the text.
    """
    buf, starts = joined(texts)
    buf = _LOWER[buf]
    kind = _CLASS[buf]
    cut = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    ends = np.r_[cut[1:], len(buf)]
    own = kind[cut] > 0
    begin, end = cut[own], ends[own]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hashes(buf, begin, end)
    doc = np.searchsorted(starts, begin, "right") - 1
    same = doc[1:] == doc[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    again = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=len(texts))
    rep = np.flatnonzero(again)
    level = mix((np.log2(again[rep]).astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    docs = np.concatenate([doc, doc[1:][same], rep]).astype(np.uint64)
    hashed = np.concatenate([h, pair, level]) >> np.uint64(64 - bits)
    both = np.unique(docs << np.uint64(bits) | hashed).astype(np.int64)
    return both >> bits, both & ((1 << bits) - 1)
