"""Vectorised hashing of byte strings: gear rolling hash, substring hashes by prefix sums, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import ASCII_SPACE, mix64

#: Base of the polynomial substring hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes hashed at once; tables of powers have this length.
BLOCK = 1 << 19


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to BLOCK + 4096."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        table = np.ones(BLOCK + 4097, np.uint64)
        table[1:] = np.uint64(base)
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


class Prefix:
    """Hashes of any substrings of a block of bytes; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    """256 pseudo-random values from the mixer; byte 0 has 0, so zero padding leaves no trace."""
    table = (mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    table[0] = 0
    return table


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: sum of table[byte j back] << j over the last 32 bytes, by doubling."""
    h = gear_table()[data]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


@lru_cache(maxsize=1)
def _lower_and_space() -> tuple[np.ndarray, np.ndarray]:
    lower, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    space[list(ASCII_SPACE)] = True
    return lower, space


def _words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of the bytes, A-Z lower-cased."""
    lower, space = _lower_and_space()
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[data]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return start, Prefix(lower[data]).of(start, end)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The bytes in blocks that end between words; a longer word is replaced by a digest of itself."""
    import xxhash

    _, space = _lower_and_space()
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            gaps = np.flatnonzero(space[np.frombuffer(raw, np.uint8, end - at, at)])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                tail = np.frombuffer(raw, np.uint8, len(raw) - at, at)
                stop, h = len(raw), xxhash.xxh3_128()
                for s in range(0, len(tail), BLOCK):
                    part = tail[s : s + BLOCK]
                    hit = np.flatnonzero(space[part])
                    if len(hit):
                        stop = at + s + int(hit[0])
                        h.update(raw[at + s : stop].lower())
                        break
                    h.update(part.tobytes().lower())
                yield b"\xff" + h.hexdigest().encode()
                at = stop
                continue
        yield raw[at:end]
        at = end


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each text, in order; small texts are hashed together."""
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0

    def flush():
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        at, h = _words_of(np.frombuffer(b" ".join(parts), np.uint8))
        cuts = np.searchsorted(at, starts)
        for i, row in enumerate(rows):
            yield row, h[cuts[i] : cuts[i + 1]]

    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if rows and held + len(raw) + 1 > BLOCK:
            yield from flush()
            rows, parts, held = [], [], 0
        if len(raw) >= BLOCK:
            yield row, np.concatenate([_words_of(np.frombuffer(p, np.uint8))[1] for p in _pieces(raw)])
            continue
        rows.append(row)
        parts.append(raw)
        held += len(raw) + 1
    if rows:
        yield from flush()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of the whole sequence if it is shorter; none if empty."""
    n = min(width, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - n + 1 + i])
    return np.unique(h)
