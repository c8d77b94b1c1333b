"""Byte-level text primitives on numpy: word spans, word hashes, shingles, rolling hashes.

All of them work on one uint8 buffer that holds many texts, so the cost per byte is
a few vector operations and no Python loop runs over words. A text much longer than a buffer is
worked through in slices, so beside the text itself its words' hashes are the largest thing held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial hash, its inverse modulo 2**64, and mixing constants.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Characters of a text that are worked on at a time.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = powers(BASE, 1 << 10)
        self.down = powers(BASE_INV, 1 << 10)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(BASE, size), powers(BASE_INV, size)
        return self.up, self.down


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray, pw: Powers) -> np.ndarray:
    """c[i] = sum of (buf[j]+1) * BASE**j over j < i, modulo 2**64."""
    up, _ = pw.of(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def chunks(texts: list, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(texts):
        yield start, len(texts)


def join_utf8(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each text, and the texts' start offsets (one more
    than there are texts)."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), offsets


def word_hashes(buf: np.ndarray, offsets: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of the buffer, and the first word's index of each text
    (one more than there are texts)."""
    space = _SPACE[buf]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    c = prefix_hash(_LOWER[buf], pw)
    _, down = pw.of(len(buf) + 1)
    words = mix64((c[ends] - c[starts]) * down[starts])
    return words, np.searchsorted(starts, offsets)


def long_word_hashes(text: str, pw: Powers, slice_chars: int = SLICE) -> np.ndarray:
    """``word_hashes`` of one text of any length, slice by slice; a word that a slice cuts is
    carried on into the next."""
    out, open_hash, open_bytes = [np.zeros(0, np.uint64)], np.zeros(1, np.uint64), 0
    for a in range(0, len(text), slice_chars):
        buf = np.frombuffer(text[a : a + slice_chars].encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.diff(_SPACE[buf].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        c = prefix_hash(_LOWER[buf], pw)
        sums = (c[ends] - c[starts]) * pw.of(len(buf) + 1)[1][starts]
        sizes = ends - starts
        if open_bytes and _SPACE[buf[0]]:
            out.append(mix64(open_hash))
        elif open_bytes:
            sums[:1] = sums[:1] * np.uint64(pow(BASE, open_bytes, 1 << 64)) + open_hash
            sizes[0] += open_bytes
        open_bytes = 0
        if not _SPACE[buf[-1]]:
            open_hash, open_bytes, sums = sums[-1:], int(sizes[-1]), sums[:-1]
        out.append(mix64(sums))
    return np.concatenate([*out, mix64(open_hash)] if open_bytes else out)


def shingles(texts: list, size: int, pw: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct ``size``-word shingle hashes of each text; a shorter text has one
    shingle, its whole word sequence; a text without words has none."""
    for lo, hi in chunks(texts):
        if hi - lo == 1 and len(texts[lo] or "") > SLICE:
            words = long_word_hashes(texts[lo], pw)
            first = np.array([0, len(words)])
        else:
            words, first = word_hashes(*join_utf8(texts[lo:hi]), pw)
        up, _ = pw.of(size + 2)
        run = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            run += words[j : len(words) - size + 1 + j] * up[j + 1] if len(run) else run
        run = mix64(run)
        for a, b in zip(first[:-1], first[1:]):
            n = int(b - a)
            if n >= size:
                yield np.unique(run[a : b - size + 1])
            elif n:
                yield mix64((words[a:b] * up[1 : n + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
