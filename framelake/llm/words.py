"""Words of whole Arrow batches of texts at once, as NumPy arrays.

Texts stay UTF-8 bytes; a word is a run of bytes other than ASCII white space. Hashes of
words and lines are 64-bit: each eight bytes are mixed with their place by a function that
is not linear in them, and the sum of these is mixed with the length. A seed gives an
independent function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Batches are cut at about this many bytes; a longer text is a batch of its own.
PART_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Part:
    data: np.ndarray
    offsets: np.ndarray


def encode(texts: pa.Array) -> Iterator[tuple[Part, slice]]:
    """Parts of a string column as bytes and offsets, nulls as empty, with the rows they hold."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        yield Part(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]), slice(at, to)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a part: the byte spans, and the number of the text of each."""

    data: np.ndarray
    offsets: np.ndarray
    space: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    eight: np.ndarray
    seed: np.uint64

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, of any length."""
        n = ends - starts
        out = mix64((self.eight[starts] & _FIRST[np.minimum(n, 8)]) ^ self.seed)
        rest = np.flatnonzero(n > 8)
        if len(rest):
            more = (n[rest] - 1) // 8
            first = np.cumsum(more) - more
            span = np.repeat(rest, more)
            place = np.arange(len(span)) - np.repeat(first, more) + 1
            some = self.eight[starts[span] + 8 * place] & _FIRST[np.minimum(n[span] - 8 * place, 8)]
            out[rest] += np.add.reduceat(mix64(some ^ mix64(place.astype(np.uint64) * _STEP ^ self.seed)), first)
        return mix64(out + n.astype(np.uint64) * _STEP)

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``k`` words inside one text, and the index of its first word."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, first = self.hashes(), np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        out = h[first]
        for j in range(1, k):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[first + j])
        return out, first


def words_of(part: Part, lower: bool = False, seed: int = 0) -> Words:
    data, offsets = part.data, part.offsets
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = _SPACE[data]
    # a text's first byte starts a word unless it is white space, whatever stands before it
    edge = np.ones(n + 1, bool)
    edge[1:n] = space[:-1] if n else space
    edge[offsets] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    after = np.ones(n, bool)
    if n:
        after[:-1] = space[1:]
        cut = offsets[(offsets > 0) & (offsets < n)] - 1
        after[cut] = True
    ends = np.flatnonzero(after & ~space) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # eight bytes from any place on; past the end they are zero
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    return Words(data, offsets, space, starts, ends, doc, eight, mix64(np.uint64(seed) * _STEP))
