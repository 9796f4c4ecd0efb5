"""Words of whole batches of texts at once, on the UTF-8 bytes: their bounds, 64-bit hashes, hashes
of any run of words, and content-selected anchor positions (minimisers).

All of it is array arithmetic over a few megabytes of text at a time, whatever the length of the
single texts; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
LEFT, RIGHT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: For the words of up to so many bytes the hash is taken in steps of eight; longer ones go one by one.
STEPPED = 64
#: The first k bytes of eight.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def byte_class(separators: bytes) -> np.ndarray:
    """True for the bytes of words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


WORD_BYTES = byte_class(SPACE_BYTES)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def text_chunks(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], "int64" if wide else "int32")[column.offset : column.offset + n + 1].astype("int64")
    data = np.frombuffer(buffers[2], "uint8") if buffers[2] is not None else np.zeros(0, "uint8")
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a run of texts.

    ``start`` and ``end`` are byte positions; ``first[i] : first[i + 1]`` are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD_BYTES):
        self.data, self.offsets = data, offsets
        inside = classes[data]
        n = len(data)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < n]
        start[at] = inside[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        end[at] = inside[at]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the text that it stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def stops(self) -> np.ndarray:
        """For each word, the end of the words of its text."""
        return np.repeat(self.first[1:], self.counts())

    def hashes(self) -> np.ndarray:
        """A hash of each word, mixed after every eight bytes: no product or sum of parts, so that
        words built from the same parts don't meet by their structure."""
        size = self.end - self.start
        eight = np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(9, "uint8")), strides=(1,))
        out = mix((eight[self.start] & FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U) * LEFT)
        at, done = np.flatnonzero(size > 8), 8
        while len(at) and done < STEPPED:
            block = eight[self.start[at] + done] & FIRST_BYTES[np.minimum(size[at] - done, 8)]
            out[at] = mix(out[at] * RIGHT + block)
            done += 8
            at = at[size[at] > done]
        for i in at.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]])
        return out

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """A hash of all words of each text, from the words' hashes and places."""
        place = np.arange(self.n) - np.repeat(self.first[:-1], self.counts())
        total = np.append(U(0), np.cumsum(mix(hashes + mix(place.astype(U) + LEFT))))
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.counts().astype(U))

    def string(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


class Runs:
    """Hashes of any runs of words, from the hashes of the words: that of twice as many words is
    mixed from those of both halves, that of any other number from those of two runs that lap."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.doubled = [hashes]

    def _double(self, k: int) -> np.ndarray:
        """Of every run of 2**k words."""
        while len(self.doubled) <= k:
            h, step = self.doubled[-1], 1 << (len(self.doubled) - 1)
            self.doubled.append(mix(h[:-step] * LEFT + h[step:] * RIGHT) if len(h) > step else h[:0])
        return self.doubled[k]

    def all(self, length: int) -> np.ndarray:
        """Of every run of ``length`` words, whether or not within one text."""
        if self.n < length:
            return np.zeros(0, U)
        n, k = self.n - length + 1, length.bit_length() - 1
        h = self._double(k)
        return mix(h[:n] * LEFT + h[length - (1 << k) :][:n] * RIGHT + U(length))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs of one word or more from ``start`` to ``end``."""
        size = end - start
        out = np.zeros(len(size), U)
        power = np.frexp(size.astype("float64"))[1] - 1
        for k in np.unique(power).tolist():
            at = np.flatnonzero(power == k)
            h = self._double(k)
            out[at] = mix(h[start[at]] * LEFT + h[end[at] - (1 << k)] * RIGHT + size[at].astype(U))
        return out


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, "int64")
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        have += step
    return at


def anchors(words: Words, runs: Runs, seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions: those whose hash of ``seed`` words is the smallest of ``window`` neighbours.

    Every run of ``window + seed - 1`` words of one text has exactly one anchor, which depends on
    its words alone; so equal runs have it at the same place. Returns, for each anchor, its word
    position, its seed hash, and the first and last start of the runs that it stands for.
    """
    seeds = runs.all(seed)
    at = leftmost_minima(seeds, window)
    span = window + seed - 1
    if not len(at):
        z = np.zeros(0, "int64")
        return z, np.zeros(0, U), z, z
    starts = np.arange(len(at))
    inside = starts + span <= words.stops()[: len(at)]
    starts, at = starts[inside], at[inside]
    if not len(at):
        z = np.zeros(0, "int64")
        return z, np.zeros(0, U), z, z
    # the same position may serve two texts only at their border, where runs do not reach across
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    return at[lo], seeds[at[lo]], starts[lo], starts[hi]
