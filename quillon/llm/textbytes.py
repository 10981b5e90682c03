"""Whole-batch text handling on Arrow buffers with NumPy.

Texts are never turned into Python strings here: a batch is one byte array with
offsets, and words are found and hashed for all its documents at once. Batches
are cut into pieces of bounded size, so memory doesn't grow with the partition;
a text longer than a piece is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
PIECE_BYTES = 1 << 20

_Q = 0xD6E8FEB86659FD93
#: Spans up to this many bytes are hashed and compared eight bytes at a time, all at once; longer ones one by one.
SHORT_SPAN = 64


def _table(word: str) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    if word == "space":  # words are [^\x20\x09-\x0D]+
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:  # words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        t[:128] = False
        t[ord("0") : ord("9") + 1] = t[ord("a") : ord("z") + 1] = True
    return t


SPACE_WORDS, ALNUM_WORDS = _table("space"), _table("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def release() -> None:
    """Give freed memory back to the system, so that idle workers hold little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def task_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, with memory given back before the first and after the last."""
    release()
    try:
        yield from batches
    finally:
        release()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (first, last + 1, bytes, offsets) of a batch's rows, each of at most `most` bytes or one row."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a piece: start and end byte of each, and each document's range of words (`at`)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = table[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        if len(data):
            edge[0], edge[-1] = inside[0], False
            np.logical_and(inside[1:], ~inside[:-1], out=edge[1:-1])
            firsts = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[1:] > offsets[:-1])]
            edge[firsts] = inside[firsts]
            self.starts = np.flatnonzero(edge[:-1])
            edge[-1] = inside[-1]
            edge[0] = False
            np.logical_and(~inside[1:], inside[:-1], out=edge[1:-1])
            lasts = offsets[1:][(offsets[1:] > offsets[:-1])]
            edge[lasts] = inside[lasts - 1]
            self.ends = np.flatnonzero(edge)
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes everywhere."""
        return span_hashes(self.data, self.starts, self.ends)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; the end is padded with zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The numbers at the places `at`, only their first `left` bytes where fewer than eight are left."""
    unused = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
    return lanes[at] << unused


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: eight bytes at a time are scrambled in; long ranges take XXH3."""
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * np.uint64(_Q) + np.uint64(1))
    if len(starts) == 0:
        return h
    lanes = _lanes(data)
    which = np.flatnonzero(lengths <= SHORT_SPAN) if int(lengths.max()) > SHORT_SPAN else np.arange(len(starts))
    step = 0
    while len(which):
        h[which] = mix(h[which] ^ _lane(lanes, starts[which] + step, lengths[which] - step))
        step += 8
        which = which[lengths[which] > step]
    long = np.flatnonzero(lengths > SHORT_SPAN)
    if len(long):
        from xxhash import xxh3_64_intdigest

        view = memoryview(np.ascontiguousarray(data))
        h[long] = mix(h[long] ^ np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64))
    return h


def same_spans(x: np.ndarray, x_starts: np.ndarray, y: np.ndarray, y_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether byte ranges of equal lengths in x and in y hold the same bytes, pair by pair."""
    same = np.ones(len(lengths), bool)
    if not len(lengths):
        return same
    x_lanes, y_lanes = _lanes(x), _lanes(y)
    which, step = np.flatnonzero((lengths > 0) & (lengths <= SHORT_SPAN)), 0
    while len(which):
        left = lengths[which] - step
        equal = _lane(x_lanes, x_starts[which] + step, left) == _lane(y_lanes, y_starts[which] + step, left)
        same[which[~equal]] = False
        step += 8
        which = which[equal & (left > 8)]
    for i in np.flatnonzero(lengths > SHORT_SPAN).tolist():
        n = int(lengths[i])
        same[i] = np.array_equal(x[x_starts[i] : x_starts[i] + n], y[y_starts[i] : y_starts[i] + n])
    return same


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word, the same for two words of the piece if and only if their bytes are the same."""
    h = w.hashes()
    order = np.argsort(h, kind="stable")
    size = w.ends - w.starts
    alike = h[order][1:] == h[order][:-1]
    a, b = order[1:][alike], order[:-1][alike]
    if not np.all(size[a] == size[b]) or not np.all(same_spans(w.data, w.starts[a], w.data, w.starts[b], size[a])):
        raw, known = w.data.tobytes(), {}  # unequal words of equal hash: tell them apart by their bytes
        return np.array([known.setdefault(raw[i:j], len(known)) for i, j in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], np.int64)
    numbers = np.empty(len(h), np.int64)
    numbers[order] = np.cumsum(np.concatenate([np.zeros(min(len(h), 1), np.int64), ~alike]))
    return numbers


def repeated_windows(numbers: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first words of the runs of k words that stand twice or more in their document; words are compared, not hashes."""
    where, h = windows(mix(numbers.astype(np.uint64)), at, k)
    doc = np.searchsorted(at, where, "right") - 1
    h = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    alike = h[order][1:] == h[order][:-1]
    a, b = where[order[1:][alike]], where[order[:-1][alike]]
    true = doc[order[1:][alike]] == doc[order[:-1][alike]]
    for j in range(k):
        true &= numbers[a + j] == numbers[b + j]
    if not true.all():  # unequal runs of equal hash: sort by the words themselves
        columns = [doc, *(numbers[where + j] for j in range(k))]
        order = np.lexsort(columns)
        alike = np.ones(max(len(order) - 1, 0), bool)
        for c in columns:
            alike &= c[order][1:] == c[order][:-1]
    twice = np.zeros(len(where), bool)
    twice[order[1:][alike]] = twice[order[:-1][alike]] = True
    return where[twice]


def windows(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every run of k words that lies within one document."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        h *= np.uint64(_Q)
        h += hashes[j : n - k + 1 + j]
    keep = np.ones(n - k + 1, dtype=bool)
    for j in range(1, k):  # the last k - 1 words of a document start no window
        x = at[1:] - j
        keep[x[(x >= at[:-1]) & (x < len(keep))]] = False
    where = np.flatnonzero(keep)
    return where, mix(h[where])


def covered(n: int, where: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in the windows of k words that start at `where`."""
    step = np.zeros(n + 1, dtype=np.int32)
    step[where] += 1
    step[np.minimum(where + k, n)] -= 1
    return np.cumsum(step)[:n] > 0
