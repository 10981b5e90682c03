"""Sequence packing by power-of-two decomposition.

A document's token ids, with an end id, are cut into pieces whose lengths are
powers of two: as many of the full length as fit, then the binary digits of the
rest, largest first. Every piece is a sequence of its own, so none crosses
documents and, its length being a power of two, none is padded. Sequences of
equal length form batches (`bucket`, `batch_id`). Everything is decided row by
row, without a shuffle.

Tokens: where a vocabulary's own rules are those of `CHUNKED`, it never joins
characters across ASCII white space, so a text's ids are those of its
white-space-separated chunks, in order. Chunks of up to 64 bytes are kept with
their ids in a table of the Python worker (emptied when it reaches
`cache_chunks`); each hit is compared byte by byte, so the ids are always the
tokenizer's. Longer chunks are tokenized where they stand. With any other
vocabulary whole texts are given to the tokenizer.

Names of special tokens in a text become those tokens, as the library does by default.

Cases: a null or empty text is the end id alone; repeated rows are packed each
for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import small_batches
from .textbytes import LOWER, SHORT_SPAN, SPACE_WORDS, Words, pieces, same_spans, span_hashes, task_batches

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "bucket int, batch_id long"
)


def decompose(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then falling powers of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


# The normalizer and pre-tokenizer for which chunks and `plainer` are proved to keep the ids.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("A") : ord("Z") + 1] = _ASCII_LETTER[ord("a") : ord("z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def plainer(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    """The piece's chunks, so spelt that fewer are distinct but the ids of a `CHUNKED` vocabulary stay the same.

    Such a vocabulary lower-cases and parts letters from marks itself, so A-Z may be
    lowered here (unless a non-ASCII character follows, which may combine with it)
    and a space may stand between a letter and a mark. Documents are parted by spaces.
    """
    follow = np.append(data[1:], np.uint8(0))
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    two_before = np.concatenate([np.zeros(1, np.uint8), before[:-1]])
    letter = _ASCII_LETTER[before] | ((two_before == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    insert = _STOP[data] & letter
    if b"<|" in data.tobytes():  # names of special tokens are matched as they stand
        lowered, insert = data, np.zeros(len(data), bool)
    else:
        lowered = np.where(follow < 0x80, LOWER[data], data)
    begins = offsets[1:-1][offsets[1:-1] < len(data)]
    insert[begins] = True
    at = np.flatnonzero(insert)
    own = np.ones(len(data) + len(at), bool)
    own[at + np.arange(len(at))] = False
    out = np.full(len(own), 0x20, np.uint8)
    out[own] = lowered
    return out, Words(out, offsets + np.searchsorted(at, offsets), SPACE_WORDS)


def chunked(tokenizer) -> bool:
    """Whether a tokenizer's rules are those of `CHUNKED`, with special names that hold no white space and begin with `<|`."""
    own = json.loads(tokenizer.to_str())
    plain = all(a["content"].startswith("<|") and not any(map(str.isspace, a["content"])) and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in own["added_tokens"])
    return plain and own["model"].get("type") == "BPE" and not own["model"].get("dropout") and own["post_processor"] is None and all(own[k] == v for k, v in CHUNKED.items())


class TextTokenizer:
    """Token ids of whole texts, for any vocabulary."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a piece, ids per document)."""
        raw, at = data.tobytes(), offsets.tolist()
        ids = [self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)


class ChunkTokenizer:
    """Token ids of texts by way of a table of the short chunks met so far, for `CHUNKED` vocabularies.

    The table is an open-addressed array of 64-bit chunk hashes with the chunks' bytes beside it, so a
    whole piece is looked up and compared at once and the table has no Python objects.
    """

    def __init__(self, tokenizer, cache_chunks: int):
        self.tokenizer, self.most = tokenizer, cache_chunks
        self.slots = 1 << (2 * cache_chunks - 1).bit_length()
        self._empty()

    def _empty(self) -> None:
        self.keys, self.values = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint16 if narrow else np.uint32), np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.int32)
        self.text, self.text_starts, self.text_sizes = np.zeros(1 << 17, np.uint8), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.known = self.text_used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of the chunk of each hash, -1 if there is none."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        found = self.values[slot]
        again = np.flatnonzero((found >= 0) & (self.keys[slot] != h))
        while len(again):
            slot[again] = (slot[again] + 1) & (self.slots - 1)
            s = slot[again]
            found[again] = self.values[s]
            again = again[(found[again] >= 0) & (self.keys[s] != h[again])]
        return found

    def _add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes from self.known on."""
        number = np.arange(self.known, self.known + len(h), dtype=np.int32)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = h[put], number[put]
            rest = np.ones(len(h), bool)
            rest[put] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)
        self.known += len(h)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array from a place on, which grows as needed."""
        x = getattr(self, name)
        if len(x) < at + len(values):
            x = np.concatenate([x, np.zeros(max(at + len(values) - len(x), len(x)), x.dtype)])
            setattr(self, name, x)
        x[at : at + len(values)] = values

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for lo in range(0, len(chunks), 8192) for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in chunks[lo : lo + 8192]], add_special_tokens=False)]

    def _learn(self, h: np.ndarray, chunks: list[bytes]) -> None:
        """Take chunks of distinct hashes into the table."""
        ids = self._encode(chunks)
        lengths, sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, chunks))
        self._put("flat", self.used, np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(lengths.sum())))
        self._put("starts", self.known, self.used + np.cumsum(lengths) - lengths)
        self._put("lengths", self.known, lengths)
        self._put("text", self.text_used, np.frombuffer(b"".join(chunks), np.uint8))
        self._put("text_starts", self.known, self.text_used + np.cumsum(sizes) - sizes)
        self._put("text_sizes", self.known, sizes)
        self.used += int(lengths.sum())
        self.text_used += int(sizes.sum())
        self._add(h)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a piece, ids per document)."""
        text, w = plainer(data, offsets)
        sizes, raw = w.ends - w.starts, text.tobytes()
        short = np.flatnonzero(sizes <= SHORT_SPAN)
        h = span_hashes(text, w.starts[short], w.ends[short])
        which = np.full(len(w), -1, np.int64)
        found = self._find(h)
        if len(unknown := np.flatnonzero(found < 0)):
            new, first = np.unique(h[unknown], return_index=True)
            if self.known + len(new) > self.most:
                self.slots = max(self.slots, 1 << (2 * len(h)).bit_length())
                self._empty()
                unknown = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
            at = short[unknown[first]]
            self._learn(new, [raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            found[unknown] = self._find(h[unknown])
        sure = self.text_sizes[found] == sizes[short]
        sure[sure] = same_spans(text, w.starts[short[sure]], self.text, self.text_starts[found[sure]], sizes[short[sure]])
        which[short[sure]] = found[sure]
        lengths = np.where(which >= 0, self.lengths[which], 0).astype(np.int64)
        other = np.flatnonzero(which < 0)  # long chunks, and those whose hash another chunk has
        own = [raw[a:b] for a, b in zip(w.starts[other].tolist(), w.ends[other].tolist(), strict=True)]
        distinct = list(dict.fromkeys(own))
        ids = dict(zip(distinct, self._encode(distinct), strict=True))
        lengths[other] = [len(ids[x]) for x in own]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        known = np.flatnonzero(which >= 0)
        n = lengths[known]
        rest = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        values = self.flat[rest + np.repeat(self.starts[which[known]].astype(np.int64), n)]
        if not len(other):
            return values, np.diff(ends[w.at])
        flat = np.empty(ends[-1], self.flat.dtype)
        flat[rest + np.repeat(ends[known], n)] = values
        for i, x in zip(other.tolist(), own, strict=True):
            flat[ends[i] : ends[i + 1]] = ids[x]
        return flat, np.diff(ends[w.at])


#: One tokenizer with its table for each path in a Python worker, kept from task to task.
_TOKENIZERS: dict[tuple[str, int], ChunkTokenizer | TextTokenizer] = {}


def tokenizer(path: str, cache_chunks: int) -> ChunkTokenizer | TextTokenizer:
    key = (path, cache_chunks)
    if key not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
        from tokenizers import Tokenizer

        _TOKENIZERS.clear()
        own = Tokenizer.from_file(path)
        _TOKENIZERS[key] = ChunkTokenizer(own, cache_chunks) if chunked(own) else TextTokenizer(own)
    return _TOKENIZERS[key]


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4096,
    end_id: int = 2, batch_tokens: int = 1 << 20, cache_chunks: int = 1_000_000, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: its place in the document, its sequence and its batch; with keep_ids, the ids too."""
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path, cache_chunks)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        seen = [0] * most.bit_length()
        first = sequence
        for batch in task_batches(batches):
            keys = batch.column(0)
            for i, j, data, offsets in pieces(batch.column(1)):
                flat, sizes = encode(data, offsets)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                rows, per_doc, kept = [], [], []
                for d in range(j - i):
                    ids = np.append(flat[bounds[d] : bounds[d + 1]].astype("<u4"), np.uint32(end_id)).astype("<u4")
                    cuts = decompose(len(ids), most)
                    view, start = memoryview(ids).cast("B"), 0
                    for n in cuts:
                        b = n.bit_length() - 1
                        rows.append((start, n, zlib.crc32(view[4 * start : 4 * (start + n)]), len(ids), sequence, 0, b, first + (b << 30) + seen[b] * n // batch_tokens))
                        if keep_ids:
                            kept.append(ids[start : start + n].astype(np.int32))
                        start, sequence, seen[b] = start + n, sequence + 1, seen[b] + 1
                    per_doc.append(len(cuts))
                x = np.array(rows, dtype=np.int64).reshape(-1, 8)
                columns = [keys.slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), per_doc)))]
                columns += [pa.array(x[:, c].astype(np.int32) if c == 6 else x[:, c]) for c in range(8)]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
