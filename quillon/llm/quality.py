"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and repeated 8-word windows of a
whole text. The method's verdict comes from zstandard: the ratio of compressed to
raw bytes of the whole text, and of each fixed chunk of it, must lie in a band
that depends on the length, as short texts compress less. A text far below its
band is repetitive, one above it is noise (random characters, encoded data).
The last chunk is judged by its own length; one too short for a band is judged
together with the chunk before it. Texts of mostly three-byte characters (CJK)
compress less than others of their length and have bands of their own.

Cases: a null or empty text has no words and fails the base rule; texts shorter
than the shortest band are judged by the base rules alone; repeated rows are
judged each for itself; an empty table gives an empty result; other columns are
ignored. All is row by row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches
from .textbytes import SPACE_WORDS, Words, covered, pieces, repeated_windows, task_batches, word_numbers

#: (from so many bytes, least ratio, greatest ratio). The greatest lie just above prose and below random letters and digits.
BANDS = (
    (256, 0.36, 0.84), (384, 0.36, 0.80), (512, 0.36, 0.76), (768, 0.36, 0.72), (1024, 0.28, 0.68), (1536, 0.28, 0.64),
    (2048, 0.28, 0.61), (3072, 0.28, 0.58), (4096, 0.20, 0.56), (16384, 0.15, 0.50), (65536, 0.12, 0.46),
)
#: The same where three-byte characters hold at least half of the bytes.
WIDE_BANDS = ((256, 0.36, 1.05), (512, 0.36, 0.94), (1024, 0.28, 0.84), (2048, 0.28, 0.76), (4096, 0.20, 0.70), (16384, 0.15, 0.68), (65536, 0.12, 0.66))
#: Chunk length in bytes, and the share of a text's bytes that may stand in chunks outside their bands.
CHUNK, CHUNK_SHARE = 4096, 0.05
WIDE = bytes(range(0xE0, 0xF0))
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunks_out double"
)


def band(raw: bytes) -> tuple[float, float]:
    """The limits of the compression ratio of a text; (0, inf) if it is too short to tell."""
    found = (0.0, float("inf"))
    wide = 6 * (len(raw) - len(raw.translate(None, WIDE))) >= len(raw)
    for least, low, high in WIDE_BANDS if wide else BANDS:
        if len(raw) >= least:
            found = (low, high)
    return found


def chunks(raw: bytes) -> list[bytes]:
    """The text in chunks of CHUNK bytes; the rest is the last, or part of it if no band is so short."""
    ends = list(range(CHUNK, len(raw) + 1, CHUNK))
    if not ends or len(raw) - ends[-1] >= BANDS[0][0]:
        ends.append(len(raw))
    ends[-1] = len(raw)
    return [raw[i:j] for i, j in zip([0, *ends], ends)]


def compression(raw: bytes, compressor) -> tuple[float | None, float]:
    """(ratio of the whole text, share of its bytes in chunks outside their bands)."""
    if not raw:
        return None, 0.0
    whole = len(compressor.compress(raw)) / len(raw)
    out = 0
    for part in chunks(raw):
        low, high = band(part)
        ratio = whole if len(part) == len(raw) else len(compressor.compress(part)) / len(part)
        out += 0 if low <= ratio <= high else len(part)
    return whole, out / len(raw)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: int = 3, k: int = 8) -> DataFrame:
    """Counts, the base verdict and the verdict with compression bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(1)):
                n = j - i
                w = Words(data, offsets, SPACE_WORDS)
                sums = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & SPACE_WORDS[data])])
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
                repeated = np.concatenate([[0], np.cumsum(covered(len(w), repeated_windows(word_numbers(w), w.at, k), k))])
                n_words, n_repeat = w.counts, repeated[w.at[1:]] - repeated[w.at[:-1]]
                raw = data.tobytes()
                parts = [raw[offsets[d] : offsets[d + 1]] for d in range(n)]
                zipped = [compression(x, compressor) for x in parts]
                base = (n_words < 20) | (100 * n_repeat > 30 * n_words)
                fits = np.array([r is None or (lambda b: b[0] <= r <= b[1])(band(x)) and out <= CHUNK_SHARE for x, (r, out) in zip(parts, zipped, strict=True)], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), pa.array(n_words.astype(np.int64)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]),
                        pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]]), pa.array([duplicate_lines(x) for x in parts], pa.int64()),
                        pa.array(n_repeat.astype(np.int64)), pa.array(base), pa.array(~base & fits),
                        pa.array([r for r, _ in zipped], pa.float64()), pa.array([x for _, x in zipped], pa.float64()),
                    ],
                    [f.split()[0] for f in SCHEMA.split(", ")],
                )

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
