"""Substring dedup over a De Bruijn graph of token k-mers.

Every run of k words is an edge between its first and its last k - 1 words. An
edge is repeated if its words also start in a document with a smaller id; that
place is its source. Edges meet by hash range; consecutive repeated edges of a
document whose sources are consecutive too form a nonbranching path, and the
words of a path are removed once its words and its source's words are found equal.

Steps. (1) Each task cuts its documents into lots of bounded size, and reduces
each lot first: of the documents in a lot that share an edge, only the smallest
id goes on, the others have their source in the lot. So an edge in a third of all
documents travels once per lot. (2) Edges travel packed, sorted and delta-coded,
to hash ranges of about `edges_per_bucket`; the smallest id of each edge is found
there, and repeated edges go back to their lots with their sources' coordinates.
(3) A lot's repeated edges are compacted to paths, those of a document with one
source packed together. (4) They join their source documents, which give a
128-bit digest of the words at each path. A source of a third of all paths is a
skewed join key, which adaptive execution splits; nothing is gathered by source.
(5) They join their own documents: where a path's words there have the same digest,
the words go. Both joins use one shuffle of the compressed texts.

Edges meet by 64-bit hashes. Unequal edges that collide (about n*n / 2**65 pairs
among n edges; 0.0005 at 1.4e8) fail the comparison of words, so a collision can
leave a passage in place but never removes one.

Cases: a null, empty or short text has no edge and keeps its words; repeated
rows have equal ids and don't repeat each other; where rows of different texts
share an id, each path is proved by the row it came from (one that passes from one
such row to another at neighbouring places is left in place); rows with a null id
are cleaned of nothing and repeat nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import SPACE_WORDS, Words, mix, pieces, task_batches, windows

K = 13
#: The lowest longs stand for null ids; so many, that these are dealt out too.
NO_ID, NO_IDS = -(1 << 63), 1 << 20
#: Words of one lot at most (a longer document is a lot of its own).
LOT_WORDS = 2_000_000
#: Edges that a lot sends to one hash range at least, on average.
LEAST_EDGES = 64
LOT_SCHEMA = "bucket long, lot long, ids binary, hashes binary, words binary, local binary"
BACK_SCHEMA = "lot long, ids binary, digests binary, repeated binary"
PATH_SCHEMA = "doc_id long, digest long, src long, paths binary"


def _zip(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _deltas(h: np.ndarray) -> bytes:
    """Sorted hashes as the first one and 6-byte steps, or 8-byte ones if a step is too long; the first byte tells which."""
    if not len(h):
        return b""
    d = np.diff(h)
    size = 6 if not len(d) or int(d.max()) < 1 << 48 else 8
    return bytes([size]) + h[:1].tobytes() + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _undeltas(x: bytes) -> np.ndarray:
    if not x:
        return np.zeros(0, np.uint64)
    size, rest = x[0], np.frombuffer(x, np.uint8, offset=9)
    wide = np.zeros((len(rest) // size, 8), np.uint8)
    wide[:, :size] = rest.reshape(-1, size)
    h = np.empty(len(wide) + 1, np.uint64)
    h[0] = np.frombuffer(x, np.uint64, 1, 1)[0]
    np.cumsum(wide.view(np.uint64).ravel(), out=h[1:])
    h[1:] += h[0]
    return h


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in two or four bytes each; the first byte tells which."""
    kind = "<u2" if not len(x) or int(x.max()) < 1 << 16 else "<u4"
    return bytes([int(kind[2])]) + x.astype(kind).tobytes()


def _places(docs: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """(documents met, edges): the numbers and ids of the lot's documents that occur, and each edge's document and place in it.

    All documents are named where most occur, as their steps compress best; else only those that do, so a
    row of few edges never carries its lot's whole list.
    """
    met = np.unique(docs)
    if 2 * len(met) > len(ids):
        met = np.arange(len(ids))
    one = _narrow(np.searchsorted(met, docs))
    return _zip(np.concatenate([np.diff(met, prepend=0), np.diff(ids[met], prepend=0)])), len(one).to_bytes(4, "little") + one + _narrow(places)


def _unplaces(met: bytes, edges: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in the lot, id, place) of each edge's document."""
    both = _unzip(met, np.int64).reshape(2, -1)
    n = int.from_bytes(edges[:4], "little")
    which, place = (np.frombuffer(x[1:], f"<u{x[0]}").astype(np.int64) for x in (edges[4 : 4 + n], edges[4 + n :]))
    return np.cumsum(both[0])[which], np.cumsum(both[1])[which], place


def _sources(docs: np.ndarray, places: np.ndarray, src: np.ndarray, src_places: np.ndarray) -> bytes:
    """Repeated edges (document's number in the lot, place in it) with their sources (id, place), in order of the first two."""
    order = np.lexsort((places, docs))
    return _zip(np.stack([np.diff(docs[order], prepend=0), places[order], src[order], src_places[order]]).astype(np.int64))


def _lot(docs: list[tuple[int, int, int]], where: list[np.ndarray], hashes: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of LOT_SCHEMA of one lot. docs: (id, words, digest) in order; where: word in the lot; hashes: of its edges."""
    ids, sizes, digests = (np.array([d[c] for d in docs], np.int64) for c in range(3))
    ends = np.cumsum(sizes)
    w, h = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((where, np.int64), (hashes, np.uint64)))
    order = np.argsort(h, kind="stable")
    h, w = h[order], w[order]
    doc = np.searchsorted(ends, w, "right")
    place = w - (ends - sizes)[doc]
    own = ids[doc]
    least, source = _least(h, own)
    later = own > least
    lot = int.from_bytes(hashlib.blake2b(ids.tobytes() + sizes.tobytes() + digests.tobytes(), digest_size=8).digest(), "little", signed=True)
    table = _zip(np.concatenate([np.diff(ids, prepend=0), sizes]))
    yield -1 - (lot & 0x7FFFFFFFFFFF), lot, table, None, _zip(digests), _sources(doc[later], place[later], least[later], place[source[later]])
    h, doc, place = h[~later], doc[~later], place[~later]
    bounds = np.searchsorted(h, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)) if buckets > 1 else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], bounds, [len(h)]])
    for b in np.flatnonzero(np.diff(bounds)):
        mine = slice(bounds[b], bounds[b + 1])
        met, edges = _places(doc[mine], place[mine], ids)
        yield int(b), lot, met, _deltas(h[mine]), edges, None


def _least(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted hashes, the smallest id of its run and the first place in the run that has it."""
    if not len(h):
        return own, np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    runs = np.diff(np.append(begins, len(h)))
    least = np.repeat(np.minimum.reduceat(own, begins), runs)
    at = np.where(own == least, np.arange(len(h)), len(h))
    return least, np.repeat(np.minimum.reduceat(at, begins), runs)


def lots(docs: DataFrame, k: int, buckets: int, lot_words: int) -> DataFrame:
    """Each task's documents as lots: reduced edges by bucket, and what is repeated within the lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LOT_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]

        def rows(*x):
            some = []
            for row in _lot(*x, buckets):
                some.append(row)
                if len(some) == 64:
                    yield some
                    some = []
            if some:
                yield some

        def packed(some):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)

        docs, where, hashes, used = [], [], [], 0
        met: set[tuple[int, int]] = set()  # rows of the lot; a copy of one of them sends no edges, as its paths would be the same
        for batch in task_batches(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, SPACE_WORDS)
                if used and used + len(w) > lot_words:
                    for some in rows(docs, where, hashes):
                        yield packed(some)
                    docs, where, hashes, used = [], [], [], 0
                    met = set()
                own = w.hashes()
                at, h = windows(own, w.at, k)
                rows_ = list(zip(ids[i:j].tolist(), word_digests(own, w).tolist(), strict=True))
                copy = np.zeros(len(rows_), bool)
                for n, row in enumerate(rows_):
                    copy[n] = row in met
                    met.add(row)
                if copy.any():
                    first = ~copy[np.searchsorted(w.at, at, "right") - 1]
                    at, h = at[first], h[first]
                docs += [(row[0], c, row[1]) for row, c in zip(rows_, w.counts.tolist(), strict=True)]
                where.append(at + used)
                hashes.append(h)
                used += len(w)
        if docs:
            for some in rows(docs, where, hashes):
                yield packed(some)

    return docs.mapInArrow(run, LOT_SCHEMA)


def word_digests(hashes: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit digest of each document's words in order, as signed numbers: tells rows with one id apart."""
    place = np.arange(len(hashes)) - np.repeat(w.at[:-1], w.counts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
    return (sums[w.at[1:]] - sums[w.at[:-1]]).view(np.int64)


def _repeated(table: pa.Table) -> pa.Table:
    """One bucket: the edges that another lot has under a smaller id, back to their lots with their sources."""
    names = [f.split()[0] for f in BACK_SCHEMA.split(", ")]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    if table.column("hashes").null_count:  # a lot's own row passes on
        return pa.table([table["lot"], table["ids"], table["words"], table["local"]], names=names)
    lot, met, hs, ws = (table[c].to_pylist() for c in ("lot", "ids", "hashes", "words"))
    h = [_undeltas(x) for x in hs]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in h])])
    doc, own, place = (np.concatenate(x) for x in zip(*map(_unplaces, met, ws), strict=True))
    h = np.concatenate(h)
    order = np.argsort(h, kind="stable")
    low, source = _least(h[order], own[order])
    least, origin = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    least[order], origin[order] = low, order[source]
    later = own > least
    out = []
    for n in range(len(lot)):
        mine = slice(bounds[n], bounds[n + 1])
        hit = later[mine]
        if hit.any():
            out.append((lot[n], None, None, _sources(doc[mine][hit], place[mine][hit], least[mine][hit], place[origin[mine][hit]])))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _paths(table: pa.Table) -> pa.Table:
    """One lot: its repeated edges as nonbranching paths; a path ends where the document or the run of sources does."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["ids"] is not None)
    both = _unzip(own["ids"], np.int64).reshape(2, -1)
    ids, digests = np.cumsum(both[0]), _unzip(own["digests"], np.int64)
    parts = [_unzip(r["repeated"], np.int64).reshape(4, -1) for r in rows if r["repeated"] is not None]
    doc = np.concatenate([np.cumsum(p[0]) for p in parts])
    word, src, place = (np.concatenate([p[c] for p in parts]) for c in (1, 2, 3))
    order = np.lexsort((word, doc))
    doc, word, src, place = doc[order], word[order], src[order], place[order]
    new = np.ones(len(word), bool)
    if len(word):
        new[1:] = (word[1:] != word[:-1] + 1) | (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    edges = np.diff(np.append(at, len(word)))
    d = doc[at]
    spans = np.stack([word[at], edges, place[at]]).astype("<u4") if len(at) else np.zeros((3, 0), "<u4")
    order = np.lexsort((spans[0], src[at], d)) if len(at) else at
    d, s, spans = d[order], src[at][order], spans[:, order]
    cuts = np.flatnonzero((d[1:] != d[:-1]) | (s[1:] != s[:-1])) + 1 if len(d) else np.zeros(0, np.int64)
    lo = np.concatenate([[0], cuts]).astype(np.int64) if len(d) else cuts
    hi = np.append(cuts, len(d)) if len(d) else cuts
    packed = [spans[:, a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    columns = [pa.array(c.astype(np.int64)) for c in (ids[d[lo]], digests[d[lo]], s[lo])]
    return pa.table([*columns, pa.array(packed, pa.binary())], names=[f.split()[0] for f in PATH_SCHEMA.split(", ")])


def unpack(paths: bytes) -> np.ndarray:
    """(3, n): first word, edges and first word at the source of each path."""
    return np.frombuffer(paths, "<u4").reshape(3, -1).astype(np.int64)


#: Rows that a task remembers so as to tell copies.
MOST_MET = 1_000_000
#: Bytes of a path's digest.
PROOF = 16


def proofs(words: list[bytes], starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """A digest of the words in each span, one after another; zeros for a span that reaches beyond them."""
    out = []
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        out.append(hashlib.blake2b(b" ".join(words[a : a + n]), digest_size=PROOF).digest() if a + n <= len(words) else bytes(PROOF))
    return b"".join(out)


def proved(own: bytes, source: bytes) -> np.ndarray:
    """Which spans have the same words at both places."""
    a, b = (np.frombuffer(x, np.uint64).reshape(-1, PROOF // 8) for x in (own, source))
    return (a == b).all(axis=1) & a.any(axis=1)


def bucket_count(docs: DataFrame, text_col: str, edges_per_bucket: int, lot_words: int, chars_per_word: int = 6) -> int:
    """Hash ranges, in proportion to the text; at most so many that a lot's row for one still holds about `LEAST_EDGES` edges.

    That bound is reached at lot_words * edges_per_bucket / LEAST_EDGES edges (2.5e10 by default). Beyond it ranges grow with
    the input; larger lots and ranges, with executors to match, move it (32e6 words a lot: 1.6e13 edges in ranges of 3e7).
    """
    chars = docs.agg(F.sum(F.length(docs[text_col]).cast("long"))).first()[0] or 0
    return max(1, min(-(-chars // (chars_per_word * edges_per_bucket)), max(lot_words // LEAST_EDGES, 1)))


def repeated_paths(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, edges_per_bucket: int = 800_000, lot_words: int = LOT_WORDS) -> DataFrame:
    """PATH_SCHEMA: per document and source the nonbranching paths with both coordinates, not yet confirmed by their words."""
    own = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    buckets = bucket_count(own, "text", edges_per_bucket, lot_words)
    sent = lots(own.filter("doc_id is not null and text is not null"), k, buckets, lot_words)
    back = sent.groupBy("bucket").applyInArrow(_repeated, BACK_SCHEMA)
    return back.groupBy("lot").applyInArrow(_paths, PATH_SCHEMA)


def _zipped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, zipped, lead): compressed texts with the digest of their words, for the joins; lead: the first row of its id and words in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        met: set[tuple[int | None, int]] = set()
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, SPACE_WORDS)
                raw, digests = data.tobytes(), word_digests(w.hashes(), w)
                packed = [z.compress(raw[offsets[d] : offsets[d + 1]]) for d in range(j - i)]
                if len(met) > MOST_MET:
                    met = set()
                lead = []
                for row in zip(batch.column(0).slice(i, j - i).to_pylist(), digests.tolist(), strict=True):
                    lead.append(row not in met)
                    met.add(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(digests), pa.array(packed, pa.binary()), pa.array(lead)], ["doc_id", "digest", "zipped", "lead"])

    own = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # a key that is never null, and the same columns, let both joins use one shuffle of the texts; null ids get keys that no path has
    packed = own.mapInArrow(run, "doc_id long, digest long, zipped binary, lead boolean")
    return packed.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID) + F.pmod("digest", F.lit(NO_IDS)), F.lit(NO_ID)).alias("id"), "digest", "zipped", "lead")


def with_proofs(paths: DataFrame, zipped: DataFrame, k: int) -> DataFrame:
    """(of, row, paths, proof): paths with the digests of the words at their source, from each row that has the source's id, copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in task_batches(batches):
            last, words, found = None, [], []
            for text, packed in zip(batch.column(3), batch.column(2), strict=True):
                text = text.as_py()
                if text != last:
                    last, words = text, z.decompress(text).split()
                p = unpack(packed.as_py())
                found.append(proofs(words, p[2], p[1] + (k - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["of", "row", "paths", "proof"])

    # `lead` is compared with a zero of the other side and never tested for null, so that no filter goes below the shuffle of the texts, which both joins use
    met = paths.select(F.col("doc_id").alias("of"), F.col("digest").alias("row"), "src", "paths").join(zipped, (F.col("src") == F.col("id")) & (F.coalesce("lead", F.lit(True)).cast("int") > F.least(F.octet_length("paths"), F.lit(0))))
    return met.select("of", "row", "paths", "zipped", "digest").mapInArrow(run, "of long, row long, paths binary, proof binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, edges_per_bucket: int = 800_000, lot_words: int = LOT_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's words less those in repeated edges, single-spaced."""
    paths = repeated_paths(docs, id_col=id_col, text_col=text_col, k=k, edges_per_bucket=edges_per_bucket, lot_words=lot_words)
    zipped = _zipped(docs, id_col, text_col)
    # a document's paths are at most its words; it is gathered by its own id, never by a source's
    per_doc = with_proofs(paths, zipped, k).repartition("of").groupBy("of", "row").agg(F.collect_set(F.struct("paths", "proof")).alias("paths"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in task_batches(batches):
            rows, size, start = [], 0, 0
            for r in range(batch.num_rows):
                words = z.decompress(batch.column(1)[r].as_py()).split()
                n = len(words)
                sure = []
                for x in batch.column(2)[r].as_py() or ():
                    p = unpack(x["paths"])
                    sure.append(p[:2, proved(proofs(words, p[0], p[1] + (k - 1)), x["proof"])])
                if sure:
                    gone = paths_cover(n, *np.concatenate(sure, axis=1), k)
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((n, n - len(words), b" ".join(words)))
                size += len(rows[-1][2])
                if size > 4 << 20 or r + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(rows)), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "n_removed", "text"],
                    )
                    rows, size, start = [], 0, r + 1

    # digests are compared beside the key, so that the texts stay dealt by id alone
    same_row = (F.col("id") == F.col("of")) & (F.col("digest").bitwiseXOR(F.col("row")) == 0)
    both = zipped.join(per_doc, same_row, "left").select(F.when(F.col("id") >= NO_ID + NO_IDS, F.col("id")).alias("doc_id"), "zipped", "paths", "lead")  # the same columns as the other join has
    return both.mapInArrow(clean, "doc_id long, n_words long, n_removed long, text string")


def paths_cover(n: int, at: np.ndarray, edges: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in paths of so many edges of k words."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + edges + k - 1, n), -1)
    return np.cumsum(step)[:n] > 0


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13),
e as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) h from p),
m as (select h, min(doc_id) lo from e group by h having min(doc_id) < max(doc_id)),
g as (select distinct doc_id, unnest(range(i, i + 13)) q from e join m using (h) where lo < doc_id),
x as (select doc_id, unnest(w) word, generate_subscripts(w, 1) q from d),
k as (select doc_id, count(*) n, sha256(string_agg(word, ' ' order by q)) s from x anti join g using (doc_id, q) group by doc_id)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, coalesce(s, sha256('')) kept_sha256 from d left join k using (doc_id)
"""
