"""Jaccard join of word n-gram sets by PartEnum signatures.

A set's size lies in a band [l, r] with r = l / threshold; sets that can link lie in
one band or in neighbouring ones, so each set takes part in two families, its own
band's and the next one's. Within a family, sets that link differ in at most
k = 2 r (1 - t) / (1 + t) elements. The feature domain (hashed shingles) is
partitioned into n1 parts, each of these into three; more than k / 2 of the n1 parts
would need two differences to be useless, so of n1 = k / 2 + g parts at least g differ
in one element at most, and two of their three parts agree. The signatures of a set
are the enumerated pairs of parts, 3 n1 a family; linked sets share one.

An empty pair of parts says nothing and isn't a signature. A set with fewer than g
parts in which a pair is empty shares a real signature with each partner; the few
others enter a further level with another partition of the domain, the last level
having the empty pairs too. A linked pair is missed at no level: it is enough that one
of the two is sure of its parts.

Equal sets are one class first. Tasks send signatures packed by hash range; a range
returns the classes that share one, each distinct list of classes once. Then, without
listing the pairs of a group:

1. in each list, classes are neighbours where their sketches allow a link (1024 bits of
   parity, whose differing bits are at most the sets' differing elements, so no linked
   pair is refused); each class is tried with its smallest and its nearest neighbour,
   and what the texts confirm is joined to components;
2. the pairs of neighbours that lie in different components are listed; in turns, each
   class is tried with its nearest one, and what has been joined goes from the list;
3. all pairs that are then left are tried.

So every pair with a common signature is either confirmed or refused by its texts, or
lies in one component already. Large lists are cut into blocks that meet pairwise.

Shingles are compared by 64-bit hashes of their words, and sets by 128 bits.

Cases: a null, empty or blank text has an empty set, linked with nothing, its own
component; texts under n words are one shingle; repeated rows and equal sets are one
component; a null id belongs to its component but never names it (a component of
null ids has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, merged_components, small_batches, small_side, spread_join
from .textbytes import SPACE_WORDS, Words, mix, pieces, task_batches, windows

#: Bits of a sketch; entries a lot sends at once; signatures a hash range holds about; classes of a list that meet in one block.
SKETCH, LOT_ENTRIES, RANGE_ENTRIES, BLOCK = 1024, 3_000_000, 2_000_000, 1024
#: Levels of partitions of the domain; parts of a part.
LEVELS, PARTS = 5, 3
#: Candidate ids and classes are broadcast up to this number (16 and 24 bytes each).
BROADCAST_IDS = 200_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def bands(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """The largest size r of each band; one band begins where the last ends."""
    ends, low = [0], 1
    while ends[-1] < most:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends[1:], np.int64)


def sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles of a piece, by document and hash; a shorter text is one shingle."""
    h = w.hashes()
    where, full = windows(h, w.at, k)
    docs, hashes = [np.searchsorted(w.at, where, "right") - 1], [full]
    for c in range(1, k):
        few = np.flatnonzero(w.counts == c)
        if len(few):
            x = np.full(len(few), c, np.uint64)
            for j in range(c):
                x = mix(x * _P + h[w.at[few] + j])
            docs.append(few)
            hashes.append(x)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _sums(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, x)
    return out


def set_keys(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's set."""
    return mix(_sums(doc, mix(h ^ _P), n) + _Q), mix(_sums(doc, mix(h ^ _Q), n) + _P)


def sketches(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """Parity of the number of elements that fall on each bit."""
    out: list[bytes] = []
    for lo in range(0, n, 2048):
        hi = min(n, lo + 2048)
        a, b = np.searchsorted(doc, [lo, hi])
        counts = np.bincount((doc[a:b] - lo) * SKETCH + (mix(h[a:b] ^ np.uint64(77)) % np.uint64(SKETCH)).astype(np.int64), minlength=(hi - lo) * SKETCH)
        bits = np.packbits((counts & 1).astype(bool).reshape(hi - lo, SKETCH), axis=1)
        out += [row.tobytes() for row in bits]
    return out


def family_shape(r: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(n1, g) of families whose sets have at most r elements."""
    useless = 2 * r * (den - num) // (den + num) // 2
    g = 1 + useless // 5
    return useless + g, g


def signatures(doc: np.ndarray, h: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of n sets given as distinct (document, hash)."""
    ends = bands(num, den)
    size = np.bincount(doc, minlength=n)
    own = np.searchsorted(ends, np.maximum(size, 1))
    owners, found = [], []
    for step in (0, 1):
        rows, d, x = np.arange(n), doc, h  # the sets of this level, and their elements
        for level in range(LEVELS):
            family = own[rows] + step
            n1, g = family_shape(ends[family], num, den)
            base = np.concatenate([[0], np.cumsum(n1)])
            seed = mix(np.uint64(level * 1000 + 1) + family.astype(np.uint64) * _P)
            y = mix(x ^ seed[d])
            part = base[d] + (((y >> np.uint64(32)) * n1[d].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            cell = part * PARTS + (((y & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS)) >> np.uint64(32)).astype(np.int64)
            sums = _sums(cell, mix(x ^ _Q), int(base[-1]) * PARTS).reshape(-1, PARTS)
            there = np.zeros(int(base[-1]) * PARTS, bool)
            there[cell] = True
            there = there.reshape(-1, PARTS)
            of = np.repeat(np.arange(len(rows)), n1)
            number = (np.arange(int(base[-1])) - base[of]).astype(np.uint64)
            weak = there.sum(axis=1) < 2  # some pair of its parts is empty
            sure = np.bincount(of, weights=weak, minlength=len(rows)).astype(np.int64) < g
            last = level == LEVELS - 1
            for without in range(PARTS):
                some = np.delete(there, without, axis=1).any(axis=1) | last
                rest = sums.sum(axis=1, dtype=np.uint64) - sums[:, without]
                sig = mix(mix(rest + seed[of]) ^ mix(number * np.uint64(PARTS) + np.uint64(without + 1)))
                owners.append(rows[of[some]])
                found.append(sig[some])
            if sure.all():
                break
            again = np.flatnonzero(~sure)
            place = np.full(len(rows), -1)
            place[again] = np.arange(len(again))
            keep = place[d] >= 0
            rows, d, x = rows[again], place[d[keep]], x[keep]
    return np.concatenate(owners), np.concatenate(found)


def own_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, h1, h2, sketch) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(1)):
                m = j - i
                doc, h = sets(Words(data, offsets, SPACE_WORDS, lower=True), k)
                a, b = (x.view(np.int64) for x in set_keys(doc, h, m))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array(np.bincount(doc, minlength=m)), pa.array(a), pa.array(b), pa.array(sketches(doc, h, m), pa.binary())], ["doc_id", "n", "h1", "h2", "sketch"])

    return small_batches(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary")


def _packs(classes: dict[tuple[int, int], None], held: list, ranges: int) -> Iterator[pa.RecordBatch]:
    """A lot's signatures, a row a hash range: six bytes each, the class's place among the row's classes, and these."""
    names = np.array([x[0] for x in classes], np.uint64)
    owner, sig = (np.concatenate(x) for x in zip(*held, strict=True))
    low = sig & np.uint64((1 << 48) - 1)
    to = ((sig >> np.uint64(48)) * np.uint64(ranges)) >> np.uint64(16) if ranges <= 1 << 12 else mix(sig) % np.uint64(ranges)
    order = np.lexsort((low, to))
    owner, low, to = owner[order], low[order], to[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(to)) + 1
    rows = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
        local, at = np.unique(owner[a:b], return_inverse=True)
        rows.append((int(to[a]), low[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), at.astype("<u2" if len(local) <= 1 << 16 else "<u4").tobytes(), names[local].tobytes()))
    for i in range(0, len(rows), 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 16], strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "sigs", "at", "classes"])


def packed_signatures(docs: DataFrame, k: int, num: int, den: int, ranges: int) -> DataFrame:
    """(range, sigs, at, classes): signatures of the rows of docs (doc_id, text), packed by lots; a class once a lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, int], None] = {}
        held, entries = [], 0
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(1)):
                doc, h = sets(Words(data, offsets, SPACE_WORDS, lower=True), k)
                size = np.bincount(doc, minlength=j - i)
                a, b = set_keys(doc, h, j - i)
                new, first = np.zeros(j - i, bool), len(classes)
                for r in np.flatnonzero(size).tolist():
                    key = (int(a[r]), int(b[r]))
                    if key not in classes:
                        classes[key] = None
                        new[r] = True
                if not new.any():
                    continue
                place = np.cumsum(new) - 1
                keep = new[doc]
                owner, sig = signatures(place[doc[keep]], h[keep], int(new.sum()), num, den)
                held.append((owner + first, sig))
                entries += len(sig)
                if entries >= LOT_ENTRIES:
                    yield from _packs(classes, held, ranges)
                    classes, held, entries = {}, [], 0
        if held:
            yield from _packs(classes, held, ranges)

    return small_batches(docs).mapInArrow(run, "range long, sigs binary, at binary, classes binary")


def _lists(table: pa.Table) -> pa.Table:
    """(list, h1): the classes that share a signature of the range, each distinct list once."""
    low, name = [], []
    for sigs, at, classes in zip(table["sigs"], table["at"], table["classes"], strict=True):
        raw = np.frombuffer(sigs.as_buffer(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        low.append(wide.reshape(-1).view("<u8"))
        names = np.frombuffer(classes.as_buffer(), np.uint64)
        name.append(names[np.frombuffer(at.as_buffer(), "<u2" if len(names) <= 1 << 16 else "<u4")])
    low, name = np.concatenate(low), np.concatenate(name)
    order = np.argsort(low, kind="stable")
    low, name = low[order], name[order]
    twin = np.zeros(len(low), bool)  # most signatures stand alone
    twin[1:] = low[1:] == low[:-1]
    twin[:-1] |= twin[1:]
    low, name = low[twin], name[twin]
    order = np.lexsort((name, low))
    low, name = low[order], name[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (name[1:] != name[:-1])
    low, name = low[new], name[new]
    run = np.cumsum(np.concatenate([[0], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    runs = int(run[-1]) + 1 if len(run) else 0
    content = mix(_sums(run, mix(name ^ _P), runs) + _Q)
    first = np.zeros(runs, bool)
    first[np.unique(content, return_index=True)[1]] = True
    keep = (first & (np.bincount(run, minlength=runs) > 1))[run]
    return pa.table({"list": content[run][keep].view(np.int64), "h1": name[keep].view(np.int64)})


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _with(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """edges with the columns of nodes (node, ...) for one end, suffixed by its name. An end of very many edges is a skewed key of a plain join, which Spark splits."""
    return edges.join(nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in nodes.columns if c != "node"]), end)


def _verified(edges: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The edges whose texts confirm them."""
    wanted = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "first_doc", "h1", "h2"), "node"))
    ids = small_side(wanted.select(F.col("first_doc").alias("_id")).distinct(), BROADCAST_IDS)
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        met: set[tuple[int, int]] = set()  # a class once a task, where ids repeat; its links are then confirmed more than once
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(1)):
                doc, h = sets(Words(data, offsets, SPACE_WORDS, lower=True), k)
                a, b = (x.view(np.int64) for x in set_keys(doc, h, j - i))
                new = [d for d, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if not (key in met or met.add(key))]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array([z.compress(raw[offsets[d] : offsets[d + 1]]) for d in new], pa.binary())], ["h1", "h2", "zipped"])
                met = set() if len(met) > 1_000_000 else met

    # the texts are shuffled once, by class, for both ends
    texts = small_batches(rows).mapInArrow(pack, "h1 long, h2 long, zipped binary").join(small_side(wanted.select("node", "h1", "h2"), BROADCAST_IDS), ["h1", "h2"]).select("node", "zipped")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in task_batches(batches):
            start = 0
            while start < len(batch):
                left, right, size, end = [], [], 0, start
                while end < len(batch) and (size < 2 << 20 or end == start):
                    left.append(z.decompress(batch["zipped_a"][end].as_py()))
                    right.append(z.decompress(batch["zipped_b"][end].as_py()))
                    size += len(left[-1]) + len(right[-1])
                    end += 1
                m = end - start
                data = np.frombuffer(b"".join(left + right), np.uint8)
                doc, h = sets(Words(data, np.concatenate([[0], np.cumsum([len(x) for x in left + right])]), SPACE_WORDS, lower=True), k)
                both = np.bincount(doc % m, minlength=m)
                order = np.lexsort((h, doc % m))
                pair, x = (doc % m)[order], h[order]
                same = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (x[1:] == x[:-1])], minlength=m)
                yield batch.select(["a", "b"]).slice(start, m).filter(pa.array(den * same >= num * (both - same)))
                start = end

    met = _with(_with(edges, texts, "a"), texts, "b")
    return small_batches(met.select("a", "b", "zipped_a", "zipped_b")).mapInArrow(compare, "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The blocks (list, i, j) of a task's sorted rows, one after another; a block may span batches."""
    kept = None
    names = ("list", "i", "j", "block", "node", "root", "n")
    for batch in task_batches(batches):
        now = {c: batch[c].to_numpy() for c in names} | {"bits": _bits(batch["sketch"])}
        kept = now if kept is None else {c: np.concatenate([kept[c], now[c]]) for c in now}
        new = np.flatnonzero((kept["list"][1:] != kept["list"][:-1]) | (kept["i"][1:] != kept["i"][:-1]) | (kept["j"][1:] != kept["j"][:-1])) + 1
        for lo, hi in zip([0, *new[:-1].tolist()], new.tolist(), strict=True) if len(new) else ():
            yield {c: v[lo:hi] for c, v in kept.items()}
        if len(new):
            kept = {c: v[new[-1] :] for c, v in kept.items()}
    if kept is not None and len(kept["node"]):
        yield kept


def _distances(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches (rows of 64-bit numbers) of sets of n and m elements can link, and in how many bits they differ."""
    far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (far * (den + num) <= (n + m) * (den - num)), far


def near_pairs(blocks: list[dict[str, np.ndarray]], num: int, den: int, across: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(block, node, node, differing bits) of pairs that can link, of different components if `across`. Few rows are compared at once."""
    few = [k for k, b in enumerate(blocks) if len(b["node"]) <= FEW]
    if few:
        ends = np.cumsum([0, *[len(blocks[k]["node"]) for k in few]])
        pairs = [np.triu_indices(len(blocks[k]["node"]), 1) for k in few]
        x, y = (np.concatenate([p[c] + at for p, at in zip(pairs, ends.tolist(), strict=False)]) for c in (0, 1))
        all_ = {c: np.concatenate([blocks[k][c] for k in few]) for c in ("bits", "n", "node", "root", "block", "i", "j")}
        ok = (all_["i"][x] == all_["j"][x]) | (all_["block"][x] != all_["block"][y])
        ok &= (all_["root"][x] != all_["root"][y]) if across else True
        x, y = x[ok], y[ok]
        for at in range(0, len(x), TOGETHER * 8):
            p, q = x[at : at + TOGETHER * 8], y[at : at + TOGETHER * 8]
            ok, far = _distances(all_["bits"][p], all_["bits"][q], all_["n"][p], all_["n"][q], num, den)
            yield np.array(few)[np.searchsorted(ends, p[ok], "right") - 1], all_["node"][p[ok]], all_["node"][q[ok]], far[ok]
    for k, own in enumerate(blocks):
        for p in range(len(own["node"]) - 1) if len(own["node"]) > FEW else ():
            q = np.arange(p + 1, len(own["node"]))
            if own["i"][0] != own["j"][0]:
                q = q[own["block"][q] != own["block"][p]]
            q = q[own["root"][q] != own["root"][p]] if across else q
            ok, far = _distances(own["bits"][q], own["bits"][p], own["n"][q], own["n"][p], num, den)
            if ok.any():
                yield np.full(int(ok.sum()), k), np.full(int(ok.sum()), own["node"][p]), own["node"][q[ok]], far[ok]


#: Blocks of up to so many members are compared together, so many members at once.
FEW, TOGETHER = 48, 8192


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, np.ndarray]]]:
    """Blocks of two members or more, some at a time."""
    held, size = [], 0
    for own in _blocks(batches):
        if len(own["node"]) > 1:
            held.append(own)
            size += len(own["node"])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _dealt(members: DataFrame) -> DataFrame:
    """members (list, blocks, node, root, n, sketch) as blocks of lists that meet pairwise, each sorted within a task."""
    blocks = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = blocks.select("list", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "node", "root", "n", "sketch")
    return small_batches(dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "node"))


def _near_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """Two kinds of rows: (node, least, nearest, far), for each member of a block that can link its smallest and its nearest neighbour there,
    and (list, node), the block's members with a neighbour, under a name that tells what they are: so equal remainders of lists are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _together(batches):
            found = list(near_pairs(blocks, num, den, False))
            if not found:
                continue
            which, x, y, far = (np.concatenate(c) for c in zip(*found, strict=True))
            one, other, gap, at = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([far, far]), np.concatenate([which, which])
            nodes, place = np.unique(one, return_inverse=True)
            least = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(least, place, other)
            order = np.lexsort((other, gap, place))
            first = order[np.concatenate([[True], place[order][1:] != place[order][:-1]])]
            yield _rows(node=nodes, least=least, nearest=other[first], far=gap[first])
            member = np.unique(np.stack([at, one], axis=1), axis=0)
            name = _sums(member[:, 0], mix(member[:, 1].astype(np.uint64) + _P), len(blocks))
            yield _rows(node=member[:, 1], list=mix(name + _Q).view(np.int64)[member[:, 0]])

    return _dealt(members).mapInArrow(run, "node long, least long, nearest long, far long, list long")


def _rows(**given: np.ndarray) -> pa.RecordBatch:
    n = len(given["node"])
    return pa.RecordBatch.from_arrays([pa.array(given[c]) if c in given else pa.nulls(n, pa.int64()) for c in ("node", "least", "nearest", "far", "list")], ["node", "least", "nearest", "far", "list"])


def _pairs_across(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, far): pairs of different components that meet in a block of a list and pass the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _together(batches):
            for _, x, y, far in near_pairs(blocks, num, den, True):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(far)], ["a", "b", "far"])

    return _dealt(members).mapInArrow(run, "a long, b long, far long").distinct()


def _edges(*pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of frames of two nodes."""
    found = None
    for df in pairs:
        x, y = df.columns
        one = df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        found = one if found is None else found.union(one)
    return found.distinct()


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, range_entries: int = RANGE_ENTRIES, block: int = BLOCK, turns: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: its set's size, and the smallest id it reaches by links of similarity num / den or more."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    own = cut(own_sets(texts, k))
    real = own.filter("n > 0")
    classes = cut(real.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    ranges = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // range_entries))
    lists = packed_signatures(texts, k, num, den, ranges).groupBy("range").applyInArrow(_lists, "list long, h1 long").distinct()
    drawn = classes.select("node", "n", "sketch")
    members = cut(lists.join(classes.select("h1", "node"), "h1").select("list", "node"))
    sizes = members.groupBy("list").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = members.join(sizes, "list").join(drawn, "node").withColumn("root", F.col("node"))
    near = cut(_near_members(placed, num, den))
    best = near.filter("least is not null").groupBy("node").agg(F.min("least").alias("least"), F.min(F.struct("far", "nearest")).alias("near"))
    tried = cut(_edges(best.select("node", "least"), best.select("node", F.col("near.nearest").alias("nearest"))))
    roots = cut(components(_verified(tried, classes, texts, k, num, den), "a", "b"))
    rooted = cut(near.filter("list is not null").select("list", "node").distinct().join(roots, "node", "left").select("list", "node", F.coalesce("root", "node").alias("root")))
    split = rooted.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo != hi")
    split = split.select("list", F.ceil(F.col("size") / block).alias("blocks"))
    rest = cut(_pairs_across(rooted.join(split, "list").join(drawn, "node"), num, den).join(tried, ["a", "b"], "left_anti"))
    for turn in range(turns + 1):  # the last turn tries all that is left
        if not rest.limit(1).count():
            break
        both = rest.select("a", "b", "far").union(rest.select("b", "a", "far"))
        nearest = both.groupBy("a").agg(F.min(F.struct("far", "b")).alias("near")).select("a", "near.b")
        tried = cut(_edges(nearest) if turn < turns else rest.select("a", "b"))
        roots = cut(merged_components(roots, _verified(tried, classes, texts, k, num, den), "a", "b"))
        if turn < turns:
            for end in ("a", "b"):
                rest = rest.drop(f"_{end}").join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
            rest = cut(rest.filter("_a != _b").join(tried, ["a", "b"], "left_anti"))
    placed = cut(classes.join(roots, "node", "left").select(F.struct("h1", "h2").alias("key"), "first_doc", "copies", F.coalesce("root", "node").alias("root")))
    names = cut(placed.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("members")))
    by_class = cut(spread_join(placed, names, "root", "members").select("key", "copies", "component_id"))
    keyed = own.select("doc_id", F.col("n").alias("n_shingles"), F.struct("h1", "h2").alias("key"))
    found = spread_join(keyed.filter("n_shingles > 0"), by_class, "key", "copies").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(keyed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


#: SQL lists all pairs that share a shingle, and follows links to a fixed point. {docs}: the table.
SQL = r"""
with recursive d as materialized (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from {docs}),
e as materialized (select distinct r, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from d where len(w) > 0),
n as materialized (select r, count(*) n from e group by r),
l as materialized (select a, b from (select x.r a, y.r b, count(*) c from e x join e y on x.s = y.s and x.r <> y.r group by all) p join n x on x.r = a join n y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
t as (select r a, r b from d union select t.a, l.b from t join l on t.b = l.a),
c as (select a r, min(doc_id) component_id from t join d on d.r = t.b group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from d join c using (r) left join n using (r)
"""
