"""Hard negatives by exact integer scores, anchors against all rows in tiles.

Components become integers (floor of `scale` times the component). Rows are packed
into tiles, anchors into panels; a cell of the grid is one panel and a few tiles,
and cells are dealt out by a shuffle, so neither side is broadcast nor collected.
In a cell, scores are products of int64 matrices by Strassen's recursion: blocks
are padded with zeros to even sizes, halved, and seven products of sums and
differences of the halves replace eight. Integer sums are exact, and as all steps
are ring operations, a score is right whenever it fits in 64 bits itself.

Two passes, each with bounded heaps that merge: first each anchor's `positives`
best rows of its label; then, for each anchor and positive, the `negatives` best
rows of another label whose score lies in the window from `low` to `high` percent
of the positive's. A cell merges its tiles' heaps, Spark merges the cells'.

Cases: rows with a null label, a null vector or a null or non-finite component take
no part. Vectors of unequal length are padded with zeros. Equal scores go by
smaller id, a null id last (such a row is no anchor). Repeated rows are rows: a
copy of an anchor is another row of its label, and repeated anchors have results
each. An empty table, and a table without anchors, give an empty result. Vectors
so long that 100 times a score could leave 64 bits are an error. Other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .textbytes import task_batches

#: Sides of a product up to which it is not halved further; anchors scored at once.
LEAF, ANCHOR_BLOCK = 16, 512
PACKED = "size int, dims int, kind string, ids binary, named binary, labels binary, anchors binary, tiles binary, places binary, vectors binary, wanted binary, wanted_ids binary, wanted_named binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best allowed columns of each row; equal scores go by the smaller column."""
    if np.count_nonzero(ok) > 4 * k * len(ok) and scores.shape[1] > k:
        held = np.where(ok, scores, np.iinfo(np.int64).min)
        ok = ok & (held >= np.partition(held, -k, axis=1)[:, -k, None])
    row, column = np.nonzero(ok)
    score = scores[row, column]
    keep = _first(row, (column, -score), k)
    return row[keep], column[keep], score[keep]


def _first(row: np.ndarray, by: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Where the first k of each row stand, by the last of `by` first, as lexsort has it."""
    order = np.lexsort((*by, row))
    own = row[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class Heap:
    """The k best (score, id) of each of many rows; heaps over parts of the candidates merge."""

    def __init__(self, k: int):
        self.k, self.row, self.score, self.id, self.named = k, *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)

    def offer(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray, named: np.ndarray) -> None:
        row, score, ident, named = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ident), (self.named, named)))
        keep = _first(row, (ident, ~named, -score), self.k)
        self.row, self.score, self.id, self.named = row[keep], score[keep], ident[keep], named[keep]

    def ids(self) -> pa.Array:
        return pa.array(self.id, mask=~self.named)


def _matrix(lists: pa.ListArray, kind=np.int64) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    size = np.diff(ends)
    out = np.zeros((len(lists), int(size.max()) if len(size) else 0), kind)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - ends[row]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: pa.Table) -> dict[str, list]:
    """One tile of the rows, in the order of their ids, nulls last."""
    named = ~np.asarray(rows["id"].is_null())
    ids = rows["id"].fill_null(0).to_numpy().astype(np.int64)
    order = np.lexsort((ids, ~named))
    vectors = _matrix(rows["v"].combine_chunks())[order]
    top = int(np.abs(vectors).max()) if vectors.size else 0
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if top <= np.iinfo(t).max)
    wanted = rows["wanted"].combine_chunks()
    scores = wanted.flatten()
    flat = lambda c: scores.field(c).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    # (row in the tile's order, place among the row's windows, score), row by row
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    windows = np.stack([back[np.repeat(np.arange(len(order)), np.diff(at))], flat("k").astype(np.int64), flat("score").astype(np.int64)], axis=1)
    of = lambda c: rows[c].to_numpy()[order].tobytes()
    return {
        "size": [len(order)], "dims": [vectors.shape[1]], "kind": [kind], "ids": [ids[order].tobytes()], "named": [named[order].tobytes()], "labels": [of("label")], "anchors": [np.asarray(rows["anchor"])[order].tobytes()],
        "tiles": [of("tile")], "places": [of("place")], "vectors": [vectors.astype(kind).tobytes()], "wanted": [windows.tobytes()], "wanted_ids": [scores.field("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
        "wanted_named": [(~np.asarray(scores.field("id").is_null())).tobytes()],
    }


class Tile:
    """A tile as arrays."""

    def __init__(self, row: dict):
        n = row["size"]
        of = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.labels, self.tiles, self.places = (of(c, np.int64) for c in ("ids", "labels", "tiles", "places"))
        self.named, self.anchors = of("named", bool), of("anchors", bool)
        self.vectors = of("vectors", row["kind"]).reshape(n, row["dims"]).astype(np.int64)
        self.wanted = of("wanted", np.int64).reshape(-1, 3)
        self.wanted_ids = pa.array(of("wanted_ids", np.int64), mask=~of("wanted_named", bool))


WINDOWS = "array<struct<k:long,score:long,id:long>>"


def _pack(df: DataFrame, most: int) -> DataFrame:
    """Rows as tiles of at most `most` rows, each of one partition."""
    schema = pa.schema([pa.field(n, t) for n, t in (("size", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "named", "labels", "anchors", "tiles", "places", "vectors", "wanted", "wanted_ids", "wanted_named")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in task_batches(batches):
            while len(batch):
                own, batch = batch.slice(0, most - n), batch.slice(most - n)
                held.append(own)
                n += len(own)
                if n == most:
                    yield pa.RecordBatch.from_pydict(_packed(pa.Table.from_batches(held)), schema)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pydict(_packed(pa.Table.from_batches(held)), schema)

    return small_batches(df).mapInArrow(run, PACKED)


def _unpack(tiles: DataFrame) -> DataFrame:
    """(tile, place, id, label, v) of the tiles' anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task_batches(batches):
            for row in batch.to_pylist():
                t, at = Tile(row), None
                at = np.flatnonzero(t.anchors)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["tile"], np.int64)), pa.array(at), pa.array(t.ids[at], mask=~t.named[at]), pa.array(t.labels[at]), pa.array(list(t.vectors[at]), pa.list_(pa.int64()))], ["tile", "place", "id", "label", "v"])

    return tiles.mapInArrow(run, "tile long, place long, id long, label long, v array<long>")


def _blocks(panel: Tile, tiles: pa.Table) -> Iterator[tuple[np.ndarray, Tile, int, np.ndarray]]:
    """(anchors, tile, tile's number, scores) of a panel with each tile, a block of anchors at a time."""
    for row in tiles.to_pylist():
        tile = Tile(row)
        d = max(panel.vectors.shape[1], tile.vectors.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
        right = np.ascontiguousarray(wide(tile.vectors).T)
        for i in range(0, len(panel.ids), ANCHOR_BLOCK):
            at = np.arange(i, min(i + ANCHOR_BLOCK, len(panel.ids)))
            yield at, tile, row["tile"], strassen(wide(panel.vectors[at]), right)


def _cells(tiles: DataFrame, anchors: DataFrame, n_tiles: int, n_anchors: int, panel_rows: int):
    """Each panel of anchors with each group of tiles, cogrouped; a panel's number is its partition's."""
    n_panels = math.ceil(n_anchors / panel_rows)
    salts = math.ceil(n_tiles / min(16, max(1, n_tiles // 16)))
    panels = cut(_pack(anchors.withColumn("anchor", F.lit(True)).repartition(n_panels), panel_rows)).withColumn("panel", F.spark_partition_id())
    left = tiles.withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(salts))).withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(n_panels - 1))))
    right = panels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return left.groupBy("panel", "salt").cogroup(right.groupBy("panel", "salt"))


def mine(
    vectors: DataFrame, *, anchors: Column, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, tile_rows: int = 1024, panel_rows: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchors` holds; label, if given, stands for the label column."""
    spark = vectors.sparkSession
    x = vectors[vector_col].cast("array<double>")
    own = vectors.select(vectors[id_col].cast("long").alias("id"), (vectors[label_col] if label is None else label).cast("long").alias("label"), x.alias("x"), F.coalesce(anchors & vectors[id_col].isNotNull(), F.lit(False)).alias("anchor"), vectors[label_col].isNull().alias("off"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    own = own.filter(~F.col("off") & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    size = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(F.floor(v * scale).cast("double"), 2.0))
    n_anchors, longest = own.agg(F.count(F.when(F.col("anchor"), 1)), F.max(size)).first()
    if (longest or 0.0) * max(high, low, 100) >= 2.0**62:
        raise ValueError("vectors too long: 100 times a score could leave 64 bits")
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    none = F.array().cast(WINDOWS).alias("wanted")
    zero = F.lit(0).cast("long")
    whole = own.select("id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("v"), "anchor", zero.alias("tile"), zero.alias("place"), none)
    tiles = cut(_pack(whole, tile_rows)).withColumn("tile", F.monotonically_increasing_id())
    n_tiles = tiles.count()
    found = cut(_unpack(tiles))

    def near(own_tiles: pa.Table, own_panels: pa.Table) -> pa.Table:
        out = []
        for row in own_panels.to_pylist():
            panel, heap = Tile(row), Heap(positives)
            for at, tile, number, scores in _blocks(panel, own_tiles):
                ok = panel.labels[at][:, None] == tile.labels
                self_ = np.flatnonzero(panel.tiles[at] == number)
                ok[self_, panel.places[at][self_]] = False
                r, c, s = best(scores, ok, positives)
                heap.offer(at[r], s, tile.ids[c], tile.named[c])
            out.append(pa.table({"tile": panel.tiles[heap.row], "place": panel.places[heap.row], "score": heap.score, "id": heap.ids()}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("tile", "place", "score", "id")})

    def within(own_tiles: pa.Table, own_panels: pa.Table) -> pa.Table:
        out = []
        for row in own_panels.to_pylist():
            panel, heap = Tile(row), Heap(negatives)
            for at, tile, _, scores in _blocks(panel, own_tiles):
                foreign = panel.labels[at][:, None] != tile.labels
                for k in range(1, positives + 1):
                    w = np.flatnonzero((panel.wanted[:, 1] == k) & (panel.wanted[:, 0] >= at[0]) & (panel.wanted[:, 0] <= at[-1]))
                    mine_, ps = panel.wanted[w, 0] - at[0], panel.wanted[w, 2][:, None]
                    held = scores[mine_]
                    r, c, s = best(held, foreign[mine_] & (100 * held >= low * ps) & (100 * held <= high * ps), negatives)
                    heap.offer(w[r], s, tile.ids[c], tile.named[c])
            row_of = panel.wanted[heap.row, 0]
            out.append(pa.table({
                "tile": panel.tiles[row_of], "place": panel.places[row_of], "anchor_id": panel.ids[row_of], "k": panel.wanted[heap.row, 1], "positive_id": panel.wanted_ids.take(heap.row), "positive_score": panel.wanted[heap.row, 2],
                "negative_id": heap.ids(), "negative_score": heap.score,
            }))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("tile", "place", "anchor_id", "k", "positive_id", "positive_score", "negative_id", "negative_score")})

    first = _cells(tiles, found.withColumn("wanted", none), n_tiles, n_anchors, panel_rows).applyInArrow(near, "tile long, place long, score long, id long")
    by_score = W.partitionBy("tile", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = first.withColumn("k", F.row_number().over(by_score).cast("long")).filter(F.col("k") <= positives)
    wanted = ranked.groupBy("tile", "place").agg(F.collect_list(F.struct("k", "score", "id")).cast(WINDOWS).alias("wanted"))  # at most `positives` each
    second = _cells(tiles, found.join(wanted, ["tile", "place"]), n_tiles, n_anchors, panel_rows).applyInArrow(
        within, "tile long, place long, anchor_id long, k long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    last = W.partitionBy("tile", "place", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return second.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: {vectors}: the table.
SQL = """
with v as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from {vectors}
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r ar, a.vec_id anchor_id, c.vec_id, a.lab = c.lab same,
  coalesce(list_sum(list_transform(range(1, least(len(a.e), len(c.e)) + 1), lambda i: a.e[i] * c.e[i])), 0)::bigint score from v a join v c on a.r <> c.r where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by ar order by score desc, vec_id nulls last) k from s where same qualify k <= 5)
select p.anchor_id, p.vec_id positive_id, (row_number() over (partition by p.ar, k order by s.score desc, s.vec_id nulls last))::int rank, s.vec_id negative_id, p.score positive_score, s.score negative_score
from p join s on s.ar = p.ar where not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10
"""
