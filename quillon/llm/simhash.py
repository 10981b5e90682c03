"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes
(seed 42) of the text's 4-word shingles. Documents link at `radius` differing bits.

Search: exact copies first fall to one row per fingerprint. The 64 bits form a
ring of radius + 1 segments. If two fingerprints differ in at most `radius` bits,
some segment starts a chain whose first l segments differ in at most
floor(l * radius / (radius + 1)) bits for every l (the pigeonring principle): the
first segment is equal, the first two differ in one bit at most, and so on.
Fingerprints meet where their first segment is equal; a bucket with more than
`dense` members is dealt anew by the next segment (its own value, and the values
one bit away), so the second link of the chain becomes part of the key. Within a
bucket the further chain conditions prune in turn, then the full distance is
checked. Each bucket returns links that connect what it found connected, not all
pairs, so a large group of near copies costs rows in proportion to its members.

Cases: a null, empty or blank text has fingerprint zero and links like any other;
texts under four words are one shingle; repeated rows are copies; an empty table
gives an empty result; other columns are ignored. A null id belongs to its
group but never names it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, spread_join
from .textbytes import task_batches

BITS = 64
#: Parts words.
SPACES = r"[\x20\x09-\x0D]+"


def segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of the radius + 1 segments, widths as equal as can be."""
    m = radius + 1
    at = [round(i * BITS / m) for i in range(m + 1)]
    return [(at[i], at[i + 1] - at[i]) for i in range(m)]


def chain_masks(radius: int) -> list[list[tuple[int, int]]]:
    """For each start: (bits of the chain's first l segments, most differing bits) for l = 2 to radius + 1."""
    parts = segments(radius)
    m = len(parts)
    found = []
    for i in range(m):
        mask, row = 0, []
        for n in range(1, m + 1):
            low, width = parts[(i + n - 1) % m]
            mask |= ((1 << width) - 1) << low
            if n > 1:
                row.append((mask, n * radius // m))
        found.append(row)
    return found


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, key, fp): the fingerprint of each row as a signed long; key is the text's hash.

    Places of words are exploded, hashed and voted on in one generated stage. Each of 32 sums
    counts two bits, one in either half of a long. Rows of one id and text come out as often as they went in.
    """
    text = docs[text_col].cast("string")
    w = F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SPACES), "")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(w, F.array().cast("array<string>")).alias("w"))
    p = F.col("p")
    placed = own.select("doc_id", "key", "w", F.posexplode_outer("w").alias("p", "_word")).filter(p.isNull() | (p == 0) | (p + k <= F.size("w")))
    shingle = F.concat_ws(" ", *[F.get("w", p + i) for i in range(k)])
    hashed = placed.select("doc_id", "key", "p", F.when(p.isNotNull(), F.xxhash64(shingle)).alias("h"))
    half = (1 << BITS // 2) - 1
    pairs = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND((1 << BITS // 2) + 1)).alias(f"s{i}") for i in range(BITS // 2)]
    votes = hashed.groupBy("doc_id", "key").agg(F.count("p").alias("shingles"), F.count(F.when(p.isNull() | (p == 0), 1)).alias("copies"), *pairs)
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        s = F.col(f"s{b % 32}")
        ones = s.bitwiseAND(half) if b < 32 else F.shiftrightunsigned(s, 32)
        fp = fp.bitwiseOR(F.when(2 * ones > F.col("shingles"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(0))
    folded = votes.select("doc_id", "key", fp.alias("fp"), "copies")
    # copies in two steps, so that no list is long
    blocks = folded.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 4096))))
    return blocks.select("doc_id", "key", "fp", F.explode(F.array_repeat(F.lit(0), F.least(F.col("copies") - F.col("i") * 4096, F.lit(4096)).cast("int"))).alias("_")).drop("_")


def _near(x: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Positions in x (differences) that pass every link of the chain; the last is the full distance."""
    where = np.arange(len(x))
    for mask, most in chain:
        ok = np.bitwise_count(x & np.uint64(mask)) <= most
        x, where = x[ok], where[ok]
        if not len(x):
            break
    return where


def connect(fps: np.ndarray, chain: list[tuple[int, int]], block: int = 512) -> list[tuple[int, int]]:
    """Links (positions) that connect all members of a bucket that the chain connects."""
    n = len(fps)
    if n < 2:
        return []
    if n <= block:
        a, b = np.triu_indices(n, 1)
        ok = _near(fps[a] ^ fps[b], chain)
        if len(ok) <= 4 * n:
            return list(zip(a[ok].tolist(), b[ok].tolist(), strict=True))
    links: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left):  # breadth first: each member is compared once with those not yet reached
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            ok = _near(fps[left] ^ fps[p], chain)
            if len(ok):
                found = left[ok]
                links += [(p, int(q)) for q in found]
                queue += found.tolist()
                left = np.delete(left, ok)
    return links


def bucket_rows(fps: DataFrame, radius: int, dense: int) -> DataFrame:
    """(bucket, segment, fp): where fingerprints meet; dense buckets are dealt anew by the chain's second segment."""
    parts = segments(radius)
    m = len(parts)
    value = lambda i: F.shiftrightunsigned("fp", parts[i][0]).bitwiseAND((1 << parts[i][1]) - 1)
    seg = fps.select("fp", F.posexplode(F.array(*[value(i) for i in range(m)])).alias("segment", "v"))
    seg = seg.withColumn("home", F.col("segment").cast("long") * (1 << 13) + F.col("v"))
    # at most (radius + 1) * 2**13 rows, whatever the input
    heavy = seg.groupBy("home").count().filter(F.col("count") > dense).select("home", F.lit(True).alias("heavy"))
    seg = seg.join(F.broadcast(heavy), "home", "left")
    light = seg.filter(F.col("heavy").isNull()).select(F.col("home").alias("bucket"), "segment", "fp")
    chosen = F.element_at(F.array(*[value((i + 1) % m) for i in range(m)]), F.col("segment") + 1)
    width = F.element_at(F.array(*[F.lit(parts[(i + 1) % m][1]) for i in range(m)]), F.col("segment") + 1)
    # a visitor goes only where its value is the larger, so each pair of values meets in one place
    flips = F.filter(F.transform(F.sequence(F.lit(0), width - 1), lambda b: chosen.bitwiseXOR(F.expr("1L") * F.pow(F.lit(2), b).cast("long"))), lambda x: x < chosen)
    again = seg.filter(F.col("heavy")).select("home", "segment", "fp", F.explode(F.concat(F.array(chosen), flips)).alias("u"))
    return light.union(again.select((F.lit(1 << 40) + F.col("home") * (1 << 14) + F.col("u")).alias("bucket"), "segment", "fp"))


def links(fps: DataFrame, *, radius: int = 4, dense: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within the radius."""
    chains = chain_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush(keys, seg, fp, upto):
            edges_a, edges_b = [], []
            cuts = np.flatnonzero(np.diff(keys[:upto])) + 1
            bounds = np.concatenate([[0], cuts, [upto]]) if upto else np.zeros(1, np.int64)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo > 1:
                    own = fp[lo:hi]
                    for p, q in connect(own, chains[seg[lo]]):
                        edges_a.append(own[p])
                        edges_b.append(own[q])
            a, b = np.array(edges_a, np.uint64).view(np.int64), np.array(edges_b, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in task_batches(batches):
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            now[2] = now[2].view(np.uint64)
            if kept:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            upto = int(np.searchsorted(now[0], now[0][-1]))
            if upto:
                yield flush(*now, upto)
            kept = [x[upto:] for x in now]
        if kept and len(kept[0]):
            yield flush(*kept, len(kept[0]))

    dealt = bucket_rows(fps, radius, dense).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, k: int = 4, dense: int = 2048) -> DataFrame:
    """(doc_id, key, fp, group, component_id) of each row: its text's hash, fingerprint and group; component_id is the group's smallest id.

    `group` tells groups apart even where ids repeat with different texts, so that two groups have the same smallest id.
    """
    own = cut(fingerprints(docs, id_col=id_col, text_col=text_col, k=k))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")))
    roots = components(links(fps.select("fp"), radius=radius, dense=dense), "a", "b")
    placed = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("group")))
    names = cut(placed.groupBy("group").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("members")))
    by_fp = cut(spread_join(placed, names, "group", "members").select("fp", "n", "group", "component_id"))
    return spread_join(own, by_fp, "fp", "n").select("doc_id", "key", "fp", "group", "component_id")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
