"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. Each bit has a binary classifier over
hashed byte trigrams (log ratios of the trigram's frequency in the languages with
+1 and in those with -1, each language weighing the same). Decoding weighs each
bit's exponential loss by how often that bit is right for that language in
training, and takes the language of least loss; a small lead over the second is
flagged as ambiguous.

Training reads at most about `sample_per_lang` rows of each of the `most_langs` most
frequent languages, chosen by a hash of the id; prediction reads whole texts, row by row, without a shuffle.

Cases: a null text, or one without a letter, is `und` with score 0; a table
without usable labels makes every row `und`; one language only is always that
language; repeated rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import LOWER, pieces, task_batches

GRAMS = 1 << 13
UNKNOWN = "und"
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = True
#: Documents whose grams are counted at once.
BLOCK = 256


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: exhaustive for up to 7 classes, else random codes far apart."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        rest = [x for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array([(1, *x) for x in rest], np.int8).T.copy()
    rng, bits, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        m = rng.choice(np.array([1, -1], np.int8), (n, bits))
        m = m[:, np.abs(m.sum(0)) < n]
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > apart:
            best, apart = m, d
    return best


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, GRAMS) counts of the hashed byte trigrams of each lower-cased text with a space at either end."""
    n = len(offsets) - 1
    padded, own = np.full(len(data) + 2 * n, 0x20, np.uint8), np.ones(len(data) + 2 * n, bool)
    at = offsets + 2 * np.arange(n + 1)
    own[at[:-1]] = own[at[1:] - 1] = False
    padded[own] = LOWER[data]
    wide = padded.astype(np.uint32)
    code = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    start = np.arange(len(doc)) + 2 * doc  # len(text) grams in each document
    return np.bincount(doc * GRAMS + code[start], minlength=n * GRAMS).reshape(n, GRAMS)


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first, last + 1, counts, bytes, offsets) of a batch's rows."""
    for i, j, data, offsets in pieces(column):
        for lo in range(0, j - i, BLOCK):
            hi = min(lo + BLOCK, j - i)
            part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            yield i + lo, i + hi, gram_counts(part, off), part, off


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (GRAMS, bits)
    trust: np.ndarray  # (languages, bits)

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        z = np.clip(margins[:, None, :] * self.code[None].astype(np.float32), -8, 8)
        return (np.exp(-z) * self.trust[None]).sum(2)


def bit_weights(sums: np.ndarray, code: np.ndarray, alpha: float) -> np.ndarray:
    """(GRAMS, bits) log ratios from (languages, GRAMS) counts."""
    p = (sums + alpha) / (sums.sum(1, keepdims=True) + alpha * GRAMS)
    return np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1).astype(np.float32)


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample_per_lang: int, most_langs: int = 256, alpha: float = 0.5) -> Model:
    """Learn from rows with a language, at most about sample_per_lang of each of the most_langs most frequent ones (documented bounds;
    rows chosen by hash). A bit's trust is measured crosswise: the classifiers of either half of the sample on the other half."""
    rows = small_batches(docs).select(docs[id_col].alias("k"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return Model(langs, code, np.zeros((GRAMS, 0), np.float32), np.ones(code.shape, np.float32))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / v)))])
    number = lambda salt, n: F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(salt)), F.lit(n))
    picked = rows.filter(number("lang", 1 << 20) < share[F.col("lang")] * (1 << 20)).select("text", "lang", number("half", 2).alias("half"))
    index = {x: i for i, x in enumerate(langs)}

    def labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.array([index[x] for x in batch.column(1).to_pylist()], np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(langs), GRAMS), np.int64)
        for batch in task_batches(batches):
            lang, half = labels(batch)
            for i, j, counts, _, _ in counted(batch.column(0)):
                np.add.at(sums, (half[i:j], lang[i:j]), counts)
        half, lang = np.nonzero(sums.sum(2))
        yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(lang), pa.array(list(sums[half, lang]), pa.list_(pa.int64()))], ["half", "lang", "grams"])

    # two rows of fixed length per language and task of the bounded sample, summed where they meet
    got = picked.mapInArrow(run, "half long, lang long, grams array<long>")
    sums = np.zeros((2, len(langs), GRAMS), np.float64)
    each = got.select("half", "lang", F.posexplode("grams").alias("g", "c")).filter("c > 0").groupBy("half", "lang", "g").agg(F.sum("c").alias("c"))
    table = each.toArrow()
    sums[table["half"].to_numpy(), table["lang"].to_numpy(), table["g"].to_numpy()] = table["c"].to_numpy()
    model = Model(langs, code, bit_weights(sums.sum(0), code, alpha), np.ones(code.shape, np.float32))
    crosswise = [Model(langs, code, bit_weights(sums[1 - h], code, alpha), model.trust) for h in (0, 1)]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(code.shape, np.int64), np.zeros(len(langs), np.int64)
        for batch in task_batches(batches):
            lang, half = labels(batch)
            for i, j, counts, _, _ in counted(batch.column(0)):
                margins = np.where((half[i:j] == 0)[:, None], crosswise[0].margins(counts), crosswise[1].margins(counts))
                np.add.at(right, lang[i:j], margins * code[lang[i:j]] > 0)
                np.add.at(seen, lang[i:j], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs))), pa.array(seen), pa.array(list(right), pa.list_(pa.int64()))], ["lang", "n", "right"])

    trust = np.ones(code.shape)
    tested = picked.mapInArrow(test, "lang long, n long, right array<long>")
    bits = [F.sum(F.get("right", F.lit(b))).alias(f"b{b}") for b in range(code.shape[1])]
    for r in tested.groupBy("lang").agg(F.sum("n").alias("n"), *bits).collect():
        trust[r["lang"]] = [(r[f"b{b}"] + 1) / (r["n"] + 2) for b in range(code.shape[1])]
    model.trust = (trust / trust.sum(1, keepdims=True)).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lead: float = 0.02, keep: tuple[str, ...] = (), with_letters: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row, and the columns named in keep; has_letters on request."""
    langs = np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task_batches(batches):
            for i, j, counts, data, offsets in counted(batch.column(1)):
                letters = np.concatenate([[0], np.cumsum(LETTER[LOWER[data]])])
                known = letters[offsets[1:]] > letters[offsets[:-1]]
                for d in np.flatnonzero(~known):
                    known[d] = any(map(str.isalpha, data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")))
                n = j - i
                best, score, close = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n, bool)
                if len(model.langs) == 1:
                    best, score = np.zeros(n, np.int64), np.ones(n)
                elif model.langs:
                    loss = model.losses(model.margins(counts)).astype(np.float64)
                    ranked = np.sort(loss, 1)
                    best, close = loss.argmin(1), ranked[:, 1] - ranked[:, 0] < lead
                    score = 1 / np.exp(4 * (ranked[:, :1] - loss)).sum(1)
                best, score = np.where(known, best, len(model.langs)), np.where(known, score, 0.0)
                same = [c.slice(i, n) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [same[0], pa.array(langs[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(close & known), *same[2:], *[pa.array(known)][: int(with_letters)]],
                    ["doc_id", "lang_pred", "score", "ambiguous", *keep, *["has_letters"][: int(with_letters)]],
                )

    own = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c] for c in keep])
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:]) + (", has_letters boolean" if with_letters else "")
    return own.mapInArrow(run, f"doc_id long, lang_pred string, score double, ambiguous boolean{extra}")


def fold(id_col) -> F.Column:
    """crc32 of the id's text modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def held_out(id_col) -> F.Column:
    """Whether a row is held out; a null id is not."""
    return F.coalesce(fold(id_col) == 1, F.lit(False))


def fit_on_training_folds(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 4000) -> Model:
    return fit(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, sample_per_lang=sample_per_lang)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 4000) -> DataFrame:
    """Learn from the training folds and predict every row: (doc_id, held_out, lang_pred, score, ambiguous)."""
    model = fit_on_training_folds(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_per_lang=sample_per_lang)
    return predict(docs, model, id_col=id_col, text_col=text_col).withColumn("held_out", held_out("doc_id"))
