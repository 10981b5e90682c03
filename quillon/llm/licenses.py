"""License scan by a positional index of rare words.

Templates (short license notices, and the terms of short licenses) are kept as words with positions. Document
frequencies of the template words are counted over all documents. For each file
and template, the template's `rare_words` highest-IDF words that occur in the file
are looked up; each occurrence votes for the place where that template would
begin. So no template takes another's words away, whatever else a file holds. A
template whose looked-up words agree on a place, within `slack` words, is a
candidate; it is reported if all of its mandatory key phrases stand within the
span it claims.

Base places (fixed phrases) are counted on every text whatever the index says.

Words: A-Z lowered, parted at ASCII characters other than letters and digits.

Cases: a null, empty or wordless text has no places and no labels; repeated rows
are judged each for itself; an empty table gives an empty result; other columns
are ignored. One pass counts, one judges; neither shuffles texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import ALNUM_WORDS, Words, buffers, pieces, task_batches

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices and terms of well-known public licenses and the phrases that must stand in each. `bsd` is the family, whatever its clauses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("deal in the software without restriction", "sublicense and or sell copies of the software")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", ("gnu general public license", "free software foundation", "either version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", ("gnu general public license", "free software foundation", "either version 2")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is", ("redistribution and use in source and binary forms", "distribution this software is provided by")),
    ("bsd-2", "released under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "neither the name of", "endorse or promote products derived from this software")),
    ("bsd-3", "released under the bsd 3 clause license", ("bsd 3 clause",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0", ("waived all copyright and related or neighboring rights",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("fee is hereby granted provided that the above copyright notice",)),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties", ("fee is hereby granted the software is provided as is",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("held liable for any damages arising from the use of this software", "redistribute it freely")),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that these words have in any text."""
    data, offsets = buffers(pa.array(words))
    return Words(data, offsets, ALNUM_WORDS).hashes()


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted word hashes
    maybe: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))  # low bits of those hashes
    openings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # first two words of each phrase, as one number
    words: list[dict[int, list[int]]] = field(default_factory=list)  # of each template: word, places in it
    templates: list[tuple[str, int, tuple[tuple[int, ...], ...]]] = field(default_factory=list)
    base: list[tuple[tuple[int, ...], str]] = field(default_factory=list)


def build() -> Index:
    """Words become their places in the sorted vocabulary; phrases become tuples of those."""
    texts = [t for _, t, keys in TEMPLATES] + [k for _, _, keys in TEMPLATES for k in keys] + list(BASE)
    names = sorted({w for t in texts for w in t.split()})
    hashes = word_hashes(names)
    order = np.argsort(hashes)
    number = {names[o]: i for i, o in enumerate(order)}
    code = lambda t: tuple(number[w] for w in t.split())
    index = Index(hashes[order])
    for label, text, keys in TEMPLATES:
        places = defaultdict(list)
        for at, w in enumerate(code(text)):
            places[w].append(at)
        index.words.append(dict(places))
        index.templates.append((label, len(text.split()), tuple(map(code, keys))))
    index.base = [(code(p), label) for p, label in BASE.items()]
    index.maybe[(index.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    phrases = [p for p, _ in index.base] + [k for _, _, keys in index.templates for k in keys]
    index.openings = np.unique([p[0] * len(names) + p[1] for p in phrases])
    return index


def _vocabulary_words(w: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(word places, vocabulary numbers) of a piece's words that templates hold."""
    h = w.hashes()
    where = np.flatnonzero(index.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    h = h[where]
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    sure = index.vocabulary[at] == h
    return where[sure], at[sure]


def document_frequencies(docs: DataFrame, index: Index, text_col: str) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each vocabulary word), counted over all documents."""
    vocabulary = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(0)):
                w = Words(data, offsets, ALNUM_WORDS, lower=True)
                where, word = _vocabulary_words(w, index)
                doc = np.searchsorted(w.at, where, "right") - 1
                for lo in range(0, j - i, 4096):
                    held = np.zeros((min(4096, j - i - lo), len(vocabulary)), bool)
                    some = slice(*np.searchsorted(doc, [lo, lo + 4096]))
                    held[doc[some] - lo, word[some]] = True
                    df += held.sum(0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df], pa.list_(pa.int64()))], ["n", "df"])

    # one row of the vocabulary's fixed length a task
    got = small_batches(docs).select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "n long, df array<long>")
    total = got.agg(F.sum("n").alias("n"), *[F.sum(F.get("df", F.lit(i))).alias(f"w{i}") for i in range(len(vocabulary))]).first()
    return total["n"] or 0, np.array([total[f"w{i}"] or 0 for i in range(len(vocabulary))])


def _places(sequence: dict[int, int], phrase: tuple[int, ...], among: list[int]) -> list[int]:
    """Places where the phrase's words stand consecutively."""
    return [p for p in among if all(sequence.get(p + k) == w for k, w in enumerate(phrase))]


def judge(where: np.ndarray, word: np.ndarray, index: Index, idf: np.ndarray, rare_words: int, slack: int, agree: float) -> tuple[list[int], set[str], set[str], float]:
    """(base places, base labels, all labels, score) of one document's template words."""
    sequence = dict(zip(where.tolist(), word.tolist(), strict=True))
    by_word: dict[int, list[int]] = defaultdict(list)
    for p, w in sequence.items():
        by_word[w].append(p)
    found, base, score = [], set(), 0.0
    for phrase, label in index.base:
        places = _places(sequence, phrase, by_word.get(phrase[0], []))
        if places:
            base.add(label)
            found += places
    labels = set(base)
    for t, (label, n, keys) in enumerate(index.templates):
        if label in labels:
            continue
        said = [_places(sequence, k, by_word.get(k[0], [])) for k in keys]
        if not all(said):
            continue
        held = set(sorted((w for w in index.words[t] if w in by_word), key=lambda w: (-idf[w], w))[:rare_words])
        votes: dict[int, set[int]] = defaultdict(set)
        for w in held:
            for at in index.words[t][w]:
                for p in by_word[w]:
                    votes[p - at].add(w)
        for s in votes:
            together = set().union(*(votes.get(s + d, set()) for d in range(-slack, slack + 1)))
            if sum(idf[w] for w in together) < agree * sum(idf[w] for w in held):
                continue
            if all(bisect_left(places, s - slack) < bisect_right(places, s + n + slack) for places in said):
                labels.add(label)
                score = max(score, min(1.0, sum(idf[w] for w in together) / max(sum(idf[w] for w in held), 1e-9)))
                break
    return found, base, labels, 1.0 if base else score


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare_words: int = 16, slack: int = 2, agree: float = 0.5) -> DataFrame:
    """Base places, labels and score of each row."""
    index = build()
    n, df = document_frequencies(docs, index, text_col)
    idf = np.log((n + 1) / (df + 0.5))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task_batches(batches):
            for i, j, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, ALNUM_WORDS, lower=True)
                where, word = _vocabulary_words(w, index)
                doc = np.searchsorted(w.at, where, "right") - 1
                # only where a base or key phrase opens can there be a place or a label
                opens = np.zeros(len(where), bool)
                if len(where) > 1:
                    opens[:-1] = (where[1:] == where[:-1] + 1) & (doc[1:] == doc[:-1]) & np.isin(word[:-1] * len(index.vocabulary) + word[1:], index.openings)
                bounds = np.searchsorted(where, w.at)
                rows = [(0, None, None, "", "", 0.0)] * (j - i)
                for d in np.unique(doc[opens]).tolist():
                    mine = slice(bounds[d], bounds[d + 1])
                    found, base, labels, score = judge(where[mine] - w.at[d], word[mine], index, idf, rare_words, slack, agree)
                    rows[d] = (len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts.astype(np.int64)), *columns], [f.split()[0] for f in SCHEMA.split(", ")])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
