"""Licence texts in documents by diagonal voting.

All rolling word k-gram hashes of documents are joined to the positions of licence templates; every match votes for its
diagonal (place in the document minus place in the template); neighbouring diagonals merge into one span, which survives
insertions and deletions of a few words; spans are verified word by word against the text. Licence phrases, found as
consecutive words, are the base; the templates add labels of their own.

What is found depends on a text alone, so matches and spans are keyed by a 128-bit digest of the text: copies are verified
once, and ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.llm import common as C
from tonearc.llm.windows import Known, windows

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-2": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-3": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "bsd-3": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
}


def split(text: str) -> list[bytes]:
    """Words of a short text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return C.WORD_BYTES[raw].tobytes().split()


def _hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _common(own: np.ndarray, theirs: np.ndarray) -> list[int]:
    """Where the words of a longest common subsequence stand in own, ascending."""
    n, m = len(own), len(theirs)
    best = np.zeros((n + 1, m + 1), np.int32)
    same = own[:, None] == theirs[None, :]
    for i in range(n):
        diagonal = best[i, :-1] + same[i]
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(diagonal, best[i, 1:]))
    i, j, at = n, m, []
    while i and j:
        if same[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            at.append(i - 1)
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return at[::-1]


def _densest(at: list[int], least: float) -> tuple[int, int, int]:
    """The stretch (words matched, first, last) of most matched words, each missed one costing as many as keep a share of
    `least`: common words of the prose around an excerpt do not widen it."""
    cost = least / max(1 - least, 1e-9)
    best, found, run, start = 0.0, (0, 0, -1), 0.0, 0
    for k, x in enumerate(at):
        run -= cost * (x - at[k - 1] - 1) if k else 0.0
        if run <= 0:
            run, start = 0.0, k
        run += 1
        if run > best:
            best, found = run, (k - start + 1, at[start], x)
    return found


def _verified(h: np.ndarray, low: int, high: int, wanted: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(similarity, first word, last word) of a template among diagonals low to high of a text's words, if it is there.
    Wide runs are looked at a template's length at a time, so what is compared stays a few templates long."""
    found = None
    for d in range(low, high + 1, len(wanted)):
        a, z = max(0, d), min(len(h), min(high, d + len(wanted)) + len(wanted))
        at = _common(h[a:z], wanted)
        if not at:
            continue
        matched, lo, hi = _densest(at, least)
        options = [(len(at) / len(wanted), a + at[0], a + at[-1]), (matched / max(hi - lo + 1, 20), a + lo, a + hi)]
        share, lo, hi = max(options, key=lambda o: o[0])
        if share >= least and (found is None or share > found[0]):
            found = min(1.0, share), lo, hi
    return found


def _digests(column: pa.Array) -> list[bytes]:
    """128 bits of each text."""
    buf, rows = C.text_bytes(column)
    view = memoryview(buf)
    return [xxhash.xxh3_128_digest(view[a:z]) for a, z in zip(rows[:-1].tolist(), rows[1:].tolist())]


class _Words:
    def __init__(self, column: pa.Array):
        low, starts, ends, self.first = C.words(*C.text_bytes(column))
        self.code, self.pieces = C.distinct_pieces(low, starts, ends)
        own = _hash(self.pieces)
        self.hash = own[self.code] if len(own) else np.zeros(0, np.uint64)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, k: int = 4, votes: int = 2, drift: int = 3, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_words, n_base (places of phrases), first_word, last_word (smallest and largest start of a
    phrase, null without one), base_labels, labels (distinct, sorted, comma-joined), score (1 with a phrase, else the
    best verified similarity, 0 without any), spans (label, first and last word, similarity).

    A span counts if at least `votes` k-grams vote for its diagonals (all of them for templates of fewer) and a share
    `least` of the template's words stands there in order, or a stretch of 20 words or more in which that share of words
    is the template's. A null text counts as empty; rows of null or repeated ids are each judged by their own text; of
    spans that overlap the most similar stays, then the longest, then the smaller label; an empty table gives no rows;
    other columns are ignored."""
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    text = C.id_and_text(docs, id_col, text_col)
    known = [(label, split(t)) for label, some in templates.items() for t in some]
    known = [(label, w) for label, w in known if len(w) >= k]
    rows = []
    for t, (label, w) in enumerate(known):
        at, h = windows(_hash(w), np.array([0, len(w)]), k)
        rows += [(t, int(p), int(x)) for p, x in zip(at, h.view(np.int64))]
    positions = spark.createDataFrame(rows, "template int, template_at int, hash long")  # the templates' own size
    hashes = np.array([r[2] for r in rows], np.int64).view(np.uint64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of phrases, and all k-grams that templates have."""
        wanted, test = [(_hash(split(p)), label) for p, label in phrases.items()], Known(hashes)
        for step in C.text_steps(batches):
            own = _Words(step.column("text"))
            n_rows, n = step.num_rows, np.diff(own.first)
            places, names = [np.zeros(0, np.int64)], [set() for _ in range(n_rows)]
            for h, label in wanted:
                at = np.flatnonzero(own.hash[: max(len(own.hash) - len(h) + 1, 0)] == h[0])
                for j in range(1, len(h)):
                    at = at[own.hash[at + j] == h[j]]
                row = np.searchsorted(own.first, at, side="right") - 1
                inside = at + len(h) <= own.first[row + 1]
                at, row = at[inside], row[inside]
                places.append(at)
                for r in set(row.tolist()):
                    names[r].add(label)
            at = np.concatenate(places)
            row = np.searchsorted(own.first, at, side="right") - 1
            count = np.bincount(row, minlength=n_rows)
            low, high = np.full(n_rows, np.iinfo(np.int64).max), np.full(n_rows, -1)
            np.minimum.at(low, row, at - own.first[row])
            np.maximum.at(high, row, at - own.first[row])
            none = count == 0
            at, h = windows(own.hash, own.first, k)
            keep = test.where(h)
            at, h = at[keep], h[keep]
            row = np.searchsorted(own.first, at, side="right") - 1
            begin = C.prefix(np.bincount(row, minlength=n_rows))
            keys = [key if some else None for key, some in zip(_digests(step.column("text")), np.diff(begin) > 0)]
            yield pa.RecordBatch.from_arrays(
                [
                    step.column("doc_id"), pa.array(n), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([sorted(s) for s in names], pa.list_(pa.string())),
                    pa.array(keys, pa.binary()), C.lists((at - own.first[row]).astype(np.int32), begin, pa.int32()), C.lists(h.view(np.int64), begin, pa.int64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "key", "at", "hashes"],
            )

    looked = C.saved(text.mapInArrow(look, "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, key binary, at array<int>, hashes array<long>"), "licence-words")
    texts = looked.where(F.col("key").isNotNull()).select("key", "at", "hashes").dropDuplicates(["key"])
    grams = texts.select("key", F.explode(F.arrays_zip("at", "hashes")).alias("g")).select("key", F.col("g.at").alias("doc_at"), F.col("g.hashes").alias("hash"))
    hits = grams.join(F.broadcast(positions) if len(rows) * 16 <= C.BROADCAST_BYTES else positions, "hash")
    diagonals = hits.withColumn("diagonal", F.col("doc_at") - F.col("template_at")).groupBy("key", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(0))
    merged = diagonals.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = merged.groupBy("key", "template", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    sizes = [len(w) for _, w in known]
    need = F.element_at(F.array(*[F.lit(min(votes, n - k + 1)) for n in sizes]), F.col("template") + 1)
    voted = C.saved(runs.where(F.col("votes") >= need).groupBy("key").agg(F.collect_list(F.struct("template", "low", "high")).alias("runs")), "licence-spans")

    few = (voted.agg(F.sum(F.size("runs") * 40 + 80)).first()[0] or 0) <= C.BROADCAST_BYTES
    kind = "key binary, spans array<struct<label:string,first:int,last:int,similarity:double>>"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_digests(b.column("text")), pa.binary()), b.column("text")], ["key", "text"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = [(label, _hash(w)) for label, w in known]
        for step in C.text_steps(batches):
            own = _Words(step.column("text"))
            out = []
            for r, runs in enumerate(step.column("runs").to_pylist()):
                h, spans = own.hash[own.first[r] : own.first[r + 1]], []
                for run in runs:
                    label, wanted = theirs[run["template"]]
                    if found := _verified(h, run["low"], run["high"], wanted, least):
                        spans.append({"label": label, "first": found[1], "last": found[2], "similarity": found[0]})
                kept: list[dict] = []
                for s in sorted(spans, key=lambda s: (-s["similarity"], s["first"] - s["last"], s["label"])):
                    if all(s["last"] < o["first"] or s["first"] > o["last"] or (s["similarity"] == o["similarity"] and s["label"] == o["label"]) for o in kept):
                        kept.append(s)
                out.append(sorted(kept, key=lambda s: (s["first"], s["label"])))
            shape = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([step.column("key"), pa.array(out, shape)], ["key", "spans"])

    chosen = text.select("text").mapInArrow(keyed, "key binary, text string").join(F.broadcast(voted) if few else voted, "key")
    spans = chosen.dropDuplicates(["key"]).mapInArrow(verify, kind)  # a text and its copies once
    found = looked.drop("at", "hashes").join(spans, "key", "left")
    own = F.coalesce(F.transform("spans", lambda s: s.label), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s.similarity)), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "spans",
    )
