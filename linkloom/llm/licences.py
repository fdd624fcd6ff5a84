"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A text is one run of words, so a notice may wrap over lines and stand behind comment marks. For every
template each window of as many words (the whole text, if it is shorter) is a sparse vector of word counts
times inverse document frequency. Frequencies are counted over all words of all texts; a word that fewer
than ``RARE`` of the texts have weighs as if so many had it, in templates as in texts, so the words with a
weight of their own are at most 1 / RARE times the mean number of distinct words in a text, and only those
are collected and broadcast.

The cosine has a bound that is a ratio of running sums, as a window's norm is at least that of its words
taken one by one. Windows whose bound reaches ``ACCEPT`` are worked out exactly, best bound first, until no
bound is above what was found. A file's own licence is its best template. Files without one inherit that of
the nearest directory above them that holds a licence file.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, resident, sized_parts, small_batches, stash, vacate

ACCEPT = 0.8
#: Share of the texts below which a word weighs no more.
RARE = 0.001

# Wording of common licences and of their usual notices.
_MIT_TERMS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission."
)
_GNU_HEADER = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; "
    "either version {2} of the License, or (at your option) any later version."
)
_CREATIVE = "This work is licensed under a Creative Commons {0} {1} International License."
TEMPLATES = [
    ("AGPL-3.0", _GNU_HEADER.format("program", "Affero ", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD_TERMS),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_THIRD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CREATIVE.format("Attribution", "4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CREATIVE.format("Attribution-NonCommercial", "4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CREATIVE.format("Attribution-ShareAlike", "4.0")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU_HEADER.format("program", "", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU_HEADER.format("program", "", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU_HEADER.format("library", "Lesser ", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU_HEADER.format("library", "Lesser ", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License Copyright (c)"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT_TERMS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Every licence also has its SPDX line, with the suffixes that identifiers may have.
_SPDX = [(name, f"SPDX-License-Identifier: {name}{end}") for name in dict.fromkeys(n for n, _ in TEMPLATES) for end in ("", *(("-only", "-or-later") if "GPL" in name else ()))]


def words(text: str) -> list[str]:
    """Lower-case words of letters and digits, with single dots and hyphens inside."""
    return _WORD.findall(text.lower())


_TEMPLATE_WORDS = [(name, words(text)) for name, text in TEMPLATES + _SPDX]


class Matcher:
    """Cosines to the templates under given document frequencies."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        least = documents * RARE
        weigh = lambda n: math.log((1 + documents) / (1 + max(n, least))) + 1
        vocabulary = sorted({w for _, ws in _TEMPLATE_WORDS for w in ws} | set(frequency))
        self.place = {w: i for i, w in enumerate(vocabulary)}
        #: by place, the last for all other words
        self.weight = np.array([weigh(frequency.get(w, 0)) for w in vocabulary] + [weigh(0)])
        self.templates = []
        for name, ws in _TEMPLATE_WORDS:
            count = Counter(ws)
            norm = math.sqrt(sum((n * self.weight[self.place[w]]) ** 2 for w, n in count.items()))
            gain = np.zeros(len(vocabulary) + 1)  # what each occurrence of a word adds to the product of window and template
            for w, n in count.items():
                gain[self.place[w]] = n * self.weight[self.place[w]] ** 2 / norm
            self.templates.append((name, len(ws), gain))

    def best(self, texts: list[str]) -> list[tuple[float, str | None]]:
        """For each text its highest cosine, if it reaches ``ACCEPT``, and the licence; of equal ones the longest template's, then the first's."""
        split = [words(t) for t in texts]
        sizes = np.array([len(ws) for ws in split], np.int64)
        other = len(self.place)
        look = self.place.get
        ids = np.fromiter((look(w, other) for ws in split for w in ws), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        square = np.concatenate(([0.0], np.cumsum(self.weight[ids] ** 2)))
        found: dict[int, list[tuple[float, int, int, int]]] = {}
        for t, (_, length, gain) in enumerate(self.templates):
            product = np.concatenate(([0.0], np.cumsum(gain[ids])))
            short = np.flatnonzero((sizes > 0) & (sizes <= length))
            first = [starts[short]]
            last = [ends[short]]
            if len(ids) > length:
                # a window can reach the bar only where it gains a part of what the template has
                at = np.flatnonzero(product[length:] - product[:-length] >= ACCEPT * np.sqrt(square[length:] - square[:-length]) - 1e-9)
                text = np.searchsorted(ends, at, "right")
                at = at[(at + length <= ends[text]) & (sizes[text] > length)]
                first.append(at)
                last.append(at + length)
            a, b = np.concatenate(first), np.concatenate(last)
            total = np.sqrt(np.maximum(square[b] - square[a], 1e-12))
            bound = (product[b] - product[a]) / total
            keep = bound >= ACCEPT - 1e-9
            for i, x, y, u in zip(np.searchsorted(ends, a[keep], "right").tolist(), a[keep].tolist(), b[keep].tolist(), bound[keep].tolist(), strict=True):
                found.setdefault(i, []).append((-u, t, x, y))
        out: list[tuple[float, str | None]] = [(0.0, None)] * len(texts)
        for i, windows in found.items():
            top = (0.0, 0, 0)
            for u, t, x, y in sorted(windows):
                if -u < top[0] - 1e-9:
                    break
                score = (round(self._cosine(ids[x:y], t), 12), self.templates[t][1], -t)
                if score[0] >= ACCEPT and score > top:
                    top = score
            if top[0]:
                out[i] = top[0], self.templates[-top[2]][0]
        return out

    def _cosine(self, ids: np.ndarray, t: int) -> float:
        each, n = np.unique(ids, return_counts=True)
        known = each < len(self.place)
        # words without a place of their own are taken for different ones
        norm = math.sqrt(((n[known] * self.weight[each[known]]) ** 2).sum() + n[~known].sum() * self.weight[-1] ** 2)
        return float((n * self.templates[t][2][each]).sum() / norm)


_SLICE = 1 << 20
_HELD = 200_000  # distinct words that a task holds before it passes them on


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of texts that have them, summed over what the task has read."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    vacate()
    held: Counter = Counter()
    for _, texts in sized_parts(batches, 0, _SLICE):
        for t in texts:
            held.update(set(words(t.decode("utf-8", "replace"))))
        if len(held) > _HELD:
            yield out(held)
            held = Counter()
    yield out(held)


def _matched(model, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = resident(("licences", tag), lambda: Matcher(*model.value))
        for part, texts in sized_parts(batches, 0, _SLICE):
            score, name = zip(*matcher.best([t.decode("utf-8", "replace") for t in texts]), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["id", "path", "own", "score"])

    return run


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", licence_file: str = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$") -> DataFrame:
    """One row per row of ``files``: id, path, licence, score, origin, licence_path.

    origin: own, inherited or none; score: the file's own best cosine, 0 if none reaches ``ACCEPT``;
    licence_path: the file that the licence comes from. Several licence files in one directory: the one of
    the highest cosine counts, then the smallest path. Null texts have no licence of their own; a null
    path lies in the root directory. Repeated rows get equal results.
    """
    small_batches(files.sparkSession)
    rows = pick(files, text=text_col, id=id_col, path=path_col).withColumn("path", F.coalesce("path", F.lit("")))
    kind = dict(rows.dtypes)["id"]
    n = rows.count()
    counts = rows.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = counts.filter(F.col("n") > n * RARE).toArrow()
    model = files.sparkSession.sparkContext.broadcast((n, dict(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True))))
    own = rows.mapInArrow(_matched(model, uuid.uuid4().hex), f"id {kind}, path string, own string, score double")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = stash(own.withColumn("folder", folder), "own")

    better = F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), F.col("own").alias("l"))
    named = own.filter(F.col("own").isNotNull() & F.col("path").rlike(licence_file)).groupBy("folder").agg(F.min(better).alias("best"))
    named = stash(named.select(F.col("folder").alias("above"), F.col("best.l").alias("given"), F.col("best.p").alias("licence_path")), "named")
    # each directory finds its nearest licensed ancestor, itself included; files then join their directory
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    folders = own.select("folder").distinct().select("folder", F.inline(F.array_distinct(ancestors)))
    nearest = folders.join(named, "above").groupBy("folder").agg(F.max(F.struct("depth", "given", "licence_path")).alias("near"))
    nearest = stash(nearest, "nearest")  # so that the join has no aggregate in its stage and Spark can split a flat directory
    out = own.join(nearest, "folder", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "id", "path",
        F.coalesce("own", "near.given").alias("licence"), "score",
        F.when(mine, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("near.licence_path")).alias("licence_path"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, source) as files: source/thousands/hundreds/name.

    A text of at most 50 words that names a licence is taken for the licence file of its directory.
    """
    docs = pick(docs, doc_id="doc_id", text="text", source="source")
    short = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")) <= 50) & F.col("text").rlike(r"(?i)licen[sc]e")
    name = F.when(short, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    level = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return docs.select("doc_id", "text", F.concat_ws("/", "source", level(1000), level(100), name).alias("path"))
