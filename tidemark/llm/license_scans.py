"""License scans: templates retrieved by MinHash bands over overlapping text windows, verified by exact containment.

DataFrame functions only. Words are maximal runs of ASCII letters and digits of the lower-cased text; shingles are five
words. Templates are cut into passages of at most ``MAX_PASSAGE`` shingles. A passage of n shingles belongs to the size
class c, the power of two with c/2 < n <= c; documents are cut into windows of 2c shingles that begin every c shingles,
so a passage lies whole in one of them. A template of fewer than five words is one shingle of all its words and is sought
among the document's shingles of that width. Windows without any shingle of a passage are left out before anything else
(lossless: a passage that is contained shares shingles).

Bands have one MinHash value each. Containment 0.8 or more in such a window means a Jaccard similarity of 0.19 or more
((0.8 n) / (2c + 0.2 n) at n just over c/2), so ``BANDS`` = 64 bands meet with probability 1 - 0.81**64 > 0.999998.
Pairs met are verified exactly, on the words and not on hashes: a template is reported for a document if one window
holds ``threshold`` (0.8) or more of the distinct shingles of one of its passages.

Scale: documents are read where they are and only windows that hold template shingles go on, so nothing is shuffled but
the windows met (by document, pre-aggregated). The template side is a given list; its passages, of a bounded size each, are
worked through in blocks of about ``block``, whose bands are some ten thousand rows: a proven bound for their broadcast.

Null and empty texts have no windows; templates without words are sought nowhere; very long texts are cut into windows
whole, in memory that grows with them; repeated rows count as rows of one doc_id, null doc_ids as one document; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 64
MAX_PASSAGE = 128
THRESHOLD = 0.8

#: Notices as their licences word them, and the two short licences whole.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashes_of(words: Column, width: int = SHINGLE) -> Column:
    """64-bit hash of every shingle of an array of words, in order."""

    def rolled(w: Column) -> Column:
        at = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return _bound(words, rolled)


def shingles_of(words: Column, width: int = SHINGLE) -> Column:
    """The distinct shingles of an array of words as strings."""

    def rolled(w: Column) -> Column:
        at = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, width), " ")))

    return _bound(words, rolled)


def minhashes(hashes: Column) -> Column:
    def seeded(i: int):  # a default argument would be taken for the lambda's index
        return lambda x: F.xxhash64(x, F.lit(i))

    return _bound(hashes, lambda h: F.array(*[F.array_min(F.transform(h, seeded(i))) for i in range(BANDS)]))


def passages_of(templates: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``templates`` (license, template) whose shingles have that width, as passages: license, passage, size_class, shingles, hashes."""
    right = F.size("words") >= SHINGLE if width == SHINGLE else F.size("words") == width
    words = templates.select("license", words_of(F.col("template")).alias("words")).where(right)
    starts = F.sequence(F.lit(1), F.size("words") - width + 1, F.lit(MAX_PASSAGE))
    cut = words.select("license", F.explode(F.transform(starts, lambda s: F.slice("words", s, MAX_PASSAGE + width - 1))).alias("words"))
    n = F.size("words") - width + 1
    return cut.select("license", F.array_join("words", " ").alias("passage"), F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int").alias("size_class"), shingles_of(F.col("words"), width).alias("shingles"), hashes_of(F.col("words"), width).alias("hashes")).distinct()


def _scan_block(docs: DataFrame, passages: DataFrame, threshold: float, width: int) -> DataFrame | None:
    # Bounded by the block: its passages' classes and shingle hashes.
    known = passages.select("size_class", F.explode("hashes").alias("h")).groupBy("size_class").agg(F.collect_set("h").alias("h")).collect()
    if not known:
        return None
    every = F.lit(sorted({h for r in known for h in r["h"]}))
    # Generators keep the optimizer from repeating the work above them inside the filters below.
    found = docs.select("doc_id", "text", F.explode(F.array(hashes_of(words_of(F.col("text")), width))).alias("hashes")).where(F.arrays_overlap("hashes", every))
    found = found.select("doc_id", "hashes", F.explode(F.array(words_of(F.col("text")))).alias("words"))

    def windows(size_class: int, hashes: list[int]) -> Column:
        starts = F.sequence(F.lit(1), F.size("hashes"), F.lit(size_class))
        own = F.filter(starts, lambda s: F.arrays_overlap(F.slice("hashes", s, 2 * size_class), F.lit(sorted(hashes))))
        return F.transform(own, lambda s: F.struct(F.lit(size_class).alias("size_class"), F.slice("words", s, 2 * size_class + width - 1).alias("words"), F.slice("hashes", s, 2 * size_class).alias("hashes")))

    window = found.select("doc_id", F.explode(F.concat(*[windows(r["size_class"], r["h"]) for r in known])).alias("w"))
    banded = window.select("doc_id", F.col("w.size_class").alias("size_class"), F.col("w.words").alias("words"), F.posexplode(minhashes(F.col("w.hashes"))).alias("band", "value"))
    of_passages = passages.select("license", "passage", "size_class", "shingles", F.posexplode(minhashes(F.col("hashes"))).alias("band", "value"))
    met = banded.join(F.broadcast(of_passages), ["size_class", "band", "value"]).dropDuplicates(["doc_id", "license", "passage", "words"])
    share = F.size(F.array_intersect(shingles_of(F.col("words"), width), F.col("shingles"))) / F.size("shingles")
    return met.select("doc_id", "license", share.alias("containment")).where(F.col("containment") >= threshold - 1e-9)


def scan_licenses(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, block: int = 256) -> DataFrame:
    """``docs`` (doc_id, text) under ``templates`` (license, template): doc_id, license, containment (the largest)."""
    named = templates.select("license", "template").distinct()
    n_words = F.size(words_of(F.col("template")))
    widths = [r["w"] for r in named.select(F.least(n_words, F.lit(SHINGLE)).alias("w")).distinct().where("w > 0").orderBy("w").collect()]  # five at most
    scans = []
    for width in widths:
        passages = passages_of(named, width)
        n_blocks = max(1, -(-passages.count() // block))
        part = F.pmod(F.xxhash64("license", "passage"), F.lit(n_blocks))
        scans += [_scan_block(docs, passages.where(part == i), threshold, width) for i in range(n_blocks)]
    scans = [s for s in scans if s is not None]
    if not scans:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment")).where(F.lit(False))
    return reduce(DataFrame.unionByName, scans).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
