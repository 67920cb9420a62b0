"""License scans: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Notices and bodies of licenses, and the license they name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    ("BSD", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER,
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    ),
]
SHINGLE = 2  # words in a shingle: notices have as few as five words
PASSAGE = 8  # words in a passage of a template
STRIDE = 8  # words from window to window
WINDOW = PASSAGE + STRIDE - 1  # so that a passage lies whole in a window wherever it starts
BANDS = 32  # of one row each


def _words(text: Column) -> Column:
    """Lower-case words of letters and digits with what joins them (``by-nc``, ``4.0``)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*"), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _minima(hashes: Column) -> Column:
    """The least of the shingles' hashes under each of BANDS hash functions: the hash of the hash and the function's number."""
    under = lambda i: F.transform(hashes, lambda h: F.xxhash64(h, F.lit(i)))
    return F.array(*[F.array_min(under(i)) for i in range(BANDS)])


def templates(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """notice, license, start, own (shingles) and lows (minima) of each passage of the notices; longer notices are cut into passages of PASSAGE words."""
    rows = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(NOTICES if notices is None else notices)], "notice int, license string, text string")
    words = rows.select("notice", "license", _words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    last = F.greatest(F.size("w") - PASSAGE, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PASSAGE)), F.array(last)))
    cutout = words.select("notice", "license", F.explode(starts).alias("start"), "w").select("notice", "license", "start", F.slice("w", F.col("start") + 1, PASSAGE).alias("w"))
    return cutout.select("notice", "license", "start", F.array_distinct(_hashes(F.col("w"))).alias("own"), _minima(_hashes(F.col("w"))).alias("lows"))


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, digest, license, notices found, windows and best containment for every license named in a whole text.

    A text is cut into windows of WINDOW words, one every STRIDE, so that a passage of PASSAGE words or fewer
    lies whole in one of them. Windows in which fewer shingles are known from the templates than ``least`` of the
    shortest passage cannot hold one and are left out first, without loss. Each other window has BANDS minimum hashes over its
    two-word shingles and meets the passages that share one of them. A passage of s shingles that lies whole in a
    window of WINDOW - 1 shingles has Jaccard similarity s / (WINDOW - 1) or more with it and shares one of the
    BANDS minima with probability 1 - (1 - s / (WINDOW - 1)) ** BANDS or more: 0.99998 for a five-word notice, more
    for longer ones. Retrieved pairs are verified by exact containment: the share of the passage's
    shingles that the window has, ``least`` or more. A notice of several passages is found if the shingles of its found passages make up
    ``least`` of all its passages' shingles; that share is its containment.

    The templates are a parameter of fixed size, so their shingles and minima go to the tasks as literals and a
    broadcast; hot notices are counted in the task that found them before anything is shuffled.

    Null and empty texts and those of one word have no licenses, and no notices find nothing; a null doc_id is kept;
    repeated rows with equal id and text count as one; texts of fewer than WINDOW words are one window.
    """
    known = templates(docs.sparkSession, notices)
    shingles = sorted({h for r in known.select("own").collect() for h in r["own"]})  # the templates' own, a few thousand at most
    fewest = min((r["n"] for r in known.select(F.ceil(F.size("own") * least - 1e-9).alias("n")).distinct().collect()), default=1)
    is_known = (lambda h: h.isin(shingles)) if shingles else (lambda h: F.lit(False))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where(F.size("w") >= SHINGLE)
    hashed = rows.select("doc_id", "digest", _hashes(F.col("w")).alias("h"))
    at = F.filter(F.transform("h", lambda h, i: F.when(is_known(h), i).otherwise(-1)), lambda i: i >= 0)
    hashed = hashed.withColumn("at", at).where(F.size("at") >= fewest)
    last = F.greatest(F.ceil((F.size("h") - (WINDOW - 1)) / STRIDE), F.lit(0)).cast("int")
    span = WINDOW - 1
    # a shingle lies in the window that starts at or before it, and in the one before that if that one reaches so far
    first = F.transform("at", lambda i: F.floor(i / STRIDE).cast("int"))
    reach = F.filter(F.concat(first, F.transform(first, lambda k: k - 1)), lambda k: (k >= 0) & (k <= last))
    window = lambda k: F.slice("h", k * STRIDE + 1, span)
    windows = hashed.select("doc_id", "digest", "h", F.explode(F.array_distinct(reach)).alias("k")).select("doc_id", "digest", "k", window(F.col("k")).alias("own"))
    windows = windows.where(F.size(F.array_distinct(F.filter("own", is_known))) >= fewest)
    lows = windows.select("doc_id", "digest", "k", "own", F.posexplode(_minima(F.col("own"))).alias("band", "low"))
    keys = known.select("notice", "license", "start", F.col("own").alias("passage"), F.posexplode("lows").alias("band", "low"))
    met = lows.join(F.broadcast(keys), ["band", "low"])  # BANDS rows a passage of the fixed templates
    shared = F.size(F.array_intersect("passage", "own"))
    held = met.select("doc_id", "digest", "license", "notice", "start", "k", shared.alias("shared"), F.size("passage").alias("size")).where(F.col("shared") >= F.col("size") * least - 1e-9)
    once = held.groupBy("doc_id", "digest", "license", "notice", "start").agg(F.max("shared").alias("shared"), F.countDistinct("k").alias("windows"))
    whole = known.groupBy("notice").agg(F.sum(F.size("own")).alias("size"))
    named = once.groupBy("doc_id", "digest", "license", "notice").agg(F.sum("shared").alias("shared"), F.max("windows").alias("windows"))
    named = named.join(F.broadcast(whole), "notice").withColumn("containment", F.col("shared") / F.col("size")).where(F.col("containment") >= least - 1e-9)
    return named.groupBy("doc_id", "digest", "license").agg(F.count("*").alias("notices"), F.max("windows").alias("windows"), F.max("containment").alias("containment"))
