"""Licence scans: segments of texts compared to licence templates by Dice, natively.

A segment is a line, or a paragraph of several lines. Normalised (lower case,
letters and digits only) it is a set of word bigrams. Dice coefficient d between
sets of a and b members can reach the threshold only if a lies between
b*d/(2-d) and b*(2-d)/d; these size bounds select the templates a segment is
compared to, by an equi-join on its number of bigrams.

Defined cases: null or empty text has no segment; a segment of fewer than two
words has no bigram and matches nothing; equal scores within a segment go to the
licence first in code-point order; a repeated row counts once; an empty table gives no
rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

THRESHOLD = 0.8
#: The notices by which licences ask to be named, and opening terms of licence texts.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def sizes(n: int, threshold: float) -> range:
    """Sizes of sets whose Dice coefficient with a set of n can reach the threshold."""
    fits = [a for a in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(a, n) >= threshold * (a + n)]
    return range(fits[0], fits[-1] + 1)


def segments(text: Column) -> Column:
    """Lines, and paragraphs of several lines."""
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    return F.concat(lines, F.when(F.contains(text, F.lit("\n")), paragraphs).otherwise(F.array().cast("array<string>")))


def words_of(segment: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(segment), r"[^\p{L}\p{N}]+", " ")), " ")


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, n_segments that match it, and the best score."""
    spark = docs.sparkSession
    known = [(name, bigrams_of(text)) for name, text in templates]
    rows = [(n, name, own, len(own)) for name, own in known for n in sizes(len(own), threshold)]
    # one row for each template and size within its bounds: fixed by the templates, not by the data
    bounds = F.broadcast(spark.createDataFrame(rows, "n int, license_id string, template array<string>, m int"))
    low, high = min(r[0] for r in rows), max(r[0] for r in rows)
    segs = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(segments(F.col(text_col))).alias("segment", "body"))
    words = once(segs, w=words_of(F.col("body"))).where(F.size("w") > low).withColumn("said", F.xxhash64("body"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda k: F.concat_ws(" ", F.get("w", k), F.get("w", k + 1))))
    own = once(words.select("doc_id", "segment", "said", "w"), own=pairs).select("doc_id", "segment", "said", "own", F.size("own").alias("n")).where(F.col("n").between(low, high))
    met = once(own.join(bounds, "n"), both=F.size(F.array_intersect("own", "template")))
    met = met.withColumn("score", 2 * F.col("both") / (F.col("n") + F.col("m"))).where(F.col("score") >= threshold)
    best = met.groupBy("doc_id", "segment", "said").agg(F.min(F.struct((-F.col("score")).alias("s"), "license_id")).alias("b"))
    return best.groupBy("doc_id", F.col("b.license_id").alias("license_id")).agg(F.count("*").alias("n_segments"), F.round(F.max(-F.col("b.s")), 6).alias("score"))


def sql(threshold: float = THRESHOLD, templates: tuple = TEMPLATES) -> str:
    """DuckDB: every segment against every template, without the bounds."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, bigrams_of(text)))}])" for name, text in templates)
    return rf"""
WITH templates(license_id, template) AS (VALUES {values}),
docs AS (SELECT DISTINCT doc_id, "text" AS r, string_split("text", chr(10)) AS lines,
    list_filter(regexp_split_to_array("text", '\n[ \t\r]*\n'), lambda p: contains(trim(p, ' '), chr(10))) AS paragraphs FROM documents WHERE "text" IS NOT NULL),
segs AS (SELECT doc_id, r, unnest(list_concat(lines, paragraphs)) AS body, generate_subscripts(list_concat(lines, paragraphs), 1) AS segment FROM docs),
words AS (SELECT doc_id, r, segment, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM segs),
sets AS (SELECT doc_id, r, segment, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS own FROM words WHERE len(w) >= 2),
met AS (SELECT doc_id, r, segment, license_id, 2.0 * len(list_intersect(own, template)) / (len(own) + len(template)) AS score FROM sets, templates
  WHERE len(own) <= 4 * len(template) AND len(template) <= 4 * len(own)),
best AS (SELECT doc_id, r, segment, license_id, score FROM met WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, r, segment ORDER BY score DESC, license_id) = 1)
SELECT doc_id, license_id, count(*) AS n_segments, round(CAST(max(score) AS DOUBLE), 6) AS score FROM best GROUP BY doc_id, license_id
"""
