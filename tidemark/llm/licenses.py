"""License scans: sparse TF-IDF cosines to templates and inheritance from the nearest ancestor directory (operator 5).
DataFrame functions only.

A text is cut into passages twice: into the sentences of its lines, and into the sentences of its paragraphs, where wrapped lines are put
together and marks of comments at their beginnings are left out. Passages and the sentences of the templates become sparse TF-IDF vectors
(a word's weight is 1 + ln of its count, times its inverse document frequency).
Document frequencies of the templates' words are counted over all texts; any other word counts as seen in none, which makes it weigh
most, so that a sentence about something else stays far from every template. Only passages that can come near a template are
compared: the words in which a template carries so much of its weight that without them its cosine stays under MIN_COSINE are known once
the words are counted (`keys`), and a passage without any of them is left out. That loses nothing.

A file's own licence is the one that its passages say with most words (each by its best cosine, from MIN_COSINE), in the cut that says more. A file
that consists of such passages, by at least FILE_SHARE of its words, or that has one and is named like a licence file, is a licence file of its
directory. A file without a licence takes that of the nearest directory above it that has one: paths are joined as distinct
directories, each with its ancestors, never file by file.

Defined results
  text null or empty            no licence of its own; may inherit
  very long text                cut like any other; its passages are dealt one by one
  source or lang null           an empty name in the path
  doc_id null or repeated       each row is a file
  ties                          of equal weights the first licence by name; of a directory's licences the one with most files, then by name
  no licence anywhere           license null, inherited_from null
  empty table                   no rows
  more columns                  ignored
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

MIN_COSINE = 0.5
FILE_SHARE = 0.5
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_SCAN = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"  # the same words, without places to go back to
FILE_NAME = r"^(?:un)?licen[sc]e|^copying|^notice"
#: Indents and marks of comments at the beginning of a line.
LEAD = r"(^|\n)[ \t]*(?:#+|//+|/?\*+/?|;+|--+|%+|>+)?[ \t]*"
_BREAK = "\x01"

#: Fixed value: what the BSD licences have in common.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Texts of widely used licences (short ones whole) and the usual notes that name them. A blank line ends a paragraph.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM "AS IS" WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION.

IN NO EVENT UNLESS REQUIRED BY APPLICABLE LAW OR AGREED TO IN WRITING WILL ANY COPYRIGHT HOLDER, OR ANY OTHER PARTY WHO MAY MODIFY AND/OR REDISTRIBUTE THE PROGRAM AS PERMITTED ABOVE, BE LIABLE TO YOU FOR DAMAGES, INCLUDING ANY GENERAL, SPECIAL, INCIDENTAL OR CONSEQUENTIAL DAMAGES ARISING OUT OF THE USE OR INABILITY TO USE THE PROGRAM (INCLUDING BUT NOT LIMITED TO LOSS OF DATA OR DATA BEING RENDERED INACCURATE OR LOSSES SUSTAINED BY YOU OR THIRD PARTIES OR A FAILURE OF THE PROGRAM TO OPERATE WITH ANY OTHER PROGRAMS), EVEN IF SUCH HOLDER OR OTHER PARTY HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGES."""),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM "AS IS" WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION.

IN NO EVENT UNLESS REQUIRED BY APPLICABLE LAW OR AGREED TO IN WRITING WILL ANY COPYRIGHT HOLDER, OR ANY OTHER PARTY WHO MODIFIES AND/OR CONVEYS THE PROGRAM AS PERMITTED ABOVE, BE LIABLE TO YOU FOR DAMAGES, INCLUDING ANY GENERAL, SPECIAL, INCIDENTAL OR CONSEQUENTIAL DAMAGES ARISING OUT OF THE USE OR INABILITY TO USE THE PROGRAM.

The GNU General Public License is a free, copyleft license for software and other kinds of works."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-3.0", 'As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License.'),
    ("LGPL-3.0", 'An "Application" is any work that makes use of an interface provided by the Library, but which is not otherwise based on the Library. A "Combined Work" is a work produced by combining or linking an Application with the Library.'),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 'Covered Software is provided under this License on an "as is" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing.'),
    ("MPL-2.0", """Under no circumstances and under no legal theory, whether tort (including negligence), contract, or otherwise, shall any Contributor, or anyone who distributes Covered Software as permitted above, be liable to You for any direct, indirect, special, incidental, or consequential damages of any character including, without limitation, damages for lost profits, loss of goodwill, work stoppage, computer failure or malfunction, or any and all other commercial damages or losses, even if such party shall have been informed of the possibility of such damages.

The entire risk as to the quality and performance of the Covered Software is with You. Should any Covered Software prove defective in any respect, You (not any Contributor) assume the cost of any necessary servicing, repair, or correction."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)


def sentences(text: Column) -> Column:
    """Lines and sentences of a lower-case text."""
    return F.split(F.regexp_replace(text, F.lit(r"([.;!?])[ \t\r\n]+"), F.lit("$1\n")), F.lit("\n"))


def wrapped(text: Column) -> Column:
    """Sentences of a lower-case text's paragraphs, wrapped lines put together."""
    lines = F.regexp_replace(F.regexp_replace(text, F.lit("\r"), F.lit("")), F.lit(LEAD), F.lit("$1"))
    joined = F.translate(F.regexp_replace(lines, F.lit("\n\n+"), F.lit(_BREAK)), "\n", " ")
    return F.split(F.regexp_replace(joined, F.lit(r"([.;!?])[ \t]+"), F.lit("$1" + _BREAK)), F.lit(_BREAK))


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SCAN), F.lit(0))


def template_rows(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, str, int]]:
    """(template, license, term, tf) of each sentence of the templates. They are a parameter of bounded size."""
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "at int, license string, text string")
    s = df.select("at", "license", F.posexplode(wrapped(F.lower("text"))).alias("k", "s")).select("at", "license", "k", words("s").alias("w")).where(F.size("w") > 2)
    s = s.unionByName(df.select("at", "license", F.lit(0).alias("k"), words(F.lower("text")).alias("w")).where(F.size("w").between(1, 2)))
    rows = s.select("at", "license", "k", F.explode("w").alias("term")).groupBy("at", "license", "k", "term").agg(F.count(F.lit(1)).alias("tf")).collect()
    number = {x: i for i, x in enumerate(sorted({(r["at"], r["k"]) for r in rows}))}
    return sorted((number[r["at"], r["k"]], r["license"], r["term"], r["tf"]) for r in rows)


def weight(tf: int, idf: float) -> float:
    return (1 + math.log(tf)) * idf


def keys(rows: list[tuple[int, str, str, int]], idf: dict[str, float], min_cosine: float) -> list[str]:
    """Words without all of which no passage reaches the cosine to any template: of each template the heaviest, until what is left of its
    length is under `min_cosine` of it (a cosine is at most the share of a template's length that lies in common words)."""
    by: dict[int, list[tuple[float, str]]] = {}
    for template, _, term, tf in rows:
        by.setdefault(template, []).append((weight(tf, idf[term]) ** 2, term))
    out = set()
    for weights in by.values():
        left = sum(w for w, _ in weights)
        least = max(min_cosine - 1e-5, 0.0) ** 2 * left
        for w, term in sorted(weights, reverse=True):
            if left < least:
                break
            out.add(term)
            left -= w
    return sorted(out)


def scan(files: DataFrame, *, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """files: (doc_id, path, text), path beginning with /. Gives doc_id, path, own_license, own_score, is_license_file, license,
    inherited_from (a directory) for each row. templates: (license, text), of which every sentence is one to compare with."""
    spark = files.sparkSession
    rows = template_rows(spark, templates)
    vocabulary = sorted({r[2] for r in rows})
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))

    # inverse document frequencies: a row for each word of the templates
    seen = files.select(F.explode(F.array_intersect(lits(vocabulary), words(low))).alias("term"))
    df = {r["term"]: r["df"] for r in seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    n = files.count()
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    other = math.log(n + 1) + 1
    key = lits(keys(rows, idf, min_cosine))
    length: dict[int, float] = {}
    for template, _, term, tf in rows:
        length[template] = length.get(template, 0.0) + weight(tf, idf[term]) ** 2
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))  # a row for each word of the templates
    weighed = F.broadcast(spark.createDataFrame([(a, b, t, weight(tf, idf[t]), length[a] ** 0.5) for a, b, t, tf in rows], "template int, license string, term string, tw double, t_norm double"))  # the same for each template

    near = lambda ps: F.filter(ps, lambda s: F.arrays_overlap(words(s), key))
    lines, paragraphs = near(sentences(F.col("low"))), near(wrapped(F.col("low")))
    slim = files.select("doc_id", "path", low.alias("low")).withColumn("_words", words("low"))
    slim = slim.select(
        "doc_id",
        "path",
        F.size("_words").alias("n_words"),
        F.when(F.arrays_overlap("_words", key), F.array(F.struct(F.lit(0).alias("cut"), lines.alias("s")), F.struct(F.lit(1).alias("cut"), paragraphs.alias("s")))).alias("notes"),
    )
    slim = C.materialize(slim.withColumn("row", F.monotonically_increasing_id()), "licenses")

    # passages are dealt once; everything up to the file's sums stays where a passage is
    one = slim.select("row", F.inline("notes")).select("row", "cut", F.posexplode("s").alias("note", "s")).repartition("row", "cut", "note")
    at = ["row", "cut", "note"]
    tf = one.select(*at, F.explode(words("s")).alias("term")).groupBy(*at, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(known, "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other)))
    size = tf.groupBy(*at).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dot = tf.join(weighed, "term").groupBy(*at, "template", "license", "t_norm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dot.join(size, at).select(*at, "license", "words", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score")).where(F.col("score") >= min_cosine)
    said = cosine.groupBy(*at, "license").agg(F.max("words").alias("words"), F.max("score").alias("score"))
    by = said.groupBy("row", "cut", "license").agg(F.round(F.sum(F.col("score") * F.col("words")), 4).alias("weight"), F.max("score").alias("score"))
    own = by.groupBy("row").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "license", (-F.col("score")).alias("score"))).alias("b"))
    passages = said.groupBy(*at).agg(F.max("words").alias("words")).groupBy("row", "cut").agg(F.sum("words").alias("words")).groupBy("row").agg(F.max("words").alias("words"))
    own = own.join(passages, "row").select("row", F.col("b.license").alias("own_license"), (-F.col("b.score")).alias("own_score"), "words")

    found = slim.drop("notes").join(own, "row", "left")
    named = F.regexp_like(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), F.lit(FILE_NAME))
    is_file = F.coalesce((F.col("words") >= F.lit(file_share) * F.col("n_words")) | (F.col("own_license").isNotNull() & named), F.lit(False))
    found = found.withColumns({"is_license_file": is_file, "dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1)})
    found = C.materialize(found, "licenses")

    counted = found.where("is_license_file").groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("files"))
    licensed = counted.groupBy("dir").agg(F.min(F.struct((-F.col("files")).alias("files"), F.col("own_license").alias("license"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("given"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    dirs = found.where("own_license is null").select("dir").distinct().select("dir", F.inline(up))
    near = dirs.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("b")).select("dir", F.col("b.above").alias("above"), F.col("b.given").alias("given"))
    near = C.materialize(near, "licenses")
    if near.count() <= C.BROADCAST_ROWS:
        near = F.broadcast(near)
    inherits = F.col("own_license").isNull()
    return found.join(near, "dir", "left").select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        "is_license_file",
        F.coalesce("own_license", "given").alias("license"),
        F.when(inherits, F.col("above")).alias("inherited_from"),
    )


# ---------------------------------------------------------------- query


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as files of the directories /source/lang."""
    docs = C.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def _sql_rows() -> str:
    """The templates' sentences as SQL, cut by SQL."""
    texts = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    return f"""tx(tx, license, text) AS (VALUES {texts}),
ts AS (SELECT tx, license, k, w FROM (SELECT tx, license, generate_subscripts(p, 1) AS k, regexp_extract_all(unnest(p), '{WORD}') AS w FROM (SELECT tx, license, {_WRAPPED.format("lower(text)")} AS p FROM tx)) WHERE len(w) > 2
  UNION ALL SELECT tx, license, 0, w FROM (SELECT tx, license, regexp_extract_all(lower(text), '{WORD}') AS w FROM tx) WHERE len(w) BETWEEN 1 AND 2),
tpl AS (SELECT dense_rank() OVER (ORDER BY tx, k) AS template, license, term, count(*) AS tf FROM (SELECT tx, license, k, unnest(w) AS term FROM ts) GROUP BY tx, k, license, term)"""


_WRAPPED = (
    "string_split(regexp_replace(translate(regexp_replace(regexp_replace(replace({0}, chr(13), ''), '" + LEAD + "', '\\1', 'g'), chr(10) || chr(10) || '+', chr(1), 'g'), chr(10), ' '), '([.;!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1))"
)
ORACLE_SQL = rf"""
WITH {_sql_rows()},
f AS (SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') AS dir, lower(coalesce(text, '')) AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS words FROM f),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(words) AS term FROM w) JOIN (SELECT DISTINCT term FROM tpl) USING (term) GROUP BY term),
n AS (SELECT count(*) AS n FROM f),
known AS (SELECT term, ln(CAST(n + 1 AS DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tpl) LEFT JOIN df USING (term), n),
tw AS (SELECT template, license, term, (1 + ln(tf)) * idf AS tw FROM tpl JOIN known USING (term)),
tn AS (SELECT template, sqrt(sum(tw * tw)) AS t_norm FROM tw GROUP BY template),
s AS (SELECT doc_id, 0 AS cut, unnest(string_split(regexp_replace(low, '([.;!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM f
  UNION ALL SELECT doc_id, 1, unnest({_WRAPPED.format("low")}) FROM f),
notes AS (SELECT row_number() OVER () AS note, doc_id, cut, s FROM s),
tf AS (SELECT doc_id, cut, note, term, count(*) AS tf FROM (SELECT doc_id, cut, note, unnest(regexp_extract_all(s, '{WORD}')) AS term FROM notes) GROUP BY ALL),
ww AS (SELECT doc_id, cut, note, tf.term, tf, (1 + ln(tf)) * coalesce(idf, ln(CAST(n + 1 AS DOUBLE)) + 1) AS w FROM tf LEFT JOIN known ON tf.term = known.term, n),
sz AS (SELECT note, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM ww GROUP BY note),
cs AS (SELECT ww.doc_id, cut, ww.note, license, any_value(words) AS words, round(sum(w * tw) / (any_value(norm) * any_value(t_norm)), 6) AS score
  FROM ww JOIN tw ON ww.term = tw.term JOIN tn USING (template) JOIN sz ON ww.note = sz.note GROUP BY ww.doc_id, cut, ww.note, template, license HAVING score >= {MIN_COSINE}),
said AS (SELECT doc_id, cut, note, license, max(words) AS words, max(score) AS score FROM cs GROUP BY ALL),
bw AS (SELECT doc_id, cut, license, round(sum(score * words), 4) AS weight, max(score) AS score FROM said GROUP BY ALL),
own AS (SELECT doc_id, first(license ORDER BY weight DESC, license, score DESC) AS own_license, first(score ORDER BY weight DESC, license, score DESC) AS own_score FROM bw GROUP BY doc_id),
share AS (SELECT doc_id, max(words) AS words FROM (SELECT doc_id, cut, sum(words) AS words FROM (SELECT DISTINCT doc_id, cut, note, words FROM said) GROUP BY ALL) GROUP BY doc_id),
o AS (SELECT f.doc_id, dir, own_license, own_score, coalesce(share.words >= {FILE_SHARE} * len(w.words), false) AS is_license_file
  FROM f JOIN w USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN share USING (doc_id)),
cnt AS (SELECT dir, own_license, count(*) AS files FROM o WHERE is_license_file GROUP BY ALL),
lic AS (SELECT dir AS above, first(own_license ORDER BY files DESC, own_license) AS given FROM cnt GROUP BY dir),
dirs AS (SELECT DISTINCT dir FROM o WHERE own_license IS NULL),
up AS (SELECT dir, k AS depth, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') AS above FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM dirs)),
near AS (SELECT dir, max_by(above, depth) AS above, max_by(given, depth) AS given FROM up JOIN lic USING (above) GROUP BY dir)
SELECT doc_id, o.dir || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, own_license, own_score, is_license_file,
  coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM o LEFT JOIN near ON o.dir = near.dir
"""
