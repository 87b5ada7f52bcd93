"""Licence scan of files: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by folder.

The segments of a file are its lines, its paragraphs (parted by lines without letters and digits), its leading block of
comments and its whole text. Their words (runs of ASCII letters and digits in lower case) weigh tf * idf,
idf = ln((1 + files) / (1 + df)) + 1; df is counted over all files for the words of the templates and taken as 0 for
others, so that a text about other things is far from every template. A file's licence is that of its segment with the
greatest cosine of at least `least`, ties to the first licence name; a line with an SPDX tag states its licence itself, with
score 1. A file is a licence file of its folder if its name says so or if segments of one kind that match make up half of its
words at least. A file without a licence of its own gets that of the nearest folder above it that has a licence file (of
several, the one with the greatest cosine, then the first path). All is DataFrame and SQL functions.

No segment is compared that cannot reach `least`, which loses nothing: with m(w) the greatest share that word w has in the
squared length of a template, the squared cosine is at most the sum of m over the segment's words. So that sum must be
least ** 2 at least, and one of the words must be beyond the most frequent ones that together stay below that.

A null path is the root folder's; a null text is empty; rows with a null key are files like others. Files without licence
get null and origin "none". Rows that repeat give rows each; rows with the same key and path take the best of both. An empty
table gives an empty result. Other columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Licence notices, titles and texts (fixed texts as the licences have them, without names).
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding "
        "copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the 3-clause BSD License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN "
        "NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
        "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is released into the public domain under the CC0 1.0 license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin "
        "of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not "
        "be removed or altered from any source distribution.",
    ),
]
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
LICENSE_NAME = "(?i)^(licen[sc]e|copying|unlicense|notice)([-._].*)?$"
#: What parts paragraphs, and the beginning of a line of comment.
BREAK = r"\n(?:[^A-Za-z0-9\n]*\n)+"
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|$)"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_words(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, word, tf)."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))


def segments(text: Column) -> Column:
    """An array of (kind, s): 0 lines, 1 paragraphs of several lines, 2 a text of several paragraphs, 3 a leading block of comments."""
    lines, parts = F.split(text, "\n"), F.split(text, BREAK)
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), F.lit(False))  # 0: no line of code
    lead = F.array_join(F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int")), "\n")
    of = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.alias("s"))
    none = F.array().cast("array<struct<kind:int,s:string>>")
    return F.concat(
        F.transform(lines, lambda x: of(0, x)),
        F.transform(F.filter(parts, lambda x: F.contains(x, F.lit("\n"))), lambda x: of(1, x)),
        F.when(F.size(parts) > 1, F.array(of(2, text))).otherwise(none),
        F.when(code > 2, F.array(of(3, lead))).otherwise(none),
    )


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.7, salts: int = 16) -> DataFrame:
    """files(key, path, text) -> (key, path, license, score, origin, from_path), origin "header", "inherited" or "none".
    salts: parts into which the files of a folder are split when they look up its licence."""
    spark = files.sparkSession
    terms = F.broadcast(template_words(spark, templates))  # a fixed list
    vocabulary = sorted({w for _, text in templates for w in re.split("[^a-z0-9]+", text.lower()) if w})
    # a struct, so that null keys meet their like
    files = files.select(F.struct("key", F.coalesce("path", F.lit("")).alias("path")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    has = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counted = files.select(F.explode(F.concat(has, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = F.broadcast(counted.where("word = ''").select(F.col("df").alias("files")))  # one row
    df = F.broadcast(counted.where("word <> ''"))  # a row for each word of the vocabulary
    idf = F.log((1 + F.col("files")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    t = terms.join(df, "word", "left").crossJoin(total).select("template", "license", "word", F.col("tf").alias("t_tf"), idf.alias("t_idf"), F.coalesce("df", F.lit(0)).alias("df"))
    t_norm = F.broadcast(t.groupBy("template").agg(F.sum(F.pow(F.col("t_tf") * F.col("t_idf"), 2)).alias("t_norm")))

    # what a segment's words can reach (see above); tables of the vocabulary, in one row
    reach = (least * 0.999) ** 2
    shares = t.join(t_norm, "template").groupBy("word", "df").agg(F.max(F.pow(F.col("t_tf") * F.col("t_idf"), 2) / F.col("t_norm")).alias("m"))
    shares = shares.withColumn("frequent", F.sum("m").over(Window.orderBy(F.desc("df"), "word")) < reach)
    needed = F.broadcast(
        shares.agg(F.struct(F.collect_list(F.when(~F.col("frequent"), F.col("word"))).alias("rare"), F.map_from_entries(F.collect_list(F.struct("word", "m"))).alias("m")).alias("needed"))
    )

    def may(text: Column) -> Column:
        total = F.aggregate(F.array_intersect(words(text), F.map_keys("needed.m")), F.lit(0.0), lambda x, w: x + F.col("needed.m")[w])
        return F.arrays_overlap(words(text), F.col("needed.rare")) & (total >= reach)

    found = files.crossJoin(needed).where(may(F.col("text"))).select("id", "text").distinct()  # rows that repeat count once
    parts = (
        found.select("id", F.size(words(F.col("text"))).alias("n_words"), F.posexplode(segments(F.col("text"))).alias("seg", "g"))
        .select("id", "n_words", "seg", F.col("g.kind").alias("kind"), F.col("g.s").alias("s"))
        .crossJoin(needed)
        .where(may(F.col("s")))
    )
    tf = parts.select("id", "n_words", "seg", "kind", F.explode(words(F.col("s"))).alias("word")).groupBy("id", "n_words", "seg", "kind", "word").agg(F.count("*").alias("tf"))
    weighed = tf.join(df, "word", "left").crossJoin(total).select("id", "n_words", "seg", "kind", "word", "tf", idf.alias("idf"))
    norms = weighed.groupBy("id", "n_words", "seg", "kind").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("norm"), F.sum("tf").alias("size"))
    dots = weighed.join(F.broadcast(t.drop("df")), "word").groupBy("id", "n_words", "seg", "template", "license").agg(F.sum(F.col("tf") * F.col("t_tf") * F.col("idf") * F.col("t_idf")).alias("dot"))
    score = F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("t_norm")), 6)
    matched = dots.join(norms, ["id", "n_words", "seg"]).join(t_norm, "template").withColumn("score", score).where(F.col("score") >= least)
    best = lambda: F.min_by("license", F.struct(-F.col("score"), "license")).alias("license")
    per_part = matched.groupBy("id", "n_words", "seg", "kind", "size").agg(F.max("score").alias("score"), best())
    tag = F.regexp_extract("s", SPDX, 1)
    tagged = files.where(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("id", F.size(words(F.col("text"))).alias("n_words"), F.posexplode(F.split("text", "\n")).alias("seg", "s"))
    tagged = tagged.select("id", "n_words", "seg", F.lit(4).alias("kind"), F.size(words(F.col("s"))).cast("long").alias("size"), F.lit(1.0).alias("score"), tag.alias("license")).where("license <> ''").distinct()
    per_kind = per_part.unionByName(tagged).groupBy("id", "kind").agg(best(), F.max("score").alias("score"), (F.sum("size") * 2 >= F.max("n_words")).alias("mostly"))
    own = per_kind.groupBy("id").agg(best(), F.max("score").alias("score"), F.bool_or("mostly").alias("mostly"))

    # folders with a licence file
    path = F.col("id.path")
    parts = F.split(path, "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    name = F.element_at(parts, -1)
    giving = own.where(F.col("mostly") | name.rlike(LICENSE_NAME)).select(folder.alias("folder"), "license", "score", path.alias("path"))
    giving = giving.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("g")).select("folder", F.col("g.license").alias("up_license"), F.col("g.path").alias("up_path"), (-F.col("g.s")).alias("up_score"))

    every = files.select("id").join(own.drop("mostly"), "id", "left").withColumn("below", folder)
    # each distinct folder looks up those above it; files then join their folder
    folders = every.where("license is null").select("below").distinct()
    above = folders.select("below", F.explode(F.sequence(F.lit(0), F.size(F.split("below", "/")))).alias("depth")).select(
        "below", "depth", F.array_join(F.expr("slice(split(below, '/'), 1, depth)"), "/").alias("folder")
    )
    nearest = above.join(giving, "folder").groupBy("below").agg(F.max_by(F.struct("up_license", "up_path", "up_score"), "depth").alias("up"))
    # a folder may hold a third of all files: its rows are split by a salt
    nearest = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = every.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(nearest, ["below", "salt"], "left")
    return out.select(
        "id.key",
        "id.path",
        F.coalesce("license", "up.up_license").alias("license"),
        F.coalesce("score", "up.up_score").alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), path).otherwise(F.col("up.up_path")).alias("from_path"),
    )


def license_sql(files: str, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.7) -> str:
    """The same for DuckDB; files: a query of (key, path, text)."""
    counted = [(i, name, w, n) for i, (name, text) in enumerate(templates) for w, n in Counter(filter(None, re.split("[^a-z0-9]+", text.lower()))).items()]
    values = ", ".join(f"({i}, '{name}', '{w}', {n})" for i, name, w, n in counted)
    folder = lambda x: f"array_to_string(list_slice(string_split({x}, '/'), 1, len(string_split({x}, '/')) - 1), '/')"
    return f"""
WITH files AS (SELECT key, coalesce(path, '') AS path, coalesce(text, '') AS text FROM ({files})),
tw AS (SELECT * FROM (VALUES {values}) t(template, license, word, tf)),
ws AS (SELECT key, path, text, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM files),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM ws) WHERE word IN (SELECT word FROM tw) GROUP BY word),
nn AS (SELECT count(*) AS files FROM files),
ls AS (SELECT *, string_split(text, chr(10)) AS ln, string_split_regex(text, '{BREAK}') AS pa FROM (SELECT DISTINCT key, path, text, w FROM ws)),
lc AS (SELECT *, coalesce(list_position(list_transform(ln, lambda x: regexp_matches(x, '{COMMENT}')), false), 0) AS code FROM ls),
sg AS (SELECT key, path, len(w) AS n_words, 0 AS kind, unnest(ln) AS s, generate_subscripts(ln, 1) AS i FROM ls
UNION ALL SELECT * FROM (SELECT key, path, len(w), 1, unnest(pa) AS s, generate_subscripts(pa, 1) FROM ls) WHERE contains(s, chr(10))
UNION ALL SELECT key, path, len(w), 2, text, 1 FROM ls WHERE len(pa) > 1
UNION ALL SELECT key, path, len(w), 3, array_to_string(list_slice(ln, 1, code - 1), chr(10)), 1 FROM lc WHERE code > 2),
hd AS (SELECT *, kind || '.' || i AS line FROM sg),
tf AS (SELECT key, path, n_words, kind, line, word, count(*) AS tf FROM (SELECT key, path, n_words, kind, line, unnest(string_split_regex(lower(s), '[^a-z0-9]+')) AS word FROM hd) WHERE word <> '' GROUP BY ALL),
wd AS (SELECT tf.*, ln((1 + files)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM tf LEFT JOIN df USING (word), nn),
nm AS (SELECT key, path, n_words, kind, line, sum(power(tf * idf, 2)) AS norm, sum(tf) AS size FROM wd GROUP BY ALL),
tt AS (SELECT template, license, word, tf AS t_tf, ln((1 + files)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS t_idf FROM tw LEFT JOIN df USING (word), nn),
tn AS (SELECT template, sum(power(t_tf * t_idf, 2)) AS t_norm FROM tt GROUP BY template),
dt AS (SELECT key, path, n_words, line, template, license, sum(tf * t_tf * idf * t_idf) AS dot FROM wd JOIN tt USING (word) GROUP BY ALL),
mt AS (SELECT dt.key, dt.path, dt.line, dt.n_words, kind, size, license, round(dot / sqrt(norm * t_norm), 6) AS score FROM dt JOIN nm ON dt.key IS NOT DISTINCT FROM nm.key AND dt.path = nm.path AND dt.n_words = nm.n_words AND dt.line = nm.line JOIN tn USING (template)),
pl AS (SELECT key, path, n_words, kind, size, license, score FROM (SELECT *, row_number() OVER (PARTITION BY key, path, n_words, line ORDER BY score DESC, license) AS i FROM mt WHERE score >= {least}) WHERE i = 1
UNION ALL SELECT key, path, len(w), 4, len(list_filter(string_split_regex(lower(s), '[^a-z0-9]+'), lambda w: w <> '')), regexp_extract(s, '{SPDX}', 1), 1.0 FROM (SELECT key, path, w, unnest(ln) AS s FROM ls) WHERE regexp_extract(s, '{SPDX}', 1) <> ''),
pk AS (SELECT key, path, kind, arg_min(license, (-score, license)) AS license, max(score) AS score, sum(size) * 2 >= max(n_words) AS mostly FROM pl GROUP BY key, path, kind),
ow AS (SELECT key, path, arg_min(license, (-score, license)) AS license, max(score) AS score, bool_or(mostly) AS mostly FROM pk GROUP BY key, path),
gv AS (SELECT {folder('path')} AS folder, license, score, path FROM ow WHERE mostly OR regexp_matches(list_last(string_split(path, '/')), '{LICENSE_NAME}')),
gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) AS i FROM gv) WHERE i = 1),
ev AS (SELECT f.key, f.path, o.license, o.score, {folder('f.path')} AS below FROM files f LEFT JOIN ow o ON o.key IS NOT DISTINCT FROM f.key AND o.path = f.path),
ab AS (SELECT DISTINCT below, d, array_to_string(list_slice(string_split(below, '/'), 1, d), '/') AS folder FROM ev, LATERAL (SELECT unnest(range(0, len(string_split(below, '/')) + 1)) AS d) WHERE license IS NULL),
up AS (SELECT * FROM (SELECT below, gb.license AS up_license, gb.path AS up_path, gb.score AS up_score, row_number() OVER (PARTITION BY below ORDER BY d DESC) AS i FROM ab JOIN gb USING (folder)) WHERE i = 1)
SELECT key, path, coalesce(license, up_license) AS license, coalesce(score, up_score) AS score, CASE WHEN license IS NOT NULL THEN 'header' WHEN up_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN license IS NOT NULL THEN path ELSE up_path END AS from_path
FROM ev LEFT JOIN up USING (below)"""
