"""Licence scans: TF-IDF cosine of lines and licence files to templates, then inheritance from the nearest directory above.

Units are the lines and the paragraphs of every document (runs of lines that aren't empty without their comment marks),
its leading comment, and the whole text of licence files (by their names). Templates are notices of one line, and the
wrapped notices and texts of WRAPPED. Terms are runs of a-z and
0-9, A-Z lower-cased, joined by inner dots and hyphens. A term's IDF is ln((1 + N) / (1 + df)), its document frequency
df counted over all N documents, for terms of templates and of units alike. A unit's licence is that of the template with the largest cosine, if
it reaches LEAST_COSINE. Only units that share an anchor can: a template's anchors are its heaviest terms, so many that
the rest of its vector is shorter than LEAST_COSINE.

A document without a licence of its own has that of the licence file in its directory, or else of the nearest directory
above that has one. Directories are resolved once each, however many documents they hold.

Null texts and paths have no licence; ties go to the larger cosine, then the name that sorts first; repeated rows get
equal results; an empty table gives an empty table; only doc_id, text and the path are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import checkpointed, maybe_broadcast

LEAST_COSINE = 0.7
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"^(?:LICEN[SC]E|COPYING|NOTICE)(?:\..*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU_NOTICE = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
    " You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
)
#: Notices of several lines, and the texts of licences that are short enough to stand whole in a file.
WRAPPED = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
        ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
        " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("GPL-3.0", _GNU_NOTICE.format("program", "")),
    ("LGPL-3.0", _GNU_NOTICE.format("library", "Lesser ").partition(" This library is dist")[0]),
    ("LGPL-3.0", _GNU_NOTICE.format("library", "Lesser ")),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_REST),
)
#: Comment marks that lines begin and end with.
OPENS = r"^[ \t]*(?:/\*+!?|\*+/?|//+!?|#+!?|--+|;+|%+|<!--|\"{3}|'{3})?[ \t]*"
CLOSES = r"[ \t\r]*(?:\*+/|-->|\"{3}|'{3})?[ \t\r]*$"
COMMENT = r"^[ \t]*(?:\*|//|#|--|;|%)"


def paragraphs_of(lines: Column) -> Column:
    """The runs of two lines or more that aren't empty without their comment marks."""
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, OPENS, ""), CLOSES, ""))
    runs = F.split(F.array_join(bare, "\n"), "\n{2,}", -1)
    return F.filter(runs, lambda x: F.contains(x, F.lit("\n")))


def header_of(text: Column, lines: Column) -> Column:
    """The comment that the text begins with, as an array of one; empty where there is none."""
    plain = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), F.lit(False)).cast("int")
    marked = F.when(plain == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.slice(lines, F.lit(1), F.greatest(plain - 1, F.lit(0))), "\n"))
    block = lambda opens, closes: F.when(text.rlike(r"^\s*" + opens), F.split(text, closes, 2)[0])
    return F.array(F.coalesce(block(r"/\*", r"\*/"), block("<!--", "-->"), marked))


def default_path() -> Column:
    """Paths for a table without any: sixteen documents to a directory, the first of them its licence file."""
    return F.concat(F.lit("repo"), F.floor(F.col("doc_id") / 256).cast("string"), F.lit("/d"), F.floor(F.col("doc_id") / 16).cast("string"), F.lit("/"), F.when(F.col("doc_id") % 16 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def local_terms(text: str) -> list[str]:
    import re

    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def template_vectors(idf: dict[str, float], templates=TEMPLATES) -> list[dict[str, float]]:
    """Unit vectors of the templates; templates without terms have none."""
    vectors = []
    for _, text in templates:
        own = local_terms(text)
        raw = {t: own.count(t) * idf[t] for t in own}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({t: x / norm for t, x in raw.items()} if norm else {})
    return vectors


def anchors_of(vectors: list[dict[str, float]], least: float) -> list[str]:
    found = set()
    for vector in vectors:
        rest = 1.0
        for t, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if rest < least * least * (1 - 1e-9):
                break
            found.add(t)
            rest -= x * x
    return sorted(found)


def document_frequencies(docs: DataFrame, always: list[str]) -> DataFrame:
    """term and df, the rows of docs (text) that have it, for every term of two rows or more and those of always that any row has.

    Counts are shuffled, not words: each task adds up its own first.
    """
    seen = docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return seen.where((F.col("df") > 1) | F.col("term").isin(always))


def unit_licences(docs: DataFrame, templates=TEMPLATES + WRAPPED, least: float = LEAST_COSINE) -> DataFrame:
    """doc_id, text_key, licence and score of the best unit for each text of docs (doc_id, path, text) that has one."""
    vocabulary = sorted({t for _, text in templates for t in local_terms(text)})
    frequencies = checkpointed(document_frequencies(docs, vocabulary))
    frequency = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}  # a row for each template term at most
    total = docs.count()
    idf = {t: math.log((1 + total) / (1 + frequency.get(t, 0))) for t in vocabulary}
    vectors = template_vectors(idf, templates)
    anchors = anchors_of(vectors, least)
    spark = docs.sparkSession
    weights = spark.createDataFrame([(t, k, templates[k][0], x) for k, v in enumerate(vectors) for t, x in v.items()], "t_term string, template int, licence string, weight double")
    heads = F.array(*[F.lit(t) for t in anchors]) if anchors else F.array().cast("array<string>")
    name = F.substring_index("path", "/", -1)
    lines = F.split("text", "\n", -1)
    parts = F.concat(lines, paragraphs_of(lines), header_of(F.col("text"), lines))
    units = F.when(name.rlike(LICENCE_FILE), F.concat(parts, F.array("text"))).otherwise(parts)
    near = docs.where(F.arrays_overlap(terms_of(F.col("text")), heads))
    rows = near.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(units).alias("unit", "line"))
    rows = rows.select("doc_id", "text_key", "unit", terms_of(F.col("line")).alias("terms")).where(F.arrays_overlap("terms", heads))
    # rows that repeat scale a unit's counts alike, which leaves its cosines as they are
    keys = ["doc_id", "text_key", "unit"]
    counts = checkpointed(rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf")))
    # the terms of units, each once, meet the counts; a term that has none there is in one document only
    wanted = counts.groupBy("term").agg(F.lit(1).alias("one"))
    idfs = wanted.join(frequencies.withColumnRenamed("term", "seen_term"), F.col("term") == F.col("seen_term"), "left")
    idfs = checkpointed(idfs.select(F.col("term").alias("i_term"), F.log((1.0 + total) / (1 + F.coalesce("df", F.lit(1)))).alias("idf")))
    counts = counts.join(maybe_broadcast(idfs, idfs.count()), F.col("term") == F.col("i_term"))
    counts = checkpointed(counts.select(*keys, "term", (F.col("tf") * F.col("idf")).alias("x")))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counts.join(F.broadcast(weights), F.col("term") == F.col("t_term")).groupBy(*keys, "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    scored = dots.alias("d").join(norms.alias("n"), on).select("d.doc_id", "d.text_key", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    return scored.groupBy("doc_id", "text_key").agg(F.min(F.struct((-F.col("score")).alias("rank"), "licence")).alias("best")).select("doc_id", "text_key", F.col("best")["licence"].alias("licence"), (-F.col("best")["rank"]).alias("score"))


def licences(docs: DataFrame, path: Column | None = None, templates=TEMPLATES + WRAPPED, least: float = LEAST_COSINE) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence and inherited_from (a directory) for every row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (default_path() if path is None else path).alias("path"))
    best = checkpointed(unit_licences(own, templates, least))
    parts = own.select("doc_id", "path", F.xxhash64("text").alias("key"))
    matched = parts.join(best.select(F.col("doc_id").alias("best_id"), "text_key", "licence", "score"), F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("text_key")), "left")
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.instr("path", "/") > 0, F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("")
    matched = checkpointed(matched.select("doc_id", "path", F.when(F.col("path").isNotNull(), folder).alias("folder"), name.rlike(LICENCE_FILE).alias("is_licence"), "licence", "score"))
    given = matched.where("is_licence and licence is not null").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("rank"), "licence"))["licence"].alias("given"))
    given = checkpointed(given.select(F.col("folder").alias("given_folder"), "given"))
    folders = matched.where("folder is not null").select("folder").distinct()
    steps = F.split("folder", "/", -1)
    above = folders.select("folder", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))).alias("depth", "ancestor"))
    found = above.join(maybe_broadcast(given, given.count()), F.col("ancestor") == F.col("given_folder"))
    nearest = found.groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "given")).alias("near"))
    nearest = checkpointed(nearest.select(F.col("folder").alias("near_folder"), F.col("near")["ancestor"].alias("ancestor"), F.col("near")["given"].alias("given")))
    out = matched.join(nearest, F.col("folder") == F.col("near_folder"), "left")
    inherits = F.col("licence").isNull() & F.col("given").isNotNull()
    return out.select("doc_id", "path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "given").alias("licence"), F.when(inherits, F.col("ancestor")).alias("inherited_from"))
