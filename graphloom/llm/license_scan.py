"""License scans: headers and licence files against templates, then inheritance along directories.

What is compared: a licence file (its name says so) as a whole; of every file its leading comment block, each paragraph and
each line that speaks of a licence. Equal units are one row, with their count; each is compared to the licence templates by
the cosine of sparse TF-IDF vectors ((1 + ln tf) idf, idf over all units), and a template counts from MIN_COSINE on. A
licence may have several templates: its notices, its title, its text. A file's own licence is that of its best unit; an SPDX
expression is the licence itself, whole and as written ("MIT OR Apache-2.0", "GPL-2.0-or-later"). A licence file also covers its directory and everything below: a file without an own
licence takes the one of its nearest ancestor directory that has a licence file, by joins on the ancestors' paths.

Templates are a table (license, template), by default TEMPLATES; read_templates() takes a folder of licence texts. Texts are
read once, to a written table of paths and units. TEMPLATES are a fixed list, so their terms are broadcast; units and
directories are joined, never broadcast.

Inputs: null text has no unit; a null path is in no directory; of several units, or licence files in a directory, the best
cosine, then the smallest licence name decides; equal rows give equal results, and rows that share a doc_id are judged each
by its own text; doc_id may be null or a text; a long text is read whole, and its licence file is one unit; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_COSINE = 0.55
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Notices, titles and texts of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD} {_NEITHER} {_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0, NonCommercial."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, ShareAlike."),
    ("CC0-1.0", "CC0 1.0 Universal. The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _gnu(_GPL, "2")),
    ("GPL-2.0", _gnu(_GPL, "2") + _GNU_END.format(_GPL, _GPL)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _gnu(_GPL, "3")),
    ("GPL-3.0", _gnu(_GPL, "3") + _GNU_END.format(_GPL, _GPL)),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu(_AGPL, "3")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _gnu(_LGPL, "2.1")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _gnu(_LGPL, "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to <https://unlicense.org>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
]
SAYS = r"(?i)licen[sc]e[ds]?\b|\bcopyright\b|spdx-|permission is (?:hereby )?granted|redistribution and use|public domain"
NAMED = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)"
_ID = r"(?:\([ \t]*)*[a-z0-9.-]*[a-z0-9]\+?(?:[ \t]*\))*"
#: An expression of identifiers, joined by AND, OR or WITH (in capitals).
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?-i:AND|OR|WITH)[ \t]+{_ID})*)"
_NOT_TERM = r"[^\p{L}\p{N}.]+"
#: Parentheses around the whole of an expression, or that have no other.
_AROUND = r"^\([ \t]*([^()]*?)[ \t]*\)?$|^([^()]*?)[ \t]*\)$"


def _terms(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), _NOT_TERM), lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), lambda t: t != "")


def _units(text: Column, path: Column) -> Column:
    """array<string>: what of a file is compared, white space collapsed."""
    lines = F.split(text, "\n")
    first_code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False)
    lead = F.array_join(F.when(first_code > 0, F.slice(lines, F.lit(1), (first_code - 1).cast("int"))).otherwise(lines), "\n")
    whole = F.when(F.coalesce(path.rlike(NAMED), F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))
    said = F.filter(F.concat(F.array(lead), F.split(text, r"\n[ \t\r]*\n"), lines), lambda x: x.rlike(SAYS))
    flat = F.transform(F.concat(whole, said), lambda x: F.trim(F.regexp_replace(x, C.SPACE, " ")))
    some = text.rlike(SAYS) | F.coalesce(path.rlike(NAMED), F.lit(False))
    return F.when(some, F.array_distinct(F.filter(flat, lambda x: x != "")))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(license, template) of a folder of texts, named as their licences."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.txt)?$", 1).alias("license"), F.col("value").alias("template"))
    return rows.filter("license <> ''")


def matched_units(units: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(unit_id, license, cosine) of distinct units (unit_id, unit, n) that reach MIN_COSINE."""
    own = templates is None
    if own:
        templates = units.sparkSession.createDataFrame(TEMPLATES, "license string, template string")
    templates = templates.distinct().withColumn("t_id", F.md5(F.concat_ws("\n", "license", "template")))
    weight = (1 + F.log("tf")) * F.col("idf")
    each = units.select("unit_id", "n", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit_id", "n", "term").agg(F.count("*").alias("tf"))
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    idf = each.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))  # total is one row
    idf = idf.select("term", F.log((1 + F.col("total")) / (1 + F.col("df"))).alias("x")).select("term", (F.col("x") + 1.0).alias("idf"))
    vectors = each.join(idf, "term").select("unit_id", "term", weight.alias("u"))
    of_template = templates.select("t_id", "license", F.explode(_terms(F.col("template"))).alias("term")).groupBy("t_id", "license", "term").agg(F.count("*").alias("tf"))
    new = F.log(1 + F.col("total")) + 1.0  # a template term that no unit has
    weights = of_template.join(idf, "term", "left").crossJoin(F.broadcast(total)).withColumn("idf", F.coalesce("idf", new)).select("t_id", "license", "term", weight.alias("w"))
    t_norm = weights.groupBy("t_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    side = weights.join(t_norm, "t_id")
    u_norm = vectors.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("u_norm"))
    dots = vectors.join(F.broadcast(side) if own else side, "term")  # TEMPLATES bound it
    dots = dots.groupBy("unit_id", "t_id", "license", "t_norm").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(u_norm, "unit_id").select("unit_id", "license", F.round(F.col("dot") / (F.col("t_norm") * F.col("u_norm")), 4).alias("cosine"))
    best = scored.groupBy("unit_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.filter(-F.col("b.c") >= MIN_COSINE).select("unit_id", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def document_path(docs: DataFrame) -> Column:
    """A path for rows of `documents`, which has none: source/lang/(id div 64)/id.txt, and a LICENSE file, in that
    directory or for odd ids one above, where the text begins with its licence."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")))
    name = F.col("doc_id").cast("string")
    leaf = F.concat(top, F.lit("/"), F.floor(F.col("doc_id") / 64).cast("string"), F.lit("/"))
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\n]*)", 1)
    here = F.when(F.col("doc_id") % 2 == 0, leaf).otherwise(F.concat(top, F.lit("/")))
    return F.when(first.rlike(SAYS), F.concat(here, F.lit("LICENSE-"), name)).otherwise(F.concat(leaf, name, F.lit(".txt")))


def scan(files: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per row of files (doc_id, path, text): doc_id, path, license, how ("own", "inherited" or "none"), cosine
    (of the deciding unit; 1 of an SPDX identifier), from_dir (the directory inherited from)."""
    rows = files.select("doc_id", "path", "text", F.monotonically_increasing_id().alias("row_key"))
    spdx = F.regexp_replace(F.regexp_replace(F.nullif(F.regexp_extract("text", SPDX, 1), F.lit("")), _AROUND, "$1$2"), r"[ \t]+", " ")
    # the only step that reads the texts; row numbers are written with it
    rows = C.written(rows.select("row_key", "doc_id", "path", spdx.alias("spdx"), _units(F.col("text"), F.col("path")).alias("units")), "units")
    each = rows.select("row_key", F.explode("units").alias("unit")).withColumn("unit_id", F.md5("unit"))
    matches = matched_units(each.groupBy("unit_id").agg(F.first("unit").alias("unit"), F.count("*").alias("n")), templates)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    said = rows.filter("spdx IS NOT NULL").select("row_key", F.col("spdx").alias("license"), F.lit(1.0).alias("cosine"))
    found = each.select("row_key", "unit_id").join(matches, "unit_id").select("row_key", "license", "cosine").join(said.select("row_key"), "row_key", "left_anti").unionByName(said)
    own = found.groupBy("row_key").agg(best.alias("b")).select("row_key", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    keyed = rows.select("row_key", "doc_id", "path", directory.alias("of"))
    of_dir = own.join(keyed.filter(F.col("path").rlike(NAMED)), "row_key").groupBy(F.col("of").alias("dir")).agg(best.alias("b")).select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine"))
    # Every directory of the table once, with its ancestors; the nearest that has a licence file is found per directory.
    dirs = keyed.filter("of IS NOT NULL").select("of").distinct()
    steps = F.split("of", "/")
    ancestors = dirs.select("of", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).select("of", "depth", F.array_join(F.slice(F.split("of", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = ancestors.join(of_dir, "dir").groupBy("of").agg(F.max_by(F.struct("dir", "dir_license", "dir_cosine"), "depth").alias("d")).select("of", "d.*")
    out = keyed.join(own, "row_key", "left").join(nearest, "of", "left")
    mine, taken = F.col("license").isNotNull(), F.col("dir_license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, "own").when(taken, "inherited").otherwise("none").alias("how"),
        F.coalesce("cosine", "dir_cosine").alias("cosine"),
        F.when(~mine & taken, F.col("dir")).alias("from_dir"),
    )


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEMPLATES)
    terms = lambda c: rf"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}.]+'), lambda t: regexp_replace(t, '^\.+|\.+$', '', 'g')), lambda t: t <> '')"
    return rf"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS top, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || (doc_id // 64) AS leaf, regexp_matches(regexp_extract(coalesce(text, ''), '^([^\n]*)', 1), '{SAYS}') AS lic FROM documents),
p AS (SELECT doc_id, text, lic, string_split(text, chr(10)) AS ls, CASE WHEN NOT lic OR doc_id % 2 = 0 THEN leaf ELSE top END AS dir, CASE WHEN lic THEN '/LICENSE-' || doc_id ELSE '/' || doc_id || '.txt' END AS name,
      regexp_replace(regexp_replace(nullif(regexp_extract(text, '{SPDX}', 1), ''), '{_AROUND}', '\1\2'), '[ \t]+', ' ', 'g') AS spdx FROM f),
c AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '{COMMENT}')), false) AS code FROM p WHERE regexp_matches(text, '{SAYS}')),
l AS (SELECT DISTINCT doc_id, trim(regexp_replace(u, '[\x20\x09-\x0D]+', ' ', 'g')) AS unit FROM (
      SELECT doc_id, text AS u FROM c WHERE lic
      UNION ALL SELECT doc_id, array_to_string(CASE WHEN code > 0 THEN ls[1:code - 1] ELSE ls END, chr(10)) FROM c
      UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM c
      UNION ALL SELECT doc_id, unnest(ls) FROM c) x(doc_id, u) WHERE regexp_matches(u, '{SAYS}')),
h AS (SELECT unit, count(*) AS n FROM l GROUP BY unit),
tot AS (SELECT coalesce(sum(n), 0) AS total FROM h),
e AS (SELECT unit, n, term, count(*) AS tf FROM (SELECT unit, n, unnest({terms('unit')}) AS term FROM h) GROUP BY ALL),
idf AS (SELECT term, ln((1 + total) / (1 + sum(n))) + 1 AS idf FROM e, tot GROUP BY term, total),
v AS (SELECT unit, term, (1 + ln(tf)) * idf AS u FROM e JOIN idf USING (term)),
t AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest({terms('template')}) AS term FROM (VALUES {values}) x(license, template)) GROUP BY ALL),
w AS (SELECT license, template, term, (1 + ln(tf)) * coalesce(idf, ln(1 + total) + 1) AS w FROM t LEFT JOIN idf USING (term), tot),
s AS (SELECT unit, license, round(dot / (tn * un), 4) AS cosine FROM (SELECT unit, license, template, sum(u * w) AS dot FROM v JOIN w USING (term) GROUP BY ALL)
      JOIN (SELECT license, template, sqrt(sum(w * w)) AS tn FROM w GROUP BY ALL) USING (license, template) JOIN (SELECT unit, sqrt(sum(u * u)) AS un FROM v GROUP BY unit) USING (unit)),
m AS (SELECT * FROM s WHERE cosine >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, license) = 1),
o AS (SELECT doc_id, license, cosine FROM l JOIN m USING (unit) WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE spdx IS NOT NULL) UNION ALL SELECT doc_id, spdx, 1.0 FROM p WHERE spdx IS NOT NULL),
own AS (SELECT doc_id, dir, lic, license, cosine FROM o JOIN p USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
d AS (SELECT dir, license, cosine FROM own WHERE lic QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
a AS (SELECT p.doc_id, d.dir, d.license, d.cosine FROM p JOIN d ON p.dir = d.dir OR starts_with(p.dir, d.dir || '/') QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT p.doc_id, p.dir || p.name AS path, coalesce(own.license, a.license) AS license, CASE WHEN own.license IS NOT NULL THEN 'own' WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(own.cosine, a.cosine) AS cosine, CASE WHEN own.license IS NULL THEN a.dir END AS from_dir
FROM p LEFT JOIN own ON p.doc_id = own.doc_id LEFT JOIN a ON p.doc_id = a.doc_id"""


ORACLE_SQL = _oracle()
