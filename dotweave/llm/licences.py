"""Licence scans, in DataFrame functions only.

Header lines that speak of a licence, or whole licence files, become sparse
TF-IDF vectors; their cosine with each known template names the licence. An SPDX
identifier says it outright. Where no line does, neighbouring comment and cue lines
are joined into one vector and compared with the wording of whole headers and of the
beginnings of licence texts, words that no header has weighing little. A file
without one of its own inherits from the nearest directory above it that has a
licence file, by joins of directory paths; where there is none it has no licence. A
licence file is one that is named so, or one every line of which speaks of a licence;
what a file says of itself beside other things says nothing of its neighbours.

Edge cases: null and empty texts have no licence; texts are read whole, and long ones
cost in proportion; of equal cosines the template
that is listed first wins; a null path has no directory and inherits nothing;
several licence files in a directory: the one of the smallest order value, then
licence, counts; repeated rows are scanned each; an empty table gives an empty table;
columns that aren't kept are not read, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import cut_lineage, deal

# Licence names and the wording that declares them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "All rights reserved.",
}
NAMES = {"MIT-short": "MIT"}
CUE = "(?i)licen[cs]|copyright|spdx|public domain|rights reserved|released under"
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"
#: The wording of whole headers; what follows a slash tells several of one licence apart.
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
_WARRANTY = " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this {what}. If not, see http://www.gnu.org/licenses/"
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy"
_MIT_ALL = " of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ALL = " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_KINDS = {"GPL-3.0": ("program", "", "3"), "GPL-2.0": ("program", "", "2"), "LGPL-3.0": ("library", "Lesser ", "3"), "LGPL-2.1": ("library", "Lesser ", "2.1"), "AGPL-3.0": ("program", "Affero ", "3")}
_COPY = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FSF = "Copyright (C) {year} Free Software Foundation, Inc. "
HEADERS = {
    "GPL-3.0/title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _FSF.format(year=2007) + _COPY,
    "GPL-2.0/title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + _FSF.format(year="1989, 1991") + _COPY,
    "LGPL-3.0/title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _FSF.format(year=2007) + _COPY,
    "LGPL-2.1/title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 " + _FSF.format(year="1991, 1999") + _COPY,
    "AGPL-3.0/title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _FSF.format(year=2007) + _COPY,
    "Apache-2.0/title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "MPL-2.0/title": "Mozilla Public License Version 2.0",
    "BSL-1.0/title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "Apache-2.0": _APACHE,
    "Apache-2.0/all": _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": _MIT,
    "MIT/grant": _MIT + _MIT_ALL,
    "MIT/all": _MIT + _MIT_ALL + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + _AS_IS,
    "BSD-3-Clause": _BSD,
    "BSD-2-Clause/all": _BSD + _BSD_ALL + _DISCLAIMER,
    "BSD-3-Clause/all": _BSD + _BSD_ALL + _NEITHER + _DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "Copyright (c). All rights reserved.",
} | {f"{k}{end}": (_GNU + more).format(what=what, name=name, n=n) for k, (what, name, n) in _KINDS.items() for end, more in (("", ""), ("/all", _WARRANTY))}
#: What a word that no header has weighs.
STRANGE = 0.3
#: Lines that may belong to a header: comments, lines without words, and lines with words that headers are made of.
HEADER_CUE = CUE + "|permission|redistribut|warrant|merchantab|gnu |apache|mozilla|free software|unencumbered|liab"
COMMENT = r"^\\s*(#|//|/\\*|\\*|--|;|%|<!--|REM )|^[^A-Za-z0-9]*$"
#: An identifier, or several joined by operators.
SPDX = r"SPDX-License-Identifier:[ \\t(]*([A-Za-z0-9.+-]+([ ()]+(?:OR|AND|WITH)[ ()]+[A-Za-z0-9.+-]+)*)"
SMALL = 100_000
LEAST = 0.6


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def weights(templates: dict[str, str] = TEMPLATES) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """(idf of each word, idf of other words, for each template and word: idf times its part of the template's unit vector)."""
    n = len(templates)
    bags = {name: _words(text) for name, text in templates.items()}
    idf = {w: math.log((1 + n) / (1 + sum(w in b for b in bags.values()))) + 1 for w in sorted({w for b in bags.values() for w in b})}
    parts = {}
    for name, bag in bags.items():
        vector = {w: bag.count(w) * idf[w] for w in sorted(set(bag))}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        parts[name] = {w: round(x / norm * idf[w], 12) for w, x in vector.items()}
    return {w: round(x, 12) for w, x in idf.items()}, round(math.log(1 + n) + 1, 12), parts


def _map(values: dict[str, float]) -> str:
    return f"map({', '.join(f'{w!r}, {x!r}D' for w, x in values.items())})"


def _vector(ws: str, templates: dict[str, str], other: float | None = None) -> str:
    """SQL: an array of words with the length of its TF-IDF vector, by one pass over the sorted words."""
    idf, rare, _ = weights(templates)
    part = f"power(a.c * coalesce(element_at({_map(idf)}, a.w), {rare if other is None else other!r}D), 2)"
    same = "struct(w AS w, a.c + 1 AS c, a.s AS s)"
    return f"struct({ws} AS ws, aggregate(array_sort({ws}), struct('' AS w, 0D AS c, 0D AS s), (a, w) -> IF(a.w = w, {same}, struct(w AS w, 1D AS c, a.s + {part} AS s)), a -> sqrt(a.s + {part})) AS norm)"


def _best(templates: dict[str, str]) -> str:
    """SQL: for a vector ``v``, the struct (cosine, rank, licence) of the best template."""
    table = ", ".join(f"struct({-i} AS rank, {NAMES.get(name, name).split('/')[0]!r} AS licence, {_map(part)} AS part)" for i, (name, part) in enumerate(weights(templates)[2].items()))
    dot = "aggregate(v.ws, 0D, (a, w) -> a + coalesce(element_at(t.part, w), 0D))"
    return f"array_max(transform(array({table}), t -> struct(round({dot} / v.norm, 9) AS cosine, t.rank AS rank, t.licence AS licence)))"


WORDS = "filter(split(lower(l), '[^a-z0-9]+'), w -> w <> '')"


def scan(df: DataFrame, path: Column, text: str = "text", keep: list[str] | None = None, whole: Column | None = None, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``keep`` plus path, own (its licence, null if none), cosine (of its best line; 0 without one) and file (whether it is a licence file); no shuffle.

    ``whole`` marks licence files, whose text also counts as one line; by default the
    name tells. Otherwise a file with a licence is one if all its lines speak of it.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep or [])], path.alias("path"), body.alias("body"), (F.coalesce(whole, F.lit(False)) if whole is not None else F.coalesce(path.rlike(LICENCE_FILE), F.lit(False))).alias("file"))
    lines = f"filter(split(body, '\n'), l -> l RLIKE '{CUE}')"
    out = source.withColumn("lines", F.expr(f"filter(transform({lines}, l -> {WORDS}), ws -> size(ws) > 0)"))
    out = out.withColumn("best", F.expr(f"array_max(transform(transform(lines, ws -> {_vector('ws', templates)}), v -> {_best(templates)}))"))
    out = out.withColumn("spdx", F.expr(f"regexp_replace(regexp_replace(regexp_extract(body, '{SPDX}', 1), '(-only|-or-later|[+])(?![A-Za-z0-9])', ''), '[ ()]+', ' ')"))
    # Headers over several lines, for the files that nothing else decides; that all rights are reserved is said in front of open licences too.
    joined = f"filter(split(array_join(transform(split(body, '\n'), l -> CASE WHEN l RLIKE '{HEADER_CUE}' OR l RLIKE '{COMMENT}' THEN l ELSE '\n' END), ' '), '\n'), l -> l RLIKE '{HEADER_CUE}')"
    runs = f"CASE WHEN (best.cosine >= {least} AND best.licence <> 'Proprietary') OR spdx <> '' OR NOT body RLIKE '{HEADER_CUE}' THEN array() WHEN file THEN concat(array(body), {joined}) ELSE {joined} END"
    out = out.withColumn("blocks", F.expr(f"filter(transform({runs}, l -> {WORDS}), ws -> size(ws) > 0)"))
    out = out.withColumn("header", F.expr(f"array_max(transform(transform(blocks, ws -> {_vector('ws', HEADERS, STRANGE)}), v -> {_best(HEADERS)}))"))
    told = F.when(F.col("spdx") != "", F.struct(F.lit(1.0).alias("cosine"), F.col("spdx").alias("licence"))).when((F.col("header.cosine") >= least) & ((F.col("header.licence") != "Proprietary") | (F.coalesce("best.cosine", F.lit(0.0)) < least)), F.struct("header.cosine", "header.licence")).otherwise(F.struct("best.cosine", "best.licence"))
    out = out.withColumn("told", told)
    own = F.when(F.col("told.cosine") >= least, F.col("told.licence"))
    speaks = F.expr(f"NOT exists(split(body, '\n'), l -> NOT l RLIKE '{HEADER_CUE}' AND l RLIKE '[^ \t\r]')")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep or [])], "path", own.alias("own"), F.coalesce("told.cosine", F.lit(0.0)).alias("cosine"), F.when(own.isNull(), False).otherwise(F.col("file") | speaks).alias("file"))


def _parent(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def licence_files(scanned: DataFrame, order: str, marked: Column | None = None) -> DataFrame:
    """(directory, licence) of the rows that are licence files (or that ``marked`` names as such)."""
    marked = F.col("file") if marked is None else marked
    first = F.min(F.struct(order, F.col("own")))
    return scanned.where(marked & F.col("own").isNotNull() & F.col("path").isNotNull()).groupBy(F.expr(_parent("path")).alias("directory")).agg(first.alias("f")).select("directory", F.col("f.own").alias("licence"))


def inherit(scanned: DataFrame, directories: DataFrame) -> DataFrame:
    """``scanned`` plus licence (own, or that of the nearest directory above) and origin (null for own).

    The paths are resolved once a directory; files then join their directory's
    answer, sent to all executors only while there are few directories, else with
    those of a directory of very many files dealt to many parts.
    """
    homes = scanned.where(F.col("own").isNull() & F.col("path").isNotNull()).groupBy(F.expr(_parent("path")).alias("home")).agg(F.count(F.lit(1)).alias("copies"))
    up = "transform(sequence(1, size(split(home, '/'))), k -> struct(k AS depth, array_join(slice(split(home, '/'), 1, k), '/') AS directory))"
    above = homes.select("home", "copies", F.explode(F.expr(up)).alias("a")).select("home", "copies", "a.depth", "a.directory").join(directories, "directory")
    near = cut_lineage(above.groupBy("home").agg(F.max_by(F.struct("directory", "licence"), "depth").alias("got"), F.max("copies").alias("copies")))
    files = scanned.withColumn("home", F.when(F.col("own").isNull(), F.expr(_parent("path"))))
    if near.count() <= SMALL:
        met = files.join(F.broadcast(near), "home", "left")
    else:
        left, right = deal(files, near, "home", "copies", F.xxhash64("path"))
        met = left.join(right, ["home", "__part"], "left").drop("__part")
    return met.drop("home", "copies").withColumns({"licence": F.coalesce("own", "got.licence"), "origin": F.when(F.col("own").isNull(), F.col("got.directory"))}).drop("got", "file")
