"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to canonical form - lower case, copyright lines taken out, punctuation and white space to single blanks, equivalent
spellings to one of them - and its SHA-256 is looked up among the digests of known licence texts by a hash join. Whole texts
are looked up, and every single line as a text of its own, so that one-line notices inside a document are found.

Only texts that hold a word which every known licence has (``markers``, checked against the canonical known texts; without such words all
texts go on) are brought to canonical form. They must be single words: what is between two words may be anything that the form takes out. Defined results: null and empty texts match nothing; rows that repeat an id count together, a null id
is an id; an empty table gives an empty result; equal digests of known texts go to the smaller name; very long texts are brought to
canonical form whole; only the id and text columns are read, so further columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted

# Well-known licence texts and notices, in public use.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT),
    ("MIT", "MIT License " + _GRANT),
    ("MIT", "The MIT License (MIT) " + _GRANT),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License " + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(""" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""")),
    ("GPL-2.0-or-later", _GNU.format("2")),
    ("GPL-3.0-or-later", _GNU.format("3")),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
]
# Spellings that count as the second one, after punctuation has gone.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("modifications", "modification"), ("https", "http"), ("v2 0", "version 2 0"), ("v3", "version 3"), ("v 2 0", "version 2 0"),
]
MARKERS = "licen[cs]e|permission|permitted|domain|software"
COPYRIGHT_LINE = r"(^|\n)[^\n]*(copyright[ :]*([(]c[)]|\x{a9}|[0-9]{4})|([(]c[)]|\x{a9}) *[0-9]{4}|all rights reserved)[^\n]*"
NO_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NO_WORD, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same as DuckDB text."""
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{NO_WORD}', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", markers: str | None = MARKERS) -> DataFrame:
    """(id, license_id, scope, matches): scope ``text`` for whole texts, ``line`` for lines; ``known`` is (license_id, text)."""
    known = known_texts(docs.sparkSession) if known is None else known
    if markers and known.where(~canonical(F.col("text")).rlike(markers)).limit(1).count():
        markers = None
    digests = known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(quoted(id_col).alias("id"), quoted(text).alias("t")).where(F.length("t") > 0)
    marked = (lambda c: F.lower(c).rlike(markers)) if markers else (lambda c: F.lit(True))
    rows = rows.where(marked(F.col("t")))
    whole = rows.select("id", F.lit("text").alias("scope"), F.col("t").alias("unit"))
    lines = rows.where(F.contains("t", F.lit("\n"))).select("id", F.lit("line").alias("scope"), F.explode(F.split("t", "\n", -1)).alias("unit")).where(marked(F.col("unit")))
    units = whole.unionByName(lines).select("id", "scope", F.sha2(canonical(F.col("unit")), 256).alias("digest"))
    found = units.join(digests, "digest")       # Spark broadcasts the digests when their size allows
    return found.groupBy(F.col("id").alias(id_col), "license_id", "scope").agg(F.count("*").alias("matches"))


def scan_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"      # noqa: E731
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
with known(license_id, t) as (values {values}),
     digests as (select sha256({canonical_sql("t")}) as digest, min(license_id) as license_id from known group by 1),
     units as (select doc_id, 'text' as scope, text as unit from documents where length(text) > 0
               union all
               select doc_id, 'line', unnest(string_split(text, chr(10))) from documents where contains(text, chr(10)))
select doc_id, license_id, scope, count(*) as matches
from (select doc_id, scope, sha256({canonical_sql("unit")}) as digest from units) join digests using (digest)
group by doc_id, license_id, scope
"""
