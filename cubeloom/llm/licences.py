"""Licence scan by canonical digests, with DataFrame operations only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines and equivalent spellings
make no difference), and its digest is looked up in the digests of known licences by a hash join. What is
looked up are entire texts: a whole document, and each of its lines taken as a text of its own, as
notices stand on one line in documents that are about something else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import free_name, stored

#: Equivalent spellings of lower-case words, applied in this order. Only single words are replaced, so that it makes no
#: difference where lines end.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("sublicense", "sub license"),
    ("colour", "color"), ("favour", "favor"), ("judgement", "judgment"), ("organisation", "organization"), ("recognised", "recognized"),
    ("authorised", "authorized"), ("noninfringement", "non infringement"), ("percent", "per cent"), ("whilst", "while"),
    ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("https", "http"), ("v", "version"), ("ver", "version"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

#: Names with a version that stand in one-line notices.
_NAMED = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "Apache-2.0": ("Apache License, Version 2.0",), "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2",), "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0",), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
}
_NOTICES = ("Released under {}.", "Released under the {}.", "Licensed under {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.")
_SPDX = "{0} {0}-only {0}-or-later"

#: Licence and text; whoever knows more passes a table of their own.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License " + _MIT), ("MIT", "The MIT License (MIT) " + _MIT), ("ISC", _ISC), ("ISC", "ISC License " + _ISC),
    ("BSD-2-Clause", _BSD.format("")), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD.format("")), ("BSD-3-Clause", _BSD.format(_BSD_THIRD)),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD.format(_BSD_THIRD)), ("Zlib", _ZLIB), ("Zlib", "zlib License " + _ZLIB),
    ("MPL-2.0", _MPL_NOTICE), ("Apache-2.0", _APACHE_NOTICE), ("GPL-2.0-or-later", _GPL_NOTICE.format(2)), ("GPL-3.0-or-later", _GPL_NOTICE.format(3)),
    *((name, notice.format(title)) for name, titles in _NAMED.items() for title in titles for notice in _NOTICES),
    *((name, f"SPDX-License-Identifier: {spdx}") for name in _NAMED for spdx in (_SPDX.format(name).split() if "GPL" in name else [name])),
)

#: A line that begins, after signs of a comment, with the word or the sign and has a year or a sign; and the usual line after it.
COPYRIGHT = r"(?m)^[ \t/*#;-]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©)[^\n]*$|(?m)^[ \t/*#;-]*all rights reserved\.?[ \t]*$"
#: What stands between words, besides line feeds.
BETWEEN = r"[^\p{L}\p{N}\n]+"

#: A version that is one word with its number.
VERSION = " (?:version|ver|v)([0-9])"


def _spelled(words: Column) -> Column:
    """Lines of words, each with a space of its own on either side, in their canonical spelling."""
    words = F.regexp_replace(words, VERSION, " version  $1")
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new.replace(' ', '  ')} "))
    return words


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, those without a word left out: lower-case words between single spaces."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    text = F.regexp_replace(text, BETWEEN, "  ")
    text = F.concat(F.lit(" "), F.replace(text, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    # spellings can only be met where their words are, so most texts skip them
    any_word = "|".join(old for old, _ in SPELLINGS)
    text = F.when(F.rlike(text, F.lit(f" (?:{any_word}) |{VERSION}")), _spelled(text)).otherwise(text)
    lines = F.split(F.regexp_replace(text, " +", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def digest(text: Column) -> Column:
    """The digest of a whole text in canonical form, in which the ends of lines make no difference."""
    return _digest(F.array_join(canonical_lines(text), " "))


def _digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``digest, license_id``: one row for each digest of the known texts (of two licences, the first by name)."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_digest, license_id, line_license_ids, n_license_lines``: one row for each row of ``docs``.

    ``text_digest`` is the digest of the canonical whole text and ``license_id`` the licence that it is, if any.
    ``line_license_ids`` holds, sorted and joined by commas, the licences whose whole text is a line of the document, and
    ``n_license_lines`` counts those lines. Null texts are empty; empty texts, and texts that are empty in canonical form,
    are no licence. Null ids, repeated rows and extra columns make no difference; an empty table gives no rows. A text is
    canonised whole, so the longest must fit in a task's memory several times.

    ``known`` is the caller's ``digest, license_id`` table, of any size; of two licences with one digest the first by name
    counts. Left out, it is that of this module. Whole texts and lines are looked up in it by hash joins; of lines, only 128
    bits of the digest are carried.
    """
    lines = free_name(docs, "canonical")
    rows = docs.withColumn(lines, canonical_lines(F.col(text_col))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        _digest(F.array_join(lines, " ")).alias("text_digest"),
        F.transform(lines, lambda x: F.unhex(F.substring(_digest(x), 1, 32))).alias("lines"),
    )
    rows = stored(rows)
    table = known_digests(docs.sparkSession) if known is None else known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    short = table.select(F.unhex(F.substring("digest", 1, 32)).alias("line"), F.col("license_id").alias("line_license"))
    hits = rows.select("row", F.explode("lines").alias("line")).join(short, "line")
    hits = hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("line_license")), ",").alias("ids"), F.count("*").alias("n"))
    found = rows.drop("lines").join(table.withColumnsRenamed({"digest": "text_digest"}), "text_digest", "left").join(hits, "row", "left")
    return found.select(
        "doc_id", "text_digest", "license_id", F.coalesce("ids", F.lit("")).alias("line_license_ids"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
    )
