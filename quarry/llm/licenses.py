"""Licence scans with DataFrame functions only.

The whole text, each of its lines, and each block of several lines (between lines without letters or digits) are normalised (a-z and 0-9, one space between words) and compared with licence notices by the
Dice coefficient of their sets of word bigrams. A unit of b bigrams reaches t against a notice of n only if
t / (2 - t) * n <= b <= (2 - t) / t * n, so notices out of that range are pruned before bigrams are matched.

A unit that reaches t against a notice of n bigrams shares at least t / (2 - t) * n of them. Keywords are words of the notices such that
fewer bigrams than that have none of them, so a text without a keyword can't match, nor can any of its lines: it is passed over after one
look at its words. A unit whose first words alone have more distinct bigrams than any range allows is passed over as well."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Notices of public licences, and the whole of those of a few paragraphs.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB_WARRANTY = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
_ZLIB_GRANT = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_APACHE_GRANT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE_GRANT),
    ("BSD-2-Clause", _BSD),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", _ISC_GRANT),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MIT", _MIT_REST),
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_REST),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THIRD + _BSD_REST),
    ("BSD-3-Clause", _BSD_THIRD),
    ("ISC", _ISC_GRANT + _ISC_REST),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_REST),
    ("Zlib", _ZLIB_WARRANTY + _ZLIB_GRANT),
    ("Zlib", _ZLIB_GRANT),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("Apache-2.0", _APACHE_GRANT + " " + _APACHE_REST),
    ("Apache-2.0", _APACHE_REST),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
# Words too common to tell a notice from prose.
COMMON_WORDS = set("a all an and any are as at be by can for from have in is it its may no not of on or that the this to under was which with you your".split())
# What stands between blocks: a line break, nothing of letters or digits, a line break.
BREAK = r"\n[^A-Za-z0-9]*\n"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(words: Column) -> Column:
    """Distinct word bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def _pairs(text: str) -> set[tuple[str, str]]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    return set(zip(words, words[1:]))


def keywords(notices: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words one of which stands in every unit that reaches the threshold against some notice."""
    found: set[str] = set()
    for _, text in notices:
        pairs = _pairs(text)
        needed = math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9)
        open_ = [p for p in pairs if not found & set(p)]
        while len(open_) >= needed:
            words = {w for p in open_ for w in p}
            best = min(words, key=lambda w: (w in COMMON_WORDS or w.isdigit(), -sum(w in p for p in open_), w))
            found.add(best)
            open_ = [p for p in open_ if best not in p]
    return sorted(found)


def matches(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, notice, license, dice) for each notice that a unit reaches; unit 0 is the whole text, above zero are line numbers, below zero
    numbers of blocks. A notice that is wrapped over lines is found as a block, or as the whole text.

    Rows of one doc_id count as one document; a null doc_id is a value like others. Null and empty texts have no units. Texts of any length are
    compared whole; of equal matches all are rows."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "notice int, license string, text string")
    known = known.select("notice", "license", bigrams(F.split(normalised("text"), " ")).alias("b")).withColumn("n", F.size("b"))
    low, high = F.col("n") * (threshold / (2 - threshold)) - 1e-9, F.col("n") * ((2 - threshold) / threshold) + 1e-9
    probes = F.broadcast(known.select("notice", "license", "n", low.alias("low"), high.alias("high"), F.explode("b").alias("bigram")))
    most = math.floor(max(len(_pairs(t)) for _, t in notices) * (2 - threshold) / threshold + 1e-9)
    words = F.split(normalised("text"), " ")
    held = docs.select("doc_id", "text").where(F.arrays_overlap(words, F.array(*[F.lit(w) for w in keywords(notices, threshold)])))
    numbered = lambda parts, sign: F.transform(parts, lambda x, i: F.struct((sign * (i + 1)).alias("unit"), x.alias("part")))
    lines = numbered(F.split("text", "\n"), 1)
    blocks = F.filter(numbered(F.split("text", BREAK), -1), lambda x: x.part.contains("\n"))
    whole = F.array(F.struct(F.lit(0).alias("unit"), F.col("text").alias("part")))
    units = held.select("doc_id", F.explode(F.concat(whole, lines, blocks)).alias("u")).select("doc_id", "u.unit", "u.part")
    some = lambda w: F.when(F.size(bigrams(F.slice(w, 1, most + 2))) <= most, bigrams(w))
    rows = lambda b: F.transform(b, lambda x: F.struct(x.alias("bigram"), F.size(b).alias("size")))
    sized = units.select("doc_id", "unit", F.explode(_let(F.split(normalised("part"), " "), lambda w: _let(some(w), rows))).alias("r")).select("doc_id", "unit", "r.size", "r.bigram")
    met = sized.join(probes, "bigram").where("size between low and high")
    counted = met.groupBy("doc_id", "unit", "size", "notice", "license", "n").agg(F.countDistinct("bigram").alias("common"))
    return counted.withColumn("dice", 2.0 * F.col("common") / (F.col("size") + F.col("n"))).where(F.col("dice") >= threshold).select("doc_id", "unit", "notice", "license", "dice")


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_units, licenses) for each distinct doc_id: the best match (ties: first name), how many units match, all names.

    Without a match license and dice are null, n_units is zero and licenses empty."""
    found = matches(docs, notices, threshold)
    best = found.groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"), F.countDistinct("unit").alias("n"), F.array_sort(F.collect_set("license")).alias("names"))
    ids = docs.select("doc_id").distinct()
    joined = ids.join(best.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.coalesce("n", F.lit(0)).alias("n_units"), F.concat_ws(",", "names").alias("licenses"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL = f"""
with notices(notice, license, text) as (values {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(NOTICES))}),
units as (
  select doc_id, 0 as unit, text as part from documents where text is not null
  union all
  select doc_id, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) as int), unnest(string_split(text, chr(10))) from documents where text is not null
  union all
  select * from (select doc_id, -cast(unnest(generate_series(1, len(b))) as int) as unit, unnest(b) as part from (select doc_id, string_split_regex(text, '{BREAK}') as b from documents where text is not null)) where contains(part, chr(10))
),
words as (select doc_id, unit, string_split(trim(regexp_replace(translate(part, '{CAPITALS}', '{SMALL}'), '[^a-z0-9]+', ' ', 'g')), ' ') as w from units),
nwords as (select notice, license, string_split(trim(regexp_replace(translate(text, '{CAPITALS}', '{SMALL}'), '[^a-z0-9]+', ' ', 'g')), ' ') as w from notices),
grams as (select distinct doc_id, unit, w[i] || ' ' || w[i + 1] as bigram from (select doc_id, unit, w, unnest(generate_series(1, len(w) - 1)) as i from words where len(w) > 1)),
ngrams as (select distinct notice, license, w[i] || ' ' || w[i + 1] as bigram from (select notice, license, w, unnest(generate_series(1, len(w) - 1)) as i from nwords)),
sizes as (select doc_id, unit, count(*) as size from grams group by all),
nsizes as (select notice, count(*) as n from ngrams group by all),
common as (select g.doc_id, g.unit, k.notice, k.license, count(*) as common from grams g join ngrams k using (bigram) group by all),
dices as (select doc_id, unit, license, 2.0::double * common / (size + n) as dice from common join sizes using (doc_id, unit) join nsizes using (notice)),
best as (
  select doc_id, min({{'d': -dice, 'license': license}}) as b, count(distinct unit) as n_units, string_agg(distinct license, ',' order by license) as licenses
  from dices where dice >= {THRESHOLD} group by doc_id
)
select d.doc_id, b.license as license, -b.d as dice, coalesce(n_units, 0) as n_units, coalesce(licenses, '') as licenses
from (select distinct doc_id from documents) d left join best on d.doc_id = best.doc_id
"""
