"""Licence scans by canonical digest, in DataFrame operations only.

Texts are normalised (case, copyright lines, equivalent spellings, punctuation, spaces), and the digest
of the entire normalised text is hash-joined with the digests of known licences, normalised in the same
way. Single lines are looked up among the digests of known notices likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

_MIT_END = _MIT_BODY[_MIT_BODY.index(_AS_IS) :]
_MIT_START = _MIT_BODY[: _MIT_BODY.index(", subject to the following conditions")]
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
    "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law. " + _MIT_END.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
    "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
    "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
    "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
    "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the "
    "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
    "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by "
    "a source language processor. " + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
    "FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

# Public licence texts, each with its usual headings.
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("MIT-0", "MIT No Attribution\n" + _MIT_START + ". " + _MIT_END),
    ("MIT-0", _MIT_START + ". " + _MIT_END),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
)
# Canonical digests of longer public licence texts, as they are commonly installed with systems.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Artistic-1.0", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
# One-line notices.
NOTICES: tuple[tuple[str, str], ...] = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("all-rights-reserved", "All rights reserved."),
)
# Spellings that count as equal, by the word that stands for them.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licen[cs]e", "license"),
    ("licen[cs]ed", "licensed"),
    ("licen[cs]es", "licenses"),
    ("licen[cs]ee", "licensee"),
    ("licen[cs]ees", "licensees"),
    ("licen[cs]ing", "licensing"),
    ("sub-?licen[cs]e", "sublicense"),
    ("merchant[ai]bility", "merchantability"),
    ("non-?infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organi[sz]ation", "organization"),
    ("whilst", "while"),
)
_COPYRIGHT_LINE = r"(?m)^[^\w\n]*(copyright\b[^\n]*(\d{4}|\(c\)|©)|\(c\)[^\n]*\d{4}|©)[^\n]*$|^[^\w\n]*all rights reserved\W*$"


def _canonical(low: Column) -> Column:
    """Lower-cased text without punctuation, spellings unified, single spaces."""
    out = F.regexp_replace(low, r"\b(" + "|".join(p for p, _ in SPELLINGS) + r")\b", "\u0001$1\u0001")
    for pattern, word in SPELLINGS:
        out = F.regexp_replace(out, f"\u0001{pattern}\u0001", word)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def normalised(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, spellings unified, single spaces; null: empty."""
    return _canonical(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, " "))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def line_digest(line: Column) -> Column:
    """Of a single line, which may itself be one that :func:`normalised` drops."""
    return F.sha2(_canonical(F.lower(line)), 256)


def known_licences(spark: SparkSession, known: tuple[tuple[str, str], ...] = TEXTS, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """``digest, licence`` of the given texts and digests, one row per digest: a table as small as the lists."""
    rows = spark.createDataFrame(list(known), "licence string, text string").select(digest(F.col("text")).alias("digest"), "licence")
    more = spark.createDataFrame(list(digests), "licence string, digest string").select("digest", "licence")
    return rows.union(more).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``docs`` with digest, licence (of the entire text; null: none known) and notices (sorted array of
    the licences that single lines name) added; columns of these names are replaced.

    A null or empty text, or one of punctuation alone, has the digest of the empty string and no licence; an
    empty table gives no rows. The notices' digests are a literal map of the expression, as they are few.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("digest", "licence", "notices")]
    lines_known = spark.createDataFrame(list(notices), "licence string, text string").select(line_digest(F.col("text")).alias("digest"), "licence")
    spoken = {r["digest"]: r["licence"] for r in lines_known.collect()}  # as many as ``notices``
    named = F.create_map(*[F.lit(x) for pair in spoken.items() for x in pair]) if spoken else F.create_map().cast("map<string,string>")
    hint = r"(?i)licen[cs]e|rights\W+reserved"  # every notice has one of these; lines are cut only where one occurs
    lines = F.filter(F.split("text", r"[\r\n]+"), lambda x: x.rlike(hint))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: named[line_digest(x)]))))
    rows = docs.select(*kept, digest(F.col("text")).alias("digest"), F.when(F.col("text").rlike(hint), found).otherwise(F.array().cast("array<string>")).alias("notices"))
    return rows.join(F.broadcast(known_licences(spark, texts)), "digest", "left").select(*kept, "digest", "licence", "notices")


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document whose entire text is one, and the notices in all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(low: str) -> str:
    out = f"regexp_replace({low}, {_sql_text(chr(92) + 'b(' + '|'.join(p for p, _ in SPELLINGS) + ')' + chr(92) + 'b')}, concat(chr(1), '\\1', chr(1)), 'g')"
    for pattern, word in SPELLINGS:
        out = f"regexp_replace({out}, concat(chr(1), {_sql_text(pattern)}, chr(1)), {_sql_text(word)}, 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _sql_digest(text: str) -> str:
    return f"sha256({_sql_canonical(f'regexp_replace(lower(coalesce({text}, {_sql_text("")})), {_sql_text(_COPYRIGHT_LINE)}, {_sql_text(" ")}, {_sql_text("g")})')})"


def _sql_rows(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in rows)


#: The query in DuckDB's SQL.
ORACLE = f"""with known as (select digest, min(licence) as licence from (select licence, {_sql_digest("text")} as digest from (values {_sql_rows(TEXTS)}) t(licence, text) union all select licence, digest from (values {_sql_rows(DIGESTS)}) d(licence, digest)) group by 1),
 spoken as (select distinct licence, sha256({_sql_canonical("lower(text)")}) as digest from (values {_sql_rows(NOTICES)}) t(licence, text)),
 lines as (select doc_id, unnest(string_split_regex(text, '[\\r\\n]+')) as line from documents where text is not null),
 named as (select doc_id, string_agg(distinct licence, ',' order by licence) as notices from (select doc_id, sha256({_sql_canonical("lower(line)")}) as digest from lines where regexp_matches(line, '(?i)licen[cs]e|rights\\W+reserved')) join spoken using (digest) group by 1),
 digested as (select doc_id, {_sql_digest("text")} as digest from documents)
 select doc_id, digest, licence, coalesce(notices, '') as notices from digested left join known using (digest) left join named using (doc_id)"""
