"""Licence scan by canonical digests.

A text's canonical form is lower-cased, without copyright notices, with one spelling of words
that licences spell in several ways and single spaces for punctuation and white space. Digests
of whole texts, and of every line taken as a whole text, are hash-joined with the table of
those of known licences and notices.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: fixed steps after NOTICES: (what a text must hold, pattern, replacement), in this order, after
#: lower-casing; the syntax is common to Java, RE2 and Python
LINES = [
    (("all rights reserved",), r"(^|\n)[ \t#*/;%-]*all rights reserved[. \t]*", "\n"),
    (("http",), r"https?://(www\.)?", " "),
    (("",), r"[\x00-\x2f\x3a-\x60\x7b-\x7f“”‘’–—©®™]+", " "),
]
_MARGIN = r"[ \t#*/;%-]*"
#: words that follow "copyright" in running text, unless a colon follows them
_PROSE = "notices?|holders?|owners?|laws?|licen[cs](?:es?|ing|ed)|statements?|interests?|protect(?:ion|ed)|acts?|and|or|in|is|are|of|to|for|on|as|by law|that|which|this|shall|may|must|will|with|from|any|infringements?|claims?|information|ownership|page|symbols?|lines?|terms?|treat(?:y|ies)|rights?|status|policy|registration|materials?|works?|control|headers?|disclaimers?|years?|dates?|permissions?|grants?|management|assignments?|attributions?|restrictions?|has|have|not|you|if|each|all"


def _notices(word: str, named: str) -> list[tuple[tuple[str, ...], str | None, str, str]]:
    """Copyright notices, which a line may also begin with by wrapping: (what a text must hold,
    what it must not, pattern, replacement). ``word`` is the pattern of the word itself,
    ``named`` of the word and what parts it from a holder, that is, from no running text.

    With a mark or a year a line is a notice; with a holder only, it must begin a paragraph or
    follow a title. "(c)" after "(b)" is an item of a list."""
    marked = rf"(?:\(c\)[ \t]*)?{word}[ \t:]*(?:\(c\)|©|&copy;|[\[<{{])|\(c\)[ \t]*{word}"
    dated = rf"(?:\(c\)|{word})[ \t:,-]*(?:(?:\(c\)|{word}|by)[ \t:,-]*)*(?:19|20)[0-9][0-9]|{named}[^\n]*\b(?:19|20)[0-9][0-9]\b"
    begins = rf"(^|\n{_MARGIN}\n|licen[cs]e[^\n]{{0,12}}\n)"
    return [
        (("copyright", "(c)", "©"), None, rf"(^|\n){_MARGIN}(?:©|{marked}|{dated})[^\n]*", "$1"),
        (("copyright",), None, rf"{begins}(?:{_MARGIN}{named}[^ \t\n][^\n]*(?:\n|$))+", "$1\n"),
        (("(c)",), "(b)", rf"{begins}(?:{_MARGIN}\(c\)[ \t:]+[^ \t\n][^\n]*(?:\n|$))+", "$1\n"),
    ]


NOTICES = _notices("copyright", rf"copyright[ \t:]+(?![ \t:]*(?:{_PROSE})\b(?![ \t]*:))")
#: equivalent spellings, replaced in this order
SPELLINGS = [("licence", "license"), ("licensing", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("favour", "favor"), ("judgement", "judgment"), ("whilst", "while"), ("version 2 0", "version 2"), ("version 3 0", "version 3")]
#: a line without one of these is no known licence; checked against the table of known ones
ANCHOR = "licen[cs]|permission|redistribution"
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: whole licence texts, with and without their titles, and one-line notices
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ZERO), ("0BSD", "BSD Zero Clause License\n" + _ZERO),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_TAIL),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("ISC", "SPDX-License-Identifier: ISC"),
]

#: fixed values: canonical digests of the usual licence texts as published, of each whole and,
#: where it has the line, up to and without "END OF TERMS AND CONDITIONS"
WHOLE: dict[str, str] = {
    "ed3253f0360f22768d8684cecad1f3dbfd8928ab945f33f6b057a8f7f66e0106": "Apache-2.0",
    "6af045568954dc6ece74e7a460e6117f11328ff5a0c9eb97985b8a8f1926aca3": "Apache-2.0",
    "5bce3b79777fa38de46d8be7cdc11b60b104f9321d240323b530276127e4c148": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause-UC",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "9240cf82b62ed5dc1ac43771b46a561d66fd096e5bcfafbfa7e70fbad929f15a": "GFDL-1.2",
    "89f4908df09c43d2fe7346b85c360c28ab9ee447f06a3f3a16726577ee3fc283": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "c0660aac1855cc4cb6715605c820103ebb45be7647de80f593dbf197bf460e67": "GPL-3.0",
    "a08fe89f9ebaf0a05bb462e69fe69dc0afcf86f3c3b1b3d1b385a6bd20f458c2": "GPL-3.0",
    "6f34e32d2551535a4abb11e6751dcbfe60cfbdef734b36d369c6dacd5830bd4d": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "5673fa20f8f092f6750b922c0d57461dfaf076e14f3f138751a6059226bb14f6": "MPL-1.1",
    "b9ace9910174ea7b059d4c725e05488e0370e00d742c82ca4a28212bec31bd83": "MPL-2.0",
}


def canonical_text(text: str) -> str:
    """The canonical form of one string, for the table of known licences."""
    text = text.lower()
    for _, without, pattern, by in NOTICES:
        if without is None or without not in text:
            text = re.sub(pattern, by.replace("$1", r"\1"), text)
    for _, pattern, by in LINES:
        text = re.sub(pattern, by, text)
    for was, by in SPELLINGS:
        text = text.replace(was, by)
    return text.strip(" ")


def canonical(text):
    """The canonical form as a column."""
    text = F.lower(text)
    for holds, without, pattern, by in [*NOTICES, *((h, None, p, b) for h, p, b in LINES)]:
        done = F.regexp_replace(text, F.lit(pattern), F.lit(by))
        if any(holds):
            test = F.lit(False)
            for word in holds:
                test = test | F.contains(text, F.lit(word))
            if without is not None:
                test = test & ~F.contains(text, F.lit(without))
            done = F.when(test, done).otherwise(text)
        text = done
    for was, by in SPELLINGS:
        text = F.replace(text, F.lit(was), F.lit(by))
    return F.trim(text)


def known_digests(known: list[tuple[str, str]] = KNOWN, whole: dict[str, str] = WHOLE) -> dict[str, str]:
    """Digest -> licence id: of the texts ``known`` and the digests ``whole``."""
    return {**whole, **{hashlib.sha256(canonical_text(t).encode()).hexdigest(): i for i, t in known}}


def scan(spark: SparkSession, docs: DataFrame, known: list[tuple[str, str]] = KNOWN, whole: dict[str, str] = WHOLE) -> DataFrame:
    """``doc_id, digest, license_id, line_licenses, n_license_lines`` of every row.

    ``license_id`` is the licence that the whole text is, or null; ``line_licenses`` the
    sorted ids of its lines that are a known text or notice, joined by commas (empty if none).
    Null text counts as empty and has no licence. The table of known digests is as long as
    ``known`` and ``whole`` and therefore broadcast. Repeated rows and rows with a null id come
    back as they are; other columns are ignored; an empty table gives an empty result.

    Texts are read once: what is stored and joined are digests.
    """
    table = spark.createDataFrame(sorted(known_digests(known, whole).items()), "digest string, license_id string")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    if all(re.search(ANCHOR, canonical_text(t)) for _, t in known):  # the texts of ``whole`` hold it
        lines = F.when(F.lower(text).rlike(ANCHOR), F.filter(lines, lambda x: F.lower(x).rlike(ANCHOR))).otherwise(F.array().cast("array<string>"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("lines"))
    own = cut(own.withColumn("_row", F.monotonically_increasing_id()))
    found = own.select("_row", F.explode("lines").alias("digest")).join(F.broadcast(table), "digest")
    lines = found.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    return own.join(lines, "_row", "left").join(F.broadcast(table), "digest", "left").select(
        "doc_id", "digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")
    )


#: in SQL, whose patterns know no look-ahead, the word before running text gets this in its midst
_MARK = r"\x01"


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The scan as DuckDB SQL, without the shortcuts, in the same canonical form: the word before
    running text is marked first, so that a notice is told without look-ahead. (A text that
    holds the mark within that word itself would come out otherwise.)"""

    def quoted(x: str) -> str:
        return "E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"

    def replaced(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {quoted(pattern)}, {by}, 'g')"

    def steps(name: str, source: str, columns: str) -> str:
        """CTEs that end in ``name``, with the digest of the column ``t`` of ``source``."""
        prose = rf"([ \t:]+(?:{_PROSE})"
        of = [
            replaced("lower(t)", rf"copyright{prose}\b)", "'copyrigh' || chr(1) || E't\\\\1'"),
            replaced("t", rf"copyrigh{_MARK}t{prose}[ \t]*:)", "E'copyright\\\\1'"),
        ]
        for _, without, pattern, by in _notices(rf"copyrigh{_MARK}?t", r"copyright[ \t:]+"):
            done = replaced("t", pattern, quoted(by.replace("$1", r"\1")))
            of.append(f"case when contains(t, '{without}') then t else {done} end" if without else done)
        of.append("replace(t, 'copyrigh' || chr(1) || 't', 'copyright')")
        of += [replaced("t", pattern, quoted(by)) for _, pattern, by in LINES]
        last = "t"
        for was, by in SPELLINGS:
            last = f"replace({last}, '{was}', '{by}')"
        of.append(f"sha256(trim({last}, ' '))")
        out = []
        for i, x in enumerate(of):
            out.append(f"{name if i == len(of) - 1 else f'{name}_{i}'} as (select {columns}, {x} as t from {source})")
            source = f"{name}_{i}"
        return ",\n".join(out)

    rows = ", ".join(f"('{d}', '{i}')" for d, i in sorted(known_digests(known, WHOLE).items()))
    return f"""
with known(digest, license_id) as (values {rows}),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
{steps("whole", "docs", "r, doc_id")},
line as (select r, unnest(string_split(t, E'\\n')) as t from docs),
{steps("lines", "line", "r")},
hits as (select r, string_agg(distinct license_id, ',' order by license_id) as line_licenses, count(*) as n
  from lines join known on known.digest = lines.t group by r)
select doc_id, whole.t as digest, known.license_id, coalesce(line_licenses, '') as line_licenses,
  coalesce(n, 0) as n_license_lines
from whole left join hits using (r) left join known on known.digest = whole.t"""
