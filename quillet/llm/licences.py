"""Licence scan by canonical digest.

A whole text is brought to a canonical form (ASCII lower case, SPDX and copyright lines and usual title lines gone,
punctuation and white space reduced, equivalent spellings made one with all their inflections) and its SHA-256 is
hash-joined to the digests of known licences. The canonical form is one chain of SQL expressions; the known digests are
a file of the package, one row each, and are broadcast.

Defined results: a null or empty text, and one of copyright lines alone, matches nothing; repeated rows each
get a result; a table of licences may hold several texts for a licence, and of several licences with one
canonical text the first name by order is given; an empty table gives an empty table; only the id and text
columns are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words that make up a licence's title line.
_TITLE = "mit|expat|isc|zlib|libpng|bsd|0bsd|unlicense|boost|gnu|x11"
_TITLE_MORE = _TITLE + "|software|zero|two|three|four|clause|new|revised|simplified|modified|original|free|or|style|version|v|licen[cs]e"

def _words(said: str) -> str:
    """The words with any punctuation and line breaks between them."""
    return said.replace(" ", "[^a-z0-9]+")


#: Holders whose notices stand in licence texts themselves, with their address, and names to be filled in. Such
#: a notice is known from its first word to its last, wherever lines break; any other one ends with its line.
_HOLDERS = _words(
    "free software foundation( inc)?( 51 franklin st(reet)? fifth floor boston ma 02110 1301( usa)?)?( https? (www )?fsf org)?|name of (the )?(author|copyright owner)|your name"
)

#: Steps of the canonical form: patterns that both Java and RE2 read alike, and what replaces their matches (group 1 as {1}).
#: "(c)" also numbers clauses: it begins a notice only before a year, or before a name and a year.
_STEPS = (
    (r"(^|\n)[^a-z0-9\n]*spdx-license-identifier[^\n]*", "\n"),
    (r"copyright[^a-z0-9]*(c[^a-z0-9]+)?(([0-9]{4}|19yy|yyyy|year)[^a-z0-9]+){1,40}(" + _HOLDERS + ")", " "),
    (_words("all rights reserved"), " "),
    (
        r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(c\)|©|[0-9]{4}|year|yyyy)|(\(c\)|©)[^a-z0-9\n]*(copyright[^a-z0-9\n]*)?([0-9]{4}|year|yyyy)"
        r"|(\(c\)|©)[^0-9\n]{1,60}(19|20)[0-9]{2})[^\n]*",
        "\n",
    ),  # copyright lines
    (rf"(^|\n)[^a-z0-9\n]*(the )?({_TITLE})([^a-z\n]+({_TITLE_MORE})){{0,20}}[^a-z\n]*(\([a-z0-9 .-]*\))?[^a-z0-9\n]*(\n|$)", "\n"),  # title lines
    (r"[^a-z0-9]+", " "),  # punctuation and white space
    (r"\b(authori|capitali|categori|emphasi|initiali|maximi|optimi|organi|reali|recogni|utili|analy)s(e|ed|es|er|ers|ing|ation|ations)\b", "{1}z{2}"),
    (r"\b(cancel|label|model|signal)l(ed|ing|er|ers)\b", "{1}{2}"),
    (r"\b(cent|calib)re(s?)\b", "{1}er{2}"),
    (r"\b(program)me(s?)\b", "{1}{2}"),
    (r"\bwill?full?(y?)\b", "wilful{1}"),
)

#: Spellings that licence matching guidelines hold equal, as parts of words, so that plurals and derived words follow.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("catalogue", "catalog"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfill", "fulfil"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licenc", "licens"),
    ("offence", "offense"),
    ("practise", "practice"),
    ("whilst", "while"),
    (" non commercial", " noncommercial"),
    (" per cent", " percent"),
    (" sub licens", " sublicens"),
)

#: Whole texts of known licences.
LICENCES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def _java(put: str) -> str:
    return put.replace("{1}", "$1").replace("{2}", "$2")


def canonical(text: Column) -> Column:
    """The canonical form of a text column; null stays null."""
    c = F.translate(text, _UPPER, _UPPER.lower())
    for found, put in _STEPS:
        c = F.regexp_replace(c, found, _java(put))
    c = F.concat(F.lit(" "), F.trim(c))
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(c)


#: licence and canonical_sha256 of whole texts of known licences, LICENCES and those of /usr/share/common-licenses among them;
#: made by known() from the texts, and to be made again when the canonical form changes.
DIGESTS = Path(__file__).with_name("licence_digests.tsv")


def digest_rows() -> list[tuple[str, str]]:
    """(licence, canonical_sha256), one for each digest."""
    return [tuple(line.split("\t")) for line in DIGESTS.read_text(encoding="utf-8").splitlines()]


def known(spark, licences: dict[str, str] | None = None) -> DataFrame:
    """canonical_sha256 and licence, one row per digest: of the given texts, or of DIGESTS."""
    if licences is None:
        return spark.createDataFrame(digest_rows(), "licence string, canonical_sha256 string").select("canonical_sha256", "licence")
    table = spark.createDataFrame(sorted(licences.items()), "licence string, body string")
    digests = table.select("licence", F.sha2(canonical(F.col("body")).cast("binary"), 256).alias("canonical_sha256"))
    return digests.groupBy("canonical_sha256").agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, canonical_sha256, licence (null if none), matched."""
    form = canonical(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col), F.sha2(form.cast("binary"), 256).alias("canonical_sha256"), (F.length(form) > 0).alias("__has"))
    names = known(df.sparkSession, licences).withColumnRenamed("canonical_sha256", "__digest")
    # names: a row a known text, from a file of the package or a dict of the caller
    return rows.join(F.broadcast(names), (rows["canonical_sha256"] == names["__digest"]) & rows["__has"], "left").select(
        id_col, "canonical_sha256", "licence", F.col("licence").isNotNull().alias("matched")
    )


def scan_sql() -> str:
    """The scan as DuckDB SQL over documents, with the digests of the package's file as literals."""
    x = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    for found, put in _STEPS:
        put = "chr(10)" if put == "\n" else "'" + put.replace("{1}", r"\1").replace("{2}", r"\2") + "'"
        x = f"regexp_replace({x}, '{found}', {put}, 'g')"
    x = f"concat(' ', trim({x}))"
    for a, b in EQUIVALENT:
        x = f"replace({x}, '{a}', '{b}')"
    values = ", ".join(f"('{licence}', '{digest}')" for licence, digest in digest_rows())
    return f"""
        WITH k(licence, digest) AS (VALUES {values}),
        d AS (SELECT doc_id, trim({x}) AS form FROM documents)
        SELECT doc_id, sha256(form) AS canonical_sha256, licence, licence IS NOT NULL AS matched
        FROM d LEFT JOIN k ON sha256(form) = digest AND form <> ''"""
