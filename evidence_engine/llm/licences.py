"""Licence scan: whole texts are brought to a canonical form, and its digest is looked up.

The canonical form lower-cases A-Z, drops copyright notices (lines where (c), ©, a year or a holder follows
"copyright", and "all rights reserved" lines), takes every run of code points but letters, marks and digits as one
space, and writes equivalent spellings one way. A line that begins with "copyright" and goes on as licence bodies do
is no notice, so it does not matter where lines end. DataFrame functions only; the digest, not the text, meets the licences.

The licences are broadcast up to ``BROADCAST_ROWS`` rows of two short strings; beyond that the join is
shuffled and Spark splits hot digests.

Defined cases: null text counts as empty; texts without any word have a digest and no licence, whatever the
licences hold; licences of one canonical form go by the smallest name; repeated rows are repeated.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

BROADCAST_ROWS = 20_000

#: Spellings taken as equal, as the public SPDX matching guidelines have them; words are apart by two spaces.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub  license", "sublicense"), ("sub  licenses", "sublicenses"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright  owner", "copyright  holder"), ("copyright  owners", "copyright  holders"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("modelling", "modeling"), ("non  commercial", "noncommercial"),
    ("organisation", "organization"), ("optimise", "optimize"), ("per  cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("https", "http"),
]

#: More of the same list, and forms of the same words.
EQUIVALENT += [
    ("analysed", "analyzed"), ("artefacts", "artifacts"), ("authorise", "authorize"), ("authorising", "authorizing"), ("calibre", "caliber"), ("capitalisations", "capitalizations"),
    ("categorise", "categorize"), ("emphasised", "emphasized"), ("favourite", "favorite"), ("favours", "favors"), ("fulfils", "fulfills"), ("fulfilment", "fulfillment"),
    ("labour", "labor"), ("licencing", "licensing"), ("maximise", "maximize"), ("modelled", "modeled"), ("offence", "offense"), ("organise", "organize"),
    ("organisations", "organizations"), ("programmes", "programs"), ("recognised", "recognized"), ("sub  licensed", "sublicensed"), ("sub  licensing", "sublicensing"), ("wilfull", "willful"),
    ("wilfully", "willfully"),
]

#: After "copyright": words of a licence body, where a notice has (c), ©, a year or a holder. Wrapped body lines begin so.
_BODY = "notices?|holders?|owners?|laws?|licen[cs]\\w*|statements?|and|or|nor|in|is|are|to|of|as|at|by|on|for|with|that|this|which|the|treaty|treaties|acts?|interests?|disclaimers?|protection|permission|status|infringement|rights?|restrictions?|material|ownership|may|must|shall|will|can|does|law|legend|grant|year|claims?|information|term|under|from|if|it|its|however"
_LEAD = r"(^|\n)([ \t\r\n*#/;\p{Z}-]*)"
#: Patterns in the order of use, and what stands for a match, as text between its first two groups and its third and fourth.
_BODY_LINE = rf"{_LEAD}copyright([ \t]+)({_BODY})\b"
_NOTICE = rf"{_LEAD}((\(c\)|©)[ \t\p{{Z}}]*(copyright|[0-9]{{4}})[^\n]*|©[^\n]*|copyright[ \t\p{{Z}}]*(\(c\)|©|[0-9]{{4}})[^\n]*|copyright[ \t]+[^ \t\r\n\x01][^\n]*)"
_RESERVED = rf"{_LEAD}all rights reserved[^\p{{L}}\p{{N}}\n]*(\n|\z)"
_WORDLESS = r"[^\p{L}\p{M}\p{N}]+"

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (name, text) of licences and notices that stand alone as a whole text, in the forms in common use.
KNOWN = [
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("Apache-2.0-notice", _APACHE_NOTICE),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("MIT", _MIT_BODY),
    ("MIT", f"MIT License\n\n{_MIT_BODY}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT_BODY}"),
    ("MIT-line", "Released under the MIT License."),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
]

#: Title lines in use above texts that are listed without one.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The BSD 2-Clause License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "Revised BSD License", "The BSD 3-Clause License", "The BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "Internet Systems Consortium License"],
    "MIT": ["The MIT License", "MIT License (MIT)", "MIT"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["The zlib License", "zlib/libpng License"],
}
_END = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """KNOWN, the full texts in licence_texts (also without what follows their terms), and both under their titles."""
    texts = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    texts += [(name, text[: text.index(_END) + len(_END)]) for name, text in texts if _END in text]
    bare = [(name, text) for name, text in [*KNOWN, *texts] if not text.startswith(("MIT License", "The MIT License", "zlib License"))]
    return [*KNOWN, *texts, *((name, f"{title}\n\n{text}") for name, text in bare for title in TITLES.get(name, []))]


def canonical(text: Column) -> Column:
    """Words of the canonical form, one space before, between and after them; one space if there are none."""
    low = S.lower_az(F.coalesce(text.cast("string"), F.lit("")))
    marked = F.regexp_replace(low, _BODY_LINE, "$1$2copyright\x01$3$4")
    bare = F.regexp_replace(F.regexp_replace(marked, _NOTICE, "\n"), _RESERVED, "\n")
    spaced = F.concat(F.lit(" "), F.regexp_replace(bare, _WORDLESS, "  "), F.lit(" "))
    same = reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUIVALENT, spaced)
    return F.regexp_replace(same, " +", " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in known or known_texts()))
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, licences: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, canonical_sha256, license_id or null), a row a document."""
    words = canonical(F.col("text")) != " "
    known = licences.where(words & F.col("license_id").isNotNull()).groupBy(digest(F.col("text")).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    known = S.settled(known, "licences")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col), digest(F.col(text_col)).alias("canonical_sha256"))
    return rows.join(known, "canonical_sha256", "left").select(id_col, "canonical_sha256", "license_id")


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licences(spark))


def _sql(text: str) -> str:
    e = f"translate(coalesce({text}, ''), '{S.UPPER_AZ}', '{S.LOWER_AZ}')"
    e = f"regexp_replace({e}, '{_BODY_LINE}', '\\1\\2copyright' || chr(1) || '\\3\\4', 'g')"
    for pattern in (_NOTICE, _RESERVED):
        e = f"regexp_replace({e}, '{pattern}', chr(10), 'g')"
    e = f"' ' || regexp_replace({e}, '{_WORDLESS}', '  ', 'g') || ' '"
    for a, b in EQUIVALENT:
        e = f"replace({e}, ' {a} ', ' {b} ')"
    return f"sha256(regexp_replace({e}, ' +', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP7_SQL = f"""
WITH l(license_id, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known_texts())}),
k AS (SELECT {_sql("text")} AS d, min(license_id) AS license_id FROM l GROUP BY 1),
c AS (SELECT doc_id, {_sql("text")} AS d FROM documents)
SELECT doc_id, c.d AS canonical_sha256, license_id FROM c LEFT JOIN k ON c.d = k.d
"""
