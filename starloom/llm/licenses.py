"""Licence scans by canonical digest: whole texts, normalised, hash-joined to the digests of known licences.

Normal form, by DataFrame functions only: A-Z lower-cased; typographic quotes, dashes and marks as blanks; lines
that are a copyright notice removed (with a year, a colon, (c) or the sign, or of names alone, as in "Copyright Jane
Doe"), as is "all rights reserved"; every other run of ASCII characters that are no letter or digit as one blank;
equivalent spellings made one. Known
texts pass through the same expression, so the two sides always agree. The digest is SHA-256 in hex.

Known are KNOWN and the rows of `known_licenses.jsonl` (license_id, text): whole licence files in the wordings at hand, with
and without their appendix, the header notices that the GPL and MPL ask for, and one-sentence notices. A notice or licence
inside a longer document is not found, as the whole text is looked up.

Defined cases. Null text: digest null, no licence. A text without letters or digits has the digest of the
empty text and matches nothing. Known texts with one normal form: the smallest licence id is reported. The
known table is broadcast while it has at most `most_broadcast` rows, and hash-joined by a shuffle beyond.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as blanks besides ASCII ones.
MARKS = "‘’“”„«»‐‑–—―…·•®™ "
#: Equivalent spellings, as patterns and what they become.
SPELLINGS = [
    ("licenc(e|ed|es|ing)", "licens{1}"),
    ("(behavi|col|fav|hon|lab|neighb)our", "{1}or"),
    ("(author|organ|recogn|capital|initial|general|real|util|penal|serial)is(e|ed|es|ing|ation)", "{1}iz{2}"),
    ("(acknowledg|judg)ement", "{1}ment"),
    ("(analog|catalog)ue", "{1}"),
    ("(cent|met)re", "{1}er"),
    ("merchantibility", "merchantability"),
    ("(non|sub|per|web) (commercial|licens|cent|site)", "{1}{2}"),
    ("copyright (owner|holder)", "copyright holder"),
    ("while", "whilst"),
    ("https", "http"),
]
NOTICE = "(^|\\n)[^a-z0-9\\n]*(copyright[ \\t]*(\\(c\\)|©|:|[0-9]{4})|\\(c\\)|©)[^\\n]*"
#: Lines of names alone, told by their capitals; (?d): lines end at \n only.
NAMED = "(?dm)^[^A-Za-z0-9\\n]*Copyright([ \\t]+(by|the|of|and|&|[A-Z][a-z'.-]+|[A-Z]\\.))+[.,]?[ \\t\\r]*$"
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: More known texts, one JSON object a line; read on the driver.
TABLE = Path(__file__).with_name("known_licenses.jsonl")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
_NO_FEE = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

"""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Known licence and notice texts. Titles are texts of their own form, so those with one stand twice.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC + _AUTHOR),
    ("ISC", "ISC License\n\n" + _ISC + _AUTHOR),
    ("0BSD", _NO_FEE + _AUTHOR),
    ("0BSD", "BSD Zero Clause License\n\n" + _NO_FEE + _AUTHOR),
    ("BSD-2-Clause", _BSD_1 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_1 + _BSD_END),
    ("BSD-3-Clause", _BSD_1 + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_1 + _BSD_NAME + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0-header", _APACHE),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
]


def shortened(text: Column) -> Column:
    """All steps but the spellings."""
    lower = F.translate(F.regexp_replace(text, NAMED, ""), UPPER + MARKS, LOWER + " " * len(MARKS))
    bare = F.regexp_replace(lower, NOTICE, "$1")
    words = F.trim(F.regexp_replace(bare, PUNCTUATION, " "))
    return F.trim(F.regexp_replace(words, " ?all rights reserved", ""))


def spelt(words: Column) -> Column:
    for pattern, becomes in SPELLINGS:
        words = F.regexp_replace(words, pattern, becomes.replace("{1}", "$1").replace("{2}", "$2"))
    return words


def digests(known: DataFrame) -> DataFrame:
    """license_id and digest of each known normal form (license_id, text)."""
    form = known.where("text is not null and license_id is not null").select("license_id", spelt(shortened(F.col("text"))).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text of KNOWN and of the data table."""
    with TABLE.open(encoding="utf-8") as f:
        more = [(r["license_id"], r["text"]) for r in map(json.loads, f)]
    return spark.createDataFrame(KNOWN + more, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """doc_id, digest, license_id (null: none known) and is_license of every document. One scan; no shuffle while the known table is small."""
    table = digests(known)
    table = F.broadcast(table) if table.count() <= most_broadcast else table.hint("shuffle_hash")
    rows = docs.select("doc_id", F.sha2(spelt(shortened(F.col("text"))), 256).alias("digest"))
    return rows.join(table, "digest", "left").select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))
