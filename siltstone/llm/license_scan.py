"""Licence scan: digests of canonical texts, joined with digests of known licences.

A text is brought to a canonical form: lower case, equivalent spellings made one,
copyright lines removed, everything but letters and digits turned to single
blanks. Texts whose canonical forms are equal have equal digests, so a hash join
finds entire texts that are a known licence; the same is done for each line,
which finds licence notices inside a document. DataFrame and SQL expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.license_texts import more_texts

#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("https", "http"), ("(c)", "copyright"), ("©", "copyright")]

#: Known licence texts and notices.
KNOWN = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "notice", "All rights reserved."),
    ("MIT", "text", "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "text", "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "text", "zlib License\n\nCopyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("WTFPL", "text", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
]

#: A line that names a copyright holder and states nothing else.
COPYRIGHT_LINE = r"(?m)^[ \t]*copyright[ \t]+[^\n]*[0-9<][^\n]*$"
#: The same without a year: under a sign, or a paragraph of its own; with the line "all rights reserved" that follows.
COPYRIGHT_LINES = r"(?m)(?:^[ \t]*copyright[ \t]+(?:[^\n]*[0-9<]|copyright\b)[^\n]*$|(?:\A|(?<=\n\n))[ \t]*copyright[ \t]+[^\n]{1,100}(?=\s*\z|\n[ \t]*\n|\n[ \t]*all rights reserved))(?:\s*\n[ \t]*all rights reserved[. \t]*$)?"
#: What every known notice holds; other lines aren't looked up.
NOTICE = r"licens|reserved|under"


def _spelled(text: Column) -> Column:
    t = F.lower(text)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def _lined(text: Column, copyright: str = COPYRIGHT_LINE) -> Column:
    """The canonical form with its line ends kept."""
    return F.regexp_replace(F.regexp_replace(_spelled(text), copyright, ""), r"[^\p{L}\p{N}\n]+", " ")


def _whole(lined: Column) -> Column:
    return F.trim(F.regexp_replace(lined, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    return _whole(_lined(text))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, kind, canonical, digest, bare) of the list above and of license_texts; ``bare`` is the digest without any copyright lines."""
    rows = spark.createDataFrame(KNOWN + more_texts(KNOWN), "license_id string, kind string, text string")
    rows = rows.select("license_id", "kind", canonical(F.col("text")).alias("canonical"), F.sha2(_whole(_lined(F.col("text"), COPYRIGHT_LINES)), 256).alias("bare"))
    return rows.withColumn("digest", F.sha2("canonical", 256))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, license_id, notices.

    ``license_id`` is that of the licence which the entire text is, by its digest
    or else by that without any copyright lines; ``notices`` the sorted distinct
    ids of licences that an entire line is, comma-joined. A null text has a null
    digest; ties between licences of one digest go to the smallest id. Repeated
    rows keep a row each; other columns aren't read. The list of licences is small
    by nature: it is checked to be at most 10,000 rows.
    """
    by_digest = licenses.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("canonical").alias("canonical"))
    known = by_digest.limit(10_001).collect()
    if not 0 < len(known) <= 10_000:
        raise ValueError("scan needs between 1 and 10,000 known licences")
    by_bare = licenses.where("kind = 'text'").groupBy("bare").agg(F.min("license_id").alias("bare_id"))
    text = F.col(text_col)
    bare = F.when(text.rlike("(?i)copyright|©|\\(c\\)"), F.sha2(_whole(_lined(text, COPYRIGHT_LINES)), 256))
    lined = docs.select(F.col(id_col).alias("id"), _lined(text).alias("lined"), bare.alias("bare"))
    whole = lined.select("id", "lined", F.sha2(_whole(F.col("lined")), 256).alias("digest"), F.coalesce("bare", F.sha2(_whole(F.col("lined")), 256)).alias("bare"))
    joined = whole.join(F.broadcast(by_digest.select("digest", "license_id")), "digest", "left").join(F.broadcast(by_bare), "bare", "left")
    # a line can be a licence only if it is as long as one; the digest is taken of those only
    lengths = F.array(*(F.lit(n) for n in sorted({len(r["canonical"]) for r in known})))
    ids = F.create_map(*(F.lit(x) for r in known for x in (r["digest"], r["license_id"])))
    marked = all(re.search(NOTICE, r["canonical"]) for r in known)
    lines = F.transform(F.split("lined", "\n"), lambda x: F.trim(x))
    alike = F.filter(lines, lambda x: (x.rlike(NOTICE) if marked else F.lit(True)) & F.array_contains(lengths, F.length(x)))
    hits = F.filter(F.transform(alike, lambda x: F.try_element_at(ids, F.sha2(x, 256))), lambda x: x.isNotNull())
    return joined.select("id", "digest", F.coalesce("license_id", "bare_id").alias("license_id"), F.coalesce(F.concat_ws(",", F.array_sort(F.array_distinct(hits))), F.lit("")).alias("notices"))


def scan_sql() -> str:
    """The same in DuckDB's SQL."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lined(x: str) -> str:
        out = f"lower({x})"
        for old, new in SPELLINGS:
            out = f"replace({out}, {text(old)}, {text(new)})"
        out = f"regexp_replace({out}, {text(COPYRIGHT_LINE)}, '', 'g')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def whole(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    known = " UNION ALL ".join(f"SELECT {text(i)} AS license_id, {text(t)} AS t" for i, _, t in KNOWN)
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, {whole(lined("t"))} AS c FROM ({known}) GROUP BY 2),
d AS (SELECT doc_id, {lined("text")} AS lined FROM documents),
w AS (SELECT doc_id, lined, {whole("lined")} AS c FROM d),
l AS (SELECT doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
  FROM (SELECT doc_id, trim(unnest(string_split(lined, chr(10)))) AS c FROM d) x JOIN known k USING (c) GROUP BY doc_id)
SELECT w.doc_id, sha256(w.c) AS digest, k.license_id, coalesce(l.notices, '') AS notices
FROM w LEFT JOIN known k USING (c) LEFT JOIN l ON l.doc_id = w.doc_id"""
