"""Licence scan by canonical digest (DataFrame functions only).

A text is canonical after lower case, without copyright lines, with punctuation and space as single blanks and with one
spelling per term. Its SHA-256 is joined with the digests of known licences: the whole text, and each line as a text of
its own, since notices stand on lines of longer texts. Only digests are joined or shuffled.

Nulls: a null text is empty; an empty canonical text has a digest and never matches. Rows with the same id and text get
the same result, one row each; known licences with the same canonical text are one, named by the smallest name. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.llm.common import bind, stored

#: Terms with several spellings, as they stand in lower-case text without punctuation.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
             ("non commercial", "noncommercial"), ("organisation", "organization"), ("whilst", "while"),
             ("merchantibility", "merchantability"), ("favour", "favor"), ("per cent", "percent"),
             ("copyright owner", "copyright holder"))

#: Texts of known licences and notices.
KNOWN = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text; lines that are empty then are left out."""
    no_rights = lambda t: F.when(
        F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("(c)")),
        F.regexp_replace(t, r"(?m)^[ \t]*(copyright[ \t]+(\(c\)|©|[0-9])|©|\(c\))[^\n]*", "")).otherwise(t)
    plain = F.regexp_replace(bind(F.lower(F.coalesce(text, F.lit(""))), no_rights), r"[^\p{L}\p{N}\n]+", " ")

    def spelled(t: Column) -> Column:
        some, out = F.lit(False), t
        for form, term in SPELLINGS:
            some, out = some | F.contains(t, F.lit(form)), F.regexp_replace(out, rf"\b{form}\b", term)
        return F.when(some, out).otherwise(t)

    lines = F.transform(F.split(bind(plain, spelled), "\n"), lambda x: F.trim(x))
    return F.array_remove(lines, "")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: text_digest, license_id of the whole text, number and names of the notice lines."""
    known = (known.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("canonical"))
             .where("canonical <> ''").groupBy("canonical").agg(F.min("license_id").alias("license_id")))
    known = stored(known.select("license_id", F.length("canonical").alias("chars"),
                                F.sha2("canonical", 256).alias("digest")), "known")
    longest = known.agg(F.max("chars")).first()[0] or 0
    lines = docs.select("doc_id", bind(canonical_lines(F.col("text")), lambda x: F.struct(
        F.sha2(F.array_join(x, " "), 256).alias("whole"),
        F.transform(F.filter(x, lambda y: F.length(y) <= longest), lambda y: F.sha2(y, 256)).alias("lines"))).alias("c"))
    # a line longer than every known licence cannot match, so it needs no digest
    digests = stored(lines.select("doc_id", F.col("c.whole").alias("text_digest"), F.col("c.lines").alias("lines")),
                     "digests")
    names = known.select("digest", "license_id")
    found = (digests.select("doc_id", "text_digest", F.posexplode("lines").alias("line", "digest")).join(names, "digest")
             .groupBy("doc_id", "text_digest", "line").agg(F.min("license_id").alias("name"))
             .groupBy("doc_id", "text_digest")
             .agg(F.count("*").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("notices"))
             .select(F.col("doc_id").alias("f_id"), F.col("text_digest").alias("f_digest"), "n_notices", "notices"))
    whole = digests.drop("lines").join(names.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return (whole.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_digest") == F.col("f_digest")), "left")
            .select("doc_id", "text_digest", "license_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
                    F.coalesce("notices", F.lit("")).alias("notices")))
