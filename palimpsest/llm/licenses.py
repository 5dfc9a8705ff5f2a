"""License scans by canonical digest lookup, in DataFrame functions only.

A text is made canonical: copyright statements out, lower case, punctuation out, equivalent spellings alike, white space
collapsed. Its digest is joined with the digests of known license texts: those of public_texts(), kept as a table of digests
(license_digests.json, made by ``python -m palimpsest.llm.licenses`` from the texts), or of texts of the caller's own. On request
each whole line is looked up too, where a notice of one line stands in a longer document.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Spellings that count as equal, after lower-casing and without punctuation; the right one is used.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfilment", "fulfillment"),
    ("http", "https"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
_ANY_VARIANT = r"\b(?:" + "|".join(a for a, _ in EQUIVALENT) + r")\b"
_MARK = r"(?:\([cC]\)|©|&copy;)"
_YEAR = r"(?:[0-9]{4}\b|<year>|\[yyyy\]|\{yyyy\})"
#: Words after "copyright" that are no holder, and beginnings of licence texts, where a holder ends.
_NO_HOLDER = (
    r"(?i:notices?|holders?|owners?|laws?|licen[cs]es?|licen[cs]ed|statements?|protection|treaty|interests?|disclaimer|"
    r"infringement|act|and|or|of|in|on|to|is|as|for|by the|permission|status|doctrine|rights?)\b"
)
_STOP = (
    r"(?i:all rights reserved|permission is hereby|permission to use|redistribution and use|licensed under|"
    r"released under|everyone is permitted|this (?:program|software|library|work|file|source|is)\b)"
)
_WORD = r"[^\s]+"
#: A copyright statement: "copyright" with a mark, a year or a holder (a capital letter, at the beginning of a line), or a
#: mark with a year; then the holder, up to the end of the line or the beginning of a licence text if that comes within 20 words,
#: else up to the first end of a sentence, of the line, or beginning of a licence text, however far.
_SHAPE = (
    rf"(?:\b(?i:copyright)[ \t:,]*(?:{_MARK}[ \t,]*(?:{_YEAR})?|{_YEAR})|{_MARK}[ \t]*(?i:copyright\b[ \t]*)?{_YEAR}|"
    rf"(?m:^)[^\p{{L}}\p{{N}}\n]*(?:Copyright|COPYRIGHT)[ \t]+(?:by[ \t]+)?(?!{_NO_HOLDER})(?=\p{{Lu}}))"
)
_HOLDER = (
    rf"(?:[^\n\S]*(?:(?!{_STOP}){_WORD}[^\n\S]+){{0,20}}?(?:(?!{_STOP}){_WORD}[^\n\S]*)?(?=\n|\z|{_STOP})|"
    rf"[^\n]*?(?:(?=\n|\z|\b{_STOP})|(?<=[\p{{L}}>]{{3}}\.)(?=[^\n\S])))?"
)
STATEMENT = rf"{_SHAPE}{_HOLDER}(?:\s*(?i:all rights reserved)\b\.?)?|(?m:^)[^\p{{L}}\p{{N}}\n]*(?i:all rights reserved)[^\p{{L}}\p{{N}}\n]*(?m:$)"
#: Every text with a statement has one of these.
_STATED = r"(?i)copyright|©|&copy;|\(c\)|all rights reserved"

#: Public licence texts and notices that the query looks for.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
)


def canonical_lines(text: Column) -> Column:
    """The lines of text in canonical form, copyright statements and empty lines out."""
    own = F.when(text.rlike(_STATED), F.regexp_replace(text, STATEMENT, " ")).otherwise(text)
    plain = F.regexp_replace(F.lower(own), r"[^\p{L}\p{N}©\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def alike(text: Column) -> Column:
    """text, canonical but for its spellings, with those replaced, and white space collapsed."""
    spelled = F.trim(F.regexp_replace(F.translate(text, "©", " "), " +", " "))
    for variant, usual in EQUIVALENT:
        spelled = F.regexp_replace(spelled, rf"\b{variant}\b", usual)
    plain = F.trim(F.regexp_replace(F.translate(text, "©", " "), " +", " "))
    return F.when(text.rlike(_ANY_VARIANT), spelled).otherwise(plain)


def digest(canonical: Column) -> Column:
    return F.sha2(F.encode(canonical, "UTF-8"), 256)


def public_texts() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of the notices of KNOWN and of the whole licence texts in license_texts.json: each with its
    title, without it, and with its usual titles; with and without the appendix that tells how to apply it."""
    return KNOWN + tuple((i, t) for i, t in json.loads(pkgutil.get_data(__package__, "license_texts.json")))


def _digests(spark: SparkSession, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in texts]))
    canonical = spark.range(1).select(rows).select("license_id", alike(F.array_join(canonical_lines(F.col("text")), " ")).alias("c"))
    return canonical.groupBy(digest(F.col("c")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_digests() -> dict[str, str]:
    """license_id of each digest of the public texts."""
    return json.loads(pkgutil.get_data(__package__, "license_digests.json"))


def known_licenses(spark: SparkSession, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """license_id, digest of the public texts, or of the given ones; of texts that are alike, the first license by name. An
    empty list gives no rows."""
    if texts is not None:
        return written(_digests(spark, texts), "known-licenses") if texts else spark.range(0).selectExpr("'' AS digest", "'' AS license_id")
    rows = [F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for d, i in known_digests().items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def license_scan(
    docs: DataFrame, known: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: bool = False
) -> DataFrame:
    """doc_id, text_digest, text_license of each row of docs, and with lines line_licenses.

    text_digest is the digest of the whole canonical text, text_license the license whose text it is, else null;
    line_licenses are the licenses, sorted, of which some whole line is the text. known(digest, license_id) may be of any
    size: the join is by hash, and small only if Spark finds it small. Null and empty texts, and those of copyright statements
    alone, have the digest of the empty text and no license. Rows are neither merged nor dropped; each gets the
    answer of its own text, whatever doc_ids repeat; a null doc_id stays null; very long texts are read whole. Of known texts that are
    alike, the first license by name counts. Empty tables give no rows. Only the named columns are read, so others may have
    any name.
    """
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), canonical_lines(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias("lines"))
    of_text = digest(alike(F.array_join("lines", " "))).alias("text_digest")
    whole = known.groupBy(F.col("digest").alias("d1")).agg(F.min("license_id").alias("text_license"))
    if not lines:
        found = own.select("doc_id", of_text)
        return found.join(whole, F.col("text_digest") == F.col("d1"), "left").select("doc_id", "text_digest", "text_license")
    of_lines = F.array_distinct(F.transform("lines", lambda x: F.unhex(digest(alike(x))))).alias("line_digests")
    # texts are worked on once; what both lookups read is small
    found = written(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", of_text, of_lines), "license-digests")
    each = found.select("row", F.explode("line_digests").alias("line"))
    of_known = known.select(F.unhex("digest").alias("d2"), F.col("license_id").alias("line_license")).distinct()
    hit = each.join(of_known, F.col("line") == F.col("d2"))
    hit = hit.groupBy("row").agg(F.array_sort(F.collect_set("line_license")).alias("line_licenses"))
    rows = found.select("row", "doc_id", "text_digest").join(whole, F.col("text_digest") == F.col("d1"), "left")
    none = F.array().cast("array<string>")
    return rows.join(hit, "row", "left").select("doc_id", "text_digest", "text_license", F.coalesce("line_licenses", none).alias("line_licenses"))


def _write_digests() -> None:
    """Makes license_digests.json anew; tests hold it against the texts."""
    from pathlib import Path

    spark = SparkSession.builder.master("local[4]").getOrCreate()
    rows = sorted(tuple(r) for r in _digests(spark, public_texts()).select("digest", "license_id").collect())
    (Path(__file__).parent / "license_digests.json").write_text(json.dumps(dict(rows), indent=0) + "\n")


if __name__ == "__main__":
    _write_digests()
