r"""Licence scans by canonical digest lookup.

A unit of text (a whole document, a paragraph or a line of it) is made canonical: lines of copyright notices go, case and
punctuation go, equivalent spellings become one, white space becomes one space. Its SHA-256 is looked up
by a hash join among the digests of known licence texts and notices, made canonical by the same function. Only
entire units match; there is no partial or fuzzy match.

Defined cases: null text counts as empty; the empty canonical text never matches; repeated rows are scanned each; texts
of any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spellings that mean the same, after lower-casing and removal of punctuation (whole words).
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("initialise", "initialize"), ("whilst", "while"), ("wilful", "willful"), ("http", "https"), ("v2", "version 2"), ("v3", "version 3"),
)

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL = "This work is licensed under the GNU General Public License, version {}."
#: Known licence texts and notices, as (licence, text).
KNOWN = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)
#: A line of a copyright notice, lower case.
COPYRIGHT_LINE = r"^[^a-z0-9©(]*(copyright +(\(c\)|©|[0-9]{4}|by )|\(c\) *[0-9]{4}|© *[0-9]{4}|all rights reserved)"


_copyright = re.compile(COPYRIGHT_LINE)
_other = re.compile("[^a-z0-9]+")
_paragraph = re.compile(r"\n[ \t\r]*\n")
_equivalent = [(a, re.compile(rf"\b{a}\b"), b) for a, b in EQUIVALENT]


def canonical(text: str) -> str:
    """The canonical form of a unit of text."""
    lines = [line for line in text.lower().split("\n") if not _copyright.match(line)]
    out = _other.sub(" ", " ".join(lines)).strip()
    for a, word, b in _equivalent:
        if a in out:
            out = word.sub(b, out)
    return out


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def units(text: str) -> list[str]:
    """What can match: the whole, lines, paragraphs of several lines; a unit that is more than one of these counts once."""
    found = dict.fromkeys([text, *text.split("\n")])
    if "\n" in text:
        found.update(dict.fromkeys(p for p in _paragraph.split(text) if "\n" in p))
    return list(found)


def known(spark, catalogue=KNOWN) -> DataFrame:
    """digest, license: bounded by the catalogue; texts that are empty when canonical match nothing."""
    rows = sorted({(digest(text), name) for name, text in catalogue if canonical(text)})
    return spark.createDataFrame(rows, "digest string, license string")


def scan(documents: DataFrame, catalogue=KNOWN) -> DataFrame:
    """doc_id, text_digest (of the whole canonical text), licenses (sorted, comma between), n_units (units that match).

    catalogue: (licence, text) of what is looked for.
    """
    kind = dict(documents.dtypes)["doc_id"]
    marked = all(re.search(MARK, text.lower()) for _, text in catalogue)

    def run(batches):
        mark = re.compile(MARK if marked else "")
        for batch in batches:
            whole, own = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                first = digest(text)
                whole.append(first)
                # a unit without the words that all known texts have is not worth a digest
                own.append([first if u is text else digest(u) for u in units(text) if mark.search(u.lower())] if mark.search(text.lower()) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole), pa.array(own, pa.list_(pa.string()))], ["doc_id", "text_digest", "digests"])

    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_digest string, digests array<string>")
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "text_digest", F.explode_outer("digests").alias("digest"))
    hit = each.join(F.broadcast(known(documents.sparkSession, catalogue)), "digest", "left")
    found = hit.groupBy("_row", "doc_id", "text_digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count("license").alias("n_units"))
    return found.select("doc_id", "text_digest", "licenses", "n_units")


#: Each known text has one of these words, whatever its spelling.
MARK = "licen[cs]|permission"


def oracle() -> str:
    """The same in SQL."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        lines = f"list_filter(string_split(lower({x}), chr(10)), lambda l: NOT regexp_matches(l, {text(COPYRIGHT_LINE)}))"
        out = f"trim(regexp_replace(array_to_string({lines}, ' '), '[^a-z0-9]+', ' ', 'g'))"
        for a, b in EQUIVALENT:
            out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
        return out

    values = ", ".join(f"({text(a)}, {text(b)})" for a, b in KNOWN)
    return f"""
        WITH known AS (SELECT DISTINCT license, sha256({canon("text")}) AS digest FROM (VALUES {values}) AS k(license, text)),
        docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        units AS (
            SELECT r, unnest(list_distinct(list_concat([text], list_concat(string_split(text, chr(10)),
                list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))))))) AS unit FROM docs
        ),
        hits AS (
            SELECT r, license FROM (SELECT r, sha256({canon("unit")}) AS digest FROM units WHERE regexp_matches(lower(unit), '{MARK}'))
            JOIN known USING (digest)
        )
        SELECT doc_id, sha256({canon("text")}) AS text_digest,
               coalesce((SELECT string_agg(DISTINCT license, ',' ORDER BY license) FROM hits WHERE hits.r = docs.r), '') AS licenses,
               (SELECT count(*) FROM hits WHERE hits.r = docs.r) AS n_units
        FROM docs
    """
