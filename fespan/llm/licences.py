"""License scans: canonical digests of entire texts, hash-joined to known licence digests; DataFrame functions only."""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, without

#: A line that is a copyright notice, after optional comment marks: a year, (c) or a capitalised holder follows the word, or it
#: only reserves all rights. Other lines that begin with the word, as wrapped licence texts have them, stay.
COPYRIGHT = (
    r"(^|\n)[ \t#*;%/!|>-]*(?:<!--[ \t]*|(?i:dnl|rem)[ \t]+)?"
    r"(?:(?:(?i:(?:portions[ \t]+)?copyright(?:ed)?)[ \t:,]*(?:(?i:by)[ \t]+)?(?:(?i:\(c\)|©|&copy;|[<\[{(]?(?:yyyy|year)\b)|[<\[{(]?(?:19|20)[0-9]{2}\b)"
    r"|(?i:\(c\)|&copy;)[ \t,]*(?:(?i:copyright)\b|(?:19|20)[0-9]{2}\b)|©"
    r"|Copyright[ \t:]+(?:by[ \t]+)?(?!(?i:licen[sc]e|notice|holder|owner|law|act|office|right|interest|and|or|statement|treat)(?i:s|y|ies|ed)?\b)\p{Lu})[^\n]*"
    r"|(?i:all rights reserved)[ \t.!*/\r]*(?=\n|\z))"
)
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Equivalent spellings (the right one is canonical), fixed values.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("modelled", "modeled"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: Titles that stand over licences, besides the first paragraph of the file in licence_texts.
TITLES = {
    "MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT", "(The MIT License)", "The MIT License (Expat)", "The Expat License"),
    "ISC": ("The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("The BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause License", "BSD-2-Clause", "Simplified BSD License", "The BSD License", "BSD License"),
    "BSD-3-Clause": ("The BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "The BSD License", "BSD License"),
    "Zlib": ("The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("Unlicense",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
}
#: First words of known texts that a test of lines lists.
FIRST_WORDS = 1000
#: What licence files may leave out at the end: the closing line and instructions for use.
TAIL = re.compile(r"(\n\s*END OF TERMS AND CONDITIONS)?\n\s*(APPENDIX:|Appendix:|ADDENDUM:|How to Apply These Terms)")
#: Known texts, fixed values: whole licences and the usual one-line notices; standard_texts() adds the files.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)


def canonical(text: F.Column) -> F.Column:
    """Lower case, no copyright lines, words joined by one space, canonical spellings."""
    t = F.lower(F.regexp_replace(text, COPYRIGHT, "\n"))
    # two spaces between words, so that each of several equal words has its own
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, "  "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: F.Column) -> F.Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def standard_texts() -> list[tuple[str, list[str], list[str], list[str]]]:
    """(license, titles, bodies, tails) of each file in licence_texts, <license>.txt or <license>~<variant>.txt; each title, body
    and tail make a text. Title and tail may be missing; items may be numbered or not."""
    out = []
    for f in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name = f.name.removesuffix(".txt").split("~")[0]
        title, _, body = f.read_text(encoding="utf-8").strip().partition("\n\n")
        m = TAIL.search(body)
        cut, tails = (body[: m.start()], {"", m[1] or "", body[m.start() :]}) if m else (body, {""})
        bodies = {cut, re.sub(r"(?m)^[0-9][.] |^[ \t]*\([a-z]\) ", "", cut), re.sub(r"(?m)^[ \t]*\([a-z]\) ", "", cut)} if name in TITLES else {cut}
        out.append((name, ["", title, *TITLES.get(name, ())], sorted(bodies), sorted(tails)))
    return out


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(known_digest, license, first): one row for each known text; first: its first canonical word. known: a list of (license, text), or by default KNOWN and
    standard_texts(), their links with http and https."""
    parts = [(n, [""], [t], [""]) for n, t in known] if known is not None else [(n, [""], [t], [""]) for n, t in KNOWN] + standard_texts()

    def strings(x):
        return F.array(*[F.lit(v) for v in x])

    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("license"), strings(a).alias("a"), strings(b).alias("b"), strings(c).alias("c")) for n, a, b, c in parts])).alias("k")).select("k.*")
    rows = rows.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).withColumn("c", F.explode("c")).select("license", F.concat("a", F.lit("\n"), "b", "c").alias("text"))
    if known is None:
        rows = rows.select("license", F.explode(F.array("text", F.replace("text", F.lit("https://"), F.lit("http://")), F.replace("text", F.lit("http://"), F.lit("https://")))).alias("text"))
    first = F.substring_index(canonical(F.col("text")), " ", 1)
    return rows.select(digest(F.col("text")).alias("known_digest"), "license", first.alias("first")).groupBy("known_digest").agg(F.min("license").alias("license"), F.min("first").alias("first"))


def _may_be_known(known: DataFrame):
    """Whether a line's first word is that of a known text (every line with a word, if known does not say or has very many)."""
    words = [r[0] for r in known.select("first").distinct().limit(FIRST_WORDS + 1).collect()] if "first" in known.columns else None
    if words is None or len(words) > FIRST_WORDS or None in words:
        return lambda line: line.rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z]")
    spelt = {*words, *(a for a, b in SPELLINGS if b.split(" ")[0] in words)}
    return lambda line: F.regexp_extract(F.lower(line), r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)", 1).isin(*sorted(spelt))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (without the text) with digest, license and notices.

    digest: SHA-256 of the whole canonical text; license: the known text it equals, or null; notices: sorted, comma-joined
    licences of the document's lines that are known texts by themselves ('' if none). Null text: null digest and license, no
    notice. Each repeated row gets its result (rows of one id and one digest share their notices); columns named like results
    are replaced. known: rows (known_digest, license), and first if lines are to be left out whose first word no known text begins
    with; others cannot equal one. The joins are equi-joins on digests.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    may, known = _may_be_known(known), known.select("known_digest", "license")
    base = without(docs, "digest", "license", "notices", "known_digest", "_lines", "_id", "_digest")
    text = F.col(text_col)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), may)
    marked = materialize(base.withColumn("digest", digest(text)).withColumn("_lines", F.array_distinct(lines)).drop(text_col), "licences")
    found = marked.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), F.explode("_lines").alias("_line")).withColumn("known_digest", digest(F.col("_line"))).join(known, "known_digest")
    notices = found.groupBy("_id", "_digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = marked.drop("_lines").join(known, F.col("digest") == F.col("known_digest"), "left").drop("known_digest")
    out = out.join(notices, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")
    return out.withColumn("notices", F.coalesce("notices", F.lit("")))
