"""Operator 6: licence scans by canonical digest, with DataFrame functions alone.

A text's canonical form has lower-case words without punctuation, lines of copyright holders and differences of
spelling. Whole texts and their lines are joined by the digests of their canonical forms to those of known licences. A
known text inside a longer one is a run of its paragraphs: documents with the digest of a known text's first paragraph
are split, and paragraphs join known ones of the same digest; a run has them all at one distance.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import kept_columns, read_table

#: Known texts up to this number are broadcast, some 20 MB; more are joined by a shuffle.
BROADCAST_TEXTS = 200_000
#: Different first words of known texts by which others are ruled out.
MAX_FIRST_WORDS = 1000
SALTS = 16

#: What the canonical form replaces, in this order.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
SPELLINGS = (
    (r"[^\p{L}\p{N}]+", " "),
    (r"\blicenc", "licens"),
    (r"([a-z])is(e[ds]?|ing|ations?)\b", r"\1iz\2"),
    (r"([a-z][a-z])our(s|ed|ing|ite|able)?\b", r"\1or\2"),
    (r"([a-z])ys(e[ds]?|ing)\b", r"\1yz\2"),
    (r"\b(non|sub|per) (commercial|licens|infring|cent)", r"\1\2"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bwhilst\b", "while"),
    (r"\b(ful|wil)fil\b", r"\1fill"),
    (r"\bwilful", "willful"),
    (r"\b(acknowl|ju)(e?)dgement", r"\1\2dgment"),
    (r"\b(ana|cata|dia)logue", r"\1log"),
    (r"\b(cen|me|thea)tre(s?)\b", r"\1ter\2"),
    (r"\bcalibre", "caliber"),
    (r"\b(cancel|label|model|signal|travel)l(ed|ing)\b", r"\1\2"),
    (r"\b(defen|offen|preten)ce", r"\1se"),
    (r"\bpracti[sz]", "practic"),
    (r"\bprogramme(s?)\b", r"program\1"),
    (r"\bartefact", "artifact"),
    (r"\bcheque", "check"),
    (r"\bmerchantib", "merchantab"),
    (r"\bhttps\b", "http"),
)
#: What of a word shows that SPELLINGS may change it.
RESPELLED = "licenc|is|our|whilst|fil|ys|wilful|dgement|logue|tre|calibre|lled|lling|ence|practis|programme|artefact|cheque|merchantib|https"
#: Where a paragraph ends: at lines without letters and digits.
BREAK = r"\n[^\p{L}\p{N}]*\n"
#: A line after which licences may be cut, as what follows is advice.
CUT = "END OF TERMS AND CONDITIONS"

#: Public licence texts and notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
)
#: Titles above licences' texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"), "Zlib": ("zlib License", "The zlib License"),
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return F.trim(out)


def digest(text: Column) -> Column:
    """Digest of the canonical form; never null, so that a join needs no second look at it."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_digests(known: DataFrame) -> DataFrame:
    """license and digest of known: license and text; texts of which nothing is left aren't known."""
    return known.where(canonical(F.col("text")) != "").select("license", digest(F.col("text")).alias("digest")).distinct()


def may_be_known(text: Column, known: DataFrame) -> Column:
    """False only for texts that can't be one of known, by the first word.

    The first word of a canonical form is that of the text in lower case, respelled, unless two words are joined or a
    copyright line stands first; such texts stay. With many different first words all texts do.
    """
    firsts = known.select(F.split_part(canonical(F.col("text")), F.lit(" "), F.lit(1)).alias("w")).where("w <> ''").distinct().limit(MAX_FIRST_WORDS + 1).collect()
    if len(firsts) > MAX_FIRST_WORDS:
        return F.lit(True)
    # Only the word is lower-cased; marks that this makes end it. A sigma's form depends on what follows the word.
    raw = F.regexp_extract(F.lower(F.regexp_extract(text, r"[\p{L}\p{N}]+", 0)), r"[\p{L}\p{N}]+", 0)
    word = raw
    for pattern, by in SPELLINGS[1:]:
        word = F.regexp_replace(word, pattern, by.replace("\\", "$"))
    word = F.when(raw.rlike(RESPELLED), word).otherwise(raw)  # no other word is respelled
    return text.contains("©") | raw.rlike("^copyright|[σς]") | word.isin(*(r["w"] for r in firsts), "c", "all", "non", "sub", "per")


def published() -> list[tuple[str, str]]:
    """The licences whose whole texts come with the package, and what stands before their advice."""
    found = sorted((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in resources.files("emberline.llm").joinpath("license_texts").iterdir() if x.name.endswith(".txt"))
    return [*found, *((name, text[: text.index(CUT)] + part) for name, text in found if CUT in text for part in ("", CUT))]


def known_texts() -> list[tuple[str, str]]:
    """NOTICES, each with the titles that stand above its licence's text, and the published texts."""
    return [*NOTICES, *published(), *((name, f"{title}\n\n{text}") for name, titles in TITLES.items() for title in titles for held, text in NOTICES if held == name and "\n" in text)]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license string, text string")


def license_files(spark: SparkSession, path: str) -> DataFrame:
    """license and text of whole licence texts in files named by their licence, to be scanned for beside the notices."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.txt)?$", 1).alias("license"), F.col("value").alias("text"))


def paragraphs(text: Column) -> Column:
    """Digests of a text's paragraphs, in order, of which something is left."""
    return F.transform(F.filter(F.split(text, BREAK), lambda x: canonical(x) != ""), lambda x: F.sha2(canonical(x), 256))


def known_runs(known: DataFrame) -> DataFrame:
    """license, run (a name of the paragraphs together), length, place and digest of each paragraph of known texts."""
    parts = known.select("license", paragraphs(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    named = parts.select("license", F.sha2(F.array_join("parts", ","), 256).alias("run"), F.size("parts").alias("length"), "parts").distinct()
    return named.select("license", "run", "length", F.posexplode("parts").alias("place", "digest"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _embedded(keyed: DataFrame, starts: DataFrame, runs: DataFrame) -> DataFrame:
    """k1, k2 and embedded, the licences that are runs of paragraphs, of the texts of starts, each text looked at once."""
    bodies = keyed.join(_salted(starts), ["k1", "k2", "salt"], "left_semi").groupBy("k1", "k2").agg(F.first("body").alias("body"))
    own = bodies.select("k1", "k2", F.posexplode(paragraphs(F.col("body"))).alias("at", "digest"))
    found = own.join(runs, "digest").groupBy("k1", "k2", "license", "run", "length", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("n"))
    return found.where("n = length").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("license")).alias("embedded"))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of docs with licenses (sorted names), n_notices (lines that are a known text), whole_text (the name, if all
    of the text is one) and embedded (sorted names of those whose paragraphs all stand in the text one after the other).

    licenses are those found in any of these ways. Paragraphs end at lines without letters and digits, however they are
    wrapped. A text of one line that is a known text counts as line, whole and embedded. Null and empty texts, and texts of
    punctuation or copyright lines alone, have none. A text that two licences share is given as both, and whole_text is the
    first of them. Texts of any length are read whole. Repeated rows each get the same result; an empty table gives an empty
    one. Columns other than text pass through unread, but for those named like a result, which the result replaces.
    """
    keep = kept_columns(docs, keep, ["licenses", "n_notices", "whole_text", "embedded"])
    kept = [f"c{i}" for i in range(len(keep))]
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))
    runs = known_runs(known)
    # A whole text or line is looked up by its own digest, a paragraph by that of a known text's first one.
    whole, first = known_digests(known).select("digest", "license", F.lit(False).alias("first")), runs.where("place = 0").select("digest", F.lit(None).cast("string").alias("license"), F.lit(True).alias("first")).distinct()
    table = whole.unionAll(first)
    small = known.count() <= BROADCAST_TEXTS
    table = F.broadcast(table) if small else table
    # Equal texts have equal results, so a text's hashes stand for its rows.
    # The rows of a text that is copied often are dealt over SALTS tasks by their place.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    keyed = inner.withColumn("k1", F.xxhash64("body")).withColumn("k2", F.xxhash64(F.lit("second"), "body")).withColumn("salt", salt)
    unit = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("part"))
    parts = F.concat(F.array(unit("whole")(F.col("body"))), F.transform(F.split("body", "\n"), unit("line")), F.transform(F.split("body", BREAK), unit("paragraph")))
    units = keyed.where(F.col("body") != "").select("k1", "k2", F.explode(parts).alias("unit")).where(may_be_known(F.col("unit.part"), known))
    hits = units.select("k1", "k2", F.col("unit.kind").alias("kind"), digest(F.col("unit.part")).alias("digest")).join(table, "digest").where(F.col("first") == (F.col("kind") == "paragraph"))
    # Copies of a text add up alike, so their number divides out.
    each = hits.groupBy("k1", "k2", "kind", "license").agg(F.count("*").alias("n"))
    copies = keyed.where(F.col("body") != "").select("k1", "k2", "salt").join(_salted(each.select("k1", "k2").distinct()), ["k1", "k2", "salt"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    n_lines, named = F.sum(F.when(F.col("kind") == "line", F.col("n"))), F.min(F.when(F.col("kind") == "whole", F.col("license")))
    found = each.groupBy("k1", "k2").agg(F.collect_set("license").alias("licenses"), n_lines.alias("lines"), named.alias("whole_text"))
    embedded = _embedded(keyed, each.where("kind = 'paragraph'").select("k1", "k2").distinct(), F.broadcast(runs) if small else runs)
    none = F.array().cast("array<string>")
    found = found.join(copies, ["k1", "k2"]).join(embedded, ["k1", "k2"], "left").withColumn("embedded", F.coalesce("embedded", none))
    found = found.select("k1", "k2", F.array_sort(F.array_union("licenses", "embedded")).alias("licenses"), (F.coalesce("lines", F.lit(0)) / F.col("copies")).cast("long").alias("n_notices"), "whole_text", "embedded")
    out = keyed.join(_salted(found), ["k1", "k2", "salt"], "left")
    results = [F.coalesce("licenses", none).alias("licenses"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), "whole_text", F.coalesce("embedded", none).alias("embedded")]
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *results)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"), notices(spark), keep=["doc_id"])
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_notices", "whole_text", F.array_join("embedded", ",").alias("embedded"))


def _sql() -> str:
    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
        for pattern, by in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    return f"""
WITH texts AS (SELECT DISTINCT license, text FROM (VALUES {values}) AS v(license, text)),
known AS (SELECT DISTINCT license, {form("text")} AS form FROM texts),
units AS (SELECT doc_id, TRUE AS whole, text AS part FROM documents WHERE text <> ''
          UNION ALL SELECT doc_id, FALSE, unnest(string_split(text, chr(10))) FROM documents WHERE text <> ''),
hits AS (SELECT doc_id, whole, license FROM units JOIN known ON {form("part")} = form AND form <> ''),
f AS (SELECT doc_id, count(*) FILTER (NOT whole) AS n_notices, min(license) FILTER (whole) AS whole_text FROM hits GROUP BY doc_id),
split AS (SELECT license, text, unnest(string_split_regex(text, '{BREAK}')) AS part, generate_subscripts(string_split_regex(text, '{BREAK}'), 1) AS i FROM texts),
runs AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY license, text) AS length FROM (SELECT license, text, i, {form("part")} AS form FROM split) WHERE form <> '' WINDOW w AS (PARTITION BY license, text ORDER BY i)),
cut AS (SELECT doc_id, unnest(string_split_regex(text, '{BREAK}')) AS part, generate_subscripts(string_split_regex(text, '{BREAK}'), 1) AS i FROM documents),
own AS (SELECT doc_id, form, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nr FROM (SELECT doc_id, i, {form("part")} AS form FROM cut) WHERE form <> ''),
e AS (SELECT doc_id, license FROM own JOIN runs USING (form) GROUP BY doc_id, license, text, length, nr - place HAVING count(*) = length),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS embedded FROM e GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM (SELECT doc_id, license FROM hits UNION ALL SELECT doc_id, license FROM e) GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_notices, 0)::BIGINT AS n_notices, whole_text, coalesce(embedded, '') AS embedded
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
