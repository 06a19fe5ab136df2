"""Licence scan by canonical digests, in built-in functions only.

A text is normalised (lower case, copyright notices dropped, runs of anything
but letters and digits to one space, equivalent spellings to one) and its
digest joined with those of the known licence texts: first the entire text,
then each of its lines, for the notices that documents carry.  Only texts
and lines with as many words as some known text get a digest; equal
normal forms have equal word counts, so nothing is lost by that.

Null and empty texts match nothing.  Rows that repeat are scanned one by
one.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepcorpus.llm import licence_texts as T

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC = _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_REST
_0BSD = _ISC_GRANT + ".\n" + _ISC_REST
_REGENTS = T.BSD_REGENTS.partition("\n\n")[2]


def _forms(name: str, text: str, *titles: str) -> tuple[tuple[str, str], ...]:
    """The text bare and under each of its titles."""
    return tuple((name, head + text) for head in ("", *(t + "\n\n" for t in titles)))


def _bsd(name: str, text: str, *titles: str) -> tuple[tuple[str, str], ...]:
    """With numbered and with bulleted conditions."""
    return _forms(name, text, *titles) + _forms(name, re.sub(r"(?m)^\d\. ", "* ", text), *titles)


def _cut(name: str, text: str, *replaced: tuple[str, str]) -> tuple[tuple[str, str], ...]:
    """With and without what follows the terms, and as earlier or later editions print an address."""
    texts = [text, text.partition("END OF TERMS AND CONDITIONS")[0], "".join(text.partition("END OF TERMS AND CONDITIONS")[:2])]
    for old, now in replaced:
        texts += [t.replace(old, now) for t in texts]
    return tuple((name, t) for t in dict.fromkeys(texts))


_FRANKLIN, _TEMPLE = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")

#: (licence, its text or one of its usual notices): public texts, fixed values.  A caller may pass more.
KNOWN = (
    *_forms("MIT", _MIT, "MIT License", "The MIT License (MIT)", "The MIT License"),
    *_forms("ISC", _ISC, "ISC License", "The ISC License", "ISC License (ISC)"),
    *_forms("0BSD", _0BSD, "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    *_bsd("BSD-2-Clause", _BSD_1 + _BSD_END, "BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    *_bsd("BSD-3-Clause", _BSD_1 + _BSD_3 + _BSD_END, "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    *_bsd("BSD-3-Clause", _REGENTS, "BSD 3-Clause License"),
    *_cut("Apache-2.0", T.APACHE_2, ("http://", "https://")),
    *_cut("GPL-2.0", T.GPL_2, (_FRANKLIN, _TEMPLE)),
    *_cut("GPL-3.0", T.GPL_3, ("https://", "http://")),
    *_forms("MPL-2.0", T.MPL_2), ("MPL-2.0", T.MPL_2.replace("http://", "https://")),
    *_forms("CC0-1.0", T.CC0_1), ("CC0-1.0", T.CC0_1.partition("\n\n")[2]),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"), ("0BSD", "SPDX-License-Identifier: 0BSD"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)

#: Words of equal meaning, one word each; fixed values.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center",
    "customised": "customized", "defence": "defense", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "maximise": "maximize", "merchantibility": "merchantability", "minimise": "minimize", "modelling": "modeling", "noncommercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: Words that go on from "copyright" in a sentence; any other word after it is a holder's name.
NOT_HOLDERS = """act after and applies are as at before can disclaimer doctrines does exists for from has holder holders if in information infringement interest interests is it law laws licence licences license licensed licensee
licenses licensing line lines may means must notice notices of on or owner owners ownership permission permissions policy protected protection right rights shall statement statements
status that to treaties treaty under was which will with without""".split()


_WORD_CHAR = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]"  # beyond ASCII


def _other_word(words: list[str], begun: bool = False) -> str:
    """A pattern of (the rest of) a word that is none of ``words``, without look-ahead, which DuckDB's patterns lack."""
    by_letter: dict[str, list[str]] = {}
    for w in filter(None, words):
        by_letter.setdefault(w[0], []).append(w[1:])
    other = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in by_letter)
    ends = [r"[^\p{L}\n]", "$"] if begun and "" not in words else []
    return "(?:" + "|".join([f"[{other}]", _WORD_CHAR, *ends, *(c + _other_word(w, True) for c, w in sorted(by_letter.items()))]) + ")"


#: A line that is a notice: a sign, "copyright" with (c), a year, a blank to fill in or a holder, "(c)" with one of these but a holder, or "all rights reserved" alone.
COPYRIGHT_LINE = (r"^[^\p{L}\p{N}©\n]*(?:©|copyright[ \t:,]*(?:\(c\)|©|[<\[{]|[0-9])|copyright[ \t:]+" + _other_word(NOT_HOLDERS)
                  + r"|c\)[ \t]*(?:copyright|©|[<\[{])|c\)[^\n]*(?:19|20)[0-9]{2}|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*")


def plain_lines(text: Column) -> Column:
    """Lower case, copyright lines empty, one space for anything but letters, digits and line ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}\n]+", " ")


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def words_in(plain: Column) -> Column:
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def canonical(plain: Column) -> Column:
    """Equivalent spellings to one; every word has spaces of its own."""
    out = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for word, same in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {same} "))
    return out


def known_digests(spark: SparkSession, known=KNOWN) -> tuple[DataFrame, list[int]]:
    """(license_id, digest) of the known texts, and their word counts.  A fixed list, so small enough to broadcast."""
    plain = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", one_line(plain_lines(F.col("text"))).alias("plain"))
    rows = plain.select("license_id", F.md5(canonical(F.col("plain"))).alias("digest"), words_in(F.col("plain")).alias("n")).distinct().collect()
    return spark.createDataFrame([(r[0], r[1]) for r in rows], "license_id string, digest string").groupBy("digest").agg(F.min("license_id").alias("license_id")), sorted({r[2] for r in rows})


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, license_id of the entire text (null: none known), n_notices (lines), notices (licences of lines, sorted, comma-joined)."""
    table, counts = known_digests(docs.sparkSession, known)
    digests = {r.digest: r.license_id for r in table.collect()}  # as many as the fixed list has
    lookup = F.broadcast(table)
    lines = docs.select("doc_id", plain_lines(F.coalesce("text", F.lit(""))).alias("lines")).withColumn("row_id", F.monotonically_increasing_id())
    candidates = lines.select("doc_id", "lines", F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: words_in(x).isin(counts)).alias("short"))
    # in-row lookup of the lines that may match: a digest against the fixed list, then the licences it names
    known_map = F.create_map(*[F.lit(x) for kv in digests.items() for x in kv]) if digests else F.create_map().cast("map<string,string>")
    found = F.filter(F.transform("short", lambda x: known_map[F.md5(canonical(x))]), lambda x: x.isNotNull())
    per_doc = candidates.select("doc_id", one_line(F.col("lines")).alias("plain"), found.alias("found"))
    digest = F.when(words_in(F.col("plain")).isin(counts), F.md5(canonical(F.col("plain"))))
    return (per_doc.withColumn("digest", digest).join(lookup, "digest", "left")
            .select("doc_id", "license_id", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices")))


def _plain_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _digest_sql(plain: str) -> str:
    out = f"' ' || replace({plain}, ' ', '  ') || ' '"
    for word, same in SPELLINGS.items():
        out = f"replace({out}, ' {word} ', ' {same} ')"
    return f"md5({out})"


def _known_sql() -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)


SQL = f"""
with known as (select name license_id, {_digest_sql("trim(regexp_replace(" + _plain_sql("body") + ", '[ \\n]+', ' ', 'g'))")} digest from (values {_known_sql()}) k(name, body) group by all),
names as (select digest, min(license_id) license_id from known group by digest),
t as (select row_number() over () row_id, doc_id, {_plain_sql("coalesce(text, '')")} lines from documents),
whole as (select row_id, doc_id, {_digest_sql("trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))")} digest from t),
line as (select row_id, {_digest_sql("trim(x)")} digest from t, unnest(string_split(lines, chr(10))) u(x)),
notice as (select row_id, count(*) n, string_agg(distinct license_id, ',' order by license_id) notices from line join names using (digest) group by row_id)
select doc_id, license_id, coalesce(n, 0)::bigint n_notices, coalesce(notices, '') notices
from whole left join names using (digest) left join notice using (row_id)
"""
