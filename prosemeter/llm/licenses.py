"""Licence scans: runs of lines, paragraphs and whole texts against templates by the Dice coefficient over word bigrams.

Method, in DataFrame operations only. A unit of text and a template are seen as sets of word bigrams, lower-cased and
without punctuation. They match if 2 * shared >= dice * (unit + template). So a unit matches only templates whose size
is within (2 - dice) / dice of its own, either way, and must share at least dice / (2 - dice) of a template's bigrams;
hence at least one of any choice of so many bigrams that fewer than that many are left. Each template names its least
common ones: a text that has none of these bigrams has no match, which is all that most texts are asked. Only the
others are cut into units; a text that is let go meets no join. The table of templates is small and broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Name and text of each template.
TEMPLATES: dict[str, str] = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
}

_GNU = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. You should have received a copy of the GNU {2} along with {5}"
_POSTAL = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_ONLINE = ". If not, see <https://www.gnu.org/licenses/>."
TEMPLATES |= {
    "gpl-2.0": _GNU.format("This program", ";", "General Public License", ";", "2", "this program") + _POSTAL,
    "lgpl-2.1": _GNU.format("This library", ";", "Lesser General Public License", ";", "2.1", "this library") + _POSTAL,
    "lgpl-3.0": _GNU.format("This program", ":", "Lesser General Public License", ",", "3", "this program") + _ONLINE,
    "agpl-3.0": _GNU.format("This program", ":", "Affero General Public License", ",", "3", "this program") + _ONLINE,
}

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "bsd-2-clause": _BSD.format(""),
    "bsd-3-clause": _BSD.format("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
}

#: The Creative Commons family, by its short names and by its sentence.
for _code, _full in {"BY": "", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC": "-NonCommercial", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"cc-{_code.lower()}-{_version}-short"] = f"Licensed under CC {_code} {_version}."
        TEMPLATES[f"cc-{_code.lower()}-{_version}-line"] = f"This work is licensed under a Creative Commons Attribution{_full} {_version} {_scope} License."

_COMMON = frozenset("a all an and any are as at be been but by can do for from had has have if in into is it its may more no not of on or other out so that the their they this to under up use used was were will with you your 0 1 2 3 4 5 6 7 8 9".split())


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, which is in ASCII."""
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def asked_bigrams(templates: dict[str, str], dice: float) -> list[str]:
    """Bigrams of which a text with a match has one at least."""
    out = set()
    for text in templates.values():
        own = bigrams(text)
        needed = math.ceil(dice / (2 - dice) * len(own) - 1e-9)
        out.update(sorted(own, key=lambda g: (sum(w in _COMMON for w in g.split()), -max(map(len, g.split())), g))[: len(own) - needed + 1])
    return sorted(out)


def any_of(bigrams_: list[str]) -> str:
    """A regular expression for any of the bigrams as words, in lower case; those with a common beginning share it."""

    def branch(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            heads.setdefault(w[:1], []).append(w[1:])
        parts = [h + branch(tails) if h else "" for h, tails in sorted(heads.items(), reverse=True)]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    between = r"[^\p{L}\p{N}]++"
    return f"(?:^|[^a-z0-9]){branch(bigrams_).replace(' ', between)}(?![a-z0-9])"


def _words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(w):
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _windows(texts: DataFrame, table: DataFrame, dice: float) -> DataFrame:
    """(uid, license, dice) of runs of two consecutive lines or more, blank ones aside.

    Only for texts that hold enough of a template's bigrams at all. A run begins and ends with a line that has part in a
    bigram of the template, else a shorter run is better; what it has of the text's bigrams that no earlier line had is
    at most what it has, so by their sums over lines a run that is surely too large is not built.
    """
    held = F.size(F.array_intersect("whole", "grams"))
    play = texts.select("uid", "t", _bigrams(_words(F.col("t"))).alias("whole")).join(F.broadcast(table), held >= F.col("n") * (dice / (2 - dice)) - 1e-9)
    play = play.select("uid", "license", "grams", "n", F.filter(F.transform(F.split("t", "\n"), _words), lambda w: F.size(w) > 0).alias("lines"))
    play = materialise(play, "licence-lines").where("size(lines) > 1")  # else lambdas over the lines would cut them again
    at = F.sequence(F.lit(1), F.size("lines"))
    line = lambda i: F.element_at("lines", i)
    has = lambda w: F.arrays_overlap(_bigrams(w), F.col("grams"))
    last = F.size("lines")
    play = play.withColumns({
        "new": F.transform(at, lambda i: F.size(_bigrams(F.flatten(F.slice("lines", F.lit(1), i))))),
        "first": F.filter(at, lambda i: (i < last) & has(F.concat(line(i), F.slice(line(F.least(i + 1, last)), 1, 1)))),
        "end": F.filter(at, lambda i: (i > 1) & has(F.concat(F.slice(line(F.greatest(i - 1, F.lit(1))), -1, 1), line(i)))),
    })
    runs = play.select("uid", "license", "grams", "n", "lines", "new", "end", F.explode("first").alias("i"))
    before = F.when(F.col("i") > 1, F.get("new", F.col("i") - 2)).otherwise(0)
    able = F.filter("end", lambda j: (j > F.col("i")) & (F.get("new", j - 1) - before - 1 <= F.col("n") * ((2 - dice) / dice) + 1e-9))
    runs = runs.withColumn("j", F.explode(able))
    own = _bigrams(F.flatten(F.slice("lines", F.col("i"), F.col("j") - F.col("i") + 1)))
    runs = runs.select("uid", "license", "grams", "n", own.alias("own"))
    return runs.select("uid", "license", (2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.col("n"))).alias("dice")).where(F.col("dice") >= dice)


def scan(docs: DataFrame, dice: float = 0.8, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_licenses, licenses, best_license, best_dice) for each row of docs.

    licenses: the names of all templates matched by a run of lines, a paragraph or the whole text, sorted and comma-joined; best:
    the one of the highest coefficient, the first by name among equals. A text without a match, a null or an empty one
    has 0, an empty string and nulls. Repeated rows and rows of null id get the answer of their text, however long it is;
    an empty table gives an empty result; other columns, of whatever name, are not looked at.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, bigrams(v)) for k, v in sorted(templates.items())], "license string, grams array<string>").withColumn("n", F.size("grams"))
    maybe = F.lower(text_col).rlike(any_of(asked_bigrams(templates, dice))) if templates else F.lit(False)
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.when(maybe, F.col(text_col)).alias("t")), "licence-texts")
    asked = rows.where("t IS NOT NULL")
    units = F.array_distinct(F.concat(F.split("t", "\n"), F.split("t", r"\n[\x20\t\r]*\n"), F.array("t")))
    cut = asked.select("uid", F.explode(units).alias("u")).select("uid", _bigrams(_words(F.col("u"))).alias("own")).where("size(own) > 0")
    own = F.size("own")
    sized = (F.col("n") >= own * (dice / (2 - dice)) - 1e-9) & (F.col("n") <= own * ((2 - dice) / dice) + 1e-9)
    met = cut.join(F.broadcast(table), sized).withColumn("dice", 2.0 * F.size(F.array_intersect("own", "grams")) / (own + F.col("n"))).where(F.col("dice") >= dice)
    met = met.select("uid", "license", "dice").union(_windows(asked.select("uid", "t"), table, dice))
    # Rows, not ids or texts, are what matches are gathered for: repeated ids do not mix, and a text in bulk is no key.
    best = met.groupBy("uid", "license").agg(F.max("dice").alias("dice")).groupBy("uid").agg(F.sort_array(F.collect_list("license")).alias("all"), F.min(F.struct(-F.col("dice"), "license")).alias("b"))
    told = asked.select("doc_id", "uid").join(best, "uid", "left").select("doc_id", F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("all", ","), F.lit("")).alias("licenses"), F.col("b.license").alias("best_license"), (-F.col("b.col1")).alias("best_dice"))
    others = rows.where("t IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_licenses"), F.lit("").alias("licenses"), F.lit(None).cast("string").alias("best_license"), F.lit(None).cast("double").alias("best_dice"))
    return told.unionByName(others)
