"""Licence scan: normalised text against licence templates by Dice over word bigrams.

A unit is a line, a paragraph (between blank lines) or the whole text.  It is
compared only with templates whose size allows the threshold: with ``a`` and
``b`` bigrams, ``2 min(a, b) / (a + b)`` bounds the coefficient.  Bigrams count
as often as they occur, on both sides, so a template has 1 against itself.
Everything is an expression over one document's row, so there is no shuffle at
all and no group can be hot.  DataFrame operations only.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
DICE = 0.8

# Public licence notices and texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
)


def bigrams(text: str) -> list[str]:
    """The bigrams of a template, in order; only letters and digits count."""
    words = re.findall(r"[^\W_]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _bounds(size: int, dice: float) -> tuple[int, int]:
    """The least and greatest number of bigrams that can reach the coefficient."""
    return -int(-size * dice / (2 - dice) // 1), int(size * (2 - dice) / dice)


def _templates(dice: float) -> list[tuple[str, int, int, int, list[str], dict[str, int]]]:
    """License, size, least and greatest unit, distinct bigrams, and how often more than once the others occur."""
    return [(name, len(b), *_bounds(len(b), dice), sorted(set(b)), {x: n - 1 for x, n in sorted(Counter(b).items()) if n > 1}) for name, text in TEMPLATES for b in (bigrams(text),)]


def _merged(known: list[tuple]) -> list[tuple[int, int]]:
    """The sizes that fit any template, as few ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(lo, 1), hi) for _, _, lo, hi, *_ in known):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def scan_licenses(docs: DataFrame, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``matches``.

    ``matches`` has (license, dice) of every unit that matches, best template
    first decided by coefficient, then by name; equal units count once.  The
    coefficient is 2 x common bigrams / (bigrams of the unit and of the
    template), each bigram as often as it occurs; a template has 1 against itself.

    Null and empty texts match nothing; a null id is kept; repeated rows come
    back as often as they occur; other columns are not read.  An empty table
    gives an empty result.
    """
    known = _templates(dice)

    def template(name: str, size: int, lo: int, hi: int, distinct: list[str], more: dict[str, int]) -> Column:
        repeated = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in more.items())).cast("array<struct<b:string,n:int>>")
        return F.struct(
            F.lit(name).alias("name"), F.lit(size).alias("size"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, distinct)).alias("bigrams"), repeated.alias("repeated"), F.lit(sum(more.values())).alias("more")
        )

    table = F.array(*(template(*t) for t in known))
    # letters and digits, single spaces between words, none at the ends of lines
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    plain = F.trim(F.regexp_replace(plain, r" ?\n ?", "\n"))
    paragraphs = F.when(F.instr("plain", "\n\n") > 0, F.transform(F.split("plain", r"\n\n+", -1), lambda u: F.replace(u, F.lit("\n"), F.lit(" ")))).otherwise(F.array().cast("array<string>"))
    whole = F.trim(F.regexp_replace("plain", r"\n+", " "))
    units = F.array_distinct(F.transform(F.concat(F.split("plain", "\n", -1), paragraphs, F.array(whole)), lambda u: F.trim(u)))
    # spaces are bigrams; counted once a unit
    counted = F.transform("units", lambda u: F.struct(u.alias("u"), (F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))).alias("n")))

    def possible(u: Column) -> Column:
        fits = F.lit(False)
        for lo, hi in _merged(known):
            fits = fits | u["n"].between(lo, hi)
        return fits

    def pairs(u: Column) -> Column:
        words = F.split(u, " ")
        return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    sized = F.transform(F.filter("counted", possible), lambda u: F.struct(u["n"].alias("n"), pairs(u["u"]).alias("b")))

    def best(u: Column) -> Column:
        near = F.filter("table", lambda t: u["n"].between(t["lo"], t["hi"]))
        once = F.transform(near, lambda t: F.struct(t.alias("t"), F.size(F.array_intersect(u["b"], t["bigrams"])).alias("common")))
        # repeated bigrams are counted only where they could make a match
        close = F.filter(once, lambda c: 2.0 * (c["common"] + c["t"]["more"]) >= dice * (u["n"] + c["t"]["size"]))

        def again(c: Column) -> Column:
            return F.aggregate(c["t"]["repeated"], F.lit(0), lambda total, r: total + F.greatest(F.lit(0), F.least(r["n"], F.size(F.filter(u["b"], lambda x: x == r["b"])) - 1)))

        return F.array_min(F.transform(close, lambda c: F.struct((-2.0 * (c["common"] + again(c)) / (u["n"] + c["t"]["size"])).alias("score"), c["t"]["name"].alias("name"))))

    hits = F.filter(F.transform("sized", best), lambda m: m["score"] <= -dice)
    rows = docs.select(F.col(id_col).alias("doc"), plain.alias("plain")).withColumn("units", units).withColumn("counted", counted).withColumn("table", table).withColumn("sized", sized)
    return rows.select(F.col("doc").alias(id_col), F.transform(hits, lambda m: F.struct(m["name"].alias("license"), (-m["score"]).alias("dice"))).alias("matches"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document with its licences and the best coefficient."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.round(F.coalesce(F.array_max(F.col("matches.dice")), F.lit(0.0)), 6).alias("best_dice"))


def _sql() -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({k}, {quoted(n)}, {s}, {lo}, {hi})" for k, (n, s, lo, hi, *_) in enumerate(_templates(DICE)))
    grams = ", ".join(f"({k}, {quoted(b)}, {1 + more.get(b, 0)})" for k, (*_, distinct, more) in enumerate(_templates(DICE)) for b in distinct)
    return rf"""
WITH t(k, name, size, lo, hi) AS MATERIALIZED (VALUES {known}),
g(k, b, n) AS MATERIALIZED (VALUES {grams}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS p FROM documents),
u AS (SELECT DISTINCT rid, trim(regexp_replace(replace(x, chr(10), ' '), ' +', ' ', 'g')) AS x FROM (SELECT rid, unnest(list_concat(string_split(p, chr(10)), string_split_regex(p, '\n *\n'), [p])) AS x FROM d)),
w AS (SELECT rid, x, string_split(x, ' ') AS w FROM u WHERE x <> ''),
v AS MATERIALIZED (SELECT row_number() OVER () AS uid, rid, w FROM w WHERE len(w) - 1 BETWEEN (SELECT greatest(min(lo), 1) FROM t) AND (SELECT max(hi) FROM t)),
p AS (SELECT uid, b, count(*) AS n FROM (SELECT uid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM v) GROUP BY uid, b),
q AS (SELECT uid, k, sum(least(p.n, g.n)) AS common FROM p JOIN g USING (b) GROUP BY uid, k),
c AS (SELECT uid, rid, name, 2.0 * common / (len(w) - 1 + size) AS dice FROM q JOIN v USING (uid) JOIN t USING (k) WHERE len(w) - 1 BETWEEN lo AND hi),
m AS (SELECT rid, uid, arg_min(name, (-dice, name)) AS name, max(dice) AS dice FROM c GROUP BY rid, uid HAVING max(dice) >= {DICE}),
o AS (SELECT rid, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best_dice FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, round(coalesce(best_dice, 0)::DOUBLE, 6) AS best_dice FROM d LEFT JOIN o USING (rid)
"""


OP6_SQL = _sql()
