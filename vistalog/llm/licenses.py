"""Licence scans with DataFrame functions alone: Dice coefficient of word bigrams against licence templates.

The whole text, its paragraphs, its lines, the sentences of its lines and runs of lines are units. A unit's words are its
runs of ASCII letters and digits, lower-cased; its set is that of its distinct word bigrams. Since the Dice coefficient
of sets of a and b elements is at most 2 min(a, b) / (a + b), only templates whose size lies between a t / (2 - t) and
a (2 - t) / t are compared. By the same bound a unit that reaches t has t / (2 - t) of a template's bigrams at least, and
so a certain number of its long words: a text without them is left out before any unit is made (see marks()).

A run of lines is sought for each template: lines of which half the bigrams are the template's, with at most two others
between them. So a licence is found within a longer text, in paragraphs, as comments and above code, and work is linear
in the lines. Of runs that overlap the best one counts.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from itertools import groupby
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Published licence texts and the notices by which works name them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 notice": "This work is licensed under the Mozilla Public License, version 2.0.",
}

TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace(
    "THIS SOFTWARE IS PROVIDED",
    """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED""",
)
for _name, _licence, _version in (("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")):
    TEMPLATES[f"{_name} header"] = re.sub(r"GNU\s+General\s+Public", f"GNU {_licence} Public", TEMPLATES["GPL-3.0 header"]).replace("version 3 of", f"version {_version} of")
    TEMPLATES[f"{_name} notice"] = f"This work is licensed under the GNU {_licence} Public License, version {_version}."
TEMPLATES["MPL-2.0 header"] = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
TEMPLATES["BSD-2-Clause notice"] = "Released under the BSD 2-Clause License."
#: The licences that are long, one a file, as their publishers give them.
LONG = Path(__file__).with_name("licences")


@lru_cache(maxsize=1)
def public_templates() -> dict[str, str]:
    """Every template by name: those above and the long texts."""
    return TEMPLATES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(LONG.glob("*.txt"))}


#: Words that many texts have, for which texts are sought last; and bigrams above which a template is long.
USUAL = frozenset("the of and to in a for by with under is this or that be as are not you it on an any".split())
LONG_BIGRAMS = 300


def bigrams_of(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, least: float) -> tuple[int, int]:
    """Smallest and largest size of a set whose Dice coefficient with a set of ``n`` elements can reach ``least``."""
    slack = 1e-9  # so that rounding excludes no size that reaches the threshold exactly
    return math.ceil(n * least / (2 - least) - slack), math.floor(n * (2 - least) / least + slack)


def normalised(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits with one space between them."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))))


def _words_of(grams: list[str]) -> dict[str, set[str]]:
    """The bigrams of each word of a template, long words first and usual ones last."""
    own: dict[str, set[str]] = {}
    for g in grams:
        for w in set(g.split(" ")):
            own.setdefault(w, set()).add(g)
    return {w: own[w] for w in sorted(own, key=lambda w: (w in USUAL, -len(w), w))}


def marks(grams: list[str], least: float) -> tuple[list[str], int]:
    """Long words of a template, and how many of them a unit must have to reach ``least``.

    A unit that reaches it has a share t / (2 - t) of the template's bigrams. If the words' bigrams are so many that the
    rest does not make up that share, some must be there; the number is that of the most frequent words whose bigrams
    close the gap. Words of six letters count, and shorter ones, longest first, only where those are too few.
    """
    needed, own = bounds(len(grams), least)[0], _words_of(grams)
    words, covered = [], set()
    for w in own:
        if len(w) < 6 and len(grams) - len(covered) < needed:
            break
        words.append(w)
        covered |= own[w]
    gap, many = needed - (len(grams) - len(covered)), 0
    for n in sorted((len(own[w]) for w in words), reverse=True):
        if gap <= 0:
            break
        gap, many = gap - n, many + 1
    return sorted(words), many


def first_marks(grams: list[str], least: float) -> list[str]:
    """A few of a template's long words of which a unit must have one to reach ``least``, by the same bound."""
    needed, own, words, covered = bounds(len(grams), least)[0], _words_of(grams), [], set()
    pool = set(marks(grams, least)[0])
    while len(grams) - len(covered) >= needed:
        words.append(max(pool, key=lambda w: (w not in USUAL, len(own[w] - covered) * (2 if len(w) >= 6 else 1), w)))
        covered |= own[words[-1]]
        pool.remove(words[-1])
    return words


def marked(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) that have enough of some template's long words; others can't reach ``least``.

    A few words are looked for in the text as it is first, those of long templates only in texts of enough characters;
    words are cut and counted where one of them is found.
    """
    grams = [bigrams_of(v) for v in templates.values()]
    short, long = [g for g in grams if len(g) <= LONG_BIGRAMS], [g for g in grams if len(g) > LONG_BIGRAMS]
    if any(marks(g, least)[1] < 1 for g in grams):
        return docs

    def enough(own: Column, some: list[list[str]]) -> Column:
        rules = json.dumps([{"words": list(w), "k": k} for w, k in sorted({(tuple(w), k) for w, k in (marks(g, least) for g in some)})])
        return F.exists(F.from_json(F.lit(rules), "array<struct<words:array<string>,k:int>>"), lambda t: F.size(F.array_intersect(own, t["words"])) >= t["k"])

    def named(some: list[list[str]]) -> Column:
        first = sorted({w for g in some for w in first_marks(g, least)})
        by_letter = "|".join(f"{k}(?:{'|'.join(w[1:] for w in own)})" for k, own in groupby(first, key=lambda w: w[0]))
        return F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{by_letter})(?![a-z0-9])")

    words = F.col("_words")
    first, good = F.lit(False), F.lit(False)
    if short:
        first, good = first | named(short), good | enough(words, short)
    if long:
        low, few = min(bounds(len(g), least)[0] for g in long), min(marks(g, least)[1] for g in long)
        first = first | (F.length("text") > 2 * low) & named(long)
        found = F.array_intersect(words, F.split(F.lit(" ".join(sorted({w for g in long for w in marks(g, least)[0]}))), " "))
        good = good | (F.size(words) > low) & (F.size(found) >= few) & enough(found, long)
    return docs.where(first).withColumn("_words", F.explode(F.array(F.split(normalised(F.col("text")), " ")))).where(good).drop("_words")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit, position, parts and words: the whole text, its paragraphs and lines if there are several, and the
    sentences of lines that have several. parts is null but for sentences, where it counts from 1 in the line.

    Lines without a word, such as blank ones or bare comment marks, part paragraphs.
    """
    kind = lambda name, parts: F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.cast("long").alias("position"), F.lit(None).cast("int").alias("parts"), F.split(normalised(x), " ").alias("words")))
    several = lambda name, parts: F.when(F.size(parts) > 1, kind(name, parts)).otherwise(kind(name, F.array().cast("array<string>")))
    sentence = lambda i: lambda y, k: F.struct(F.lit("sentence").alias("unit"), i.cast("long").alias("position"), (k + 1).cast("int").alias("parts"), F.split(normalised(y), " ").alias("words"))
    sentences = F.flatten(F.filter(F.transform(F.split("text", r"\n"), lambda x, i: F.transform(F.split(x, r"(?<=[.!?])[ \t]+"), sentence(i))), lambda u: F.size(u) > 1))
    every = F.concat(kind("text", F.array("text")), several("paragraph", F.split("text", _PARTING)), several("line", F.split("text", r"\n")), sentences)
    return docs.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.*")


_PARTING = r"\n[^A-Za-z0-9\n]*\n"


def _table(templates: dict[str, str], least: float) -> Column:
    known = [(name, grams, *bounds(len(grams), least)) for name, grams in ((k, bigrams_of(v)) for k, v in sorted(templates.items())) if grams]
    if not known:
        raise ValueError("there must be a template of two words at least")
    rows = [{"name": name, "n": len(g), "low": low, "high": high, "grams": g} for name, g, low, high in known]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,n:int,low:int,high:int,grams:array<string>>>")


def _best(sized: DataFrame, table: Column, least: float, only: str | None = None) -> DataFrame:
    """Rows of ``sized`` (grams and more) with licence, dice and n_bigrams, where a template, or that named by ``only``, reaches ``least``."""
    # An array of one set is exploded so that Spark computes the set once, not for each template that is compared.
    sized = sized.withColumn("grams", F.explode(F.array("grams"))).withColumn("n_bigrams", F.size("grams").cast("long"))
    fit = F.filter(table, lambda t: F.col("n_bigrams").between(t["low"], t["high"]) & ((t["name"] == F.col(only)) if only else F.lit(True)))
    compared = F.transform(fit, lambda t: F.struct((2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (F.col("n_bigrams") + t["n"])).alias("dice"), t["name"].alias("name")))
    best = F.aggregate(compared, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name")), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))
    found = sized.withColumn("best", best).where(F.col("best.dice") >= least)
    return found.withColumn("licence", F.col("best.name")).withColumn("dice", F.col("best.dice")).drop("best", "grams")


def runs(docs: DataFrame, table: Column, least: float) -> DataFrame:
    """doc_id, unit, position, parts, licence, dice and n_bigrams of the runs of lines that reach ``least``.

    ``position`` is that of the first line, ``parts`` the number of lines with words from the first to the last.
    """
    filled = F.filter(F.transform(F.split("text", r"\n"), lambda x, i: F.struct(i.cast("long").alias("at"), normalised(x).alias("body"))), lambda p: p["body"] != "")
    lines = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode(filled).alias("idx", "line")).select("row", "doc_id", "idx", "line.*")
    # As many rows as the templates have bigrams, a parameter of the query.
    known = docs.sparkSession.range(1).select(F.explode(table).alias("t")).select(F.col("t.name").alias("name"), F.explode("t.grams").alias("gram"))
    grams = lines.select("row", "idx", F.explode(F.array(bigrams(F.split("body", " ")))).alias("own")).select("row", "idx", F.size("own").alias("n"), F.explode("own").alias("gram"))
    near = grams.join(F.broadcast(known), "gram").groupBy("row", "idx", "n", "name").agg(F.count("*").alias("hits")).where(2 * F.col("hits") >= F.col("n"))
    order = Window.partitionBy("row", "name").orderBy("idx")
    islands = near.withColumn("cut", (F.coalesce(F.col("idx") - F.lag("idx").over(order), F.lit(0)) > 3).cast("int")).withColumn("island", F.sum("cut").over(order))
    spans = islands.groupBy("row", "name", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).where("last > first").select("row", "name", "first", "last")
    whole = lines.join(spans, "row").where("idx between first and last").groupBy("row", "doc_id", "name", "first", "last").agg(F.array_sort(F.collect_list(F.struct("idx", "at", "body"))).alias("own"))
    words = F.split(F.array_join(F.transform("own", lambda p: p["body"]), " "), " ")
    sized = whole.select("row", "doc_id", "name", "first", "last", F.element_at("own", 1)["at"].alias("position"), bigrams(words).alias("grams"))
    found = _best(sized, table, least, only="name")
    other = found.select("row", *[F.col(c).alias(f"o_{c}") for c in ("first", "last", "dice", "licence")])
    better = (F.col("o_dice") > F.col("dice")) | (F.col("o_dice") == F.col("dice")) & (F.struct("o_first", "o_last", "o_licence") < F.struct("first", "last", "licence"))
    best = found.join(other, (found["row"] == other["row"]) & (F.col("o_first") <= F.col("last")) & (F.col("first") <= F.col("o_last")) & better, "left_anti")
    return best.select("doc_id", F.lit("run").alias("unit"), "position", (F.col("last") - F.col("first") + 1).cast("int").alias("parts"), "licence", "dice", "n_bigrams")


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, unit, position, parts, licence, dice and n_bigrams of each unit whose best template reaches ``least``.

    Ties go to the first licence by name. Positions count from 0. A null or empty text, or a unit of one word, has no
    bigram and is in no row; a null doc_id stays null; repeated rows are found each for itself; other columns are
    ignored. Templates are a parameter of the query, not a table. Texts that have the templates' words are written to the
    shared folder and shuffled by row for their runs, others not at all.
    """
    templates = templates or public_templates()
    table = _table(templates, least)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = written(marked(texts, {k: v for k, v in templates.items() if bigrams_of(v)}, least), "marked")
    sizes = [bounds(len(g), least) for g in map(bigrams_of, templates.values()) if g]
    low, high = min(a for a, _ in sizes), max(b for _, b in sizes)
    sized = units(chosen).where(F.size("words") > low).select("doc_id", "unit", "position", "parts", F.explode(F.array(bigrams(F.col("words")))).alias("grams")).where(F.size("grams").between(low, high))
    found = _best(sized, table, least)
    return found.select("doc_id", "unit", "position", "parts", "licence", "dice", "n_bigrams").unionByName(runs(chosen, table, least))


def oracle(least: float = 0.8) -> str:
    """The same result in DuckDB's SQL, by joins on bigrams and without the search for long words."""
    lists = ", ".join(f"('{name}', string_split('{'|'.join(grams)}', '|'), {len(grams)})" for name, grams in ((k, bigrams_of(v)) for k, v in sorted(public_templates().items())))
    words = lambda body: f"string_split(lower(trim(regexp_replace({body}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    grams = "list_distinct(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1]))"
    return f"""
with tl(name, grams, n) as (values {lists}), t as (select name, n, unnest(grams) as gram from tl),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as (
  select r, doc_id, 'text' as unit, [text] as bodies from d
  union all select r, doc_id, 'paragraph', regexp_split_to_array(text, '\\n[^A-Za-z0-9\\n]*\\n') from d
  union all select r, doc_id, 'line', string_split(text, chr(10)) from d),
u as (select r, doc_id, unit, cast(unnest(generate_series(0, len(bodies) - 1)) as bigint) as position, cast(null as integer) as parts, unnest(bodies) as body from parts where unit = 'text' or len(bodies) > 1),
ln as (select r, doc_id, cast(unnest(generate_series(0, len(b) - 1)) as bigint) as position, unnest(b) as body from (select r, doc_id, string_split(text, chr(10)) as b from d)),
se as (select r, doc_id, position, string_split(regexp_replace(body, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)) as b from ln),
su as (select r, doc_id, 'sentence' as unit, position, cast(unnest(generate_series(1, len(b))) as integer) as parts, unnest(b) as body from se where len(b) > 1),
w as (select r, doc_id, unit, position, parts, {words('body')} as words from (select * from u union all select * from su)),
g as (select r, doc_id, unit, position, parts, {grams} as grams from w where len(words) > 1),
e as (select r, doc_id, unit, position, parts, cast(len(grams) as bigint) as n_bigrams, unnest(grams) as gram from g),
c as (select r, doc_id, unit, position, parts, n_bigrams, name, 2.0::double * count(*) / (n_bigrams + n) as dice from e join t using (gram) group by r, doc_id, unit, position, parts, n_bigrams, name, n),
b as (select *, row_number() over (partition by r, unit, position, parts order by dice desc, name) as best from c),
lw as (select r, doc_id, position, row_number() over (partition by r order by position) as idx, words from (select r, doc_id, position, {words('body')} as words from ln) where words <> ['']),
lg as (select r, idx, len(gs) as n, unnest(gs) as gram from (select r, idx, {grams} as gs from lw where len(words) > 1)),
m as (select r, idx, name from lg join t using (gram) group by r, idx, lg.n, name having 2 * count(*) >= lg.n),
cut as (select *, case when idx - lag(idx) over (partition by r, name order by idx) > 3 then 1 else 0 end as c from m),
isl as (select *, sum(c) over (partition by r, name order by idx) as island from cut),
sp as (select r, name, min(idx) as first, max(idx) as last from isl group by r, name, island having max(idx) > min(idx)),
rw as (select s.r, s.name, s.first, s.last, l.doc_id, min(l.position) as position, flatten(list(l.words order by l.idx)) as words from sp s join lw l on l.r = s.r and l.idx between s.first and s.last group by all),
rg as (select * exclude (words), {grams} as gs from rw),
re as (select * exclude (gs), len(gs) as n_bigrams, unnest(gs) as gram from rg),
rd as (select re.r, re.name, first, last, doc_id, position, n_bigrams, 2.0::double * count(*) / (n_bigrams + t.n) as dice from re join t on t.gram = re.gram and t.name = re.name group by re.r, re.name, first, last, doc_id, position, n_bigrams, t.n having 2.0::double * count(*) / (n_bigrams + t.n) >= {least})
select doc_id, unit, position, parts, name as licence, dice, n_bigrams from b where best = 1 and dice >= {least}
union all select doc_id, 'run', position, cast(last - first + 1 as integer), name, dice, n_bigrams from rd a
where not exists (select 1 from rd o where o.r = a.r and o.first <= a.last and a.first <= o.last and (o.dice > a.dice or (o.dice = a.dice and (o.first, o.last, o.name) < (a.first, a.last, a.name))))
"""
