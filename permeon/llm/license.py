"""Operator 8: licence scan by sparse TF-IDF cosine to templates, then inheritance from directories. DataFrame operations only.

Terms are runs of a-z and 0-9 after lower-casing. A unit's terms are weighted by how often they occur in it and by
ln((1 + N) / (1 + df)) + 1 over the N templates; a term of no template counts in the unit's length with df 0. Templates are
statements of one sentence, headers, heads of licence files and whole short licences. Units of a file are each line that isn't
blank, each sentence in it, each run of two and more such lines of which each has at least as much weight (squared, term by term) in the templates'
terms as in others, and the file. A file's own licence is the template with the highest cosine of any unit, if that is at least
LEAST; of equal ones the smallest licence id.

A licence file is one whose best unit, or whose lines that state a licence alone, are its larger part (or that is named so). It
licenses its directory; of several in one directory the highest cosine, then the smallest id, decides. A file without a
licence inherits from its nearest ancestor directory that has one: the distinct directories' ancestors are joined by path, the
deepest wins.

Plan: all of the cosines are computed inside the row by higher-order functions, without a shuffle: terms become places in the
templates' vocabulary (bounded by the caller's templates), units whose known terms cannot reach LEAST even if no other term
occurs twice are left out (the length is at least that long, so nothing is lost; sums by sentence bound most units before any count), the rest are weighed exactly. What
remains of a file is one small row, written once. Directories are combined before they are shuffled, so a directory with a third of
all files is one row a task; files then meet their directory's licence by a broadcast of at most DIRECTORIES rows, or
beyond that by a join that salts the files.

Result: doc_id, path, own_license, own_score (rounded to 6 places), license, license_from (null, 'own', or the directory). Null and
empty texts: no own licence. Very long texts are weighed whole. Null paths inherit nothing. Repeated rows each give a row. Ties: as
above. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import written

LEAST = 0.7
DIRECTORIES, SALTS = 100_000, 16

#: Licence ids and the sentences that state them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}

#: Also headers over several lines, heads of licence files and whole short licences; # tells a licence's texts apart.
TEXTS = TEMPLATES | {
    "Apache-2.0#head": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache-2.0#header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "BSD-3-Clause#file": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "GPL-3.0#head": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0#header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the
        GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "MIT#file": """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
        be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    "MPL-2.0#head": "Mozilla Public License Version 2.0",
    "MPL-2.0#header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Proprietary#header": "Copyright (c). All rights reserved.",
}


def _gnu(name: str, version: str, what: str = "program", address: bool = False) -> str:
    """The header of a GNU licence, of which there are many that differ in a few words."""
    end = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA." if address else "see https://www.gnu.org/licenses/."
    return f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License as
        published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what}
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details. You should have received a copy of the GNU
        {name} Public License along with this {what}. If not, {end}"""


# Neighbours of these, so that they are told apart. Licence ids and their texts.
TEXTS |= {
    "AGPL-3.0#header": _gnu("Affero General", "3"),
    "AGPL-3.0#head": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "BSD-2-Clause#file": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "EPL-2.0#header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at https://www.eclipse.org/legal/epl-2.0/""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0#head": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-2.0#header": _gnu("General", "2", address=True),
    "ISC#file": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.1#header": _gnu("Lesser General", "2.1", "library", address=True),
    "LGPL-3.0#header": _gnu("Lesser General", "3", "library"),
}
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"


def terms_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def weights(templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]], float]:
    """idf of each term, each template's unit vector, and the idf of a term that no template has."""
    n, bags = len(templates), {k: terms_of(v) for k, v in templates.items()}
    idf = {t: math.log((1 + n) / (1 + sum(t in b for b in bags.values()))) + 1 for b in bags.values() for t in b}
    out = {}
    for k, b in bags.items():
        w = {t: b.count(t) * idf[t] for t in set(b)}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[k] = {t: x / length for t, x in w.items()}
    return idf, out, math.log(1 + n) + 1


def terms_in(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda sum_, x: sum_ + of(x))


def added(sums: Column) -> Column:
    return F.struct(*(total(sums, lambda s, c=c: s[c]).alias(c) for c in ("k2", "u", "a")))


def tallies(values: Column) -> Column:
    """Structs x (each distinct value) and tf (how often it occurs)."""

    def of(ordered: Column, distinct: Column, first: Column) -> Column:
        after = lambda i: F.coalesce(F.get(first, i + 1), F.size(ordered) + 1)
        return F.transform(distinct, lambda x, i: F.struct(x.alias("x"), (after(i) - F.get(first, i)).cast("double").alias("tf")))

    return let(F.sort_array(values), lambda o: let(F.array_distinct(o), lambda d: let(F.transform(d, lambda x: F.array_position(o, x)), lambda first: of(o, d, first))))


def places(words: list[str]) -> tuple[int, list[int]]:
    """A size of table in which xxhash64 puts each of the words in a place of its own, and the places."""
    hashes = [np.uint64(xxhash.xxh64_intdigest(t, seed=42)).astype(np.int64).item() for t in words]  # the seed of the SQL function
    size = next(m for m in itertools.count(len(words) + 1) if len({h % m for h in hashes}) == len(words))
    return size, [h % size for h in hashes]


class Weigher:
    """Column expressions for units of terms; a term's code is its place in a hash table of the templates' vocabulary."""

    def __init__(self, templates: dict[str, str], least: float) -> None:
        idf, vectors, rare = weights(templates)
        words, names = sorted(idf), sorted(templates)
        self.least, self.rare2 = least, rare**2
        self.size, at = places(words)

        def literal(values: dict[str, object], blank: object) -> list:
            out = [blank] * self.size
            for t, i in zip(words, at):
                out[i] = values[t]
            return out

        def folded(value: object, of: str) -> Column:  # the optimiser makes it a literal
            return F.from_json(F.lit(json.dumps(value)), of)

        self.words = folded(literal({t: t for t in words}, ""), "array<string>")
        self.idf = folded(literal(idf, 0.0), "array<double>")
        self.most = folded(literal({t: idf[t] * max(vectors[k].get(t, 0.0) for k in names) for t in words}, 0.0), "array<double>")
        self.weighted = folded([literal({t: idf[t] * vectors[k].get(t, 0.0) for t in words}, 0.0) for k in names], "array<array<double>>")
        self.licences = F.split(F.lit(" ".join(k.split("#")[0] for k in names)), " ")

    def place(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.size)).cast("int")

    def known(self, term: Column) -> Column:
        return F.get(self.words, self.place(term)) == term

    def codes(self, terms: Column) -> Column:
        return F.transform(F.filter(terms, self.known), self.place)

    def sums(self, terms: Column, codes: Column) -> Column:
        """Struct k2 (squared weights of known occurrences), u (how many are unknown), a (above any template's product)."""
        square = lambda x: x * x
        return F.struct(
            total(codes, lambda c: square(F.get(self.idf, c))).alias("k2"), (F.size(terms) - F.size(codes)).cast("double").alias("u"),
            total(codes, lambda c: F.get(self.most, c)).alias("a"),
        )

    def length2(self, known: Column) -> Column:
        return total(known, lambda t: t["tf"] * t["tf"] * F.get(self.idf, t["x"]) * F.get(self.idf, t["x"]))

    def products(self, known: Column) -> Column:
        """With each template's unit vector."""
        return F.transform(self.weighted, lambda w: total(known, lambda t: t["tf"] * F.get(w, t["x"])))

    def may(self, sums: Column) -> Column:
        """Whether a unit may reach the threshold if all its terms occur once, and count as in the template that likes them most."""
        return (sums["a"] > 0) & (sums["a"] >= self.least * 0.999 * F.sqrt(sums["k2"] + sums["u"] * self.rare2))

    def units(self, sums: Column, of_line: Column) -> Column:
        """Structs first (line, from 0), span, part (a sentence of the line, from 1, or 0) and sums of the units that may reach the
        threshold: lines, sentences of lines that have more than one, runs of at least two like lines, the whole. There is a line."""
        n, shape = F.size(of_line), "array<struct<first:int,span:int,part:int,sums:struct<k2:double,u:double,a:double>>>"

        def unit(first: Column, span: Column, part: Column, s: Column) -> Column:
            return F.struct(first.cast("int").alias("first"), span.cast("int").alias("span"), part.cast("int").alias("part"), s.alias("sums"))

        def over(first: Column, span: Column) -> Column:
            return unit(first, span, F.lit(0), added(F.slice(of_line, first + 1, span)))

        def inside(ss: Column, i: Column) -> Column:
            return F.when(F.size(ss) > 1, F.filter(F.transform(ss, lambda s, j: unit(i, F.lit(1), j + 1, s)), lambda u: self.may(u["sums"]))).otherwise(F.array().cast(shape))

        like = lambda s: (s["a"] > 0) & (s["k2"] >= s["u"] * self.rare2)
        edge = lambda step: F.filter(F.sequence(F.lit(0), n - 1), lambda i: like(F.get(of_line, i)) & ~F.coalesce(like(F.get(of_line, i + step)), F.lit(False)))
        runs = F.filter(F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), (b - a + 1).alias("n"))), lambda r: (r["n"] > 1) & (r["n"] < n))
        lines = F.transform(of_line, lambda s, i: unit(i, F.lit(1), F.lit(0), s))
        whole = F.when(n > 1, F.array(over(F.lit(0), n))).otherwise(F.array().cast(shape))
        large = F.filter(F.concat(lines, F.transform(runs, lambda r: over(r["a"], r["n"])), whole), lambda u: self.may(u["sums"]))
        return F.concat(F.flatten(F.transform(sums, inside)), large)

    def hopeful(self, codes: Column, unknown: Column) -> Column:
        """Whether a unit may reach the threshold if all unknown terms occur once."""
        bound = self.least * 0.999

        def of(known: Column) -> Column:
            return let(self.length2(known), lambda k: (k >= bound**2 * (k + unknown * self.rare2)) & (F.array_max(self.products(known)) >= bound * F.sqrt(k + unknown * self.rare2)))

        return let(tallies(codes), of)

    def best(self, terms: Column, codes: Column) -> Column:
        """Struct s (minus the highest cosine, rounded) and t (its licence)."""
        others2 = total(tallies(F.filter(terms, lambda t: ~self.known(t))), lambda t: t["tf"] * t["tf"]) * self.rare2

        def of(known: Column) -> Column:
            length = F.sqrt(self.length2(known) + others2)
            scored = lambda n: F.transform(self.products(known), lambda p, i: F.struct((-F.round(p / n, 6)).alias("s"), F.get(self.licences, i).alias("t")))
            return let(length, lambda n: F.array_min(scored(n)))

        return let(tallies(codes), of)


def own_licences(files: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """doc_id, path, own_license, own_score, mostly: whether it is the larger part of the file."""
    w = Weigher(templates, least)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    # by line and sentence
    f = files.select("doc_id", F.col("path").cast("string").alias("path"), F.transform(lines, lambda x: F.transform(F.split(x, r"[.!?;:]\s+"), terms_in)).alias("terms"))
    f = f.withColumn("codes", F.transform("terms", lambda ss: F.transform(ss, w.codes)))
    f = f.withColumn("sums", F.zip_with("terms", "codes", lambda tt, cc: F.zip_with(tt, cc, w.sums)))
    f = f.withColumn("of_line", F.transform("sums", added))
    f = f.withColumn("units", F.when(F.size("terms") > 0, w.units(F.col("sums"), F.col("of_line"))))

    def part(column: str, u: Column) -> Column:
        """The unit's part of an array by line and sentence, as an array by sentence."""
        of = F.flatten(F.slice(column, u["first"] + 1, u["span"]))
        return F.when(u["part"] > 0, F.slice(of, F.greatest(u["part"], F.lit(1)), F.lit(1))).otherwise(of)

    f = f.withColumn("units", F.filter("units", lambda u: w.hopeful(F.flatten(part("codes", u)), u["sums"]["u"])))
    scored = F.transform("units", lambda u: F.struct(u["first"].alias("first"), u["span"].alias("span"), w.best(F.flatten(part("terms", u)), F.flatten(part("codes", u))).alias("best")))
    f = f.withColumn("scored", F.filter(scored, lambda x: -x["best"]["s"] >= least))
    f = f.withColumn("best", F.array_min(F.transform("scored", lambda x: F.struct(x["best"]["s"].alias("s"), x["best"]["t"].alias("t"), (-x["span"]).alias("span")))))
    alone = F.size(F.array_distinct(F.transform(F.filter("scored", lambda x: x["span"] == 1), lambda x: x["first"])))
    mostly = 2 * F.greatest(alone, -F.col("best.span")) > F.size("terms")
    return f.select("doc_id", "path", F.col("best.t").alias("own_license"), (-F.col("best.s")).alias("own_score"), F.coalesce(mostly, F.lit(False)).alias("mostly"))


def scan(files: DataFrame, templates: dict[str, str] = TEXTS, least: float = LEAST) -> DataFrame:
    """files: doc_id, path, text. templates: licence ids, with anything after a # to tell a licence's texts apart, and texts."""
    own = written(own_licences(files, templates, least).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licences")
    named = F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("mostly") | F.col("path").rlike(FILE_NAMES))
    of_dir = own.where("dir is not null").groupBy("dir").agg(F.min(F.when(named, F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("t"))))["t"].alias("granted"))
    of_dir = written(of_dir, "directories")
    grants = of_dir.where("granted is not null").select(F.col("dir").alias("from"), "granted")
    # '' , a, a/b, ..: a directory and what is above it
    steps = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))
    wanting = of_dir.select("dir", F.posexplode(above).alias("depth", "from"))
    inherited = wanting.join(grants, "from").groupBy("dir").agg(F.max_by(F.struct("granted", "from"), "depth").alias("inherited"))
    if of_dir.count() <= DIRECTORIES:
        out = own.join(F.broadcast(inherited), "dir", "left")
    else:
        salted = inherited.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = own.withColumn("salt", F.pmod(F.xxhash64("path", "doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["dir", "salt"], "left")
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "inherited.granted").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("inherited.from")).alias("license_from"),
    )
