"""Licence scans: normalised text compared to licence templates by the Dice coefficient of their word bigrams.

Normalised means: A-Z as a-z, and every run of characters that are neither letters nor digits as one blank, line ends
too. The whole text is searched, whatever its lines. A window that matches template B with Dice >= t shares at least
t / (2 - t) |B| of B's bigrams, so it has one of any |B| - t / (2 - t) |B| + 1 of them: the rarest among all templates are
B's probes. Where a probe occurs in a text, the template is laid over the text at that place, and the window under it is
compared. So the template's size bounds the window's, and templates without a probe in the text are pruned. All of it is
column expressions on the row of the text: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_DICE = 0.8
MOST_TEMPLATES = 2000  # the templates are part of the plan
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: notices by which works name their licence: the licence's public short name, the notice, and the words
# that must occur in a match, each pair side by side, so that notices that differ in a version or a clause are told apart
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache license"),
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT License.", "mit license"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', ""),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "without fee"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gnu general, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser, version 3"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu lesser, version 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser, version 2, 2 1"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu affero, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "by nc, nc 4"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "by 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "by sa, sa 4"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "must retain, must reproduce"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "to endorse, or promote"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ""),
)


def normalised(text: Column) -> Column:
    """Lower-case A-Z, one blank for every run of other than letters and digits."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " ")


def words_of(text: str) -> list[str]:
    """The normalised words of a template."""
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


class Templates:
    """Templates with their bigrams, probes and needed bigrams; those of less than two words match nothing."""

    def __init__(self, templates: Sequence[tuple[str, ...]], least: float):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.names, self.grams, self.needs, self.sizes = [], [], [], []
        for name, text, *needs in templates:
            words = words_of(text)
            pairs = list(zip(words, words[1:]))
            if pairs:
                self.names.append(name)
                self.grams.append(pairs)
                self.needs.append([tuple(words_of(n)) for n in (needs[0].split(",") if needs and needs[0] else [])])
                self.sizes.append(len(words))
        often: dict[tuple[str, str], int] = {}
        for pairs in self.grams:
            for pair in set(pairs):
                often[pair] = often.get(pair, 0) + 1
        ratio = least / (2 - least)
        self.probes: list[tuple[tuple[str, str], int, int]] = []  # (bigram, template, its place in the template)
        for n, pairs in enumerate(self.grams):
            own = sorted(set(pairs), key=lambda p: (often[p], p))
            self.probes += [(pair, n, pairs.index(pair)) for pair in own[: len(own) - ceil(ratio * len(own)) + 1]]


def _hashes(spark: SparkSession, known: Templates) -> dict[tuple[str, str], int]:
    pairs = sorted({p for group in (*known.grams, *known.needs) for p in group})
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)  # letters and digits only
    rows = spark.sql(f"select a, b, xxhash64(a, b) as h from values {listed} as t(a, b)").collect()
    return {(r["a"], r["b"]): r["h"] for r in rows}


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, ...]] = TEMPLATES, least: float = LEAST_DICE
) -> DataFrame:
    """Per row: (id, licence, dice double, start int, licences string).

    The best match: highest Dice, then most bigrams, then first template, then first place; `start` is the number of its
    first word in the normalised text, from 1. licences lists the names of all matches in order, joined by commas. All
    are null without a match; a null, empty or wordless text has none, nor has one of a single word. Null and repeated
    ids are kept, other columns are not read, an empty table gives an empty table. A template is (name, text) or (name,
    text, bigrams that must occur, joined by commas). At most MOST_TEMPLATES templates; without any nothing matches.
    """
    known = Templates(templates, least)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    if not known.names:
        none = F.lit(None)
        return rows.select(id_col, none.cast("string").alias("licence"), none.cast("double").alias("dice"), none.cast("int").alias("start"), none.cast("string").alias("licences"))
    hashed = _hashes(docs.sparkSession, known)
    longs = lambda pairs: F.array(*[F.lit(h).cast("long") for h in sorted({hashed[p] for p in pairs})]).cast("array<bigint>")
    table = F.array(*[
        F.struct(longs(g).alias("grams"), longs(n).alias("needs"), F.lit(size - 1).alias("length"), F.lit(name).alias("name"))
        for g, n, size, name in zip(known.grams, known.needs, known.sizes, known.names)
    ])
    probes = F.array(*[F.struct(F.lit(hashed[p]).cast("long").alias("h"), F.lit(t).alias("t"), F.lit(o).alias("o")) for p, t, o in known.probes])
    values = sorted({hashed[p] for p, _, _ in known.probes})

    def bound(value: Column, then) -> Column:
        """`then` over a value that is computed once, as a lambda variable."""
        return F.transform(F.array(value), then)[0]

    def bigrams(words: Column) -> Column:
        at = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))

    def laid(grams: Column) -> Column:
        """(t, start) of every template laid over a place where one of its probes occurs."""
        at = F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.size(grams) - 1)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(at, lambda i: F.get(grams, i).isin(values))
        over = lambda i: F.transform(F.filter(probes, lambda p: p["h"] == F.get(grams, i)), lambda p: F.struct(p["t"].alias("t"), F.greatest(i - p["o"], F.lit(0)).alias("start")))
        return F.array_distinct(F.flatten(F.transform(hits, over)))

    def scored(grams: Column) -> Column:
        def one(place: Column) -> Column:
            template = F.get(table, place["t"])
            return bound(
                F.array_distinct(F.slice(grams, place["start"] + 1, template["length"])),
                lambda window: F.struct(
                    F.when(
                        F.size(F.array_except(template["needs"], window)) == 0,
                        F.lit(2.0) * F.size(F.array_intersect(window, template["grams"])) / (F.size(window) + F.size(template["grams"])),
                    ).otherwise(0.0).alias("dice"),
                    F.size(template["grams"]).alias("size"), (-place["t"]).alias("t"), (-place["start"]).alias("start"), template["name"].alias("name"),
                ),
            )

        return F.filter(F.transform(laid(grams), one), lambda m: m["dice"] >= least)

    words = F.filter(F.split(normalised(F.col("__text")), " "), lambda w: w != "")
    found = rows.select(id_col, bound(bound(words, bigrams), scored).alias("__found"))
    best = F.array_max("__found")
    return found.select(
        id_col, best["name"].alias("licence"), best["dice"].alias("dice"), (1 - best["start"]).cast("int").alias("start"),
        F.when(F.size("__found") > 0, F.array_join(F.array_sort(F.array_distinct(F.col("__found.name"))), ",")).alias("licences"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(pairs) -> str:
    return "[" + ", ".join(_literal(" ".join(p)) for p in sorted(set(pairs))) + "]::varchar[]"


_KNOWN = Templates(TEMPLATES, LEAST_DICE)
SCAN_SQL = rf"""
with t(t, name, grams, needs, length) as (values {', '.join(f"({n}, {_literal(name)}, {_list(g)}, {_list(k)}, {size - 1})" for n, (name, g, k, size) in enumerate(zip(_KNOWN.names, _KNOWN.grams, _KNOWN.needs, _KNOWN.sizes)))}),
p(gram, t, o) as (values {', '.join(f"({_literal(' '.join(pair))}, {t}, {o})" for pair, t, o in _KNOWN.probes)}),
w as (select row_number() over () as row, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
g as (select row, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from w),
h as (select row, unnest(g) as gram, generate_subscripts(g, 1) - 1 as i from g),
c as (select distinct row, p.t, greatest(i - o, 0) as start from h join p using (gram)),
x as (select c.row, c.t, c.start, t.name, t.grams, t.needs, list_distinct(g.g[start + 1: start + length]) as win from c join t using (t) join g using (row)),
m as (select *, 2.0::double * len(list_intersect(win, grams)) / (len(win) + len(grams)) as dice from x where list_has_all(win, needs)),
b as (select row, first(name order by dice desc, len(grams) desc, t, start) as licence, max(dice) as dice, first(start order by dice desc, len(grams) desc, t, start) + 1 as start,
    array_to_string(list_sort(list(distinct name)), ',') as licences from m where dice >= {LEAST_DICE} group by row)
select doc_id, licence, dice, start::int as start, licences from w left join b using (row)
"""
