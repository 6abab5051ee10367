"""License scans by Dice coefficient over word bigrams, in DataFrame operations only.

Texts are normalised to words and their bigrams; line ends, indents and signs don't count. A notice may stand anywhere:
windows of a text begin at a bigram of a template and reach over FRAMES times the template's bigrams, up to the last
bigram of the template in them. Their Dice coefficient is 2c / (n + b) with b distinct bigrams of the template, c of
them in the window, and n bigrams of the window (those of the template once each). A window that reaches the threshold t
has c >= b * t / (2 - t): texts without any of the words that no such choice avoids are never cut into bigrams, and
templates of which a text has fewer bigrams are dropped before windows are formed. Templates are a fixed list: their
bigrams are a broadcast of fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import text_of

THRESHOLD = 0.8

#: Notices and paragraphs of licence texts by SPDX identifier: fixed values. Whole texts of several pages (Apache, GPL, MPL) are
#: told by the notices that they ask files to bear.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:",
    ),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
)
#: Words that most texts have.
COMMON = frozenset("a all and any are as at be by for from if in including is may not of or other provided shall such that the this to under use which with without you".split())
#: Lengths of windows, in bigrams of the template.
FRAMES = (0.75, 1.0, 1.25, 1.5)

#: Words after normalising: runs of letters of any language and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(segment: Column) -> Column:
    return F.filter(F.split(F.translate(segment, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SEPARATORS), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(pairs)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(license, template, t_size, t_len, g, bigram) of the fixed templates: g numbers a template's distinct bigrams."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(k).alias("license"), F.lit(t).alias("t")) for i, (k, t) in enumerate(templates)])
    table = spark.range(1).select(F.inline(rows))
    table = table.select("template", "license", bigrams_of(words_of(F.col("t"))).alias("all")).withColumn("own", F.array_distinct("all"))
    return table.select("template", "license", F.size("own").alias("t_size"), F.size("all").alias("t_len"), F.posexplode("own").alias("g", "bigram"))


def key_words(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which every window that reaches the threshold has at least one: rare and long ones first."""
    left = []
    for _, text in templates:
        w = [x for x in re.split(SEPARATORS, text.translate(_LOWER)) if x]
        pairs = set(zip(w, w[1:], strict=False))
        # with c bigrams in common the Dice is at most 2c / (c + b), that of a segment of these c alone
        need = next((c for c in range(1, len(pairs) + 1) if 2 * c >= (threshold - 1e-9) * (c + len(pairs))), len(pairs) + 1)
        left.append((pairs, need))
    chosen: list[str] = []
    while left := [(pairs, need) for pairs, need in left if len(pairs) >= need]:
        score: Counter[str] = Counter()
        for pairs, need in left:
            for word, n in Counter(x for pair in pairs for x in set(pair)).items():
                score[word] += min(n, len(pairs) - need + 1) * (len(word) ** 2 if word not in COMMON else 1e-6)
        chosen.append(max(score, key=lambda x: (score[x], x)))
        left = [({p for p in pairs if chosen[-1] not in p}, need) for pairs, need in left]
    return [w for w in chosen if not any(v in w and v != w for v in chosen)]


def license_matches(
    docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per window that reaches the threshold with a template: id, h, template, license, start, end, dice.

    start and end count the text's words, end exclusive. h is the text's hash, which tells rows with one identifier
    apart; repeated rows give their windows once. Null and empty texts have none, long ones are read whole; an empty
    table gives no rows, other columns, also of clashing names, are ignored.
    """
    table = template_table(docs.sparkSession, templates)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    keyed = F.exists(F.array(F.lower("t")), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in key_words(templates, threshold)]))
    hits = rows.where(keyed).select("id", "h", F.posexplode(bigrams_of(words_of(F.col("t")))).alias("pos", "bigram"))
    hits = hits.join(F.broadcast(table), "bigram").drop("bigram").repartition("id", "h", "template").dropDuplicates(["id", "h", "template", "pos"])
    text = Window.partitionBy("id", "h", "template")
    hits = hits.withColumn("all", F.size(F.collect_set("g").over(text)))
    hits = hits.where(F.col("all") * (2 - threshold) >= F.col("t_size") * threshold - 1e-6)  # 0.8 itself is in
    frames = []
    for f in FRAMES:
        # places in millionths of the template's length: one frame for all templates of up to some thousand words
        w = text.orderBy(F.floor(F.col("pos") * 1e6 / F.col("t_len"))).rangeBetween(0, int(f * 1e6) - 100)
        frames.append(F.struct(F.size(F.collect_set("g").over(w)).alias("c"), F.count(F.lit(1)).over(w).alias("k"), F.max("pos").over(w).alias("last")))
    hits = hits.withColumn("frames", F.array(*frames)).select("id", "h", "template", "license", "t_size", "pos", F.inline("frames"))
    dice = F.col("c") * 2.0 / (F.col("last") - F.col("pos") + 1 - F.col("k") + F.col("c") + F.col("t_size"))
    found = hits.select("id", "h", "template", "license", F.col("pos").alias("start"), (F.col("last") + 2).alias("end"), dice.alias("dice"))
    return found.where(F.col("dice") >= threshold)


def report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, license (of its best window, null if none), dice (0 if none), n_segments.

    n_segments counts the stretches of text that windows of any template cover. Of windows with the same Dice
    coefficient the first licence by name counts. Nulls, repeats and other columns as in license_matches.
    """
    found = license_matches(docs, threshold, id_col=id_col, text_col=text_col)
    before = Window.partitionBy("id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("apart", F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0)))
    found = found.groupBy(F.col("id").alias("f_id"), F.col("h").alias("f_h")).agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("top"), F.count_if("apart").alias("n_segments")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    return rows.join(found, rows["id"].eqNullSafe(found["f_id"]) & (rows["h"] == found["f_h"]), "left").select(
        F.col("id").alias(id_col),
        F.col("top.license").alias("license"),
        F.round(F.coalesce(-F.col("top.d"), F.lit(0.0)), 6).alias("dice"),
        F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"),
    )


def _oracle() -> str:
    values = ", ".join(f"({i}, '{k}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (k, t) in enumerate(TEMPLATES))
    words = lambda s: (
        f"list_filter(string_split_regex(translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda w: w <> '')"
    )
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    over = lambda f: f"(PARTITION BY doc_id, template ORDER BY floor(pos * 1e6::DOUBLE / t_len)::BIGINT RANGE BETWEEN CURRENT ROW AND {int(f * 1e6) - 100} FOLLOWING)"
    frames = " UNION ALL ".join(
        f"SELECT doc_id, template, license, t_size, pos, count(DISTINCT bigram) OVER {over(f)} AS c, count(*) OVER {over(f)} AS k, max(pos) OVER {over(f)} AS last FROM hit" for f in FRAMES
    )
    return f"""
WITH t AS (
    SELECT template, license, len(list_distinct(g)) AS t_size, len(g) AS t_len, unnest(list_distinct(g)) AS bigram
    FROM (SELECT template, license, {grams} AS g FROM (SELECT template, license, {words('x')} AS w FROM (VALUES {values}) v(template, license, x)))),
d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents)),
hit AS (SELECT doc_id, pos, t.* FROM (SELECT doc_id, unnest(g) AS bigram, unnest(range(len(g))) AS pos FROM d) JOIN t USING (bigram)),
met AS (SELECT *, 2.0::DOUBLE * c / (last - pos + 1 - k + c + t_size) AS dice FROM ({frames})),
win AS (SELECT doc_id, license, dice, pos AS s, last + 2 AS e FROM met WHERE dice >= {THRESHOLD}),
apart AS (SELECT *, s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM win),
top AS (SELECT doc_id, arg_min(license, struct_pack(d := -dice, l := license)) AS license, max(dice) AS dice, count(*) FILTER (a) AS n FROM apart GROUP BY doc_id)
SELECT d.doc_id, license, round(coalesce(dice, 0), 6)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_segments
FROM documents d LEFT JOIN top USING (doc_id)
"""


ORACLE = _oracle()
