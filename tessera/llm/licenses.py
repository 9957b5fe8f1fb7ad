"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of a-z and 0-9 of the lower-cased text, shingles five words, kept as 64-bit hashes. For each template length n, a
text is cut into windows of n + s words that start every s = ceil(n / 2) words, so any n words in a row lie in one window.
A window and a template are compared if one of BANDS MinHash values agrees. A template that lies in a window has at least a
quarter of its shingles, so it is missed with a chance below 0.75 ** BANDS, 1 in 10 ** 8. A window can only agree with a
template in a band if it holds the shingle that has the template's minimum there, so texts are scanned for those (at most BANDS for
each template), and only windows that hold one are hashed. Only DataFrame operations are used.

Templates are a parameter, a mapping or a table read by templates_from(); their minima are in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

WIDTH, BANDS, CONTAINMENT = 5, 64, 0.8

# The words of public license notices and texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    "Zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "Unlicense-full": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}


def shingle_hashes(text: Column) -> Column:
    """The hash of every five words in a row; an empty array for fewer words."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    joined = F.transform(F.array(words), lambda w: F.transform(F.when(F.size(w) >= WIDTH, F.sequence(F.lit(1), F.size(w) - (WIDTH - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WIDTH)])))
    return F.element_at(joined, 1)


def signature(shingles: Column) -> Column:
    """BANDS MinHash values, each a band of its own."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))


def step(n: int) -> int:
    return -(-n // 2)


def templates_from(table: DataFrame, name: str = "license", text: str = "text") -> dict[str, str]:
    """The templates of a table, a few rows; rows with a null name or text are left out, of a repeated name the smallest text stays."""
    rows = table.where(F.col(name).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(name).cast("string").alias("k")).agg(F.min(F.col(text).cast("string")).alias("v"))
    return {r["k"]: r["v"] for r in rows.orderBy("k").collect()}


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """license, n (words), shingles (distinct)."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()]))
    table = spark.range(1).select(rows.alias("t")).select("t.license", shingle_hashes(F.col("t.text")).alias("shingles"))
    return table.select("license", (F.size("shingles") + (WIDTH - 1)).alias("n"), F.array_distinct("shingles").alias("shingles")).where(F.size("shingles") > 0)


def windows_of(n: int, shingles: list[int]) -> Column:
    """The windows for templates of n words that hold one of the given shingles, those with the minima: array of (n, window, held)."""
    s = step(n)
    size = n + s - (WIDTH - 1)  # shingles in a window
    hits = F.filter(F.transform("shingles", lambda x, i: F.when(x.isin(shingles), i)), lambda i: i.isNotNull())
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - (size - 1)) / s).cast("int"))
    numbers = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(first(i), F.floor(i / s).cast("int")))))
    return F.transform(numbers, lambda w: F.struct(F.lit(n).alias("n"), w.alias("window"), F.array_distinct(F.slice("shingles", w * s + 1, size)).alias("held")))


def scanned(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (of the best window), windows (how many hold 0.8 of the template's shingles or more).

    One row for each id and license found. Null, empty and short texts hold none; a null id is an id of its own,
    repeated rows of an id count together. Templates of fewer than five words are never found. Empty tables give no rows; extra
    columns are ignored, whatever their names.
    """
    table = template_table(documents.sparkSession, templates)
    # the shingles that have the minima: at most BANDS for each template of the parameter
    hashed = lambda j: F.transform("shingles", lambda x: F.struct(F.xxhash64(x, j).alias("h"), x.alias("x")))
    bearers = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(hashed(j))["x"])
    by_length: dict[int, set[int]] = {}
    for r in table.select("n", bearers.alias("bearers")).collect():
        by_length.setdefault(r["n"], set()).update(r["bearers"])
    every = sorted(set().union(*by_length.values())) if by_length else [0]
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), shingle_hashes(text_or_empty(text_col)).alias("shingles"))
    rows = rows.where(F.exists("shingles", lambda x: x.isin(every)))
    kinds = [windows_of(n, sorted(x)) for n, x in sorted(by_length.items())]
    windows = rows.select("doc_id", F.explode(F.concat(*kinds)).alias("x")).select("doc_id", "x.*") if kinds else rows.selectExpr("doc_id", "0 n", "0 window", "shingles held").where("false")
    bands = windows.select("*", F.posexplode(signature(F.col("held"))).alias("band", "value"))
    wanted = table.select("license", "n", "shingles", F.posexplode(signature(F.col("shingles"))).alias("band", "value"))
    met = bands.join(F.broadcast(wanted), ["n", "band", "value"])
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    found = met.select("doc_id", "license", "window", share.alias("share")).where(F.col("share") >= CONTAINMENT)
    found = found.groupBy("doc_id", "license", "window").agg(F.max("share").alias("share"))
    return found.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.count("*").alias("windows"))


def scanned_sql(templates: Mapping[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for the result of scanned() over the view documents: every window against every template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in templates.items())
    words = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
    shingles = f"list_transform(range(1, greatest(len(w) - {WIDTH - 2}, 1)), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))"
    return f"""
WITH t AS (SELECT license, w, {shingles} AS sh, len(w) AS n, (len(w) + 1) // 2 AS s FROM
  (SELECT license, {words.format("txt")} AS w FROM (VALUES {values}) v(license, txt))),
d AS (SELECT doc_id, {shingles} AS sh FROM (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents)),
x AS (SELECT doc_id, sh, unnest(range(len(sh))) AS p, unnest(sh) AS one FROM d),
h AS (SELECT DISTINCT x.doc_id, t.license, unnest(range(CAST(greatest(0, ceil((p - (n + s - {WIDTH})) / s::DOUBLE)) AS BIGINT), p // s + 1)) AS win
  FROM x JOIN (SELECT license, n, s, unnest(sh) AS one FROM t) t USING (one)),
c AS (SELECT h.doc_id, h.license, h.win, len(list_intersect(d.sh[h.win * t.s + 1 : h.win * t.s + t.n + t.s - {WIDTH - 1}], t.sh)) / len(list_distinct(t.sh))::DOUBLE AS share
  FROM h JOIN d ON h.doc_id IS NOT DISTINCT FROM d.doc_id JOIN t USING (license))
SELECT doc_id, license, max(share) AS containment, count(DISTINCT win)::BIGINT AS windows FROM c WHERE share >= {CONTAINMENT} GROUP BY ALL"""
