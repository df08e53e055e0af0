"""Licence scans, with DataFrame functions only.

Texts are normalised (lower case, letters and digits only) and licences are found wherever they stand in them, by the Dice
coefficient of sets of word bigrams, which is 2 x common / (size + size).

1. Size bounds: a Dice coefficient of t needs t / (2 - t) of a template's bigrams, so a document that has fewer bigrams, or fewer of the
   template's, is not compared with it. One intersection of a document's bigrams with those of all templates that it is large
   enough for settles most documents.
2. In the others the places of a template's bigrams are listed. For each of a few shares (SHARES) of the template's length, the
   shortest window that holds so many places, the first of equals, is compared with the template exactly. So a licence is found inside a
   line, over several lines or paragraphs, and as a part of a longer text, and what stands before and behind it does not count.

Templates are TEMPLATES and the files in licence_texts; others may be given. They are literals in the plan: no join and no shuffle.

Defined results: null and empty texts, and texts of fewer than two words, match nothing; of templates with equal scores
all are returned; rows with equal doc_ids are judged one by one and their best score counts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import documents

THRESHOLD = 0.8
#: Shares of a template's length of which windows are compared; a template with at least LARGE bigrams is looked for in documents of a fitting size only.
SHARES, LARGE = (0.67, 0.75, 0.85, 0.95, 1.0), 400

# Public licence texts and the notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT notice": "Released under the MIT License.",
    "MIT notice 2": "Licensed under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

@lru_cache(maxsize=1)
def templates() -> dict[str, str]:
    """All templates by name."""
    files = sorted(resources.files("lorekeep.llm").joinpath("licence_texts").iterdir(), key=lambda x: x.name)
    return TEMPLATES | {x.name.removesuffix(".txt"): x.read_text() for x in files if x.name.endswith(".txt")}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> set[tuple[str, str]]:
    words = words_of(text)
    return set(zip(words, words[1:]))


def _grams(text: str) -> list[str]:
    return sorted(" ".join(x) for x in bigrams_of(text))


def _list(grams: list[str]) -> Column:
    """A constant array; one literal, whatever its length."""
    return F.split(F.lit("|".join(grams)), "[|]")


def needed(n: int, threshold: float) -> int:
    """The least number of its n bigrams that a template needs."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9)


def places(text: str) -> list[int]:
    """The numbers of places in the windows that are compared."""
    return sorted({math.ceil(share * (len(words_of(text)) - 1)) for share in SHARES})


def scan(docs: DataFrame, threshold: float = THRESHOLD, known: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and licence with a score of at least threshold: doc_id, license, score."""
    known = {name: (_grams(text), places(text)) for name, text in (known or templates()).items()}
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    rows = docs.select("doc_id", words.alias("words"))
    pairs = F.greatest(F.size("words") - 1, F.lit(0))
    rows = rows.select("doc_id", F.zip_with(F.slice("words", F.lit(1), pairs), F.slice("words", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b)).alias("grams"))
    small = sorted({g for grams, _ in known.values() if len(grams) < LARGE for g in grams})
    large = sorted({g for grams, _ in known.values() if len(grams) >= LARGE for g in grams} - set(small))
    common = F.array_intersect(_list(small), F.col("grams"))
    if large:
        least = min(needed(len(grams), threshold) for grams, _ in known.values() if len(grams) >= LARGE)
        common = F.concat(common, F.when(F.size("grams") >= least, F.array_intersect(_list(large), F.col("grams"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("common", common)

    def fitting(name: str, grams: list[str], counts: list[int]) -> Column:
        least = needed(len(grams), threshold)
        template = F.struct(F.lit(name).alias("license"), _list(grams).alias("template"), F.array(*map(F.lit, counts)).alias("counts"))
        return F.when((F.size("common") >= least) & (F.size(F.array_intersect(_list(grams), F.col("common"))) >= least), template)

    fit = F.array_compact(F.array(*(fitting(name, *x) for name, x in known.items())))
    # explode_outer and a filter behind it: for explode Spark would compute the arrays again for a filter of its own
    rows = rows.select("doc_id", "grams", F.explode_outer(fit).alias("x")).filter("x IS NOT NULL").select("doc_id", "grams", "x.*")
    hits = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains(F.col("template"), F.get("grams", i - 1)))
    rows = rows.select("doc_id", "license", "grams", "template", "counts", hits.alias("hits"))

    def score(count: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size("hits") - count + 1), lambda i: F.struct((F.get("hits", i + count - 2) - F.get("hits", i - 1) + 1).alias("size"), F.get("hits", i - 1).alias("at")))
        window = F.array_min(ends)
        part = F.slice("grams", window["at"], window["size"])
        return 2.0 * F.size(F.array_intersect(F.col("template"), part)) / (F.size(F.array_distinct(part)) + F.size("template"))

    scores = F.transform(F.filter("counts", lambda c: c <= F.size("hits")), score)
    return rows.groupBy("doc_id", "license").agg(F.round(F.max(F.array_max(scores)), 6).alias("score")).filter(F.col("score") >= threshold)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text"))


def sql(threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"('{name}', string_split('{'|'.join(_grams(text))}', '|'), {needed(len(_grams(text)), threshold)}, {places(text)})" for name, text in templates().items())
    return rf"""
WITH templates(license, template, least, counts) AS (VALUES {values}),
words AS (SELECT doc_id, row_number() OVER () AS row_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
grams AS (SELECT doc_id, row_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS grams FROM words WHERE len(words) > 1),
each AS (SELECT DISTINCT row_id, unnest(grams) AS gram FROM grams),
fit AS (SELECT row_id, license FROM each JOIN (SELECT license, least, unnest(template) AS gram FROM templates) USING (gram) GROUP BY row_id, license, least HAVING count(*) >= least),
hits AS (SELECT doc_id, license, grams, template, counts, list_filter(range(1, len(grams) + 1), lambda i: list_contains(template, grams[i])) AS hits FROM fit JOIN grams USING (row_id) JOIN templates USING (license)),
counted AS (SELECT * FROM (SELECT *, unnest(counts) AS n FROM hits) WHERE n <= len(hits)),
windows AS (SELECT *, list_min(list_transform(range(1, len(hits) - n + 2), lambda i: {{'size': hits[i + n - 1] - hits[i] + 1, 'at': hits[i]}})) AS w FROM counted),
parts AS (SELECT *, list_distinct(grams[w.at:w.at + w.size - 1]) AS part FROM windows)
SELECT doc_id, license, round(max(2.0::DOUBLE * len(list_intersect(template, part)) / (len(part) + len(template))), 6) AS score FROM parts GROUP BY ALL HAVING score >= {threshold}
"""
