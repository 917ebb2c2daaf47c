"""License scans by diagonal voting.

Every rolling k-gram of words of every document is joined with the places of the templates' k-grams. A hit at word i
of a document and word j of a template votes for the diagonal i - j. Votes are counted by document, template and
diagonal; neighbouring diagonals are merged to one span (words that were put in or left out shift the
diagonal); spans are verified: they must hold enough of the template's words, and not many others.

Templates are a fixed set of a checked size and are broadcast; a larger set is joined by a shuffle.

Defined cases: null and empty texts have no k-grams and no licences. Rows that repeat are listed each.
Spans are taken greedily, that
which holds most words first, then that with the higher coverage, then the earlier, then by template; one that overlaps a span that was taken is left out. A
document can hold several templates, and one template several times. A template of fewer than k words is refused. Empty tables give an
empty result. Further columns of the table are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import BROADCAST_ROWS, batches, gram_hashes, map_texts, word_hashes

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
_CC0 = """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."""
_GNU = """This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

#: Texts by licence and form: a whole text, a notice or clause that is found by itself, or a line.
TEMPLATES = {
    "MIT/text": _MIT,
    "MIT/full": f"{_MIT} {_WARRANTY}",
    "MIT/line": "Released under the MIT License",
    "MIT/licensed": "Licensed under the MIT License",
    "Apache-2.0/text": _APACHE,
    "Apache-2.0/full": f"{_APACHE} See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause/text": _BSD,
    "BSD-2-Clause/full": f"{_BSD} {_BSD_WARRANTY}",
    "BSD-3-Clause/text": f"{_BSD} {_BSD3}",
    "BSD-3-Clause/full": f"{_BSD} {_BSD3} {_BSD_WARRANTY}",
    "ISC/text": _ISC,
    "Unlicense/text": _UNLICENSE,
    "Zlib/text": _ZLIB,
    "BSL-1.0/text": _BOOST,
    "BSL-1.0/line": "Distributed under the Boost Software License, Version 1.0",
    "WTFPL/text": _WTFPL,
    "MPL-2.0/text": _MPL,
    "EPL-2.0/text": _EPL,
    "CC0-1.0/text": _CC0,
    "CC0-1.0/line": "Released under CC0 1.0 Universal",
    "GPL-3.0/text": _GPL,
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0/text": _GNU.format(what="program", name="", version="2", sep=";", sep2=";"),
    "LGPL-3.0/text": _GNU.format(what="library", name="Lesser", version="3", sep=":", sep2=","),
    "LGPL-2.1/text": _GNU.format(what="library", name="Lesser", version="2.1", sep=";", sep2=";"),
    "AGPL-3.0/text": _GNU.format(what="program", name="Affero", version="3", sep=":", sep2=","),
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0/text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0/text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0/text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0/text": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0/text": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "proprietary/line": "All rights reserved",
}


def template_grams(templates: dict[str, str], k: int) -> list[tuple[str, int, int, int]]:
    """Template, place, hash and number of words, for each k-gram."""
    out = []
    for name, text in templates.items():
        h, _ = word_hashes(pa.array([text.lower()]))
        if len(h) < k:
            raise ValueError(f"{name} has fewer than {k} words")
        out += [(name, j, int(g), len(h)) for j, g in enumerate(gram_hashes(h, k).view(np.int64))]
    return out


def grams(docs: DataFrame, text: str, k: int) -> DataFrame:
    """row, an id of its own for each row of docs, at and gram, for every k words of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for own, row in batches(part.column(1), part.column(0)):
                h, ptr = word_hashes(own)
                n = np.maximum(np.diff(ptr) - k + 1, 0)
                g = gram_hashes(h, k)
                at = np.repeat(ptr[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(g[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([row, lists], names=["row", "grams"])

    kind = docs.schema["row"].dataType.simpleString()
    return map_texts(docs.select("row", F.lower(text).alias("text")), run, f"row {kind}, grams array<long>").select("row", F.posexplode("grams").alias("at", "gram"))


def scanned(docs: DataFrame, *, templates: dict[str, str] | None = None, k: int = 3, slack: int = 8, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence, form, begin and end (words of the document), votes and coverage of each verified span.

    slack: how far apart diagonals of one span may be (for short templates a quarter of the words), and by how many words
    a span may be longer than the template. threshold: share of the template's words
    that a span must hold. A word is held if it is in a k-gram that hits.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    rows = template_grams(templates, k)
    places = spark.createDataFrame(rows, "template string, place int, gram long, words int")
    if len(rows) <= BROADCAST_ROWS // 4:
        places = F.broadcast(places)
    # a number for each row of the table keeps rows that repeat apart; it is made again alike if a task is run again on the same split
    own = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    hits = grams(own, "text", k).join(places, "gram").select("row", "template", "words", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = hits.groupBy("row", "template", "words", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("begin"), (F.max("at") + k).alias("end"), F.collect_list("place").alias("places"))
    # neighbouring diagonals go together; two occurrences lie further apart than that
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    anew = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= F.least(F.lit(slack), F.expr("words div 4")), 0).otherwise(1)
    spans = diagonals.withColumn("anew", anew).withColumn("span", F.sum("anew").over(order))
    held = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p, p + (k - 1))))))
    merged = spans.groupBy("row", "template", "words", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("votes").alias("votes"), held.alias("held"))
    merged = merged.withColumn("coverage", F.round(F.col("held") / F.col("words"), 6)).where((F.col("coverage") >= threshold) & (F.col("end") - F.col("begin") <= F.col("words") + slack))
    # spans that overlap, directly or by others, form a chain; greedy choice within each
    along = Window.partitionBy("row").orderBy("begin", "end", "template")
    apart = F.when(F.col("begin") < F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    chains = merged.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(along))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("h"), (-F.col("coverage")).alias("c"), "begin", "template", "end", "votes", "coverage")))
    chosen = chains.groupBy("row", "chain").agg(best_first.alias("own"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["begin"] < x["end"]) & (x["begin"] < t["end"]))
    taken = F.aggregate("own", F.slice("own", 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    merged = chosen.select("row", F.inline(taken))
    return merged.select(F.col("row.id").alias(id_col), F.split("template", "/")[0].alias("licence"), F.split("template", "/")[1].alias("form"), "begin", "end", "votes", "coverage")
