"""License scan: MinHash bands retrieve templates for text windows, exact containment verifies.

Texts and templates become five-word shingles, hashed to 64 bits.  For a
template of m shingles, windows of m shingles start at every quarter of m.  A
window's signature is 40 MinHashes, in 20 bands of two: at a Jaccard similarity
of one half, a window and a template share a band with probability 0.997.  A
retrieved pair counts if the window, widened by its step on both sides, contains
at least 0.8 of the template's shingles.  Only windows that hold some template
shingle are made; any other contains nothing of any template.

Everything is DataFrame functions.  Templates are a fixed list, so what is
broadcast has a fixed size.  Words are runs of letters and digits of the
lower-cased text.  Null, empty and short texts hold no shingle and match
nothing; rows of equal id are reported together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices, openings and (``-text``) whole texts of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

WIDTH, BANDS, ROWS, CONTAINED = 5, 20, 2, 0.8


def masks(n: int) -> Column:
    """n fixed 64-bit numbers; a MinHash is the least of all hashes xor one of them."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.xxhash64(F.lit("minhash"), k))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """Hashes of all five-word shingles, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def rolled(w: Column) -> Column:
        n = F.size(w) - (WIDTH - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, WIDTH)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, rolled)


def bands(hashes: Column, marks: Column) -> Column:
    """The signature's bands, each hashed with its number."""
    signature = F.transform(marks, lambda c: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(c))))
    return let(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice(s, k * ROWS + 1, ROWS))))


def template_table(spark: SparkSession, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """license, m (distinct shingles), and the shingles."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    return rows.select("license", F.array_distinct(shingles(F.col("text"))).alias("template")).withColumn("m", F.size("template")).where("m > 0")


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and license found: doc_id, license, containment, windows, first_word."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    listed = known.collect()  # the fixed list
    every = F.array(*(F.lit(h) for h in sorted({h for r in listed for h in r["template"]})))
    sizes = F.array(*(F.lit(m) for m in sorted({r["m"] for r in listed})))
    marks = masks(BANDS * ROWS)

    hashed = docs.select(F.col(id_col).alias("doc_id"), shingles(F.col(text_col)).alias("h")).where(F.arrays_overlap("h", every))
    at = F.filter(F.transform("h", lambda h, i: F.when(F.array_contains(every, h), i)), lambda i: i.isNotNull())
    step = lambda m: F.greatest(F.lit(1), F.floor(m / 4).cast("int"))
    # the windows of m shingles that hold position p start at multiples of the step
    starts = lambda p, m: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((p - m + 1) / step(m)).cast("int")), F.floor(p / step(m)).cast("int")), lambda g: F.struct((g * step(m)).alias("start"), m.alias("m")))
    windows = F.array_distinct(F.flatten(F.flatten(F.transform("at", lambda p: F.transform(sizes, lambda m: starts(p, m))))))
    made = hashed.withColumn("at", at).select("doc_id", "h", F.explode(windows).alias("w")).select("doc_id", "w.start", "w.m", F.slice("h", F.col("w.start") + 1, F.col("w.m")).alias("inside"), F.slice("h", F.greatest(F.lit(1), F.col("w.start") + 1 - step(F.col("w.m"))), F.col("w.m") + 2 * step(F.col("w.m"))).alias("wide"))
    banded = made.select("doc_id", "start", "m", "wide", F.explode(bands(F.col("inside"), marks)).alias("band"))
    index = known.select("license", "m", "template", F.explode(bands(F.col("template"), marks)).alias("band"))
    met = banded.join(F.broadcast(index), ["m", "band"])
    share = F.size(F.array_intersect("wide", "template")) / F.col("m")
    found = met.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= CONTAINED)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count_distinct("start").alias("windows"), F.min("start").alias("first_word"))
