"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts and templates are lower-cased, cut at everything but letters and digits, and shingled by five words. A template of n
shingles belongs to the class c, the least power of four (8 at least) not below n; a text's windows of class c are 4c
shingles long, one every 3c, so some window holds any run of c shingles. A window or template is sketched by bottom-k MinHash:
its 128 least hashes are bands of one row each, and a template is retrieved if it has a band in common with a window. With
containment 0.8 their Jaccard similarity is 0.2 / 4.05 = 0.049 or more (n > c/4), each of the 128 least hashes of both together
is common with that probability, and so a template is retrieved with probability 1 - (1 - 0.049)**128 = 0.998 or more; in the
classes 8 and 32 the bands are all shingles of a window, so nothing is missed. Verification is exact on the hashes:
|template and window| / |template| >= 0.8.

Templates are a table of three kinds: whole texts of licenses (50 to 235 shingles, so windows of 512 or 2,048 shingles and
a true sketch of a quarter or a sixteenth of them), notices (headers and passages that files quote) and citations (one line that
names a license; nothing is sketched there, as such a line is about as long as a shingle). The table's bands and shingles are broadcast only if they have at most ``BROADCAST_ROWS`` rows and
``BROADCAST_BYTES`` bytes; else they are joined by shuffling.

Result: a row per (doc_id, license, kind) with the best containment over the license's templates of that kind, the number of windows that match
and the first of them (its first word). Defined results: null and empty texts and texts of fewer than five words match
nothing; templates of fewer than five words are left out; rows of equal id count together, null ids likewise; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WIDTH, LEAST = 5, 0.8
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
CLASSES = [8 * 4**i for i in range(13)]
#: Bands of a sketch; a window's length and step in units of its class.
BANDS, LONG, STEP = 128, 4, 3
#: Shingles of a stretch.
STRETCH = 6144

#: Whole texts of licenses as their stewards publish them, without titles and copyright lines.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDER \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}
#: What files hold of a license that they refer to, as its steward words it: headers, opening passages, clauses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: The names under which licenses are cited.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
}
#: How works cite a license by its name.
FORMS = ("licensed under {0}", "licensed under the {0}", "licensed under a {0}", "released under the {0}", "distributed under the {0}", "available under the {0}", "under the terms of the {0}")


def citations() -> list[tuple[str, str]]:
    return [(license_, form.format(name)) for license_, names in NAMES.items() for name in names for form in FORMS]


def built_in() -> list[tuple[str, str, str]]:
    """(kind, license, body): the whole texts and notices above, and each name in each form of citation."""
    kinds = {"text": TEXTS.items(), "notice": NOTICES.items(), "citation": citations()}
    return [(kind, license_, body) for kind, rows in kinds.items() for license_, body in rows]


def templates_of(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(kind, license, body): :func:`built_in`, or ``rows``."""
    every = built_in() if rows is None else rows
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("license"), F.lit(v).alias("body")) for kind, k, v in every])
    return spark.range(1).select(F.explode(lines).alias("t")).select("t.*")


def shingles(text: Column) -> Column:
    """Hashes of all runs of WIDTH normalised words, in order."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    hashed = lambda x: F.when(F.size(x) >= WIDTH, F.transform(F.sequence(F.lit(1), F.size(x) - WIDTH + 1), lambda i: F.xxhash64(F.slice(x, i, WIDTH)))).otherwise(F.array().cast("array<long>"))
    return F.element_at(F.transform(F.array(w), hashed), 1)


def bands(s: Column) -> Column:
    """The least of the sorted hashes ``s``."""
    return F.slice(s, 1, BANDS)


def prepared(templates: DataFrame) -> DataFrame:
    """(template, kind, license, own: sorted distinct shingles, class), staged; templates without shingles are left out."""
    t = templates.select("kind", "license", F.sort_array(F.array_distinct(shingles(F.col("body")))).alias("own")).filter(F.size("own") > 0).distinct()
    cls = F.element_at(F.filter(F.array(*[F.lit(c) for c in CLASSES]), lambda c: c >= F.size("own")), 1)
    return staged(t.select(F.xxhash64("kind", "license", "own").alias("template"), "kind", "license", "own", cls.alias("class")), "license-templates")


def windows_of(d: DataFrame, classes: list[int]) -> DataFrame:
    """(uid, doc_id, s) -> (uid, doc_id, class, first, window): all windows of all classes, a window as its sorted shingles.

    Texts are cut into stretches first, so no row carries a whole long text along."""
    top = LONG * max(classes, default=8)
    step = STEP * max(STRETCH // STEP, max(classes, default=8))  # of all classes a multiple; a stretch reaches a window of the largest beyond it
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(step)), lambda at: F.struct(at.alias("at"), F.size("s").alias("n"), F.slice("s", at + 1, F.lit(step + top)).alias("own")))
    rows = d.filter(F.size("s") > 0).select("uid", "doc_id", F.explode(cuts).alias("t"))

    def of_class(c: int) -> Column:
        last = F.greatest(F.ceil((F.col("t.n") - LONG * c) / (STEP * c)), F.lit(0)).cast("int") * STEP * c  # of the text; it reaches the text's end
        high = F.least(last - F.col("t.at"), F.lit(step - 1))
        firsts = F.when(high >= 0, F.sequence(F.lit(0), high, F.lit(STEP * c))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda k: F.struct(F.lit(c).alias("class"), (F.col("t.at") + k).alias("first"), F.slice(F.col("t.own"), k + 1, F.lit(LONG * c)).alias("window")))

    every = F.flatten(F.array(*[of_class(c) for c in classes])) if classes else F.array().cast("array<struct<class:int,first:int,window:array<long>>>")
    return rows.select("uid", "doc_id", F.explode(every).alias("w")).select("uid", "doc_id", "w.class", "w.first", F.sort_array("w.window").alias("window"))


def scan(docs: DataFrame, templates: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    known = prepared(templates if templates is not None else templates_of(docs.sparkSession))
    size = known.agg(F.sum(F.size("own")).alias("n"), F.array_sort(F.collect_set("class")).alias("classes")).first()
    small = (size["n"] or 0) <= BROADCAST_ROWS and 64 * (size["n"] or 0) <= BROADCAST_BYTES  # bands are at most as many as shingles
    side = F.broadcast if small else (lambda x: x)
    d = docs.select(F.monotonically_increasing_id().alias("uid"), docs[doc_id].alias("doc_id"), shingles(F.col(text)).alias("s"))
    probes = windows_of(d, size["classes"] or []).select("*", F.explode(bands(F.col("window"))).alias("band"))
    index = known.select("template", "class", F.explode(bands(F.col("own"))).alias("band"))
    met = probes.join(side(index), ["class", "band"]).groupBy("uid", "first", "class", "template").agg(F.first("doc_id").alias("doc_id"), F.first("window").alias("window"))
    share = F.size(F.array_intersect("window", "own")) / F.size("own")
    met = met.join(side(known.select("template", "kind", "license", "own")), "template").select("doc_id", "license", "kind", "uid", "first", "class", share.alias("containment")).filter(F.col("containment") >= least)
    one = met.groupBy("doc_id", "license", "kind", "uid", "class", "first").agg(F.max("containment").alias("containment"))
    return one.groupBy("doc_id", "license", "kind").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("first").cast("long").alias("first_word"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
