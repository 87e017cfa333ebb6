"""Licences: TF-IDF cosine of headers and licence files to templates, inherited from the nearest directory. DataFrame functions only.

A header is a stretch of text around words of licensing, wherever it stands in the text, in two forms: each word's own line
(at most BEFORE and AFTER code points on either side), for a notice within other text, and whole stretches across lines, in
which such words follow each other within AFTER code points, for notices that are wrapped and for licence files. Their words, weighted by term frequency and inverse document frequency over all headers of the
table, are compared with each template by cosine, in sparse form: a template is a map from word to weight, so a header
meets only the words that they share. The best template at THRESHOLD or above is the document's own licence; a whole
stretch that reaches it goes before single lines, for it has the words that tell versions apart.

An SPDX identifier (SPDX-License-Identifier: and a name, the first of a text) goes before any comparison and is taken as it is,
but for an ending -only or -or-later, which tell no licence apart.

A licence file is a file named like one, or a text of which whole stretches make at least FILE_SHARE. It sets the licence
of its directory (the best score, then the smallest path). A document without a licence of its own takes that of its
nearest ancestor directory: distinct directories are expanded to their ancestors, joined with the directories that have
licences, and joined back by path; only directories take part, so a directory with a third of all documents is one row.

Frequencies are gathered for the templates' words only, so what the driver holds is bounded by the templates. Null text
has no header; a null path is the root's. Repeated rows have equal results; all columns stay, under their names, but for one
named _license, which gives way. An empty table gives
no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import cut, small_side

THRESHOLD, FILE_SHARE = 0.45, 0.6
BEFORE, AFTER = 120, 400
#: The usual notices of licences.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3. You can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by. Neither the name of the organization nor the names of its contributors may be used to endorse or promote products",
    "Zlib": "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https www.eclipse.org legal epl-2.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla org MPL 2.0",
    "ISC": "Licensed under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain. See the Unlicense, unlicense org",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal, Creative Commons Zero",
}
#: Texts of licences, or how those begin that are long.
FILES = {
    "MIT": "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "ISC License Copyright Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "BSD 2-Clause License Copyright All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "BSD 3-Clause License Copyright All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-4-Clause": "BSD 4-Clause License Copyright All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http www.apache.org licenses TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GPL-2.0 short": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0 short": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
}
_NAMES = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice|copyright)(?:[.-][a-z0-9.-]+)?$"
HEADER = r"(?i)\b(?:licen[cs]ed?|unlicense|copyright|spdx|permission is|redistribut[a-z]+|public domain|mozilla public|creative commons)\b"
#: A whole stretch: so many words of licensing at most, then the next stretch starts.
RUN = 40
STRETCH = f"(?s){HEADER}(?:.{{0,{AFTER}}}?{HEADER}){{0,{RUN}}}.{{0,{AFTER}}}"
#: An identifier in a header's own words is the licence, without any comparison.
SPDX = r"(?i)SPDX-License-Identifier:[\x20\t]*+([A-Za-z0-9.+-]++)"
_WORD = "[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*"


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w))


def _template_words(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in re.findall(_WORD, text):
        out[w.lower()] = out.get(w.lower(), 0) + 1
    return out


def frequencies(headers: DataFrame) -> tuple[int, dict[str, int]]:
    """(headers, and in how many of them each word of the templates is) of rows with an array `words`."""
    vocabulary = sorted({w for t in (*TEMPLATES.values(), *FILES.values()) for w in _template_words(t)})
    known = F.array_intersect("words", F.array(*(F.lit(w) for w in vocabulary)))
    n = headers.count()
    rows = headers.select(F.explode(known).alias("w")).groupBy("w").count().collect()  # a row for each word of the templates at most
    return n, {r["w"]: r["count"] for r in rows}


def _vectors(n: int, seen: dict[str, int]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """(idf of the templates' words, normed weights of each template and of its first sentence, which short headers quote alone)."""
    known = {name: _template_words(t) for name, t in (TEMPLATES | {f"{k}#file": v for k, v in FILES.items()}).items()}
    within: dict[str, int] = {}
    for words in known.values():
        for w in words:
            within[w] = within.get(w, 0) + 1
    idf = {w: 1 + math.log((n + len(known)) / (seen.get(w, 0) + k)) for w, k in within.items()}
    vectors = {}
    for name, text in (TEMPLATES | {f"{k}#1": re.split("[.;] ", v)[0] for k, v in TEMPLATES.items()} | {f"{k}#file": v for k, v in FILES.items()}).items():
        v = {w: c * idf[w] for w, c in _template_words(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[name] = {w: x / norm for w, x in v.items()}
    return idf, vectors


#: Weight of words outside the templates: as of one in a tenth of the headers.
_REST = 1 + math.log(10)


def _best(n: int, seen: dict[str, int]):
    """A function from a header's words to its best (score, template)."""
    idf, vectors = _vectors(n, seen)
    names = list(vectors)
    # One map literal, bounded by the templates: word -> its idf and its weight in each template; each row is one string to the parser.
    numbers = lambda *xs: f"cast(split('{','.join(f'{x:.9f}' if x else '0' for x in xs)}', ',') AS array<double>)"
    entries = ", ".join(f"'{w}', {numbers(i, *(vectors[t].get(w, 0.0) for t in names))}" for w, i in idf.items())
    rows, none = F.expr(f"map({entries})"), F.expr(numbers(_REST, *([0.0] * len(names))))
    zero = F.expr(f"array({', '.join(['0.0D'] * (len(names) + 1))})")
    label = F.expr(f"array({', '.join(repr(x) for x in names)})")

    def best(words: Column) -> Column:
        own = F.transform(F.array_distinct(words), lambda w: F.struct(F.size(F.filter(words, lambda x: x == w)).alias("c"), F.coalesce(F.try_element_at(rows, w), none).alias("v")))
        size = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + F.pow(x["c"] * F.get(x["v"], F.lit(0)), F.lit(2))))
        dots = F.aggregate(own, zero, lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q * x["c"] * F.get(x["v"], F.lit(0))))
        scored = F.zip_with(F.slice(dots, 2, len(names)), label, lambda d, name: F.struct((d / size).alias("score"), name.alias("name")))
        return F.when(F.size(words) > 0, F.array_max(scored))

    return best


def scan(docs: DataFrame, path: Column, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs and a struct `_license`: path, headers, score, own, inherited, source (the directory), license."""
    base = spans.apart(docs, __lic_text=F.coalesce(docs[text_col].cast("string"), F.lit("")), __lic_path=F.coalesce(path.cast("string"), F.lit("")))
    base = base.withColumn("__lic_key", spans.matches(F.col("__lic_text"), HEADER))
    some = F.size("__lic_key") > 0
    base = base.withColumns({"__lic_between": spans.around(F.col("__lic_text"), HEADER, F.col("__lic_key")), "__lic_long": F.when(some, spans.matches(F.col("__lic_text"), STRETCH))})
    base = base.withColumn("__lic_beside", F.when(some, F.split("__lic_text", STRETCH, -1)))
    before = lambda i: F.substring_index(F.right(F.get("__lic_between", i), F.lit(BEFORE)), "\n", -1)
    after = lambda i: F.substring_index(F.left(F.get("__lic_between", i + 1), F.lit(AFTER)), "\n", 1)
    none = F.array().cast("array<string>")
    whole = F.transform("__lic_long", lambda k, i: F.concat(F.right(F.get("__lic_beside", i), F.lit(BEFORE)), k))
    base = base.withColumns({"__lic_found": F.when(some, F.transform("__lic_key", lambda k, i: F.concat(before(i), k, after(i)))).otherwise(none), "__lic_whole": F.when(some, whole).otherwise(none)})
    words = base.withColumns({"__lic_words": F.transform("__lic_found", lambda h: _words(h)), "__lic_more": F.transform("__lic_whole", lambda h: _words(h))})
    heads = cut(words.select("__lic_words"), "license-headers").select(F.explode("__lic_words").alias("words"))
    best = _best(*frequencies(heads))
    scored = words.withColumns({"__lic_line": F.array_max(F.transform("__lic_words", lambda w: best(w))), "__lic_stretch": F.array_max(F.transform("__lic_more", lambda w: best(w)))})
    scored = scored.withColumn("__lic_best", F.when(F.col("__lic_stretch.score") >= threshold, F.col("__lic_stretch")).otherwise(F.col("__lic_line")))
    named = F.regexp_replace(F.nullif(F.regexp_extract("__lic_text", SPDX, 1), F.lit("")), "(?i)-(only|or-later)$", "")
    own_license = F.when(named.isNotNull(), named).when(F.col("__lic_best.score") >= threshold, F.substring_index(F.substring_index("__lic_best.name", "#", 1), " ", 1))
    covered = F.aggregate("__lic_whole", F.lit(0), lambda x, h: x + F.char_length(h))
    is_file = F.col("__lic_path").rlike(_NAMES) | ((F.char_length("__lic_text") > 0) & (covered >= FILE_SHARE * F.char_length("__lic_text")))
    done = scored.withColumns({"__lic_own": own_license, "__lic_file": is_file, "__lic_dir": F.regexp_replace("__lic_path", "/?[^/]*$", "")})
    narrow = cut(done.select("__lic_path", "__lic_dir", "__lic_own", "__lic_file", F.col("__lic_best.score").alias("__lic_score")), "license-paths")
    # Without own licence, the order of structs puts the higher score first, then the smaller path by the negated rank of min_by.
    files = narrow.where("__lic_file and __lic_own is not null")
    top = files.groupBy("__lic_dir").agg(F.min_by("__lic_own", F.struct(-F.col("__lic_score"), F.col("__lic_path"))).alias("license"))
    dirs = narrow.where("__lic_own is null").select("__lic_dir").distinct()
    parts = F.split("__lic_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))
    chains = dirs.withColumn("a", F.explode(ups)).select("__lic_dir", "a.depth", "a.up")
    near = chains.join(top.withColumnRenamed("__lic_dir", "up"), "up").groupBy("__lic_dir").agg(F.max_by(F.struct("license", "up"), "depth").alias("__lic_near"))
    out = done.join(small_side(cut(near, "license-dirs")), "__lic_dir", "left")
    inherited = F.when(F.col("__lic_own").isNull(), F.col("__lic_near.license"))
    value = F.struct(
        F.col("__lic_path").alias("path"), F.size("__lic_found").cast("long").alias("headers"), F.round(F.col("__lic_best.score"), 6).alias("score"), F.col("__lic_own").alias("own"), inherited.alias("inherited"),
        F.when(F.col("__lic_own").isNull(), F.col("__lic_near.up")).alias("source"), F.coalesce(F.col("__lic_own"), F.col("__lic_near.license")).alias("license"),
    )
    return spans.together(out, docs, "_license", value)
