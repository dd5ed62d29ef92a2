"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor.

Every sentence of a text that mentions a licence is a header, and so are its parts where it is cut at "or",
"and" and their like in German, French and Spanish; a licence file (by name) is taken whole as well. Term
weights come from the templates; a word they don't know weighs as one that occurs in none. A template
is compared with the texts that have all its telling words (names, versions and clauses that tell rivals
apart: affero, lesser, nc, 2.1, ...), and of those that match a text the ones go whose telling words another
one of a different licence has and exceeds: the Lesser GPL isn't taken for the GPL, but two licences in one
sentence are both found. Templates at or above ``threshold`` name the licences; the best is the document's.
Files without one of their own take that of the nearest directory above that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# How the usual licences are named in headers, and the short ones' texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_TEXTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", _MIT),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0, a dedication to the public domain, with no licence needed."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAMES} {_BSD_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("EUPL-1.2", "Licensed under the European Union Public Licence EUPL, version 1.2."),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", "Boost Software License, Version 1.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Apache-2.0", "Apache License 2.0."),
    ("MIT", "The MIT License (MIT)."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-3.0", "Licensed under the GPL version 3."),
    ("GPL-2.0", "Licensed under the GNU GPL v2."),
    ("GPL-2.0", "Licensed under the GPL version 2."),
    ("LGPL-3.0", "Licensed under the GNU LGPL v3."),
    ("LGPL-2.1", "Licensed under the GNU LGPL v2.1."),
    ("AGPL-3.0", "Licensed under the GNU AGPL v3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("MPL-2.0", "Licensed under the MPL 2.0."),
    *((name, sentence.format(said)) for name, said in (("MIT", "MIT"), ("Apache-2.0", "Apache 2.0"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-2-Clause", "BSD 2-Clause"), ("GPL-3.0", "GNU GPL v3"), ("GPL-2.0", "GNU GPL v2"), ("LGPL-3.0", "GNU LGPL v3"), ("MPL-2.0", "MPL 2.0")) for sentence in ("Lizenziert unter der {}-Lizenz.", "Veröffentlicht unter der {}-Lizenz.", "Distribué sous licence {}.", "Publié sous la licence {}.", "Licenciado bajo la licencia {}.", "Publicado bajo la licencia {}.")),
)
#: Besides their texts, every licence's tag.
TEMPLATES = (*_TEXTS, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in _TEXTS)))
#: Words that tell rivals apart.
TELLING = (
    "affero", "agpl", "apache", "boost", "bsd", "cc", "clause", "commons", "eclipse", "endorse", "epl", "eupl", "european", "gnu", "gpl", "isc", "lesser", "lgpl", "mit", "mozilla", "mpl",
    "nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike", "unlicense", "0", "1.0", "1.1", "1.2", "2", "2.0", "2.1", "3", "3.0", "4.0",
)
MENTION = r"(?i)licen[cs]|lizen[zs]|SPDX|permission is hereby granted|permission to use|redistribution and use"
#: Where a sentence that names several licences is cut.
BETWEEN = r"(?i)\s+(?:or|and|oder|und|ou|et|o|y)\s+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
SENTENCE = r"\n|(?<=[.!?])\s+"


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, float, float]], float]:
    """(template, word, weight / norm, idf) rows and the idf of words in no template."""
    bags = [Counter(re.findall(WORD, t.lower())) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, b in enumerate(bags):
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items()))
        rows += [(k, w, c * idf[w] / norm, idf[w]) for w, c in b.items()]
    return rows, math.log(1 + len(bags)) + 1


def telling_of(text: str) -> str:
    return " ".join(sorted(set(re.findall(WORD, text.lower())) & set(TELLING)))


_ROW = ("id", "row", "row2")


def header_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """(id, row, row2, whole, licence, score): the licences of each row of (id, row, row2, path, text) with their
    best scores, ``whole`` if the text as a whole was compared."""
    spark = docs.sparkSession
    rows, unseen = template_weights(templates)
    kinds = [sorted(set(telling_of(t).split())) for _, t in templates]
    table = spark.createDataFrame([(k, w, x, i, templates[k][0], kinds[k]) for k, w, x, i in rows], "template int, word string, weight double, idf double, licence string, tells array<string>")  # as large as the templates
    mentions = docs.filter(F.col("text").rlike(MENTION) | F.col("path").rlike(LICENCE_FILE))
    sentences = F.filter(F.split("text", SENTENCE, -1), lambda s: s.rlike(MENTION))
    parts = F.flatten(F.transform(sentences, lambda s: F.array_distinct(F.concat(F.array(s), F.split(s, BETWEEN, -1)))))
    files = F.when(F.col("path").rlike(LICENCE_FILE), F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("s")))).otherwise(F.array().cast("array<struct<whole:boolean,s:string>>"))
    headers = mentions.select(*_ROW, F.posexplode(F.concat(F.transform(parts, lambda s: F.struct(F.lit(False).alias("whole"), s.alias("s"))), files)).alias("k", "h"))
    bags = headers.select(*_ROW, "k", "h.whole", F.regexp_extract_all(F.lower("h.s"), F.lit(WORD), F.lit(0)).alias("bag"))
    told = bags.withColumn("telling", F.array_distinct(F.array_intersect("bag", F.array(*map(F.lit, TELLING)))))
    words = told.select(*_ROW, "k", "whole", "telling", F.explode("bag").alias("word")).groupBy(*_ROW, "k", "whole", "telling", "word").agg(F.count("*").alias("n"))
    idf = table.select("word", "idf").distinct()
    norms = words.join(F.broadcast(idf), "word", "left").groupBy(*_ROW, "k").agg(F.sqrt(F.sum((F.col("n") * F.coalesce("idf", F.lit(unseen))) ** 2)).alias("norm"))
    fitting = words.join(F.broadcast(table), "word").filter(F.size(F.array_except("tells", "telling")) == 0)
    dots = fitting.groupBy(*_ROW, "k", "whole", "template", "licence", "tells").agg(F.sum(F.col("n") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, [*_ROW, "k"]).withColumn("score", F.col("dot") / F.col("norm")).filter(F.col("score") >= threshold)
    every = scored.groupBy(*_ROW, "k", "whole").agg(F.collect_set(F.struct("licence", "tells")).alias("all"), F.collect_list(F.struct("licence", "tells", "score")).alias("found"))  # as many as there are templates
    each = every.select(*_ROW, "whole", "all", F.explode("found").alias("f"))
    told_apart = F.exists("all", lambda o: (o.licence != F.col("f.licence")) & (F.size(F.array_except(F.col("f.tells"), o.tells)) == 0) & (F.size(o.tells) > F.size(F.col("f.tells"))))
    return each.filter(~told_apart).groupBy(*_ROW, "whole", F.col("f.licence").alias("licence")).agg(F.max("f.score").alias("score"))


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def licence_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates=TEMPLATES, threshold: float = 0.6, salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, licence, licences, score, origin ('header', 'file', 'directory'
    or null). licences: all that were found, by name, comma-joined; licence: the best of them.

    A licence file counts as a whole if that matches, else by its headers. Scores are compared to
    six places, ties go to the first name. Null texts are empty, null paths lie in the root. Of
    several licence files in a directory the best score counts, then the first name; its one
    licence is what files below inherit. Repeated rows are judged alike. Files of a hot directory are
    salted over ``salts`` keys. Empty table: no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[path_col].cast("string"), F.lit("")).alias("path"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # rows are known by their id and two hashes of all of them: one hash of 64 bits isn't enough for as many
    rows = rows.withColumns({"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row": F.xxhash64("doc_id", "path", "text"), "row2": F.xxhash64(F.lit(1), "text", "path")})
    matches = header_matches(rows.select(*_ROW, "path", "text"), templates, threshold).withColumn("score", F.round("score", 6))
    first = F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("score")).alias("less"), "licence"))
    found = written(matches.groupBy(*_ROW).agg(first.alias("m"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences")).select(*_ROW, (~F.col("m.part")).alias("whole"), (-F.col("m.less")).alias("score"), "m.licence", "licences"), "licences")
    own = rows.select("doc_id", "path", *_ROW).join(found, list(_ROW), "left")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    holders = own.filter(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE)).withColumn("dir", directory)
    granted = holders.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("g"))
    folders = rows.select(directory.alias("folder"), "path").groupBy("folder").agg(F.first("path").alias("path"))
    above = folders.select("folder", F.posexplode(ancestors(F.col("path"))).alias("steps", "dir"))
    inherited = above.join(granted, "dir").groupBy("folder").agg(F.min_by("g", "steps").alias("g"))
    salted = inherited.select("folder", F.col("g.licence").alias("given"), (-F.col("g.less")).alias("given_score"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    files = own.withColumn("folder", directory).withColumn("salt", F.pmod(F.xxhash64("row", "doc_id"), F.lit(salts)).cast("int"))
    both = files.join(salted, ["folder", "salt"], "left")
    origin = F.when(F.col("licence").isNotNull(), F.when(F.col("whole"), "file").otherwise("header")).when(F.col("given").isNotNull(), "directory")
    return both.select("doc_id", F.coalesce("licence", "given").alias("licence"), F.coalesce("licences", "given").alias("licences"), F.coalesce("score", "given_score").alias("score"), origin.alias("origin"))
