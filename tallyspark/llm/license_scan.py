"""Licence scan: TF-IDF cosine of headers, notices and licence files to templates, then inheritance along paths.

Only DataFrame functions are used on the main path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize

#: Licence names and the wording of their short notices and titles.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]
#: The paragraphs and whole texts of licences and headers.
TEXTS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("GPL-3.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.'),
]
#: Pieces of a text are looked at if they have one of these words; every template has one.
CUE = r"(?i)licen[cs]e|copyright|spdx|redistribut|permission|warrant"
#: A template is taken from this cosine on.
LEAST_COSINE = 0.6
#: Names of files whose licence holds for their directory, and the share of a text that makes it such a file, for tables without such names.
LICENCE_FILE, LICENCE_SHARE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-_][^/]*)?$", 0.25
TOKEN = r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*"
PARAGRAPH = r"\n[ \t]*\n"


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spdx(names: list[str]) -> list[tuple[str, str]]:
    """The identifier line of each licence."""
    return [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(names)]


def cue_windows(words: Column, lengths: list[int]) -> Column:
    """All runs of so many tokens that hold a token with a cue, over line ends, as texts.

    Starts are marked once each, however many cues lie near: of a length n, those whose next cue is less than n tokens on.
    """

    def around(t: Column) -> Column:
        cues = F.filter(F.transform(t, lambda x, i: F.when(x.rlike(CUE), i)), lambda i: i.isNotNull())
        return F.transform(F.array(cues), lambda at: _runs(t, at, lengths))[0]

    return F.array_distinct(F.flatten(F.transform(F.array(words), around)))


def _runs(t: Column, cues: Column, lengths: list[int]) -> Column:
    """Texts of the runs: for each cue and length, starts after the last cue before it (those belong to that one) up to the cue."""

    def of_length(n: int) -> Column:
        text = lambda s: F.array_join(F.transform(_between(s, F.least(s + n, F.size(t)) - 1), lambda i: F.get(t, i)), " ")
        low = lambda c, k: F.greatest(c - n + 1, F.when(k > 0, F.get(cues, k - 1) + 1).otherwise(F.lit(0)), F.lit(0))
        return F.flatten(F.transform(cues, lambda c, k: F.transform(_between(low(c, k), c), text)))

    return F.concat(*[of_length(n) for n in lengths])


def _between(a: Column, b: Column) -> Column:
    """a to b; empty if b is smaller."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def _vectors(parts: DataFrame, keys: list[str], idf: DataFrame, n: int) -> DataFrame:
    """Unit TF-IDF vectors (keys, token, weight) of (keys, text); a token that no template has counts as unseen."""
    counted = parts.select(*keys, F.explode(tokens(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(idf), "token", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1.0))
    norm = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.where("idf is not null").join(norm, keys).select(*keys, "token", (F.col("weight") / F.col("norm")).alias("weight"))


def scan(files: DataFrame, notices: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None, least: float = LEAST_COSINE, share: float | None = None) -> DataFrame:
    """path, licence, score, inherited_from for every row of files (path string, text string).

    Of every text that has a cue the lines and paragraphs with one, runs of a notice's number of words
    around each cue (over line ends) and the text as a whole are compared with every notice, licence text
    and SPDX line. A template is taken only where its version numbers stand (of an SPDX line, all words). A
    file's own licence is the best cosine, from least on (ties: the first name). A file that LICENCE_FILE
    names, or, if share is given, of whose words the best piece has that share or more, gives its licence to its directory; a
    file without its own takes that of the nearest ancestor directory (of several there a named file's, then the first name),
    named in inherited_from, with a null score. Else licence is null.

    Null and empty texts have no own licence; null paths inherit nothing. Rows with an equal path are
    one file: each gets the best of them. An empty table gives no rows. Other columns are ignored.
    """
    notices = NOTICES if notices is None else notices
    texts = TEXTS if texts is None else texts
    templates = [*notices, *texts, *spdx([name for name, _ in [*notices, *texts]])]
    spark = files.sparkSession
    known = spark.createDataFrame([(i, *t, i < len(notices) or i >= len(notices) + len(texts)) for i, t in enumerate(templates)], "template int, licence string, text string, short boolean")
    need = F.when(F.col("text").startswith("SPDX-"), tokens(F.col("text"))).otherwise(F.filter(tokens(F.col("text")), lambda x: x.rlike("^[0-9]+([.][0-9]+)?$")))
    known = known.withColumn("words", tokens(F.col("text"))).withColumn("need", F.when(F.col("short"), F.array_distinct(need)).otherwise(F.array().cast("array<string>")))
    lengths = sorted({r["n"] for r in known.where("short").select(F.size("words").alias("n")).collect()})
    asked = F.array(*[F.lit(r["token"]) for r in known.select(F.explode("words").alias("token")).distinct().collect()])

    # One pass over the texts: which words of templates each has, and its pieces with a cue.
    files = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cued = lambda pieces: F.filter(pieces, lambda x: x.rlike(CUE))
    pieces = F.array_distinct(F.concat(cued(F.split("text", r"\n")), cued(F.split("text", PARAGRAPH)), F.array("text"), cue_windows(F.col("words"), lengths)))
    rows = files.withColumn("words", tokens(F.col("text")))
    rows = materialize(rows.select("path", F.array_intersect("words", asked).alias("seen"), F.size("words").alias("n_words"), F.when(F.col("text").rlike(CUE), pieces).alias("pieces")), "licence-rows")
    n = rows.count()
    df = rows.select(F.explode("seen").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = known.select(F.explode("words").alias("token")).distinct().join(df, "token", "left").select("token", (F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf"))
    parts = rows.where("path is not null and pieces is not null").select("path", "n_words", F.explode("pieces").alias("text")).withColumn("piece", F.xxhash64("text"))
    different = materialize(parts.groupBy("piece").agg(F.first("text").alias("text")), "licence-pieces")
    ours = _vectors(different, ["piece"], idf, n)
    theirs = _vectors(known, ["template"], idf, n).withColumnRenamed("weight", "template_weight").join(known.select("template", "licence", "need"), "template")
    scores = ours.join(F.broadcast(theirs), "token").groupBy("piece", "template", "licence", "need").agg(F.sum(F.col("weight") * F.col("template_weight")).alias("score"), F.collect_set("token").alias("has"))
    scores = scores.where((F.round("score", 9) >= least) & (F.size(F.array_except("need", "has")) == 0))
    found = scores.groupBy("piece").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "licence")).alias("b"))
    best = parts.join(found, "piece").groupBy("path").agg(F.min(F.struct("b", F.size(tokens(F.col("text"))).alias("n"), "n_words")).alias("p"))
    covers = F.col("path").rlike(LICENCE_FILE)
    if share is not None:
        covers = covers | (F.col("p.n") >= share * F.col("p.n_words"))
    best = best.select("path", F.col("p.b.licence").alias("own"), (-F.col("p.b.s")).alias("score"), covers.alias("covers"))
    paths = rows.select("path").join(best, "path", "left")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("")
    paths = materialize(paths.withColumn("folder", folder), "licence-paths")
    first = F.min(F.struct((~F.col("path").rlike(LICENCE_FILE)).alias("unnamed"), "own"))
    licensed = paths.where("own is not null and covers").groupBy(F.col("folder").alias("ancestor")).agg(first.alias("f")).select("ancestor", F.col("f.own").alias("inherited"))
    folders = paths.where("folder is not null").select("folder").distinct()
    steps = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    up = folders.select("folder", F.explode(F.array_distinct(ancestors)).alias("ancestor")).join(licensed, "ancestor")
    nearest = up.groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("l"), "ancestor", "inherited")).alias("n"))
    nearest = nearest.select("folder", F.col("n.ancestor").alias("ancestor"), F.col("n.inherited").alias("inherited"))
    out = paths.join(nearest, "folder", "left")
    from_above = F.col("own").isNull() & F.col("inherited").isNotNull()
    return out.select("path", F.coalesce("own", "inherited").alias("licence"), "score", F.when(from_above, F.col("ancestor")).alias("inherited_from"))
