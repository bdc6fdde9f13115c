"""License scans by sentence rules, in DataFrame functions only.

A text is cut into pieces (at line ends, and after . ! ? ; or : before white space), which are normalised (lower case, runs of what isn't a letter or digit become one space).
A known sentence is one piece, or several in a row: it may be wrapped over lines, go on after : or ; and hold the abbreviation "v.", but not go over a line without letters and digits or over . ! ? before white space.
Sentences that a licence is known by get their identifiers, the longest that fits first; the sequence of identifiers of a text is matched against licence rules in order, longest first: a
rule is a run of identifiers without another known sentence between. A run that matched is used up, so a full licence isn't also its notice.

Null texts count as empty and have no licence. Rows are independent, repeated ones too: there is no shuffle. Texts are read whole. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licences and notices, normalised, by identifier.
SENTENCES: dict[int, str] = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "licensed under the mit license",
    12: "the mit license",
    13: "mit license",
    14: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "you should have received a copy of the gnu general public license along with this program",
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "this work is licensed under a creative commons attribution 4 0 international license",
    40: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    41: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    42: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    60: "all rights reserved",
    70: "spdx license identifier mit",
    71: "spdx license identifier apache 2 0",
    72: "spdx license identifier gpl 3 0 only",
}
#: Fixed values: (licence, identifiers in order); longer rules come first.
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("Apache-2.0", (2, 3, 4, 5, 6)),
    ("BSD-3-Clause", (40, 41, 42)),
    ("Apache-2.0", (1, 3)),
    ("MIT", (12, 14)),
    ("MIT", (13, 14)),
    ("GPL-3.0-or-later", (21, 22)),
    ("GPL-2.0-or-later", (23, 22)),
    ("BSD-2-Clause", (40, 41)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (71,)),
    ("MIT", (10,)),
    ("MIT", (11,)),
    ("MIT", (14,)),
    ("MIT", (70,)),
    ("GPL-3.0-only", (20,)),
    ("GPL-3.0-only", (72,)),
    ("GPL-3.0-or-later", (21,)),
    ("GPL-2.0-or-later", (23,)),
    ("CC-BY-NC-4.0", (30,)),
    ("CC-BY-4.0", (31,)),
    ("CC-BY-SA-4.0", (32,)),
    ("CC-BY-4.0", (33,)),
    ("MPL-2.0", (50,)),
    ("Proprietary", (60,)),
)
#: Every known sentence has one of these words; other texts are not cut.
HINT = r"(?i)licen[sc]e|copyright|redistribution|rights[^a-z0-9]+reserved"
#: Steps to one line of words: "/" is an end of a sentence, "|" an end of a line and "," another end of a piece; sentences may go over the latter two.
MARKS: tuple[tuple[str, str], ...] = (
    (r"[^a-z0-9.!?;:\x20\t\r\n]", "_"),
    (r"(?<![a-z0-9])v\.(?=[\x20\t\r\n])", "v:"),
    (r"(?<=[.!?])[\x20\t\r\n]+", "/"),
    (r"\r\n|\r|\n", "|"),
    (r"(?<=[;:])[\x20\t]+", ","),
    (r"\|[^a-z0-9|]*(?=\|)", "/"),
    (r"[^a-z0-9/|,]+", " "),
    (r" ?([/|,]) ?", "$1"),
)
KNOWN = r"(?<![^/|,])(?:" + "|".join(s.replace(" ", "[ |,]++") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r")(?![^/|,])"


def marked(text: Column) -> Column:
    out = F.lower(text)
    for pattern, by in MARKS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(sentence, r"[ |,]+", " ")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences (known ones), sentence_ids (in order, joined by spaces), licenses (distinct, sorted, joined by commas), n_matches (of rules)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    ids = F.transform(F.regexp_extract_all(marked(text), F.lit(KNOWN), F.lit(0)), lambda s: F.try_element_at(table, normalised(s)))
    d = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(HINT), ids).otherwise(F.array().cast("array<int>")).alias("ids"))
    # each identifier stands between two bars of its own, so that runs can be cut out without touching their neighbours; a cut leaves a break
    left = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("|"), i.cast("string"), F.lit("|"))))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in run)).alias("run")) for name, run in RULES])
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, r: Column) -> Column:
        times = F.floor((F.char_length(s["left"]) - F.char_length(F.replace(s["left"], r["run"], F.lit("")))) / F.char_length(r["run"]))
        hit = times > 0
        return F.struct(F.when(hit, F.replace(s["left"], r["run"], F.lit("/"))).otherwise(s["left"]).alias("left"), F.when(hit, F.concat(s["names"], F.array(r["name"]))).otherwise(s["names"]).alias("names"), (s["n"] + times).alias("n"))

    got = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)).otherwise(start)
    d = d.withColumn("got", got)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct("got.names")), ",").alias("licenses"), F.col("got.n").alias("n_matches"))
