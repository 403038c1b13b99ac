"""Licence scans by sentence rules, in SQL functions only.

A text is cut into sentences and normalised; sentences that are known become identifiers, and the sequence of
identifiers is matched against rules in order.  A rule consumes the identifiers it matches, so that a long licence is
not also reported as the shorter one it contains.  What known sentences no rule consumes is reported as well.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and of the notices they ask for, by identifier.
SENTENCES = {
    "MitName": ["The MIT License", "The MIT License (MIT)", "MIT License"],
    "MitRef": ["Released under the MIT License", "Licensed under the MIT License", "Distributed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "MitGrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "AsIs": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "NoLiability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "Apache2Ref": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License, Version 2.0"],
    "Apache2Name": ["Apache License Version 2.0, January 2004", "Apache License, Version 2.0"],
    "ApacheObtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "ApacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "Gpl3Ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "Released under the GNU General Public License, version 3"],
    "Gpl3Plus": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "Gpl2Plus": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "Gpl2Ref": ["Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "GplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "GplSee": ["See the GNU General Public License for more details"],
    "GplCopy": ["You should have received a copy of the GNU General Public License along with this program"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdRef": ["Licensed under the BSD License", "Released under the BSD License"],
    "Bsd2Ref": ["SPDX-License-Identifier: BSD-2-Clause"],
    "Bsd3Ref": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License"],
    "CcByRef": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CcByNcRef": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CcBySaRef": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "Cc0Ref": ["Released under CC0 1.0", "This work is dedicated to the public domain", "SPDX-License-Identifier: CC0-1.0"],
    "Mpl2Ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "SPDX-License-Identifier: MPL-2.0"],
    "Reserved": ["All rights reserved"],
}

#: Licence and the sequence of identifiers that says so, in the order in which they are tried.
RULES = [
    ("MIT", "MitName MitGrant MitNotice AsIs NoLiability"),
    ("MIT", "MitGrant MitNotice AsIs NoLiability"),
    ("MIT", "MitGrant MitNotice AsIs"),
    ("Apache-2.0", "Apache2Ref ApacheObtain ApacheAsIs ApacheSee"),
    ("Apache-2.0", "Apache2Ref ApacheObtain"),
    ("GPL-3.0-or-later", "Gpl3Plus GplHope GplSee GplCopy"),
    ("GPL-3.0-or-later", "Gpl3Plus GplHope GplSee"),
    ("GPL-2.0-or-later", "Gpl2Plus GplHope GplSee GplCopy"),
    ("GPL-2.0-or-later", "Gpl2Plus GplHope GplSee"),
    ("BSD-3-Clause", "Reserved BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "Reserved BsdGrant BsdSource BsdBinary"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary"),
    ("MIT", "MitRef"),
    ("MIT", "MitName"),
    ("Apache-2.0", "Apache2Ref"),
    ("Apache-2.0", "Apache2Name"),
    ("GPL-3.0-or-later", "Gpl3Plus"),
    ("GPL-2.0-or-later", "Gpl2Plus"),
    ("GPL-3.0-only", "Gpl3Ref"),
    ("GPL-2.0-only", "Gpl2Ref"),
    ("BSD-3-Clause", "Bsd3Ref"),
    ("BSD-2-Clause", "Bsd2Ref"),
    ("BSD", "BsdRef"),
    ("CC-BY-NC-4.0", "CcByNcRef"),
    ("CC-BY-SA-4.0", "CcBySaRef"),
    ("CC-BY-4.0", "CcByRef"),
    ("CC0-1.0", "Cc0Ref"),
    ("MPL-2.0", "Mpl2Ref"),
    ("all-rights-reserved", "Reserved"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Marks: | where a sentence or paragraph ends, ~ where a line does.
ENDS = ("[.!?]+[ \t\r\n]+|\n[ \t\r]*\n", "|")
REST = ("[^a-z0-9|~]+", " ")
MARKS = " ?([|~]) ?"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(text): name for name, texts in SENTENCES.items() for text in texts}


def _pattern() -> str:
    """Known sentences between marks, longest first; a line may end between any two words of one."""
    wrapped = ["(?: |~~)".join(x.split()) for x in sorted(KNOWN, key=lambda x: (-len(x), x))]
    return "[|~](?:" + "|".join(wrapped) + ")[|~]"


def _marked(text: Column) -> Column:
    """ASCII letters in lower case, all else between letters and digits one space; each mark twice, so that each neighbour has its own."""
    cut = F.replace(F.regexp_replace(F.translate(text, UPPER + "~", LOWER + " "), *ENDS), F.lit("\n"), F.lit("~"))
    return F.concat(F.lit("|"), F.regexp_replace(F.trim(F.regexp_replace(cut, *REST)), MARKS, "$1$1"), F.lit("|"))


def _identifiers(marked: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.transform(F.regexp_extract_all(marked, F.lit(_pattern()), F.lit(0)), lambda x: names[F.trim(F.regexp_replace(x, "[|~]+", " "))])


def _sequence(name: str) -> str:
    return "/" + "/".join(name.split()) + "/"


def licence_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, n_unmatched and status of each row of docs.

    n_sentences counts the sentences with a letter or digit, lines and sentence ends both ending one; sentence_ids has
    the known ones in order, joined by /; licences those that rules found, in the rules' order, joined by comma;
    n_unmatched the known sentences that no rule consumed; status is none, licensed, or partial where some are left.
    A known sentence is one or more whole lines or sentences in a row: where several start at a place, the longest
    counts.  Null and empty texts have no sentences.  Each row stands alone: repeated rows get the same result, texts may
    be of any length, no column but doc_id and text is read, there is no shuffle, and the tables of sentences and rules
    are fixed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", _marked(text).alias("marked"))
    named = marked.select("doc_id", F.size(F.filter(F.split("marked", "[|~]+"), lambda x: F.trim(x) != "")).cast("long").alias("n_sentences"), _identifiers(F.col("marked")).alias("ids"))
    ids = F.col("ids")
    # Each identifier stands between slashes of its own, and what a rule consumed becomes one mark.
    state = named.select("doc_id", "n_sentences", F.array_join(ids, "/").alias("sentence_ids"), F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("/"), x, F.lit("/")))).alias("rest"))
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(rule).replace("/", "//")[1:-1]).alias("rule")) for name, rule in RULES])
    consumed = F.aggregate(
        steps,
        F.struct(F.col("rest").alias("rest"), F.array().cast("array<string>").alias("found")),
        lambda acc, step: F.when(acc["rest"].contains(step["rule"]), F.struct(F.replace(acc["rest"], step["rule"], F.lit("|")).alias("rest"), F.concat(acc["found"], F.array(step["name"])).alias("found"))).otherwise(acc),
    )
    # Most documents have no known sentence; for them no rule is tried.
    result = state.withColumn("_c", F.when(F.col("rest") != "", consumed))
    left = F.coalesce((F.length(F.col("_c")["rest"]) - F.length(F.translate(F.col("_c")["rest"], "/", ""))) / 2, F.lit(0)).cast("long")
    return result.select(
        "doc_id", "n_sentences", "sentence_ids", F.coalesce(F.array_join(F.array_distinct(F.col("_c")["found"]), ","), F.lit("")).alias("licences"), left.alias("n_unmatched"),
        F.when(F.col("rest") == "", "none").when(left > 0, "partial").otherwise("licensed").alias("status"),
    )


def duckdb_sql(table: str = "documents") -> str:
    """The same in DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    escape = lambda x: "E" + quote(x.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r"))
    cut = f"replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}~', '{LOWER} '), {escape(ENDS[0])}, '|', 'g'), E'\\n', '~')"
    marked = f"'|' || regexp_replace(trim(regexp_replace({cut}, '{REST[0]}', ' ', 'g'), ' '), '{MARKS}', '\\1\\1', 'g') || '|'"
    ids = f"list_transform(regexp_extract_all(marked, '{_pattern()}'), lambda x: ({known})[trim(regexp_replace(x, '[|~]+', ' ', 'g'), ' ')])"
    sql = f"""WITH cut AS (SELECT doc_id, {marked} AS marked FROM {table}),
s0 AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(marked, '[|~]+'), lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences, {ids} AS ids FROM cut),
r0 AS (SELECT doc_id, n_sentences, ids, coalesce(list_aggregate(list_transform(ids, lambda x: '/' || x || '/'), 'string_agg', ''), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM s0)"""
    for i, (name, rule) in enumerate(RULES):
        sequence = _sequence(rule).replace("/", "//")[1:-1]
        sql += f",\nr{i + 1} AS (SELECT doc_id, n_sentences, ids, replace(rest, '{sequence}', '|') AS rest, CASE WHEN contains(rest, '{sequence}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{i})"
    last = f"r{len(RULES)}"
    return sql + f"""
SELECT doc_id, n_sentences, coalesce(array_to_string(ids, '/'), '') AS sentence_ids,
 coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licences,
 CAST((length(rest) - length(replace(rest, '/', ''))) // 2 AS BIGINT) AS n_unmatched,
 CASE WHEN len(ids) = 0 THEN 'none' WHEN contains(rest, '/') THEN 'partial' ELSE 'licensed' END AS status FROM {last}"""
