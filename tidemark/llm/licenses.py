"""Licence scans by sentence-rule recognition, on SQL functions only.

A text is cut into sentences, the sentences are normalised and mapped to identifiers of known licence
sentences, and the sequence of identifiers is matched against ordered rules; a rule that matches takes
its sentences out of the sequence, so more specific rules stand first.

Sentences end at a stop with white space behind it, or at an empty line; marks of comments at the start
of lines don't count.  Lines may be wrapped or not: what isn't a known sentence as a whole is cut at its
line breaks.  A known sentence has no such end inside; wordings that do are several sentences of a rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import replacing, table

#: Identifier -> known sentence, before normalisation.  Fixed wordings of public licences.
SENTENCES = {
    "MIT_GRANT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT_NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MIT_WARRANTY": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "MIT_SHORT": "Released under the MIT License",
    "MIT_UNDER": "Licensed under the MIT License",
    "ISC_GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "APACHE_GRANT": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "APACHE_COMPLY": "you may not use this file except in compliance with the License",
    "APACHE_COPY": "You may obtain a copy of the License at",
    "APACHE_URL": "http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE_URL_SAFE": "https://www.apache.org/licenses/LICENSE-2.0",
    "APACHE_BASIS": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "APACHE_FLAT": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "APACHE_SEE": "See the License for the specific language governing permissions and limitations under the License",
    "APACHE_SHORT": "Licensed under the Apache License, Version 2.0",
    "GPL_FREE": "This program is free software",
    "GPL_TERMS": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL_ONLY_2": "version 2 of the License",
    "GPL_ONLY_3": "version 3 of the License",
    "GPL_LATER_2": "either version 2 of the License, or (at your option) any later version",
    "GPL_LATER_3": "either version 3 of the License, or (at your option) any later version",
    "GPL_TERMS_LATER_2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "GPL_TERMS_LATER_3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL_TERMS_ONLY_2": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "GPL_SHORT_3": "This work is licensed under the GNU General Public License, version 3",
    "GPL_SHORT_2": "This work is licensed under the GNU General Public License, version 2",
    "LGPL_FREE": "This library is free software",
    "LGPL_TERMS": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL_LATER_2_1": "either version 2.1 of the License, or (at your option) any later version",
    "LGPL_TERMS_LATER_3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL_SHORT_3": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL_TERMS": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL_TERMS_LATER_3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "BSD_GRANT": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD_SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD_BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSD_NAMES": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "MPL_TERMS": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC_BY": "Licensed under CC BY 4.0",
    "CC_BY_SA": "Licensed under CC BY-SA 4.0",
    "CC_BY_NC": "Licensed under CC BY-NC 4.0",
    "CC_BY_LONG": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC_BY_NC_LONG": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0": "This work is dedicated to the public domain under the CC0 1.0 Universal license",
}
#: Licence and the sentences that state it, in order; earlier rules go first.
RULES = [
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("MIT", ("MIT_GRANT",)),
    ("ISC", ("ISC_GRANT",)),
    ("Apache-2.0", ("APACHE_GRANT", "APACHE_COMPLY", "APACHE_COPY", "APACHE_URL", "APACHE_BASIS", "APACHE_SEE")),
    ("Apache-2.0", ("APACHE_GRANT", "APACHE_COMPLY", "APACHE_COPY", "APACHE_URL_SAFE", "APACHE_BASIS", "APACHE_SEE")),
    ("Apache-2.0", ("APACHE_GRANT", "APACHE_COMPLY", "APACHE_FLAT", "APACHE_SEE")),
    ("Apache-2.0", ("APACHE_GRANT", "APACHE_COMPLY")),
    ("Apache-2.0", ("APACHE_GRANT",)),
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL_TERMS_LATER_3")),
    ("GPL-2.0-or-later", ("GPL_FREE", "GPL_TERMS_LATER_2")),
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL_TERMS", "GPL_LATER_3")),
    ("GPL-2.0-or-later", ("GPL_FREE", "GPL_TERMS", "GPL_LATER_2")),
    ("GPL-3.0-only", ("GPL_FREE", "GPL_TERMS", "GPL_ONLY_3")),
    ("GPL-2.0-only", ("GPL_FREE", "GPL_TERMS", "GPL_ONLY_2")),
    ("GPL-2.0-only", ("GPL_FREE", "GPL_TERMS_ONLY_2")),
    ("LGPL-2.1-or-later", ("LGPL_FREE", "LGPL_TERMS", "LGPL_LATER_2_1")),
    ("LGPL-3.0-or-later", ("GPL_FREE", "LGPL_TERMS_LATER_3")),
    ("LGPL-3.0-or-later", ("LGPL_FREE", "LGPL_TERMS_LATER_3")),
    ("LGPL-3.0-or-later", ("LGPL_FREE", "LGPL_TERMS", "GPL_LATER_3")),
    ("AGPL-3.0-or-later", ("GPL_FREE", "AGPL_TERMS_LATER_3")),
    ("AGPL-3.0-or-later", ("GPL_FREE", "AGPL_TERMS", "GPL_LATER_3")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("MPL-2.0", ("MPL_TERMS",)),
    ("MIT", ("MIT_SHORT",)),
    ("MIT", ("MIT_UNDER",)),
    ("Apache-2.0", ("APACHE_SHORT",)),
    ("GPL-3.0-only", ("GPL_SHORT_3",)),
    ("GPL-2.0-only", ("GPL_SHORT_2",)),
    ("LGPL-3.0-only", ("LGPL_SHORT_3",)),
    ("CC-BY-4.0", ("CC_BY",)),
    ("CC-BY-4.0", ("CC_BY_LONG",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_LONG",)),
    ("CC0-1.0", ("CC0",)),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP = r"[.;:!?]+(?:[ \t\n\r]+|$)"
LINES, PARAGRAPHS = r"[\n\r]+", rf"{STOP}|\n[ \t\r]*\n"
#: Marks of comments at the start of a line, and a stop that belongs to a version ("v. 2.0").
MARKS, VERSION = r"(^|\n)[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+)[ \t]*", r"([ ,][vV])\.[ \t\n\r]+([0-9])"


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence -> identifier.  Sentences must be distinct, and have no end inside."""
    out: dict[str, str] = {}
    for name, sentence in sentences.items():
        if (norm := _normal(sentence)) in out or not norm:
            raise ValueError(f"{name}: its sentence is empty or known already")
        if re.search(PARAGRAPHS, re.sub(VERSION, r"\1.\2", sentence).rstrip(".;:!?")):
            raise ValueError(f"{name}: more than one sentence")
        out[norm] = name
    return out


def _sequence(text: Column, known: dict[str, str]) -> Column:
    lookup = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    firsts = sorted({norm.split(" ")[0] for norm in known})
    normal = lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " "))
    # what doesn't begin as a known sentence needs no normalising
    begins = lambda s: F.translate(F.regexp_extract(s, "[A-Za-z0-9]+", 0), UPPER, LOWER).isin(firsts)
    name = lambda s: F.when(begins(s), lookup[normal(s)])
    names = lambda pieces: F.filter(F.transform(pieces, name), lambda x: x.isNotNull())
    plain = F.regexp_replace(F.regexp_replace(text, MARKS, "$1"), VERSION, "$1.$2")
    read = lambda p: F.coalesce(F.transform(F.array(name(p)), lambda x: F.when(x.isNotNull(), F.array(x)))[0], F.when(p.rlike(LINES), names(F.split(p, LINES))), F.array().cast("array<string>"))
    return F.flatten(F.transform(F.split(plain, PARAGRAPHS), read))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """All columns of ``docs``, and sentence_ids array<string>, licences array<string>.

    sentence_ids: known sentences in the order of the text, repeats included.  licences: sorted, each
    once.  Null, empty and unlicensed texts have empty arrays.  Rows are never joined or moved, so
    repeated rows, ties and null ids need no care, and an empty table gives an empty table; a text is
    read whole, however long.  Columns of the input named sentence_ids or licences give way to the result.
    """
    known = _known(sentences or SENTENCES)
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast("array<string>")
    found = replacing(docs, "sentence_ids", "licences").withColumn("sentence_ids", _sequence(text, known))
    ordered = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("<" + "><".join(ids) + ">").alias("ids")) for name, ids in rules or RULES))
    start = F.struct(F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">")).alias("left"), nothing.alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"), F.array_append(state["hits"], rule["name"]).alias("hits"))
        return F.when(F.contains(state["left"], rule["ids"]), taken).otherwise(state)

    hits = F.aggregate(ordered, start, step, lambda state: F.array_sort(F.array_distinct(state["hits"])))
    return found.withColumn("licences", F.when(F.size("sentence_ids") == 0, nothing).otherwise(hits))


def op5(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    """The same law in DuckDB's functions, from the sentences and rules as they stand above."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    normal = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(f"({quote(name)}, {quote(sentence)})" for name, sentence in SENTENCES.items())
    stop = r"[.;:!?]+(?:[ \t\n\r]+|$)|\n[ \t\r]*\n"
    steps, hits, last = [], [], "s0"
    for k, (name, ids) in enumerate(RULES):
        pattern = quote("<" + "><".join(ids) + ">")
        steps.append(f"s{k + 1} AS (SELECT *, replace(l{k}, {pattern}, '|') AS l{k + 1}, contains(l{k}, {pattern}) AS h{k} FROM {last})")
        hits.append(f"CASE WHEN h{k} THEN {quote(name)} END")
        last = f"s{k + 1}"
    return rf"""
WITH m AS (SELECT map(list({normal("sentence")}), list(id)) AS m FROM (VALUES {known}) AS k(id, sentence)),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|\n)[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+)[ \t]*', '\1', 'g'),
                                        '([ ,][vV])\.[ \t\n\r]+([0-9])', '\1.\2', 'g') AS text FROM documents),
c AS (SELECT doc_id, flatten(list_transform(regexp_split_to_array(text, '{stop}'), lambda p:
        CASE WHEN m[{normal("p")}] IS NOT NULL THEN [m[{normal("p")}]]
             ELSE list_filter(list_transform(regexp_split_to_array(p, '[\n\r]+'), lambda l: m[{normal("l")}]), lambda x: x IS NOT NULL) END)) AS ids
      FROM plain, m),
s0 AS (SELECT doc_id, coalesce(ids, []) AS ids, '<' || coalesce(array_to_string(ids, '><'), '') || '>' AS l0 FROM c),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM {last}
"""


OP5_SQL = _sql()
