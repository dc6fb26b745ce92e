"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut in sentences, each is normalised, and those that are known become identifiers. The identifiers of a
document, in order, are then matched against licence rules, ordered from the most to the least specific: a rule is a
sequence of identifiers that must follow each other with no other known sentence between. What a rule matches is
taken; later rules see the rest. Everything is one narrow pass; the tables of sentences and rules are constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Sentences of published licences and of usual notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-free-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-short": "This work is licensed under the GNU General Public License, version 2.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "rights": "All rights reserved.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-short": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-rights": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "lgpl-free-2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "lgpl-free-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-free-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this program.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "eupl-use": "You may not use this work except in compliance with the Licence.",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-project-see": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "mit-project-terms": "This project is licensed under the terms of the MIT license.",
    "mit-distributed": "Distributed under the MIT License.",
    "apache-project": "This project is licensed under the Apache License 2.0.",
    "apache-released": "Released under the Apache License 2.0.",
    "bsd-3-short": "Licensed under the BSD 3-Clause License.",
    "bsd-2-short": "Licensed under the BSD 2-Clause License.",
    "isc-short": "Licensed under the ISC License.",
    "mpl-short": "Licensed under the Mozilla Public License 2.0.",
    "gpl-3-released": "Released under the GNU General Public License v3.0.",
    "lgpl-3-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc0-short": "Licensed under CC0 1.0.",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}
#: Further identifiers of the SPDX list; a tag with one is a sentence and its rule.
SPDX_IDS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0",
    "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0",
    "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "X11", "Zlib",
)
SENTENCES |= {f"spdx:{i}": f"SPDX-License-Identifier: {i}" for i in SPDX_IDS}
#: The rules in the order in which they are tried, each with the sentences that must follow each other.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liable")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is", "mit-liable")),
    ("AGPL-3.0-or-later", ("agpl-free-3", "gpl-hope", "agpl-see", "agpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl-free-3", "gpl-hope", "lgpl-see", "lgpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free-3", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-see", "gpl-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-copy", "apache-as-is", "apache-see")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    ("GPL-3.0-or-later", ("gpl-free-3", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free-3", "gpl-hope", "agpl-see")),
    ("LGPL-3.0-or-later", ("lgpl-free-3", "gpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-free-2", "lgpl-hope", "lgpl-see")),
    ("CC0-1.0", ("cc0-rights", "cc0-warranty")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0-rights",)),
    ("AGPL-3.0-or-later", ("agpl-free-3",)),
    ("LGPL-3.0-or-later", ("lgpl-free-3",)),
    ("LGPL-2.1-or-later", ("lgpl-free-2",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-short",)),
    ("EUPL-1.2", ("eupl-use",)),
    ("EPL-2.0", ("epl-terms",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free-3",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("GPL-2.0-only", ("gpl-2-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-project-see",)),
    ("MIT", ("mit-project-terms",)),
    ("MIT", ("mit-distributed",)),
    ("Apache-2.0", ("apache-project",)),
    ("Apache-2.0", ("apache-released",)),
    ("BSD-3-Clause", ("bsd-3-short",)),
    ("BSD-2-Clause", ("bsd-2-short",)),
    ("ISC", ("isc-short",)),
    ("MPL-2.0", ("mpl-short",)),
    ("GPL-3.0-only", ("gpl-3-released",)),
    ("LGPL-3.0-only", ("lgpl-3-short",)),
    ("AGPL-3.0-only", ("agpl-3-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-short",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-work",)),
    *((i, (f"spdx:{i}",)) for i in SPDX_IDS),
    ("Proprietary", ("rights",)),
)
#: Every known sentence has one of these, so texts without any need no look-up.
CUE = r"licen|permi|warrant|redistrib|rights[^a-z0-9]+reserved|copyright|public[^a-z0-9]+domain"
#: A sentence ends before white space that follows a full stop or the like, and at an empty line.
STOPS = r"(?<=[.!?])(?:[ \t\r]+|(?=\n))"
#: An address may stand in a paragraph of its own within a sentence.
ADDRESS = r"(?<=[ \t]at)[ \t\r]*\n[ \t\r*#/;%-]*\n[ \t\r*#/;%-]*(?=https?://)"
#: What a line feed stands before where no sentence can begin; there it is white space. Other single line
#: feeds may end a sentence or not.
GOES_ON = "[a-z]|WITHOUT |EXPRESS |IMPLIED|INCLUDING |FITNESS |MERCHANTABILITY|NONINFRINGEMENT|WARRANT|OR "
#: A tag ends its sentence wherever it stands.
SPDX = r"(SPDX-License-Identifier:[ \t]*[A-Za-z0-9.+-]+)"
WRAP = rf"\n[ \t*#/]*(?={GOES_ON})"


def normalised_text(s: str) -> str:
    """The normal form of a sentence: lower-case ASCII letters and digits, other runs one space."""
    import re

    return re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")


def known() -> dict[str, str]:
    """Identifiers by normal form."""
    return {normalised_text(s): k for k, s in SENTENCES.items()}


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences in order.

    A known sentence begins and ends where a line, a sentence or a paragraph does, and may run over single line feeds.
    """
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    # longer ones first, so that a sentence over two lines comes before one that its first line is
    sentences = "|".join(s.replace(" ", "[ \\n]") for s in sorted(known(), key=len, reverse=True))
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPDX, "$1.\n"), ADDRESS, " "), WRAP, " ")
    marked = F.regexp_replace(joined, STOPS, "\n\n")
    lines = F.regexp_replace(F.regexp_replace(F.lower(F.concat(F.lit("\n"), marked, F.lit("\n"))), r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n")
    found = F.regexp_extract_all(lines, F.lit(rf"(?<=\n)({sentences})(?=\n)"), F.lit(1))
    ids = F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    return F.when(text.rlike(f"(?i){CUE}"), ids).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """The sequence of identifiers with each rule's matches replaced by its licence in braces, in order of the rules."""
    out = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda k: F.concat(F.lit("<"), k, F.lit(">"))), ""))
    for licence, sequence in RULES:
        out = F.replace(out, F.lit("".join(f"<{k}>" for k in sequence)), F.lit("{" + licence + "}"))
    return out


def license_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses and n_unmatched of all documents.

    licenses: those that rules found, each once, in order of their first place, comma-joined. Null and empty texts have
    none; repeated rows have a row each; an empty table gives no rows; further columns are ignored.
    """
    with_ids = documents.select(documents["doc_id"], let(identifiers(documents["text"]), lambda ids: F.struct(ids.alias("ids"), matched(ids).alias("found"))).alias("x"))
    found = F.col("x.found")
    return with_ids.select(
        "doc_id", F.size("x.ids").cast("long").alias("n_sentences"), F.array_join("x.ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.regexp_extract_all(found, F.lit(r"\{([^}]*)\}"), F.lit(1))), ",").alias("licenses"),
        (F.size(F.split(found, "<")) - 1).cast("long").alias("n_unmatched"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    found = "array_to_string(list_transform(ids, lambda k: '<' || k || '>'), '')"
    for licence, sequence in RULES:
        found = f"replace({found}, '{''.join(f'<{k}>' for k in sequence)}', '{{{licence}}}')"
    names = ", ".join(f"'{s}': '{k}'" for s, k in known().items())
    sentences = "|".join(s.replace(" ", r"(?: |\n\n)") for s in sorted(known(), key=len, reverse=True))
    # RE2 looks neither back nor ahead: what stands around is captured, and line feeds are doubled, one for either side
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN regexp_matches(text, '(?i){CUE}') THEN text ELSE '' END AS t FROM documents
), j AS (
  SELECT r, doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{SPDX}', '\1.' || chr(10), 'g'),
    '([ \t]at)[ \t\r]*\n[ \t\r*#/;%-]*\n[ \t\r*#/;%-]*(https?://)', '\1 \2', 'g'), '\n[ \t*#/]*({GOES_ON})', ' \1', 'g') AS t FROM t
), m AS (
  SELECT r, doc_id, regexp_replace(regexp_replace(t, '([.!?])[ \t\r]+', '\1' || chr(10) || chr(10), 'g'), '([.!?])\n', '\1' || chr(10) || chr(10), 'g') AS t FROM j
), n AS (
  SELECT r, doc_id, regexp_replace(regexp_replace(lower(chr(10) || t || chr(10)), '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?', chr(10) || chr(10), 'g') AS t FROM m
), k AS (
  SELECT r, doc_id, list_transform(regexp_extract_all(t, '\n({sentences})\n', 1), lambda x: element_at(MAP {{{names}}}, replace(x, chr(10) || chr(10), ' '))[1]) AS ids FROM n
), f AS (
  SELECT *, {found} AS found FROM k
), l AS (
  SELECT *, regexp_extract_all(found, '\{{([^}}]*)\}}', 1) AS names FROM f
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses,
  CAST(length(found) - length(replace(found, '<', '')) AS BIGINT) AS n_unmatched
FROM l
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE_SQL = {"op3_license_scan": _oracle()}
