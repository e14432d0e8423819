"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, each is normalised (lower-case letters and digits, single
spaces), known licence sentences become their identifiers, and the sequence of identifiers
is matched against ordered rules: a rule's identifiers must follow each other, and what an
earlier rule has matched is no longer there for later ones. The whole text is read, within
its own row; there is no shuffle.

Known sentences begin and end at a sentence's or a line's end. Single line breaks, semicolons
and colons may also stand inside them, as in texts wrapped at any width or set in comment
signs; full stops before white space and blank lines may not. Of two that begin at one place
the longer counts.

The tables hold grants, conditions and warranties of common licences, the headings of their
texts, notices that name one in a sentence (every opening before every name), and SPDX lines.

Defined results: null or blank text has no sentences. A licence matched several times is
named once; names come in the order of the rules. Known sentences that no rule takes remain
in `rest`. Repeated rows give repeated rows; an empty table gives none. Other columns pass
through, whatever their names; the added names replace columns that are called the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences of well-known licence texts and notices, normalised.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-name-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-text": "apache license version 2 0 january 2004",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl3-text": "gnu general public license version 3 29 june 2007",
    "gpl2-text": "gnu general public license version 2 june 1991",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl-copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "lgpl3-text": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-text": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "agpl3-text": "gnu affero general public license version 3 19 november 2007",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-liability-2": "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-text": "boost software license version 1 0 august 17th 2003",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl2-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-made": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2-text": "eclipse public license v 2 0",
    "mpl2-text": "mozilla public license version 2 0",
    "mpl2-cut": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-name": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "all rights reserved",
}

#: Licences and the names that notices give them, normalised.
NAMES = {
    "MIT": ("mit license",),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2"),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0"),
    "EPL-2.0": ("eclipse public license 2 0",),
    "BSL-1.0": ("boost software license version 1 0",),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "CC-BY-4.0": ("creative commons attribution 4 0 international license",),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license",),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license",),
}
OPENINGS = ("released under", "licensed under", "distributed under", "this project is licensed under", "this software is licensed under", "this work is licensed under")
#: Identifiers of SPDX lines.
SPDX = (*NAMES, *(f"{x}-{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("only", "or-later")), "CC0-1.0", "0BSD")


def _named() -> dict[str, tuple[str, str]]:
    """Sentences that name a licence: identifier to licence and sentence."""
    article = lambda name: "a" if name.startswith("creative") else "the"
    notices = {f"{licence.lower()}-name-{k}-{j}": (licence, f"{opening} {article(name)} {name}") for licence, names in NAMES.items() for j, name in enumerate(names) for k, opening in enumerate(OPENINGS)}
    return notices | {f"spdx-{x.lower()}": (x, "spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower())) for x in SPDX}


NAMED = _named()
SENTENCES |= {i: sentence for i, (_, sentence) in NAMED.items()}

#: Rules in order: a licence and the identifiers that must follow each other.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-name-2", "apache-use", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-name-2", "apache-use", "apache-copy", "apache-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see", "agpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability-2")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability-2")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("BSL-1.0", ("boost-text", "boost-grant")),
    ("MPL-2.0", ("mpl2-cut", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-cut", "mpl2-copy-2")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free-2",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("GPL-3.0", ("gpl3-text",)),
    ("GPL-2.0", ("gpl2-text",)),
    ("LGPL-3.0", ("lgpl3-text",)),
    ("LGPL-2.1", ("lgpl21-text",)),
    ("AGPL-3.0", ("agpl3-text",)),
    ("Apache-2.0", ("apache-text",)),
    ("Apache-2.0", ("apache-name-2",)),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl2-made",)),
    ("EPL-2.0", ("epl2-text",)),
    ("EPL-1.0", ("epl1-made",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("MPL-2.0", ("mpl2-cut",)),
    ("MPL-2.0", ("mpl2-text",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    *((licence, (i,)) for i, (licence, _) in NAMED.items()),
    ("MIT", ("mit-grant",)),
    ("proprietary", ("reserved",)),
)
LICENCES = tuple(dict.fromkeys(name for name, _ in RULES))
#: White space after a full stop is a blank line, after a semicolon or colon a line break.
STOP = r"[.!?][\x20\x09-\x0D]+"
PAUSE = r"[;:](?:[\x20\x09]*(?:\r\n?|\n)|[\x20\x09\x0B\x0C]+)"
#: A known sentence from one break (a bar is a blank line) to another.
KNOWN = r"(?<![^\n|])(?:%s)(?![^\n|])" % "|".join(s.replace(" ", r"[ \n]") for s in sorted(SENTENCES.values(), key=len, reverse=True))
ADDED = ("licences", "sentence_ids", "rest")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order, each between semicolons."""
    broken = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), STOP, "\n\n"), PAUSE, "\n")
    normal = F.trim(F.lower(F.regexp_replace(broken, r"[^A-Za-z0-9\n\r]+", " ")))
    normal = F.regexp_replace(F.regexp_replace(normal, r" *(?:\r\n?|\n) *", "\n"), r"\n{2,}", "|")
    found = F.regexp_extract_all(normal, F.lit(KNOWN), F.lit(0))
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    return F.concat(F.lit(";"), F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit(";"))), ""))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with licences (joined by a bar), sentence_ids and rest; such columns are replaced."""
    out = docs.drop(*ADDED).withColumn("sentence_ids", sentence_ids(F.col(text_col)))
    # Each step is a column of its own, so that what is left is not computed over and over.
    out = out.withColumn("rest", F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("found")))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["ids"], F.lit(";"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(f";{';'.join(ids)};").alias("ids")) for name, ids in RULES))
    state = F.when(F.col("sentence_ids") == ";", F.col("rest")).otherwise(F.aggregate(rules, F.col("rest"), step))
    out = out.withColumn("rest", state)
    return out.withColumn("licences", F.array_join(F.array_distinct("rest.found"), "|")).withColumn("rest", F.col("rest.left")).select(*[c for c in docs.columns if c not in ADDED], *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", *ADDED)


def _sql() -> str:
    """The same in one expression after another. Its patterns can't look beyond a match, so
    breaks are doubled, and a match takes one break before and one after the sentence."""
    case = " ".join(f"WHEN '{s}' THEN '{i}'" for i, s in SENTENCES.items())
    broken = f"regexp_replace(regexp_replace(coalesce(text, ''), '{STOP}', chr(10) || chr(10), 'g'), '{PAUSE}', chr(10), 'g')"
    normal = rf"trim(lower(regexp_replace({broken}, '[^A-Za-z0-9\n\r]+', ' ', 'g')))"
    normal = rf"regexp_replace(regexp_replace({normal}, ' *(?:\r\n?|\n) *', chr(10), 'g'), '\n{{2,}}', '|', 'g')"
    doubled = f"replace(replace({normal}, '|', '||'), chr(10), chr(10) || chr(10))"
    known = "|".join(s.replace(" ", r"(?: |\n\n)") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    found = rf"regexp_extract_all({doubled}, '(?:^|[\n|])({known})(?:[\n|]|$)', 1)"
    ids = f"list_transform({found}, lambda s: CASE replace(s, chr(10) || chr(10), ' ') {case} END)"
    # A rule's turn is a step of one fold over the list of rules.
    rules = ", ".join(f"{{'name': '{name}', 'ids': ';{';'.join(rule)};'}}" for name, rule in RULES)
    step = "CASE WHEN contains(s.rest, r.ids) THEN {'name': '', 'ids': '', 'rest': replace(s.rest, r.ids, ';'), 'found': CASE WHEN list_contains(s.found, r.name) THEN s.found ELSE list_append(s.found, r.name) END} ELSE s END"
    start = "{'name': '', 'ids': '', 'rest': sentence_ids, 'found': []::VARCHAR[]}"
    each = f"list_transform([{rules}], lambda r: {{'name': r.name, 'ids': r.ids, 'rest': '', 'found': []::VARCHAR[]}})"
    fold = f"list_reduce(list_concat([{start}], {each}), lambda s, r: {step})"
    return (
        f"WITH d AS (SELECT doc_id, {ids} AS ids FROM documents), "
        "e AS (SELECT doc_id, ';' || array_to_string(list_transform(ids, lambda i: i || ';'), '') AS sentence_ids FROM d), "
        f"f AS (SELECT doc_id, sentence_ids, CASE WHEN sentence_ids = ';' THEN {start} ELSE {fold} END AS s FROM e) "
        "SELECT doc_id, array_to_string(s.found, '|') AS licences, sentence_ids, s.rest AS rest FROM f"
    )


SQL = _sql()
