"""Licence scans by sentence-rule recognition. DataFrame functions only.

A text is cut into sentences, twice: with every line break as an end, for licence lines that stand alone, and
with single line breaks as spaces, for sentences that wrap; a blank line ends a sentence. Normalised sentences are looked up in a table of known
licence sentences; the sequence of their identifiers, in order and without the unknown sentences between them,
is matched against ordered rules. A rule that matches takes its identifiers out of the sequence, so that the
rules after it (shorter licences that share sentences) don't see them.

Everything happens within a row: there is no shuffle, and no key that rows could pile up on.

Defined results: null and empty text have no licences; a repeated row is scanned again; a licence found
several times in a text is named once; a tag "SPDX-License-Identifier:" counts where one identifier of the table
follows, with "+" as "or later", and gives nothing where an expression of several follows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SPACE = r"[\x20\x09-\x0D]+"
ENDS = rf"[.!?;:]+{SPACE}"
BLANK = r"\n[\x20\x09\x0D]*\n"
#: Known licence sentences, lower case, with single spaces for all but letters and digits.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "mit license", "the mit license", "the mit license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "apache-2-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache-2-title": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "apache-2-comply": ["you may not use this file except in compliance with the license"],
    "gpl-2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    # the notices have a semicolon or colon after "free software", and version 2's another before "either"
    "gpl-program": ["this program is free software"],
    "gpl-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-2-later": ["either version 2 of the license or at your option any later version"],
    "gpl-3-later": ["either version 3 of the license or at your option any later version"],
    "gpl-2-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "gpl-3-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl-2-title": ["gnu general public license version 2 june 1991"],
    "gpl-3-title": ["gnu general public license version 3 29 june 2007"],
    "lgpl-library": ["this library is free software"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl-2.1-later": ["either version 2 1 of the license or at your option any later version"],
    "lgpl-2.1-terms": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"
    ],
    "lgpl-3-terms": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "lgpl-2.1-title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl-3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl-terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "agpl-3-terms": [
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "agpl-3-title": ["gnu affero general public license version 3 19 november 2007"],
    # the notice's "v. 2.0." is cut at its points
    "mpl-form": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl-2-copy": [
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ],
    "mpl-2-title": ["mozilla public license version 2 0"],
    "epl-1-notice": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"
    ],
    "epl-2-notice": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    ],
    "epl-2-title": ["eclipse public license v 2 0"],
    "cc0-title": ["cc0 1 0 universal", "creative commons cc0 1 0 universal"],
    "cc0-waiver": ["to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd-names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "cc-by-3-notice": ["licensed under cc by 3 0"],
    "cc-by-4-notice": ["licensed under cc by 4 0"],
    "cc-by-sa-3-notice": ["licensed under cc by sa 3 0"],
    "cc-by-sa-4-notice": ["licensed under cc by sa 4 0"],
    "cc-by-nc-3-notice": ["licensed under cc by nc 3 0"],
    "cc-by-nc-4-notice": ["licensed under cc by nc 4 0"],
}
#: Identifiers that may stand after a tag "SPDX-License-Identifier:".
TAGS = (
    "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-1.0 EPL-2.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 Unlicense"
).split()
SENTENCES |= {"spdx": ["spdx license identifier"]} | {f"tag-{t}": [re.sub("[^a-z0-9]+", " ", t.lower())] for t in TAGS}
#: Ordered rules, each a licence and a sequence of sentence identifiers.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-comply"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("GPL-2.0", ["gpl-2-notice"]),
    ("GPL-3.0", ["gpl-3-notice"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-terms", "gpl-2-later"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-2-terms"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-terms", "gpl-3-later"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-3-terms"]),
    ("GPL-2.0", ["gpl-2-title"]),
    ("GPL-3.0", ["gpl-3-title"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "lgpl-2.1-later"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-terms"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "gpl-3-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-terms"]),
    ("LGPL-2.1", ["lgpl-2.1-title"]),
    ("LGPL-3.0", ["lgpl-3-title"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "gpl-3-later"]),
    ("AGPL-3.0-or-later", ["agpl-3-terms"]),
    ("AGPL-3.0", ["agpl-3-title"]),
    ("MPL-2.0", ["mpl-form", "mpl-2-copy"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("EPL-1.0", ["epl-1-notice"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-3.0", ["cc-by-3-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-3.0", ["cc-by-sa-3-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-NC-3.0", ["cc-by-nc-3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    *[(t, ["spdx", f"tag-{t}"]) for t in TAGS],
]
KNOWN = {s: name for name, sentences in SENTENCES.items() for s in sentences}


def identifiers(text: Column, wrapped: bool) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    cut = F.split(lower_ascii(text), rf"{ENDS}|{BLANK}" if wrapped else rf"{ENDS}|\n")
    named = F.transform(cut, lambda s: known[F.btrim(F.regexp_replace(F.replace(s, F.lit("0+"), F.lit("0 or later")), "[^a-z0-9]+", " "))])
    return F.filter(named, lambda x: x.isNotNull())


def matched(ids: Column) -> Column:
    """The licences whose rules match a sequence of identifiers, in the order of the rules."""
    sequence = F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in rule)).alias("rule")) for name, rule in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        there = F.contains(state["rest"], rule["rule"])
        names = F.when(there, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(F.replace(state["rest"], rule["rule"], F.lit("|")).alias("rest"), names.alias("names"))

    return F.aggregate(rules, start, apply)["names"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_known, n_licences, licences) for every row: known sentences, licences, their comma-joined names in ascending order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), identifiers(text, False).alias("lines"), identifiers(text, True).alias("flowing"))
    found = cut.select("doc_id", F.greatest(F.size("lines"), F.size("flowing")).cast("long").alias("n_known"), "lines", "flowing")
    none = F.array().cast("array<string>")
    names = F.when(F.col("n_known") > 0, F.array_sort(F.array_union(matched(F.col("lines")), matched(F.col("flowing"))))).otherwise(none)
    found = found.select("doc_id", "n_known", names.alias("names"))
    return found.select("doc_id", "n_known", F.size("names").cast("long").alias("n_licences"), F.array_join("names", ",").alias("licences"))


def oracle() -> str:
    """scan() over documents, as DuckDB SQL."""
    known = ", ".join(f"'{s}': '{name}'" for s, name in KNOWN.items())
    space = r"[\x20\x09-\x0D]+"

    def ids(regex: str) -> str:
        cut = f"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{regex}')"
        named = f"list_transform({cut}, lambda s: (MAP {{{known}}})[trim(regexp_replace(replace(s, '0+', '0 or later'), '[^a-z0-9]+', ' ', 'g'))])"
        return f"list_filter({named}, lambda x: x IS NOT NULL)"

    blank = r"\x0A[\x20\x09\x0D]*\x0A"
    steps = [f"t0 AS (SELECT doc_id, {ids(f'[.!?;:]+{space}|[\\x0A]')} AS lines, {ids(f'[.!?;:]+{space}|{blank}')} AS flowing FROM documents)"]
    wrap = lambda c: f"array_to_string(list_transform({c}, lambda i: '<' || i || '>'), '')"
    steps.append(f"r0 AS (SELECT doc_id, greatest(len(lines), len(flowing)) AS n_known, {wrap('lines')} AS a, {wrap('flowing')} AS b, CAST([] AS VARCHAR[]) AS names FROM t0)")
    for i, (name, rule) in enumerate(RULES):
        key = "".join(f"<{x}>" for x in rule)
        there = f"contains(a, '{key}') OR contains(b, '{key}')"
        steps.append(f"r{i + 1} AS (SELECT doc_id, n_known, replace(a, '{key}', '|') AS a, replace(b, '{key}', '|') AS b, CASE WHEN {there} THEN list_append(names, '{name}') ELSE names END AS names FROM r{i})")
    steps.append(f"n AS (SELECT doc_id, CAST(n_known AS BIGINT) AS n_known, list_sort(list_distinct(names)) AS names FROM r{len(RULES)})")
    return "WITH " + ", ".join(steps) + " SELECT doc_id, n_known, CAST(len(names) AS BIGINT) AS n_licences, array_to_string(names, ',') AS licences FROM n"
