"""The GPL rules on their verbatim, hard-wrapped notices."""

from tiersift.llm import licences

GPL = """    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY."""


def test_gpl_notices(spark):
    texts = ["Copyright 2020 Foo.\n" + GPL.format(*x) for x in ((";", ";", 2), (":", ",", 3), (";", ",", 2), (";", ";", 3))]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [r.licences for r in sorted(got)] == ["GPL-2.0-or-later", "GPL-3.0-or-later"] * 2


def test_wrapped_grants_after_copyright_lines(spark):
    mit = """Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    isc = """Copyright (c) 2020, Foo

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
    texts = [mit, "MIT License\n \n" + mit, isc, isc.replace("\n", "\r\n")]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [r.licences for r in sorted(got)] == ["MIT", "MIT", "ISC", "ISC"]


def test_other_notices(spark):
    lesser = GPL.replace("program is free", "library is free").replace("GNU General", "GNU Lesser General")
    affero = GPL.replace("GNU General", "GNU Affero General")
    mpl = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
    epl = """/* This program and the accompanying materials are made
 * available under the terms of the Eclipse Public License 2.0
 * which is available at https://www.eclipse.org/legal/epl-2.0/

 * SPDX-License-Identifier: EPL-2.0 */"""
    cc0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and\nneighboring rights to this software to the public domain worldwide. More."
    free = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."
    apache = "   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\nTERMS"
    tags = ["# SPDX-License-Identifier: MIT\nimport x", "// SPDX-License-Identifier: GPL-2.0+\n// more", "/* SPDX-License-Identifier: BSD-3-Clause */", "MIT", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    texts = [lesser.format(";", ";", "2.1"), lesser.format(":", ",", 3), affero.format(":", ",", 3), mpl, epl, cc0, free, apache, *tags, None, ""]
    want = ["LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC0-1.0", "Unlicense", "Apache-2.0", "MIT", "GPL-2.0-or-later", "BSD-3-Clause", "", "", "", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = licences.scan(docs).collect()
    assert [r.licences for r in sorted(got)] == want
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    rows = con.execute(licences.oracle()).fetchall()
    assert sorted(rows) == sorted(map(tuple, got))


def test_every_rule_can_match(spark):
    texts = [".\n\n".join(licences.SENTENCES[i][-1] for i in rule) + ".\n" for _, rule in licences.RULES]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [r.licences for r in sorted(got)] == [name for name, _ in licences.RULES]
