import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import licences as L

MIT = """The MIT License (MIT)

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD = """Copyright (c) 2001, The Owner
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty. See the
GNU General Public License for more details."""


@pytest.mark.parametrize("text, want", [
    (MIT, ["MIT"]), (BSD, ["BSD-2-Clause"]), (BSD + ENDORSE, ["BSD-3-Clause"]), (GPL, ["GPL-3.0-or-later"]),
    ("Released under the MIT License.", ["MIT"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]), ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not", ["MPL-2.0"]),
    ("You may not use this file except in compliance with the License.", ["unknown"]),
    ("Some words.\nReleased under the MIT License.\nMore words. Licensed under CC BY 4.0. End", ["MIT", "CC-BY-4.0"]),
    ("Copyright (c) 2020 Me", []), ("A licence to print money. The software is good.", []), ("", []), (None, []),
])
def test_rules(text, want):
    assert [m[1] for m in L.scan(text)] == want


@pytest.mark.parametrize("text, want", [
    ("Copyright 2020 Foo\nReleased under the MIT License.", [("MIT", "Released under the MIT License.")]),
    ("Copyright (c) 2020 Foo\nLicensed under the Apache License, Version 2.0.\nOther words", [("Apache-2.0", "Licensed under the Apache License, Version 2.0.")]),
    ("Copyright (c) 2020 Foo Released under the MIT License.", [("MIT", "Released under the MIT License.")]),
    ("Copyright 2019 A\nCopyright 2020 B and\nothers\nReleased under\nthe MIT License", [("MIT", "Released under\nthe MIT License")]),
    ("Copyright 2020 Foo\nThis work is licensed under the GNU General\nPublic License, version 3.", [("GPL-3.0-only", "This work is licensed under the GNU General\nPublic License, version 3.")]),
    ("Licensed under the Apache License, Version 2.0\nReleased under the MIT License", [("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "Released under the MIT License")]),
    ("Copyright 2020 Foo\nand the others of it", []), ("Copyright 2020 Foo\nAll rights reserved", []),
])
def test_a_notice_that_follows_a_copyright_is_found(text, want):
    assert [(m[1], text[m[2]:m[2] + m[3]]) for m in L.scan(text)] == want


ISC = """Copyright (c) 2020 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.mark.parametrize("first, mark, last", [("/*", " * ", " */"), ("/*", " ", "*/"), ("#", "# ", "#"), ("//", "// ", ""), ("", "-- ", ""), ("<!--", "  ", "-->"), ("/" + "*" * 70, " * ", " " + "*" * 70 + "/"), ("", "\t;; ", "")])
@pytest.mark.parametrize("notice, want", [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (ISC, "ISC"), ("Copyright 2020 Foo LLC\n\n" + APACHE.replace("# ", "").replace("#", ""), "Apache-2.0"),
                                          ("Copyright 2020 Foo\nThis work is licensed under the GNU General\nPublic License, version 3.", "GPL-3.0-only")])
def test_notices_in_comments(first, mark, last, notice, want):
    text = "\n".join([first, *((mark + line).rstrip() for line in notice.split("\n")), last, "x = 1"])
    got = list(L.scan(text))
    assert [m[1] for m in got] == [want] and text[got[0][2]:].startswith("This work" if "work" in notice else notice.split()[0])
    assert "work" in notice or len(got[0][4]) >= 2


@pytest.mark.parametrize("text, want", [
    ("This code is dual-licensed under the Foo License.", "This code is dual-licensed under the Foo License."), ("Copyright 2020 Foo\nLicensed under the Foo\nLicense, see there", "Licensed under the Foo\nLicense, see there"),
    ("# Words\n#\n# Released under the terms of\n# the Bar Licence\n", "Released under the terms of\n# the Bar Licence"), ("// SPDX-License-Identifier: MIT */", None), ("The licence is under the tree", ""),
    ("This package is\nreleased under the MIT License.", None),
])
def test_sentences_that_put_something_under_an_unknown_licence(text, want):
    got = [(m[1], text[m[2]:m[2] + m[3]]) for m in L.scan(text)]
    assert [x for x, _ in got] == ["MIT"] if want is None else got == [("unknown", want)] * bool(want)


def test_long_runs_of_marks_take_no_long_time():
    for run in ("#" * 100_000, "* " * 50_000, " " * 100_000, "-" * 100_000 + "x", "x" + "*" * 100_000 + "x", "/* " * 30_000 + "x", "\n#" * 50_000):
        assert [m[1] for m in L.scan("licence\n" + run + "\n\nReleased under the MIT License.")] == ["MIT"]


def test_apache_header_in_comments_is_one_match():
    rule, licence, start, length, names = next(iter(L.scan("x = 1\n\n" + APACHE)))
    assert licence == "Apache-2.0" and names[0] == "apache-licensed"


def test_rows_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    line = "Released under the MIT License."
    docs = [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, "é " * 50_000 + "\n" + line + "\n" + "x " * 50_000), (5, line + "\n" + line)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rule": F.lit(1), "licence": F.lit("mine"), "id": F.lit(0), "start": F.lit("s")})
    got = sorted(((r.doc_id, r.licence, r.start, r.length) for r in L.scan_licences(df).collect()), key=repr)
    n = len(line)
    assert got == sorted([(1, "MIT", 0, n), (1, "MIT", 0, n), (None, "MIT", 0, n), (4, "MIT", 100_001, n), (5, "MIT", 0, n), (5, "MIT", n + 1, n)], key=repr)


def test_empty_table(spark):
    assert L.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_a_search_for_the_planted_sentences(spark):
    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    planted = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
               "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = [(r.doc_id, name, m.start(), len(s)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for s, name in planted.items() for m in re.finditer(re.escape(s), r.text or "")]
    got = [(r.doc_id, r.licence, r.start, r.length) for r in QUERIES["op6_licence_scan"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
