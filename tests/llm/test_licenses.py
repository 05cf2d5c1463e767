"""Licence recognition on unedited licence texts and notices, hard-wrapped and in comments."""

import duckdb
import pytest

from terravane.llm import license_scan

MIT = '''MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''

APACHE = '''Copyright 2024 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''

GPL = '''This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
GPL3, GPL2 = GPL.format(":", ",", 3), GPL.format(";", ";", 2)

LGPL = '''This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
'''

BSD2 = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
'''
THIRD = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''

MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''

ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
'''

UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
'''


def commented(text: str, mark: str) -> str:
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


CASES = [
    (MIT, "MIT"), (commented(MIT, "//"), "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), (" ".join(MIT.split("\n")[4:]), "MIT"), (APACHE, "Apache-2.0"), (commented(APACHE, " *"), "Apache-2.0"),
    (commented(GPL3, "#"), "GPL-3.0"), (GPL3, "GPL-3.0"), (GPL2, "GPL-2.0"), (LGPL, "LGPL-2.1"), (BSD2.format(""), "BSD-2-Clause"), (BSD2.format(THIRD), "BSD-3-Clause"), (MPL, "MPL-2.0"), (commented(MPL, "--"), "MPL-2.0"),
    (ISC, "ISC"), (UNLICENSE, "Unlicense"), ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "GPL-3.0"), ("# SPDX-License-Identifier: MIT", "MIT"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under the Apache License," + " " * 900 + "Version 2.0", "Apache-2.0"), ("Some title\nReleased under the MIT License\nand more prose that goes on", "MIT"),
    ("plain prose. Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("\n".join(MIT.split("\n")[::-1]), ""), ("not released under the MIT License", ""), ("a.\n\n.b\n..", ""), (None, ""), ("", ""), (" \n.\x01\n ", ""), ("x y\n" * 3000, ""),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)]
    return license_scan.digest(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).toPandas().sort_values("doc_id")


def test_true_texts(scanned):
    assert scanned["licenses"].tolist() == [want for _, want in CASES]


def test_sql_agrees(scanned):
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(len(CASES)), "text": [t for t, _ in CASES]})  # noqa: F841
    assert duckdb.sql(license_scan.oracle_sql()).df().sort_values("doc_id").values.tolist() == scanned.values.tolist()


def test_every_rule_fires(spark):
    rows = [(rule, ".\n\n".join(s for sid in seq for s, x in license_scan.KNOWN.items() if x == sid)) for _, rule, seq in license_scan.RULES]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r["doc_id"] in r["rules"] for r in found)


def test_repeated_sentences_cost_no_more_than_their_number(spark):
    text = ".\n\n".join(s for s, x in license_scan.KNOWN.items() if x in ("bsd.1", "bsd.2", "bsd.3")) + ".\n\n"
    assert license_scan.scan(spark.createDataFrame([(1, text * 2000)], "doc_id int, text string")).first()["n_sentences"] == 6000
