"""Licence recognition by sentences: known sentences become identifiers, identifier sequences match ordered rules.

A text is normalised (lower case; letters, digits, stops and line ends kept, other runs become one space, so comment marks, quotes
and list marks go) and cut into passages at blank lines and at stops that a space or a line end follows. A passage of several
lines may end with a known sentence that was wrapped: the longest run of its last lines that is one is taken for it. Every other
line is looked up by itself. A rule is an ordered list of identifiers; a text carries the licence if the list is a subsequence
of the text's identifiers, whatever stands between them. Everything is one projection of built-in functions over the
scan: the tables are literals of fixed size, nothing is shuffled, and the cost of a text grows with its length.

Defined results: null and empty texts have no sentences and no licence. A rule counts once a text however
often it matches; where a longer rule of a family matches, the shorter ones it extends are dropped. Repeated
rows are scanned alike. Columns other than the id and the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

# Identifier and sentence of licence texts and notices, normalised.
SENTENCES = (
    ("mit.1", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit.2", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit.3", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit.4", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit.5", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit.6", "released under the mit license"),
    ("mit.7", "licensed under the mit license"),
    ("mit.8", "this project is licensed under the mit license"),
    ("mit.9", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache.1", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache.2", "you may obtain a copy of the license at"),
    ("apache.3", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache.4", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache.5", "licensed under the apache license version 2.0"),
    ("apache.6", "apache license version 2.0 january 2004 http www.apache.org licenses"),
    ("apache.7", "terms and conditions for use reproduction and distribution"),
    ("gpl.1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl.2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl.3", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl.4", "this work is licensed under the gnu general public license version 3"),
    ("gpl.5", "this work is licensed under the gnu general public license version 2"),
    ("gpl.6", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl.7", "gnu general public license version 3 29 june 2007"),
    ("gpl.8", "gnu general public license version 2 june 1991"),
    ("lgpl.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl.2", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl.3", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl.1", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd.1", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd.2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd.3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd.4", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd.5", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd.6", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd.7", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc.1", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc.2", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc.3", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl.1", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl.2", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    ("mpl.3", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"),
    ("cc.1", "licensed under cc by 4.0"),
    ("cc.2", "licensed under cc by sa 4.0"),
    ("cc.3", "licensed under cc by nc 4.0"),
    ("cc.4", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc.5", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc.6", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc.7", "this work is licensed under the creative commons attribution 4.0 international license"),
    ("cc.8", "this work is licensed under the creative commons attribution sharealike 4.0 international license"),
    ("cc.9", "this work is licensed under the creative commons attribution noncommercial 4.0 international license"),
    ("unlicense.1", "this is free and unencumbered software released into the public domain"),
    ("unlicense.2", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("boost.1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost.2", "distributed under the boost software license version 1.0"),
    ("zlib.1", "this software is provided as is without any express or implied warranty"),
    ("zlib.2", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("epl.1", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0"),
)

# Licence and the short identifier that a tag line names it by.
TAGS = (
    ("MIT", "MIT"), ("MIT-0", "MIT-0"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"),
    ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"),
    ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("BSD-2-Clause", "BSD-2-Clause"),
    ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("0BSD", "0BSD"), ("MPL-2.0", "MPL-2.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("Unlicense", "Unlicense"), ("BSL-1.0", "BSL-1.0"), ("Zlib", "Zlib"), ("EPL-2.0", "EPL-2.0"),
)

# Licence, rule and its ordered sentence identifiers.
TEXT_RULES = (
    ("MIT", "mit-text", ("mit.1", "mit.2", "mit.3", "mit.4")),
    ("MIT", "mit-unbroken-text", ("mit.9", "mit.3", "mit.4")),
    ("MIT-0", "mit0-text", ("mit.5", "mit.3", "mit.4")),
    ("MIT", "mit-line", ("mit.6",)),
    ("MIT", "mit-line-2", ("mit.7",)),
    ("MIT", "mit-line-3", ("mit.8",)),
    ("Apache-2.0", "apache-notice", ("apache.1", "apache.2", "apache.3", "apache.4")),
    ("Apache-2.0", "apache-short-notice", ("apache.1",)),
    ("Apache-2.0", "apache-line", ("apache.5",)),
    ("Apache-2.0", "apache-text", ("apache.6", "apache.7")),
    ("GPL-3.0", "gpl3-notice", ("gpl.1", "gpl.3")),
    ("GPL-3.0", "gpl3-line", ("gpl.4",)),
    ("GPL-3.0", "gpl3-text", ("gpl.7",)),
    ("GPL-2.0", "gpl2-notice", ("gpl.2", "gpl.3")),
    ("GPL-2.0", "gpl2-only-notice", ("gpl.6",)),
    ("GPL-2.0", "gpl2-line", ("gpl.5",)),
    ("GPL-2.0", "gpl2-text", ("gpl.8",)),
    ("LGPL-2.1", "lgpl21-notice", ("lgpl.1", "lgpl.3")),
    ("LGPL-3.0", "lgpl3-notice", ("lgpl.2", "lgpl.3")),
    ("AGPL-3.0", "agpl3-notice", ("agpl.1", "gpl.3")),
    ("BSD-3-Clause", "bsd3-text", ("bsd.1", "bsd.2", "bsd.3", "bsd.4", "bsd.5")),
    ("BSD-3-Clause", "bsd3-university-text", ("bsd.1", "bsd.2", "bsd.3", "bsd.6")),
    ("BSD-4-Clause", "bsd4-text", ("bsd.1", "bsd.2", "bsd.3", "bsd.7")),
    ("BSD-2-Clause", "bsd2-text", ("bsd.1", "bsd.2", "bsd.3", "bsd.5")),
    ("ISC", "isc-text", ("isc.1", "isc.2")),
    ("0BSD", "0bsd-text", ("isc.3", "isc.2")),
    ("MPL-2.0", "mpl2-notice", ("mpl.1", "mpl.2")),
    ("MPL-2.0", "mpl2-old-notice", ("mpl.1", "mpl.3")),
    ("CC-BY-4.0", "cc-by-line", ("cc.1",)),
    ("CC-BY-SA-4.0", "cc-by-sa-line", ("cc.2",)),
    ("CC-BY-NC-4.0", "cc-by-nc-line", ("cc.3",)),
    ("CC-BY-4.0", "cc-by-notice", ("cc.4",)),
    ("CC-BY-SA-4.0", "cc-by-sa-notice", ("cc.5",)),
    ("CC-BY-NC-4.0", "cc-by-nc-notice", ("cc.6",)),
    ("CC-BY-4.0", "cc-by-notice-2", ("cc.7",)),
    ("CC-BY-SA-4.0", "cc-by-sa-notice-2", ("cc.8",)),
    ("CC-BY-NC-4.0", "cc-by-nc-notice-2", ("cc.9",)),
    ("Unlicense", "unlicense-text", ("unlicense.1", "unlicense.2")),
    ("Unlicense", "unlicense-line", ("unlicense.1",)),
    ("BSL-1.0", "boost-text", ("boost.1",)),
    ("BSL-1.0", "boost-line", ("boost.2",)),
    ("Zlib", "zlib-text", ("zlib.1", "zlib.2")),
    ("EPL-2.0", "epl2-notice", ("epl.1",)),
)
#: A rule is dropped where one that extends it matches.
EXTENDED_BY = {
    "apache-short-notice": ("apache-notice",),
    "bsd2-text": ("bsd3-text", "bsd3-university-text", "bsd4-text"),
    "bsd3-text": ("bsd4-text",),
    "bsd3-university-text": ("bsd4-text",),
    "unlicense-line": ("unlicense-text",),
}


def normal(sentence: str) -> str:
    """A sentence as the tables have it."""
    return re.sub(r"[^\w.]+", " ", sentence.lower().replace("_", " ")).strip(" .")


_TAG_SENTENCES = {tag: normal(f"SPDX-License-Identifier: {tag}") for _, tag in TAGS}
KNOWN = {s: sid for sid, s in SENTENCES} | {s: f"spdx.{tag}" for tag, s in _TAG_SENTENCES.items()}
RULES = (*TEXT_RULES, *((lic, f"spdx-{tag}", (f"spdx.{tag}",)) for lic, tag in TAGS))
LONGEST = max(map(len, KNOWN))

#: Line ends, then what becomes a space, then where passages end, as marked by the character 1.
_LINE_ENDS = r"\r\n?"
_NOISE = r"[^\p{L}\p{N}.!?\n]+"
_BLANK = r"\n ?(\n ?)+"
_STOP = r"[.!?]+([ \n\x01]|$)"


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = list(KNOWN)
    table = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _LINE_ENDS, "\n"), _NOISE, " ")
    passages = F.split(F.regexp_replace(F.regexp_replace(clean, _BLANK, "\x01"), _STOP, "\x01$1"), "\x01", -1)
    ids = lambda xs: F.transform(F.filter(xs, lambda x: x.isin(known)), lambda x: F.element_at(table, x))

    def found(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
        return let(lines, wrapped)

    def wrapped(lines: Column) -> Column:
        # from which line on the rest may be one sentence: no more characters than the longest has
        n = F.size(lines)
        sizes = F.transform(F.reverse(lines), lambda x: F.length(x) + 1)
        fit = F.aggregate(sizes, F.struct(F.lit(0).alias("k"), F.lit(0).alias("sum")),
                          lambda a, x: F.struct((a["k"] + F.when(a["sum"] + x <= LONGEST + 1, 1).otherwise(0)).alias("k"), (a["sum"] + x).alias("sum")), lambda a: a["k"])
        starts = F.when((n > 1) & (fit > 1), F.sequence(n - fit + 1, n - 1)).otherwise(F.array().cast("array<int>"))
        return let(F.get(F.filter(starts, lambda i: F.array_join(F.slice(lines, i, n), " ").isin(known)), 0), lambda at: F.when(
            at.isNull(), ids(lines)).otherwise(F.concat(ids(F.slice(lines, F.lit(1), at - 1)), ids(F.array(F.array_join(F.slice(lines, at, n), " "))))))

    return F.flatten(F.transform(F.filter(passages, lambda p: F.length(p) >= 8), found))


def _follows(ids: Column, seq: tuple[str, ...]) -> Column:
    """Whether seq is a subsequence of ids: each of its items in turn at its first place after the last one."""
    items = F.array(*[F.lit(x) for x in seq])
    if len(seq) == 1:
        return F.array_contains(ids, seq[0])
    return F.aggregate(ids, F.lit(0), lambda k, x: k + F.when(x == F.get(items, k), 1).otherwise(0)) == len(seq)


def matched(ids: Column) -> dict[str, Column]:
    """For each rule, whether its identifiers are a subsequence of ids and no rule that extends it matches."""
    hit = {rule: _follows(ids, seq) for _, rule, seq in RULES}
    return {rule: reduce(lambda a, longer: a & ~hit[longer], EXTENDED_BY.get(rule, ()), hit[rule]) for rule in hit}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences long, sentence_ids array, rules array and licenses array (sorted, distinct)."""

    def named(ids: Column) -> Column:
        hits = matched(ids)
        of = F.array_compact(F.array(*[F.when(hits[rule], F.struct(F.lit(lic).alias("l"), F.lit(rule).alias("r"))) for lic, rule, _ in RULES]))
        none = F.array().cast("array<struct<l:string,r:string>>")
        return F.struct(ids.alias("s"), F.when(F.size(ids) > 0, of).otherwise(none).alias("m"))

    out = df.select(F.col(id_col).alias("_id"), let(sentence_ids(F.col(text_col)), named).alias("_x"))
    return out.select(
        F.col("_id").alias(id_col),
        F.size("_x.s").cast("long").alias("n_sentences"),
        F.col("_x.s").alias("sentence_ids"),
        F.transform("_x.m", lambda x: x["r"]).alias("rules"),
        F.array_sort(F.array_distinct(F.transform("_x.m", lambda x: x["l"]))).alias("licenses"),
    )


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan() with its lists joined by commas."""
    join = lambda c: F.array_join(c, ",").alias(c)
    return scan(df, id_col, text_col).select(id_col, "n_sentences", join("sentence_ids"), join("rules"), join("licenses"))


def oracle_sql(table: str = "documents") -> str:
    """DuckDB SQL for digest() of a table with doc_id and text."""
    values = ", ".join(f"('{s}', '{sid}')" for s, sid in KNOWN.items())
    pattern = {rule: "(^| )" + "( .*)? ".join(x.replace(".", "[.]") for x in seq) + "( |$)" for _, rule, seq in RULES}
    one = {rule: f"regexp_matches(ids, '{p}')" for rule, p in pattern.items()}
    cond = {rule: " AND NOT ".join([one[rule], *[one[x] for x in EXTENDED_BY.get(rule, ())]]) for rule in one}
    rules = ", ".join(f"CASE WHEN {cond[rule]} THEN '{rule}' END" for _, rule, _ in RULES)
    lics = ", ".join(f"CASE WHEN {cond[rule]} THEN '{lic}' END" for lic, rule, _ in RULES)
    return rf"""
WITH known(s, sid) AS (VALUES {values}),
src AS (SELECT row_number() OVER () AS rid, doc_id,
               regexp_replace(regexp_replace(lower(coalesce(text, '')), '{_LINE_ENDS}', chr(10), 'g'), '{_NOISE}', ' ', 'g') AS t FROM {table}),
cut AS (SELECT rid, string_split(regexp_replace(regexp_replace(t, '{_BLANK}', chr(1), 'g'), '{_STOP}', chr(1) || '\1', 'g'), chr(1)) AS p FROM src),
passage AS (SELECT rid, i, list_filter(list_transform(string_split(p[i], chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l
            FROM cut, unnest(range(1, len(p) + 1)) AS u(i)),
tail AS (SELECT rid, i, j, array_to_string(l[j:], ' ') AS s FROM passage, unnest(range(1, len(l))) AS u(j) WHERE len(l) > 1 AND len(array_to_string(l[j:], ' ')) <= {LONGEST}),
wrap AS (SELECT rid, i, min(j) AS j FROM tail JOIN known USING (s) GROUP BY ALL),
found AS (SELECT rid, i, j, sid FROM wrap JOIN tail USING (rid, i, j) JOIN known USING (s)
          UNION ALL SELECT x.rid, x.i, x.k, sid FROM (SELECT rid, i, k, l[k] AS s FROM passage, unnest(range(1, len(l) + 1)) AS u(k)) AS x
          JOIN known USING (s) LEFT JOIN wrap w ON w.rid = x.rid AND w.i = x.i WHERE w.j IS NULL OR x.k < w.j),
ids AS (SELECT rid, count(*) AS n, string_agg(sid, ' ' ORDER BY i, j) AS ids FROM found GROUP BY rid),
j AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids FROM src LEFT JOIN ids USING (rid))
SELECT doc_id, n::BIGINT AS n_sentences, replace(ids, ' ', ',') AS sentence_ids, array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS rules,
       array_to_string(list_sort(list_distinct(list_filter([{lics}], lambda x: x IS NOT NULL))), ',') AS licenses FROM j
"""
