"""License scans by sentence-rule recognition, in DataFrame operations only.

A text is cut at line ends, at markup (a tag is a cut), after ``.``, ``!`` or ``?`` followed by white space, and before
words that lead in a name (``released`` and the like); what lies between is normalised to lower-case letters and digits with
single spaces between. Normalised sentences are mapped to identifiers by hash tables that the plan holds as constants:

1. the first words of every piece are looked up among the openings of all known sentences;
2. where an opening is known, the text from there, as long as a sentence of that opening, is looked up among the
   sentences, if it ends where a piece ends.

So a look-up costs the same however many sentences are known, a sentence is found where it fills one piece or several
adjacent ones (wrapped at any width, in a comment, with a stop or a tag within), and only hits are compared. Blank
lines end a sentence, and so does a tag alone on a line. Of sentences found one within another the longest counts. What
is found in a text, in order of place, is its identifier sequence; a rule, an ordered sequence of identifiers, matches
where its identifiers stand in that order, with nothing known in between. ``BSD`` is the family; the rules of two and
three clauses name the licence beside it.

All of this happens within a row, so nothing is shuffled, and neither a hot source nor long texts weigh on a task.
Defined results: null or empty text has no sentences and no licence; a repeated sentence counts each time;
each row shows what its own text holds, whatever other rows have its id, and null ids stay; an empty table gives no
rows; only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import let, sums_before, table, text_or_empty

#: White space after a sentence, which is a cut like the line end that may follow it.
STOP = r"(?<=[.!?])[^\S\n]++(?!\n)"
#: Markup, and the mark that stands for it until all white space is in order.
TAG, MARK = r"</?[a-z][^<>]*+>", "\x01"
#: Words that lead in the name of a licence; a sentence may begin with them.
LEADS = ("licensed", "released", "distributed", "published", "available", "provided")
#: At most so many words of a sentence are its opening.
OPENING = 3

#: Wording of public licence notices, by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-neither": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-work": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
}
#: Ordered rules: licence and the sentence identifiers that make it, in that order.
RULES = (
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-head", "apache-basis")),
    ("Apache-2.0", ("apache-head", "apache-copy", "apache-basis", "apache-see")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-short",)),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-neither")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-details")),
    ("EPL-2.0", ("epl-terms",)),
    ("Zlib", ("zlib-grant",)),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC0-1.0", ("cc0-work",)),
    ("Unlicense", ("unlicense-free",)),
)


#: Public names of licences. Sentences are made of them by rule (``wordings``).
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPLv3", "LGPLv3"),
    "MIT": ("MIT License", "MIT/Expat License", "Expat License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}


def wordings(names: dict[str, tuple[str, ...]] = NAMES) -> dict[str, tuple[str, ...]]:
    """By identifier the sentences that name a licence after a lead-in, and the line of a file that names it."""
    named = {f"{k.lower()}-named": tuple(f"{lead} under {article}{x}" for x in of for lead in LEADS for article in ("", "the ", "a ")) for k, of in names.items()}
    return named | {f"{k.lower()}-line": (f"SPDX-License-Identifier: {k}",) for k in names}


#: All sentences by identifier and all rules; where one wording has two identifiers, that of ``SENTENCES`` counts.
KNOWN = SENTENCES | wordings()
ALL_RULES = RULES + tuple((k, (f"{k.lower()}-{how}",)) for k in NAMES for how in ("named", "line"))


def norm(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, one a line; a blank line is an empty piece."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(text), TAG, MARK), STOP, "\n")
    clean = F.regexp_replace(cut, r"[^a-z0-9\n\x01]+", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, r" ?\x01[ \x01]*+", MARK), r"[ \x01]?\n[ \x01]?", "\n")
    led = F.regexp_replace(F.translate(clean, MARK, "\n"), rf" ((?:{'|'.join(LEADS)})\b)", "\n$1")
    return F.trim(led)


def hashed(entries: dict[str, object], kind: str) -> Callable[[str], str]:
    """SQL of a look-up in a constant hash table: the key's value, null where the key is unknown. The time of one does not
    depend on the number of keys: buckets are chosen by CRC-32, and the key itself decides within."""
    n = 1 << (2 * len(entries)).bit_length()
    buckets: list[list] = [[] for _ in range(n)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % n].append({"key": key, "value": value})
    held = f"from_json('{json.dumps(buckets)}', 'array<array<struct<key:string,value:{kind}>>>')"
    return lambda key: f"get(filter({held}[cast(crc32(cast({key} AS binary)) % {n} AS int)], e -> e.key = {key}), 0).value"


def anchors(norms: list[str], least: int = 7) -> list[str]:
    """A few long words of which every sentence holds one, so a text without all of them holds no sentence."""
    left, chosen = list(norms), []
    while left:
        words = sorted({w for x in left for w in ([w for w in x.split() if len(w) >= least] or [max(x.split(), key=len)])})
        best = max(words, key=lambda w: sum(w in x for x in left))
        chosen.append(best)
        left = [x for x in left if best not in x]
    return chosen


def license_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str | tuple[str, ...]] = KNOWN) -> DataFrame:
    """(doc_id, found): of every row the known sentences (pos, sid) in order, pos being the place in the pieces of its text."""
    of: dict[str, str] = {}
    for sid, said in sentences.items():
        for x in (said,) if isinstance(said, str) else said:
            of.setdefault(norm(x), sid)
    norms = list(of)
    number, n = {x: i for i, x in enumerate(norms)}, len(norms)
    opening = min(OPENING, *(len(x.split()) for x in norms))
    by_opening: dict[str, list[str]] = defaultdict(list)
    for x in norms:
        by_opening[" ".join(x.split()[:opening])].append(x)
    opens = hashed({k: {"long": sorted({len(x) for x in xs}), "words": max(len(x.split()) for x in xs)} for k, xs in by_opening.items()}, "struct<long:array<int>,words:int>")
    sentence = hashed(number, "int")
    #: By sentence, what is added to its code for the code of each known one that stands in it.
    inner = json.dumps([[m.start() * n + number[x] - j for x in norms if len(x) < len(y) and x in y for m in re.finditer(rf"(?<![a-z0-9]){x}(?![a-z0-9])", y)] for j, y in enumerate(norms)])

    # a sentence of so many words fills at most as many pieces
    ends = "substring(ahead, long + 1, 1) = '\\n'"
    said = let("translate(left(ahead, long), '\\n', ' ')", "said", sentence("said"))
    numbers = f"transform(known.long, long -> CASE WHEN {ends} THEN {said} END)"
    ahead = let("concat_ws('\\n', slice(piece, i + 1, known.words), array(''))", "ahead", numbers)
    first = f"substring_index(concat_ws(' ', slice(piece, i + 1, {opening})), ' ', {opening})"
    at_piece = let(first, "first", let(opens("first"), "known", f"CASE WHEN known IS NULL THEN cast(array() AS array<int>) ELSE {ahead} END"))
    hits = f"flatten(transform(sequence(0, size(piece) - 1), i -> transform(filter({at_piece}, s -> s IS NOT NULL), s -> struct(i AS i, s AS s))))"
    begins = sums_before("transform(piece, x -> length(x) + 1L)")
    # place * n + number of the sentence, for each hit
    codes = f"CASE WHEN size(hits) = 0 THEN cast(array() AS array<bigint>) ELSE {let(begins, 'begins', f'transform(hits, h -> begins[h.i] * {n} + h.s)')} END"
    within = f"flatten(transform(codes, c -> transform(from_json('{inner}', 'array<array<bigint>>')[cast(c % {n} AS int)], d -> c + d)))"

    # Generators keep Spark from working out the pieces anew for each use.
    text = text_or_empty(F.col(text_col))
    likely = reduce(or_, [F.lower(text).contains(w) for w in anchors(norms)])
    cut = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.when(likely, F.split(pieces(text), "\n")).otherwise(F.array(F.lit(""))))).alias("piece"))
    hit = cut.select("doc_id", "piece", F.explode(F.array(F.expr(hits))).alias("hits"))
    found = hit.select("doc_id", F.explode(F.array(F.expr(codes))).alias("codes"))
    sid = F.array(*[F.lit(of[x]) for x in norms])
    longest = F.array_except("codes", F.expr(within))
    return found.select("doc_id", F.transform(F.array_sort(longest), lambda c: F.struct(F.floor(c / n).alias("pos"), sid[(c % n).cast("int")].alias("sid"))).alias("found"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str | tuple[str, ...]] = KNOWN, rules: tuple = ALL_RULES) -> DataFrame:
    """One row per input row: id, n_sentences, sequence (identifiers in order), licenses (sorted, distinct), both comma-joined."""
    found = license_sentences(docs, id_col, text_col, sentences)
    sequences = found.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join(F.transform("found", lambda x: x["sid"]), ",").alias("sequence"))
    framed = F.concat(F.lit(","), F.col("sequence"), F.lit(","))
    matched = F.array(*[F.when(framed.contains("," + ",".join(ids) + ","), F.lit(name)) for name, ids in rules])
    licenses = F.when(F.col("n_sentences") > 0, F.array_join(F.array_sort(F.array_distinct(F.array_compact(matched))), ",")).otherwise("")
    return sequences.select(F.col("doc_id").alias(id_col), "n_sentences", "sequence", licenses.alias("licenses"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same by search: every sentence is looked for at every piece of every text that holds its words."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    first = {norm(x): sid for sid, said in reversed(KNOWN.items()) for x in ((said,) if isinstance(said, str) else said)}
    known = ", ".join(f"({quoted(sid)}, {quoted(x)})" for x, sid in first.items())
    hit = ", ".join(f"CASE WHEN contains(',' || sequence || ',', {quoted(',' + ','.join(ids) + ',')}) THEN {quoted(name)} END" for name, ids in ALL_RULES)
    # RE2 has neither look-around nor possessive runs: white space before line ends goes first, a stop is put back.
    cut = "lower(coalesce(text, ''))"
    for pattern, then in (
        ("</?[a-z][^<>]*>", r"\x01"), (r"[\t\v\f\r ]+\n", r"\n"), (r"([.!?])[\t\v\f\r ]+", r"\1\n"), (r"[^a-z0-9\n\x01]+", " "), (r" ?\x01[ \x01]*", r"\x01"),
        (r"[ \x01]?\n[ \x01]?", r"\n"), (r"\x01", r"\n"), (rf" ((?:{'|'.join(LEADS)})\b)", r"\n\1"),
    ):
        then = then.replace(r"\1", r"\\1")
        cut = f"regexp_replace({cut}, {quoted(pattern)}, E{quoted(then)}, 'g')"
    return f"""
WITH known(sid, norm) AS (VALUES {known}),
c AS (SELECT doc_id, trim({cut}) AS cut FROM documents),
p AS (SELECT doc_id, translate(cut, E'\\n', ' ') AS flat, string_split(cut, E'\\n') AS pieces FROM c),
l AS (SELECT doc_id, sid, norm FROM p JOIN known ON contains(flat, norm)),
e AS (SELECT doc_id, flat, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM p WHERE doc_id IN (SELECT doc_id FROM l)),
s AS (SELECT doc_id, flat, 1 + sum(length(piece) + 1) OVER w - length(piece) - 1 AS a, sum(length(piece) + 1) OVER w AS z FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, sid, a::BIGINT AS a, (a + length(norm))::BIGINT AS z FROM s JOIN l USING (doc_id) WHERE substr(flat, a::BIGINT, length(norm)) = norm),
b AS (SELECT h.* FROM h SEMI JOIN s ON h.doc_id = s.doc_id AND h.z = s.z),
m AS (SELECT doc_id, count(*) AS n_sentences, string_agg(sid, ',' ORDER BY a) AS sequence FROM b WHERE NOT EXISTS
      (SELECT 1 FROM b AS o WHERE o.doc_id = b.doc_id AND o.a <= b.a AND o.z >= b.z AND o.z - o.a > b.z - b.a) GROUP BY doc_id),
r AS (SELECT *, list_sort(list_distinct(list_filter([{hit}], lambda x: x IS NOT NULL))) AS names FROM m)
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sequence, '') AS sequence,
       coalesce(array_to_string(names, ','), '') AS licenses
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""


ORACLE = _oracle()
