"""Licence scans by sentence rules, in DataFrame functions only.

Comment marks in front of lines are taken away. A text is cut at sentence ends and blank lines; a
sentence that is not known as a whole stands for its lines, so wrapped sentences and lines without a
full stop are found alike, in one order. A known sentence that the cut itself takes apart, as at a
colon, is put together again from its parts. Units are normalised to lower-case words of a-z and 0-9
and looked up in the hashed set of known licence sentences. A rule is an ordered sequence of sentence
identifiers; one pass over the sentences found fires it when its identifiers occur in that order,
other known sentences may stand between. A text without any of the trigger words, one of which is in
every known sentence, has no known sentence and isn't cut. There is no shuffle.

Defined results: a null or empty text has no licence; repeated sentences and rows do no harm; very
long texts are read whole, in time proportional to their length; an empty table gives an empty
result. Columns other than the id and the text are not returned, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and customary licence lines.
SENTENCES = {
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-4": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-1": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2": "you may not use this file except in compliance with the License.",
    "apache-3": "You may obtain a copy of the License at",
    "apache-4": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-5": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-3": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-4": "See the GNU General Public License for more details.",
    "gpl2-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "agpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-5": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-2": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
}
# Licences whose SPDX line alone names them.
SPDX = ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
# Licence, then its sentence identifiers in order.
RULES = (
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("GPL-2.0", ("gpl2-line",)),
    ("GPL-3.0", ("gpl3-line",)),
    ("GPL-3.0", ("gpl-1", "gpl-2")),
    ("ISC", ("isc-1",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-2",)),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("AGPL-3.0", ("agpl-1",)),
    ("CC0-1.0", ("cc0-1",)),
    ("GPL-2.0", ("gpl2-1", "gpl-2")),
    ("LGPL-2.1", ("lgpl21-1", "lgpl21-2")),
    ("MPL-2.0", ("mpl-1",)),
    ("Unlicense", ("unlicense-1", "unlicense-2")),
    ("Zlib", ("zlib-1", "zlib-2", "zlib-3")),
)
RULES += tuple((x.removesuffix("-only").removesuffix("-or-later"), (f"spdx-{x}",)) for x in SPDX)
TRIGGERS = ("licen", "permission", "redistribut", "warrant", "software", "copyright")
SENTENCE_END = r"(?<=[.;:!?])\s+|\n[ \t]*\n"
#: Comment marks in front of a line.
COMMENT = r"(?m)^[ \t]*(?:#+|//[/!]*|/\*+!?|\*+/?|--+|;+|%+|<!--+)[ \t]*"


def normalise(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).strip()


def known(sentences: dict[str, str] = SENTENCES, triggers: tuple[str, ...] = TRIGGERS) -> dict[str, int]:
    """Number of each normalised sentence. Every sentence must hold a trigger."""
    out = {}
    for i, (name, text) in enumerate(sentences.items()):
        if not any(t in normalise(text) for t in triggers):
            raise ValueError(f"{name} has no trigger word")
        out[normalise(text)] = i
    return out


def taken_apart(sentences: dict[str, str] = SENTENCES) -> list[tuple[str, ...]]:
    """The normalised parts of each sentence that SENTENCE_END cuts, those of most parts first."""
    cut = [tuple(u for u in map(normalise, re.split(SENTENCE_END, text)) if u) for text in sentences.values()]
    return sorted({parts for parts in cut if len(parts) > 1}, key=lambda parts: (-len(parts), parts))


def _together(units: Column, apart: list[tuple[str, ...]]) -> Column:
    """``units`` (normalised or ``?``, not empty) with parts of one sentence that follow each other joined by a space."""
    if not apart:
        return units
    # two line ends between units and one around all, so that neighbours don't share one
    text = F.concat(F.lit("\n"), F.array_join(units, "\n\n"), F.lit("\n"))
    for parts in apart:
        text = F.replace(text, F.lit("\n" + "\n\n".join(parts) + "\n"), F.lit("\n" + " ".join(parts) + "\n"))
    return F.filter(F.split(text, "\n"), lambda u: u != "")


def _norm(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def _in_order(found: Column, wanted: tuple[str, ...]) -> Column:
    """Whether ``wanted`` is a subsequence of ``found``, by one pass that counts the identifiers met so far."""
    if len(wanted) == 1:
        return F.array_contains(found, wanted[0])
    rule = F.array(*map(F.lit, wanted))
    return F.aggregate(found, F.lit(0), lambda met, u: F.when(F.get(rule, met) == u, met + 1).otherwise(met)) == len(wanted)


def gate(text: Column, triggers: tuple[str, ...]) -> Column:
    """Whether a trigger is in the normalised text, told from the raw text."""
    return text.rlike("(?i)" + "|".join("[^a-zA-Z0-9]+".join(map(re.escape, t.split())) for t in triggers))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, triggers: tuple[str, ...] = TRIGGERS) -> DataFrame:
    """doc_id, n_sentences (distinct known ones), licenses (names in order, joined by commas; empty if none)."""
    table, apart = list(known(sentences, triggers)), taken_apart(sentences)
    wanted = sorted({*table, *(p for parts in apart for p in parts)})
    is_wanted, is_known = (lambda u: u.isin(wanted)), (lambda u: u.isin(table))
    none = F.array().cast("array<string>")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    d = d.select("doc_id", F.when(gate(F.col("_text"), triggers), F.split(F.regexp_replace("_text", COMMENT, ""), SENTENCE_END)).alias("_cut"))
    lines = F.transform("_cut", lambda s: F.filter(F.transform(F.split(s, "\n"), _norm), lambda u: u != ""))
    both = F.transform(lines, lambda ls: F.struct(ls.alias("lines"), F.array_join(ls, " ").alias("whole")))
    # a unit that is neither known nor a part only keeps parts around it from each other
    units = F.flatten(F.transform(both, lambda b: F.when(is_wanted(b["whole"]), F.concat(F.when(F.size(b["lines"]) > 1, F.filter(b["lines"], is_known)).otherwise(none), F.array(b["whole"]))).otherwise(F.transform(b["lines"], lambda u: F.when(is_wanted(u), u).otherwise("?")))))
    d = d.select("doc_id", units.alias("_units"))
    d = d.select("doc_id", F.coalesce(F.filter(_together(F.col("_units"), apart), is_known), none).alias("_found"))
    d = d.select("doc_id", "_found", F.size(F.array_distinct("_found")).cast("long").alias("n_sentences"))
    norm = {name: normalise(text) for name, text in sentences.items()}
    fired = []
    for name in sorted({r[0] for r in rules}):
        hits = F.lit(False)
        for _, ids in (r for r in rules if r[0] == name):
            hits = hits | _in_order(F.col("_found"), tuple(norm[i] for i in ids))
        fired.append(F.when((F.col("n_sentences") > 0) & hits, F.lit(name)))
    return d.select("doc_id", "n_sentences", F.concat_ws(",", *fired).alias("licenses"))
