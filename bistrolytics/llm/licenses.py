"""Licences named or quoted in texts, by sentence rules.

A text is cut into sentences, each is normalised (lower case, runs of anything but ASCII letters
and digits become one space) and looked up in a table of known licence sentences. The identifiers,
in order, are matched with the rules: a rule is the sequence of its sentences, and at most
``max_gap`` unknown sentences may stand between two of them.

Sentences end at marks and at blank lines. Lines are joined first, without comment marks at their
start, since licence texts are wrapped. Where a joined sentence of several lines is not known, lines
are tried: the longest run of whole lines that makes a known sentence, from the top, is one; all other
lines are unknown sentences each, as notices without a mark at their end stand on lines of their own.
Without any such run the joined lines are one unknown sentence.

Everything is a DataFrame expression over one row; nothing is shuffled. The sentence table is a
literal of a few dozen entries.

Nulls: a null or empty text has no sentence and no licence; a null id stays. Repeated rows are
scanned one by one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Licence identifiers and the public texts that name or grant each licence.
RULES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Ends of sentences: marks before white space or the end of the text, and line ends.
SENTENCE_END = r"[.;:!?]+[ \t\r\n]+|[\r\n]+|[.;:!?]+$"
NOISE = "[^a-z0-9]+"

#: Documents: line ends (with a comment word), blank or comment-only lines, marks at the start of a line.
LINE_END = r"^[ \t]*(?i:dnl|rem)(?![A-Za-z0-9_])|(?:\r\n?|\n)(?:[ \t]*(?i:dnl|rem)(?![A-Za-z0-9_]))?"
_MARKS = r"[ \t!-/:-@\[-`{-~]"
BLANK_LINES = rf"\n{_MARKS}*\n[\n{_MARKS[1:]}*"
LINE_START = rf"\n{_MARKS}+"
BLOCK_END = r"[.;:!?]+[ \t\n]+|\n\n|[.;:!?]+$"


def sentences(text: str) -> list[str]:
    """Normalised sentences of a rule's text, cut like documents are."""
    cut = (re.sub(NOISE, " ", s.lower()).strip() for s in re.split(SENTENCE_END, text))
    return [s for s in cut if s]


def sentence_table(rules=RULES) -> dict[str, int]:
    """Identifier (from 1) of each known sentence."""
    table: dict[str, int] = {}
    for _, text in rules:
        for s in sentences(text):
            table.setdefault(s, len(table) + 1)
    return table


def _literal_map(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def scan(
    docs: DataFrame, rules=RULES, max_gap: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_licenses): known sentences in order, and sorted licences."""
    table = sentence_table(rules)
    known = _literal_map(table)

    def identifier(sentence):
        return F.element_at(known, F.trim(F.regexp_replace(F.lower(sentence), NOISE, " ")))

    def normal(piece):
        return F.trim(F.regexp_replace(F.lower(piece), NOISE, " "))

    longest = max((len(s.split()) for s in table), default=0)
    starts = F.array(*[F.lit(s + " ") for s in table])

    def by_line(lines):
        """Identifiers of the lines: each state is (identifiers, lines taken)."""

        def step(state, line, k):
            runs = F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.size(lines) - k)),
                lambda n: F.struct(n.alias("n"), F.element_at(known, F.array_join(F.slice(lines, k + 1, n), " ")).alias("id")),
            )
            best = F.when(
                F.exists(starts, lambda s: s.startswith(F.concat(line, F.lit(" ")))),
                F.array_max(F.filter(runs, lambda r: r["id"].isNotNull())),
            )
            return F.when(k < state["next"], state).otherwise(
                F.struct(
                    F.concat(state["ids"], F.array(best["id"])).alias("ids"), F.coalesce(k + best["n"], k + 1).cast("int").alias("next")
                )
            )

        def finish(state):
            # without a known line it is one wrapped sentence
            return F.when(F.exists(state["ids"], lambda i: i.isNotNull()), state["ids"]).otherwise(F.array(F.lit(None).cast("int")))

        numbered = F.transform(lines, lambda line, k: F.struct(line.alias("line"), k.alias("k")))
        none = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("next"))
        return F.aggregate(numbered, none, lambda state, x: step(state, x["line"], x["k"]), finish)

    def identifiers(block):
        whole = identifier(block)
        lines = F.filter(F.transform(F.split(block, "\n"), normal), lambda line: line != "")
        return F.when(whole.isNotNull() | ~block.contains("\n"), F.array(whole)).otherwise(by_line(lines))

    text = F.regexp_replace(docs[text_col].cast("string"), LINE_END, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLANK_LINES, "\n\n"), LINE_START, "\n")
    # empty pieces between two ends are no sentences
    blocks = F.filter(F.split(text, BLOCK_END), lambda s: F.lower(s).rlike("[a-z0-9]"))
    found = docs.select(docs[id_col].alias("doc_id"), F.flatten(F.transform(blocks, identifiers)).alias("_ids"))
    placed = F.filter(F.transform("_ids", lambda i, k: F.struct(k.alias("at"), i.alias("id"))), lambda x: x["id"].isNotNull())

    def append(line, x):
        # "|" between neighbours, "/" where too many unknown sentences lie between
        near = x["at"] - line["at"] <= max_gap + 1
        mark = F.when(line["text"] == "", "|").when(near, "|").otherwise("|/|")
        return F.struct((F.concat(line["text"], mark, x["id"].cast("string"))).alias("text"), x["at"].alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    line = F.when(F.size("_known") > 0, F.aggregate("_known", start, append, lambda s: F.concat(s["text"], F.lit("|")))).otherwise("")
    hits = [
        F.when(F.col("_line").contains("|" + "|".join(str(table[s]) for s in sentences(text)) + "|"), F.lit(name))
        for name, text in rules
    ]
    lined = found.select("doc_id", F.coalesce(placed, F.array()).alias("_known")).withColumn("_line", line)
    licenses = F.when(F.col("_line") == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    )
    return lined.select(
        "doc_id",
        F.transform("_known", lambda x: x["id"]).alias("sentence_ids"),
        licenses.alias("licenses"),
    ).withColumn("n_licenses", F.size("licenses").cast("long"))
