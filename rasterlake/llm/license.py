"""Operator 3: licence recognition by sentences and ordered rules, in DataFrame functions only.

A text's sentences are normalised and matched with known licence sentences, each in one line or wrapped over
several; the identifiers, in order and without what isn't known between them, are matched against the rules
from first to last. What a rule has matched is used up, so a longer rule that stands earlier wins over its parts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work

#: Sentences of public licences, as normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "licensed under the apache license version 2.0": "apache-notice",
    "licensed under the apache license version 2.0 the license": "apache-notice",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by 4.0": "cc-by-notice",
    "licensed under cc by-sa 4.0": "cc-by-sa-notice",
    "licensed under cc by-nc 4.0": "cc-by-nc-notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-notice",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer in this position and unchanged": "bsd-source",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted": "hpnd-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this software is provided as-is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "distributed under the boost software license version 1.0": "bsl-notice",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license": "agpl3-only-grant",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl2-notice",
    "licensed under the bsd 3-clause license": "bsd3-notice",
    "licensed under the bsd 2-clause license": "bsd2-notice",
    "licensed under the isc license": "isc-notice",
    "licensed under the gnu general public license v3.0": "gpl3-notice",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "cc-by-nc-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl3-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "gpl2-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only-grant",
    "licensed under the gnu general public license version 2": "gpl2-notice",
    "licensed under the gnu general public license v2.0": "gpl2-notice",
    "licensed under the gnu affero general public license version 3": "agpl3-notice",
    "licensed under the gnu affero general public license v3.0": "agpl3-notice",
    "licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "licensed under the gnu lesser general public license v3.0": "lgpl3-notice",
    "licensed under the gnu lesser general public license version 2.1": "lgpl21-notice",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "asf-head",
    "the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license": "apache-head",
    "the asf licenses this file to you under the apache license version 2.0": "apache-notice",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-grant",
    "licensed under the apache license 2.0": "apache-notice",
    "licensed under the apache 2.0 license": "apache-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "licensed under the creative commons cc0 1.0 universal license": "cc0-notice",
    "licensed under cc0 1.0": "cc0-notice",
    "licensed under the mozilla public license version 2.0": "mpl-notice",
    "licensed under the mozilla public license 2.0": "mpl-notice",
    "licensed under the boost software license version 1.0": "bsl-notice",
    "licensed under the zlib license": "zlib-notice",
    "licensed under the sil open font license version 1.1": "ofl-notice",
    "licensed under the unlicense": "unlicense-notice",
    "licensed under the bsd license": "bsd-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql-grant",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "version 3 29 june 2007": "gnu3-date",
    "version 2 june 1991": "gpl2-date",
    "version 2.1 february 1999": "lgpl21-date",
    "version 3 19 november 2007": "agpl3-date",
    "version 2.0 january 2004": "apache-date",
    "gnu general public license": "gpl-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "apache license": "apache-title",
    "all rights reserved": "reserved",
}
#: Clauses that name a holder, as patterns over normalised words, and the form that SENTENCES holds.
HOLDERS = (
    ("neither the names? of (?:the )?[a-z0-9.+ \n-]{1,120}? nor the names of (?:its|their|the|any) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("the names? of (?:the )?[a-z0-9.+ \n-]{1,120}? may not be used to endorse", "the name of the author may not be used to endorse"),
    ("(?:this|the|our) [a-z0-9+-][a-z0-9.+ \n-]{0,60}? (?:is|are) (?:licensed|released|distributed|published) under (?:the terms of )?the ", "licensed under the "),
    ("to the extent possible under law [a-z0-9.+ \n-]{1,120}? (?:has|have) waived all copyright", "to the extent possible under law the author has waived all copyright"),
)
#: Rules, in the order in which they are tried: licence, and the sequence of identifiers.
RULES = (
    ("MIT", ("mit-grant", "mit-condition")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-head", "apache-copy")),
    ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-head",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("AGPL-3.0-only", ("agpl3-only-grant",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("GPL-3.0-only", ("gpl3-only-grant", "gpl-warranty")),
    ("GPL-3.0-only", ("gpl3-only-grant",)),
    ("GPL-2.0-only", ("gpl2-only-grant", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl2-only-grant",)),
    ("GPL-3.0-only", ("gpl-title", "gnu3-date")),
    ("GPL-2.0-only", ("gpl-title", "gpl2-date")),
    ("LGPL-3.0-only", ("lgpl-title", "gnu3-date")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl21-date")),
    ("AGPL-3.0-only", ("agpl-title", "agpl3-date")),
    ("Apache-2.0", ("apache-title", "apache-date", "apache-grant")),
    ("Apache-2.0", ("apache-title", "apache-date")),
    ("Apache-2.0", ("asf-head", "apache-notice")),
    ("Apache-2.0", ("apache-grant",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("LGPL-2.1-only", ("lgpl21-notice",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("OFL-1.1", ("ofl-notice",)),
    ("Zlib", ("zlib-notice",)),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("0BSD", ("0bsd-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("Unlicense", ("unlicense-notice",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("HPND", ("hpnd-grant",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("ISC", ("isc-notice",)),
    ("all-rights-reserved", ("reserved",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = r"\n|[.!?:]+[ \t\r]+"
JUNK = "[^a-z0-9.+-]+"
EDGES = "^[ .+-]+|[ .+-]+$"
#: Within texts: END closes a sentence, a newline may stand in one. A colon, "v." before a number, "Inc." and the like in a clause, and one newline do not close it.
END = "\x01"
SOFT = r"(?<=\bv)[.][ \t\r\n][^a-z0-9\x01]*(?=[0-9])|(?<=\b(?:inc|ltd|corp|co|llc))[.][ \t\r\n][^a-z0-9\x01]*(?=(?:nor|and|or|may)\b)|:[ \t\r]++(?!\n)"
HARD = r"[.!?]+[ \t\r\n]+|\n[^a-z0-9\n]*\n"
LINE_JUNK = r"[^a-z0-9.+\n\x01-]+"
LINE_EDGES = r"[ .+-]*([\n\x01])[ .+-]*"
GAP = "[.+-]* [ .+-]*"


def sentence_pattern(sentences: dict[str, str]) -> str:
    """A pattern of whole sentences between ends or line breaks, the longest first; a gap between words is as
    given, or a line break, at whose sides no punctuation is left."""

    def one(sentence: str) -> str:
        words, gaps = re.split(GAP, sentence), re.findall(GAP, sentence)
        safe = lambda x: re.sub("([.+-])", r"[\1]", x)
        return safe(words[0]) + "".join((f"[{g}\n]" if g == " " else f"(?:{safe(g)}|\n)") + safe(w) for g, w in zip(gaps, words[1:], strict=True))

    return f"(?<![^\n{END}])(?:{'|'.join(one(x) for x in sorted(sentences, key=lambda x: (-len(x), x)))})(?![^\n{END}])"


def anchors(sentences: dict[str, str]) -> list[str]:
    """A few words of letters of which every sentence has one, also in a text that names another holder: texts without any of
    them hold no known sentence."""
    left = []
    for sentence in sentences:
        for _, held in HOLDERS:
            sentence = sentence.replace(held, " ")
        words = {w for w in sentence.split(" ") if w.isalpha()}
        left.append({w for w in words if len(w) >= 7} or words)  # long words are rare in other texts
    if not all(left):
        return [""]  # a sentence without such a word: every text is looked at
    out = []
    while left:
        every = {w for words in left for w in words}
        best = max(sorted(every), key=lambda w: (sum(w in words for words in left), len(w)))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def scan_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (array, in order), matches (array of struct<rule int,
    license, n>, by rule), licenses (sorted, distinct) of every document, its whole text.

    A known sentence stands between sentence ends, line breaks or both, and may itself be wrapped over lines, with
    comment marks that are no letters; a blank line ends it. Whoever a clause of HOLDERS names stands for the
    holder. Of sentences that begin at one place the longest
    counts. Null, empty and unlicensed texts have empty arrays. Repeated rows are scanned each; other columns than
    doc_id and text aren't read. One narrow pass: no shuffle, and the sentence table is a literal. Texts with no word of
    anchors() are settled by a byte search."""
    words = lambda x: re.sub(GAP, " ", x)
    known = F.create_map(*[F.lit(x) for k, v in sentences.items() for x in (words(k), v)])
    text = F.translate(F.coalesce("text", F.lit("")), UPPER + END, LOWER + " ")
    for pattern, by in ((SOFT, "\n"), (HARD, END), (LINE_JUNK, " "), (LINE_EDGES, "$1"), (EDGES, ""), *[(re.sub(r" (?![^\[]*\])", r"[ \n]", x), y) for x, y in HOLDERS]):
        text = F.regexp_replace(text, pattern, by)
    found = F.regexp_extract_all(text, F.lit(sentence_pattern(sentences)), F.lit(0))
    ids = F.transform(found, lambda x: known[F.regexp_replace(F.translate(x, "\n", " "), GAP, " ")])
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    near = reduce(lambda a, b: a | b, [F.contains("__low", F.lit(w)) for w in anchors(sentences)], F.lit(False))
    df = work.pick(docs, "doc_id", "text").withColumn("__low", low)
    df = df.select("doc_id", F.when(near, ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    # every identifier is "<id>;": rules are plain strings in it, and what is matched becomes "|"
    rest = F.concat(F.lit(";"), F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(x, F.lit(";")))))
    df = df.withColumn("rest", rest)
    found = []
    for i, (_, sequence) in enumerate(rules):
        text = ";".join(sequence) + ";"
        # an identifier can't begin inside another: the one before it ended with ";" or "|"
        pattern = f"(?<=[;|]){text.replace('.', '[.]')}"
        df = df.withColumn(f"n{i}", F.regexp_count("rest", F.lit(pattern)).cast("int")).withColumn("rest", F.regexp_replace("rest", pattern, "|"))
        found.append(F.struct(F.lit(i).alias("rule"), F.lit(rules[i][0]).alias("license"), F.col(f"n{i}").alias("n")))
    matches = F.filter(F.array(*found), lambda m: m["n"] > 0)
    return df.select("doc_id", F.size("sentence_ids").alias("n_sentences"), "sentence_ids", matches.alias("matches")).withColumn("licenses", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))))


def op3_sentence_rule_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence sentences and licences."""
    found = scan_licenses(work.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ";").alias("sentence_ids"), F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["rule"], m["license"], m["n"])), ";").alias("matches"), F.array_join("licenses", ";").alias("licenses"))


def oracle() -> str:
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    steps, parts = [], []
    before = "i"
    for n, (name, sequence) in enumerate(RULES):
        text = ";".join(sequence) + ";"
        # RE2 has no look-behind; identifiers never end in another's name, so a marked start does the same
        mark = f"([;|]){text}"
        steps.append(f"r{n} AS (SELECT * REPLACE (regexp_replace(regexp_replace(rest, '{mark}', '\\1|', 'g'), '{mark}', '\\1|', 'g') AS rest), CAST((length(rest) - length(replace(rest, '{text}', ''))) // {len(text)} AS INTEGER) AS n{n} FROM {before})")
        parts.append(f"CASE WHEN n{n} > 0 THEN '{n}:{name}:' || n{n} END")
        before = f"r{n}"
    line = f"regexp_replace(regexp_replace(s, '{JUNK}', ' ', 'g'), '{EDGES}', '', 'g')"
    for pattern, by in HOLDERS:
        line = f"regexp_replace({line}, '{pattern}', '{by}')"
    names = ", ".join(f"CASE WHEN n{n} > 0 THEN '{name}' END" for n, (name, _) in enumerate(RULES))
    return f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ENDS}'),
  lambda s: map {{{known}}}[{line}]), lambda x: x IS NOT NULL) AS ids FROM documents),
i AS (SELECT doc_id, ids, ';' || array_to_string(list_transform(ids, lambda x: x || ';'), '') AS rest FROM s),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_sentences, array_to_string(ids, ';') AS sentence_ids, concat_ws(';', {", ".join(parts)}) AS matches,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ';') AS licenses FROM {before}
"""


ORACLE = oracle()
