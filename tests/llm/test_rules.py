"""Line rules, licences, revisits and top-k against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm import license, linerules, topk, warc

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_words", T.StringType()), ("ids", T.StringType()))])


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", None) for k, t in enumerate(texts)], SCHEMA)


def sound(text):
    """Lines without a fault, paragraph by paragraph."""
    out = set()
    for part in re.split(r"\n(?:[\x20\x09-\x0D]*\n)+", "\n" + (text or "") + "\n"):
        lines = [x for x in part.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        for k, x in enumerate(lines):
            # a stop behind the line leaves only the rule that asks for one
            unended = linerules.line_fault(x) == "punctuation" and linerules.line_fault(x + ".") is None
            later = any(re.search(linerules.ENDED, y) for y in lines[k + 1 :])
            if linerules.line_fault(x) is None or unended and later and max(map(len, lines)) <= 100:
                out.add(x)
    return out


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    spans = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, s in enumerate(spans) if spans.count(s) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_line_rules(spark):
    r = random.Random(4)
    texts = [None, "", " \n ", "one", "a b a b a b a b", "é ü #*$ |<>", "x\nx\n x\n\nx"]
    for _ in range(40):
        texts.append("\n".join(" ".join(r.choices(["a", "bé", "c,", "d|", "#", "E!", "end."], k=r.randrange(0, 12))) for _ in range(r.randrange(1, 9))))
    texts.append("word next after that. " * 20000)
    got = {x.doc_id: x for x in linerules.clean_lines(frame(spark, texts)).collect()}
    for k, t in enumerate(texts[:-1]):
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == plain(t)
        good = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x) and x in sound(t)]
        assert g.clean_text == "\n".join(good)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)
    assert got[len(texts) - 1].n_words == 80000 and got[len(texts) - 1].base_failed
    assert linerules.clean_lines(frame(spark, texts).limit(0)).count() == 0


def test_line_faults():
    fault = linerules.line_fault
    assert fault("A plain sentence that ends.") is None
    assert fault("Home") == "navigation" and fault("a | b | c d e f g h i") == "navigation"
    assert {fault(x) for x in ("Startseite Kontakt Impressum Datenschutz", "Accueil, Contact, Mon compte".replace("Mon ", ""), "Inicio · Noticias · Contacto · Ayuda", "One » Two » Three and a few more words")} == {"navigation"}
    assert {fault(x) for x in ("Alle Rechte vorbehalten, heute.", "Tous droits réservés par eux ici.", "Lea la POLÍTICA DE PRIVACIDAD de ellos.")} == {"boilerplate"}
    assert fault("a line of ten words or more in which nothing ever ends") == "punctuation" and fault("it ends here. But the line goes on for some more words") is None
    assert fault("## ** $$") == "punctuation" and fault("NOW!! BUY!!") == "punctuation" and fault("... --") == "punctuation"
    assert fault("Copyright 2020, All Rights Reserved by them.") == "boilerplate"


def test_clashing_columns(spark):
    docs = frame(spark, ["one two.", None]).withColumn("kept", F.lit("x")).withColumn("clean_text", F.lit(1)).withColumn("n_lines", F.lit(None))
    assert "clean_text" not in linerules.clean_lines(docs, with_text=False).columns
    assert {r.doc_id: (r.kept, r.clean_text) for r in linerules.clean_lines(docs).collect()} == {0: (False, "one two."), 1: (False, "")}


def test_rejects_what_loses_too_much(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    menu = "\n".join(["Home", "About", "Contact"] * 60)
    got = {x.doc_id: x.kept for x in linerules.clean_lines(frame(spark, [good, good + "\n" + menu])).collect()}
    assert got[0] and not got[1]


def test_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    texts = [None, "", "Nothing here.", "Text.\nReleased under the MIT License.", "RELEASED under the MIT   License. Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.\nmore\nAll rights reserved.", bsd, "All rights reserved.\nAll rights reserved.", "filler line. " * 30000 + "\nReleased under the MIT License."]
    got = {r.doc_id: r for r in license.scan_licenses(frame(spark, texts)).collect()}
    assert [got[k].licenses for k in range(9)] == [[], [], [], ["MIT"], ["CC-BY-NC-4.0", "MIT"], ["Apache-2.0", "all-rights-reserved"], [], ["all-rights-reserved"], ["MIT"]]
    assert got[6].sentence_ids == ["bsd-grant", "bsd-source"] and got[7].matches[0].n == 2
    assert license.scan_licenses(frame(spark, []).limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright 2020 Someone. All rights reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_licenses(spark):
    given = {MIT: ["MIT"], BSD: ["BSD-3-Clause", "all-rights-reserved"], ISC: ["ISC"], APACHE: ["Apache-2.0"], GPL: ["GPL-3.0-or-later"], MPL: ["MPL-2.0"]}
    marks = ("", "# ", "// ", " * ", "-- ", ";; ")
    texts, want = [], []
    for text, names in given.items():
        for mark in marks:
            texts.append("x = 1\n" + "".join(f"{mark}{x}\n" for x in text.splitlines()) + "\ny = 2\n")
            want.append(names)
        texts += [text.replace("\n", "\r\n"), text.replace("(the", "\n(the").replace(" of ", "\nof ")]
        want += [names, names]
    # a blank line ends a sentence; lines without a full stop are still read by themselves
    texts += ["Released under the\n\nMIT License", "Someone\nAll rights reserved\nReleased under the\nMIT License\nmore"]
    want += [[], ["MIT", "all-rights-reserved"]]
    got = {r.doc_id: r.licenses for r in license.scan_licenses(frame(spark, texts)).collect()}
    assert [(k, got[k]) for k in range(len(texts))] == list(enumerate(want))


HELD = BSD.replace("Neither the name of the copyright holder nor the names of its contributors", "Neither the name of Some Organization, Inc. nor the names of its\n   contributors")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
AGPL = GPL.replace("GNU General", "GNU Affero General")


def test_named_holders_and_more_licenses(spark):
    got = {r.doc_id: r.licenses for r in license.scan_licenses(frame(spark, [HELD, ZLIB, AGPL, "# " + HELD.replace("\n", "\n# "), "Neither the name of this nor that."])).collect()}
    assert got == {0: ["BSD-3-Clause", "all-rights-reserved"], 1: ["Zlib"], 2: ["AGPL-3.0-or-later"], 3: ["BSD-3-Clause", "all-rights-reserved"], 4: []}


def test_every_sentence_has_an_anchor(spark):
    """Each known sentence alone in a text is found, so no anchor is missing; holders' clauses too, whoever they name."""
    words = license.anchors(license.SENTENCES)
    assert len(words) < 15 and all(any(w in s for w in words) for s in license.SENTENCES)
    texts = [f"x\n{s}\ny" for s in license.SENTENCES]
    got = {r.doc_id: r.sentence_ids for r in license.scan_licenses(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [[v] for v in license.SENTENCES.values()]
    assert license.anchors({"1.0 2": "x"}) == [""] and license.anchors({}) == []


def test_longer_rules_win(spark):
    rules = (("both", ("a", "b")), ("one", ("a",)), ("two", ("b",)))
    found = license.scan_licenses(frame(spark, ["first\nsecond\nnoise\nfirst\nthird", "second\nfirst", "first\nnoise\nsecond"]), {"first": "a", "second": "b", "third": "c"}, rules).orderBy("doc_id").collect()
    assert [[(m.license, m.n) for m in r.matches] for r in found] == [[("both", 1), ("one", 1)], [("one", 1), ("two", 1)], [("both", 1)]]


RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, target_id string"


def test_revisits(spark):
    ok = {"ETag": '"1"', "Content-Type": "a", "Date": "d1", "X": "y"}
    rows = [
        (1, "http://www.A.com/x/?utm_source=q#f", 10, "response", 200, ok, "D1", ""), (2, "https://a.com:443/x", 20, "response", 404, ok, "D2", ""), (3, "http://a.com/x", 30, "revisit", 304, {"etag": 'W/"1"', "date": "d3", "content-type": "no"}, None, ""),
        (4, "http://a.com/x", 10, "revisit", 304, {"etag": '"1"'}, None, ""), (5, "http://a.com/x", 40, "revisit", 304, {"etag": '"2"'}, None, ""), (6, "http://a.com/x", 40, "revisit", 304, {}, None, ""), (7, None, 40, "revisit", 304, {"etag": '"1"'}, None, ""),
        (8, "http://a.com/x", None, "revisit", 304, None, None, ""), (9, "http://a.com/x", 35, "response", 200, None, "D9", ""), (9, "http://a.com/x", 30, "request", 200, ok, "D9", ""), (10, "http://a.com/x", 36, "revisit", 304, {"etag": '"1"'}, None, ""),
    ]
    for rows_a_range in (1, 3, 100):
        got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD), rows_a_range).collect()}
        assert {k: (r.target_id, r.verdict) for k, r in got.items()} == {3: (1, "resolved"), 4: (None, "orphan"), 5: (9, "unvalidated"), 6: (9, "unvalidated"), 7: (None, "orphan"), 8: (None, "orphan"), 10: (9, "unvalidated")}
        assert got[3].headers == {"etag": 'W/"1"', "content-type": "a", "date": "d3", "x": "y"} and got[3].digest == "D1" and got[5].digest is None
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_of_one_hot_url(spark):
    """One URL holds all rows: every number of time ranges gives what a plain search gives."""
    r = random.Random(1)
    rows = [(k, "http://h.org/", r.randrange(400), r.choice(["response", "revisit"]), 200, {"etag": str(r.randrange(3))}, f"D{k}", "") for k in range(600)]
    want = {}
    for k, _, ts, kind, _, h, _, _ in rows:
        if kind == "revisit":
            last = max(((t, i, g["etag"]) for i, _, t, a, _, g, _, _ in rows if a == "response" and t < ts), default=None)
            want[k] = (last and last[1], "orphan" if last is None else "resolved" if last[2] == h["etag"] else "mismatch")
    for rows_a_range in (5, 90, 1000):
        got = {x.record_id: (x.target_id, x.verdict) for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORD), rows_a_range).collect()}
        assert got == want


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SCORE_ROWS", 50)
    rng = np.random.default_rng(8)
    vectors = rng.choice([-0.5, 0.0, 0.25, 0.1], (230, 6)).astype(np.float32).astype(float).tolist()
    rows = [(k, v, 0) for k, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0], 0), (1002, [float("nan")] * 6, 0), (1003, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0), (1010, [1e30] * 6, 0), (1020, [0.5, 0.5], 0)]
    df = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    got = topk.top_k(df, df.filter(F.col("vec_id") % 10 == 0)).collect()
    ints = {k: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for k, v in enumerate(vectors)}
    ints[1010] = [int(np.float32(1e30)) * 1024] * 6
    ints[1020] = [512, 512, 0, 0, 0, 0]
    fits = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
    want = []
    for q in ints:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)[:10]
            want += [(q, i + 1, c, fits(-s), None if fits(-s) is not None else str(abs(s))) for i, (s, c) in enumerate(best)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_large_weights(spark):
    vectors = {0: [70000.0, 1e6, -3.0], 1: [1e5, 0.5, 0.0], 2: [0.25, -1e6, 1.0], 3: [1e8, -1e3, 0.0], 4: [3e12, 2.0, -7e9], 10: [1e-3, 0.5, 1e7]}
    df = topk.usable(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df.filter("vec_id <> 4"), df.filter("vec_id % 10 = 0")).collect()}
    ints = {k: [int(np.floor(1024 * x)) for x in v] for k, v in vectors.items()}
    assert got == {(q, c): sum(a * b for a, b in zip(ints[q], ints[c], strict=True)) for q in (0, 10) for c in (0, 1, 2, 3, 10) if c != q}
    # the sum leaves the long range on the way and comes back
    w = spark.createDataFrame([(1, [2.0**30, 2.0**30]), (2, [2.0**30, -(2.0**30) + 2.0**-10])], "vec_id long, embedding array<double>")
    assert {r.score for r in topk.top_k(w, w).collect()} == {1 << 40}
    # scores beyond a long are ranked all the same
    wide = {20: [1e200, -1.0], 21: [1e150, 0.0], 22: [-1e150, 0.0], 23: [-1e160, 0.0], 24: [0.0, 1.0], 25: [1.7e308, 5.0]}
    df = topk.usable(spark.createDataFrame(list(wide.items()), "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.filter("vec_id = 20")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(25, None), (21, None), (24, -1024 * 1024), (22, None), (23, None)]
    assert got[1].digits == str(int(1e200) * int(1e150) * 1024 * 1024)


def test_top_k_takes_large_components(spark):
    df = topk.usable(spark.createDataFrame([(0, [1.0, 1.0]), (1, [70000.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 70001 << 20), (2, 3 << 20)]


def test_revisits_in_a_burst(spark):
    """Most records within a few moments of one URL: ranges follow the counts."""
    r = random.Random(3)
    rows = [(k, "http://h.org/", 10**9 + r.randrange(6) if k % 10 else r.randrange(2 * 10**9), r.choice(["response", "revisit"]), 200, {"etag": "1"}, "D", "") for k in range(500)]
    rows += [(500, "http://h.org/", None, "revisit", 200, {"etag": "1"}, "D", "")]
    want = {k: max(((t, i) for i, _, t, a, *_ in rows if a == "response" and t < ts), default=(None, None))[1] if ts is not None else None for k, _, ts, kind, *_ in rows if kind == "revisit"}
    for rows_a_range in (20, 100, 10**6):
        assert {x.record_id: x.target_id for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORD), rows_a_range).collect()} == want


def test_index_pages_are_their_folders(spark):
    same = ["http://a.org/x/index.html", "https://www.a.org/x/index.htm?utm_source=q#top", "http://a.org/x/INDEX.PHP", "http://a.org/x/default.aspx", "http://a.org/x/"]
    other = {"http://a.org/x/myindex.html": "a.org/x/myindex.html", "http://a.org/y?u=/index.html": "a.org/y?u=/index.html", "http://a.org/x/index.html/z": "a.org/x/index.html/z", "http://a.org/x/index.php?id=3": "a.org/x/?id=3", "http://a.org/index.html": "a.org"}
    got = spark.createDataFrame([(u,) for u in [*same, *other]], "url string").select(warc.canonical_url(F.col("url")).alias("k")).collect()
    assert [r.k for r in got] == ["a.org/x"] * len(same) + list(other.values())
    rows = [(1, same[0], 10, "response", 200, {"etag": "1"}, "D", ""), (2, same[4], 20, "revisit", 304, {"etag": "1"}, None, "")]
    found = warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).first()
    assert (found.target_id, found.verdict) == (1, "resolved")


def test_repeated_query_ids_are_rows_of_their_own(spark, monkeypatch):
    rows = [(k % 5, [float(k), 1.0]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    results = []
    for block in (1, 2, 4096):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        got = topk.top_k(df, df.filter("vec_id < 2"), 3).collect()
        assert len(got) == 6 * 3 and sorted(r.rank for r in got) == sorted([1, 2, 3] * 6)
        results.append(sorted(map(repr, got)))
    assert results[0] == results[1] == results[2]


def test_paths_keep_their_case(spark):
    at = "etag"
    rows = [(1, "http://X/A", 1, "response", 200, {at: "q"}, "dA"), (2, "HTTP://u@WWW.x:80/a", 2, "response", 200, {at: "q"}, "da"), (3, "http://x/A#f", 3, "revisit", 304, {at: "q"}, None), (4, "http://x/a/", 4, "revisit", 304, {at: "q"}, None), (5, "https://x?Q=A", 5, "revisit", 304, {at: "q"}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string")
    got = {r.record_id: (r.url_key, r.target_id, r.digest) for r in warc.resolve_revisits(df).collect()}
    assert got == {3: ("x/A", 1, "dA"), 4: ("x/a", 2, "da"), 5: ("x?Q=A", None, None)}


def test_wrapped_prose_is_kept(spark):
    import textwrap

    prose = "The committee that met in the old town hall on the hill decided after a long and open debate to leave the bridge as it was, " * 3 + "which pleased nobody. "
    text = prose * 3
    hindi = "यह एक बहुत लंबा वाक्य है जो बारह से अधिक शब्दों के साथ लिखा गया है और यहाँ समाप्त होता है। " * 6
    junk = "\n".join(f"word{k} and some more words that go on and on without any end of a sentence {k}" for k in range(9))
    texts = [textwrap.fill(text, 72), textwrap.fill(text, 80), text, hindi.replace("। ", "।\n"), junk, junk + "\n\n" + textwrap.fill(text, 80)]
    got = {r.doc_id: r for r in linerules.clean_lines(frame(spark, texts)).collect()}
    assert [got[k].base_failed or got[k].kept for k in range(4)] == [True] * 4
    assert [got[k].kept_chars == got[k].word_chars for k in range(6)] == [True, True, True, True, False, False]
    assert got[4].kept_chars == 0 and got[5].punctuation_lines == 9
    # a line that is too long for a wrapped paragraph, and a sentence that never ends
    assert linerules.line_faults("x " * 60 + "\nand it ends.")[0][1] == "punctuation"
    assert [f for _, f in linerules.line_faults("one two three four five six seven eight nine ten\neleven\n\nEnd.")] == ["punctuation", "navigation", None]


def test_usual_headers_are_named(spark):
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License {} published by\nthe Free Software Foundation{}.\n\nThis program is distributed in the hope that it will be useful."
    texts = {
        gpl.format("as", ", version 3 of the License"): ["GPL-3.0-only"], gpl.format("as", ", version 2"): ["GPL-2.0-only"], gpl.format("version 2 as", ""): ["GPL-2.0-only"],
        gpl.format("as", "; either version 2\nof the License, or (at your option) any later version"): ["GPL-2.0-or-later"],
        "To the extent possible under law, Jane Doe and others have waived all copyright and\nrelated or neighboring rights to this work.": ["CC0-1.0"],
        "This package is licensed under the MIT License.": ["MIT"], "The foo-bar 2.1 library is released under the terms of the Apache License, Version 2.0.": ["Apache-2.0"],
        " * Licensed to the Apache Software Foundation (ASF) under one or more\n * contributor license agreements.  See the NOTICE file.\n * The ASF licenses this file to You under the Apache License, Version 2.0\n * (the \"License\"); you may not use this file except in compliance with\n * the License.  You may obtain a copy of the License at\n *": ["Apache-2.0"],
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": ["GPL-3.0-only"], "   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/": ["Apache-2.0"],
        "Subject to the terms and conditions of\n      this License, each Contributor hereby grants to You a perpetual,\n      worldwide, non-exclusive, no-charge, royalty-free, irrevocable\n      copyright license to reproduce, prepare Derivative Works of,\n      publicly display, publicly perform, sublicense, and distribute the\n      Work and such Derivative Works in Source or Object form.": ["Apache-2.0"],
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.": ["OFL-1.1"], "The parcel is delivered under the bridge. This code is not licensed.": [],
    }
    got = {r.doc_id: r.licenses for r in license.scan_licenses(frame(spark, list(texts))).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())
