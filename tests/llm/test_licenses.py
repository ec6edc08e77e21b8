"""Planted notices are found by family, and plain text is left alone."""

import random

from wayfold.llm import licenses as L
from wayfold.llm.licenses import TEMPLATES, scan_licenses


def test_planted_notices_and_edges(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 90))) for _ in range(n))
    rows, want = [], {}
    for k, (family, notices) in enumerate(sorted(TEMPLATES.items())):
        rows.append((k, f"{text(3)}\n{notices[0]}.\n{text(2)}"))
        want[k] = family
    rows += [(100 + k, text(5)) for k in range(60)] + [(200, None), (201, ""), (202, "\n\n"), (None, "Released under the MIT License."), (203, "MIT License " * 3000)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, families string")).collect()}
    assert len(got) == len(rows)
    assert {k: got[k].families for k in want} == want
    assert all(got[100 + k].families == "" for k in range(60)) and got[None].families == "mit"
    assert [got[k].n_paragraphs for k in (200, 201, 202)] == [0, 0, 0]


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wrapped_notices_and_several_licences(spark):
    rows = [
        (0, "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published", "gpl"),
        (1, " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that", "bsd"),
        (2, "// This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0. If a copy", "mpl"),
        (3, "Licensed under the MIT License or the Apache License, Version 2.0, at your option", "apache,mit"),
        (4, "Released under the\n\nbest of terms, the license of which is unknown", ""),
        (5, "Licensed under the GNU Lesser General Public License, version 2.1", "lgpl"),
    ]
    got = {r.doc_id: r.families for r in scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {k: f for k, _, f in rows}


def test_templates_against_brute_force(spark):
    """Every family's notices, whole or with words lost, wrapped at any width, are found where a comparison of every
    stretch of words with every template finds them, and nothing else is."""
    rng = random.Random(21)
    prose = [f"word{k}" for k in range(400)]
    rows = []
    for k in range(150):
        text = [rng.choice(prose) for _ in range(rng.randint(0, 120))]
        for family in rng.sample(sorted(L.TEMPLATES), rng.randint(0, 2)):
            own = rng.choice(L.TEMPLATES[family]).split()
            own = [w for w in own if rng.random() > rng.choice([0, 0.1, 0.3])]
            at = rng.randint(0, len(text))
            text[at:at] = own
        width = rng.randint(3, 30)
        rows.append((k, "\n".join(" ".join(text[j : j + width]) for j in range(0, len(text), width))))

    def families(text):
        ws = L.plain_words(text.encode())
        found = set()
        for family, templates in L.TEMPLATES.items():
            for t in templates:
                own = L.plain_words(t.encode())
                others = {w for f, ts in L.TEMPLATES.items() if f != family for o in ts for w in L.plain_words(o.encode())}
                mark = set(own) - others or set(own)
                spans = [ws[a : a + L.STRETCH] for a in range(0, max(len(ws), 1), L.STEP)]
                if any(common([own.index(w) if w in own else -1 for w in part], [own.index(w) for w in own]) >= L.LEAST_SHARE * len(own) and mark & set(part) for part in spans):
                    found.add(family)
        return found

    def common(a, b):
        return L.common_length(b, a)

    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k: families(t) for k, t in rows}
    missed = {k: want[k] - got[k] for k in got if want[k] - got[k]}
    assert sum(map(len, want.values())) > 60 and not missed
    extra = {k: (got[k] - want[k]) for k in got if got[k] - want[k]}
    assert sum(map(len, extra.values())) <= 3, extra  # a notice within one line and across two stretches


def test_licences_in_very_long_texts_and_empty_tables(spark):
    text = "plain words and more of them " * 30_000 + "\nReleased under the MIT License\n"
    got = L.scan_licenses(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r.families for r in got] == ["mit", "mit"]
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
