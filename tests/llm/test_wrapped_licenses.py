"""Licence notices wrapped over several lines."""

from __future__ import annotations

import textwrap

import pytest

from catchwork.llm import licenses

MIT = """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:"""


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), try_new=True)


def test_wrapped_notices(spark, model):
    cases = [(notice, family) for notice, family in ((MIT, "mit"), (GPL, "gpl"), (BSD, "bsd"))]
    rows, want = [], {}
    for notice, family in cases:
        for text in (notice, textwrap.indent(notice, "# ", lambda _: True), textwrap.indent(notice, " * ", lambda _: True), "Some prose here.\n\n" + notice + "\n\nMore prose follows."):
            want[len(rows)] = family
            rows.append((len(rows), text))
    got = {r.doc_id: set(r.families.split(",")) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {i: family in got[i] for i, family in want.items()} == dict.fromkeys(want, True), got


FULL = {
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "bsd-3-clause": BSD + """

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "gpl-3.0": GPL,
    "gpl-2.0": GPL.replace("either version 3", "either version 2"),
    "lgpl-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "agpl-3.0": GPL.replace("GNU General", "GNU Affero General"),
    "mit": MIT,
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.""",
}


@pytest.mark.parametrize("width", [40, 76])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_variants_of_wrapped_notices(spark, model, width, mark):
    def wrapped(text):
        return "\n".join(mark + x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width), ""])

    rows = [(i, wrapped(t)) for i, t in enumerate(FULL.values())]
    got = {r.doc_id: r.variants.split(",") for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [name in got[i] for i, name in enumerate(FULL)] == [True] * len(FULL), got


def test_report(model):
    assert model.report["unknown_kept"] > 0.98 and 0 <= model.report["new_templates"] <= 1


def test_features_by_definition(model):
    """Feature hits of spans against plain counting."""
    spans = [licenses.paragraphs(t.encode())[0] for ts in licenses.TEMPLATES.values() for t in ts] + [[], [b"zzz"]]
    names = {i: (w,) for w, i in model.words.items()}
    by = {i: w for w, i in model.words.items()}
    n = len(model.words)
    names |= {n + i: (by[c // n], by[c % n]) for i, c in enumerate(model.codes.tolist())}
    row, at = licenses._Features(model.words, model.codes)(spans)
    got = sorted(zip(row.tolist(), (names[a] for a in at.tolist()), strict=True))
    known = set(names.values())
    want = sorted((i, g) for i, s in enumerate(spans) for g in [*((w,) for w in s), *zip(s, s[1:], strict=False)] if g in known)
    assert got == want


def test_confirmation_by_definition(spark, model):
    """Every confirmed one-line hit has the stated share of a template's word pairs, and no span without it is confirmed."""
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    cut = [" ".join(t.split()[: max(1, len(t.split()) * k // 10)]) for t in lines for k in (3, 5, 7, 9, 10)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(cut)), "doc_id long, text string"), model).collect()}
    pairs = lambda t: (lambda w: set(zip(w, w[1:])) or {(w[0], b"")})(licenses.paragraphs(t.encode())[0])  # noqa: B905, E731
    for i, t in enumerate(cut):
        held = {f for f, ts in licenses.TEMPLATES.items() if any(len(pairs(t) & pairs(x)) >= 0.6 * len(pairs(x)) for x in ts)}
        assert set(filter(None, got[i].families.split(","))) <= held
    assert all(got[i].families for i, t in enumerate(cut) if t in lines)
