import re

import pytest

from nearloom.llm import licenses


def grams(text):
    words = re.sub(r"[\W_]+", " ", "".join(c.lower() if c.isascii() else c for c in text)).split()
    return set(zip(words, words[1:])) or set(words)


def best(passage):
    mine, found = grams(passage), []
    for name, content in licenses.TEMPLATES.items():
        theirs = grams(content)
        d = 2 * len(mine & theirs) / (len(mine) + len(theirs)) if mine else 0
        if d >= 0.8:
            found.append((-d, name))
    return min(found, default=None)


LINES = [
    "Released under the MIT License.", "released UNDER the mit license", "Released under the MIT", "MIT", "",
    "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 today",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0!", "some words that are no notice at all",
    licenses.TEMPLATES["GPL-3.0-or-later"], licenses.TEMPLATES["BSD-style"].upper(), "Released under the MIT License. " * 3,
]


def test_equals_plain_version(doc_frame):
    rows = [(i, line) for i, line in enumerate(LINES)] + [(100, "\n".join(LINES)), (101, "Released under\nthe MIT License.\n\nOther words here")]
    got = sorted((r.doc_id, r.kind, r.number, r.license, round(r.dice, 12)) for r in licenses.scan(doc_frame(rows)).collect())
    want = []
    for i, text in rows:
        parts = [("line", n, p) for n, p in enumerate(text.split("\n"))]
        parts += [("paragraph", n, p) for n, p in enumerate(re.split(r"\n[ \t\r]*\n", text)) if "\n" in p]
        for kind, n, p in parts:
            found = best(p)
            if found:
                want.append((i, kind, n, found[1], round(-found[0], 12)))
    assert got == sorted(want) and {r[3] for r in got} >= {"MIT", "Apache-2.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-3.0-or-later", "BSD-style"}
    assert (101, "paragraph", 0, "MIT", 1.0) in got


def test_odd_rows(doc_frame, odd_rows):
    notice = [(30, "Released under the MIT License.")] * 2
    got = licenses.scan(doc_frame(odd_rows + notice))
    assert [(r.doc_id, r.license) for r in got.collect()] == [(30, "MIT")] * 2
    assert licenses.scan(doc_frame([])).count() == 0
    assert licenses.scan(doc_frame(notice), templates={}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(doc_frame([]), threshold=0)


def test_plan_is_native(doc_frame, capsys):
    licenses.scan(doc_frame([(1, "x")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_planted_notices_of_the_given_documents_are_found(spark):
    lines = ("All rights reserved.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
             "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, n) for r in docs.collect() for n, x in enumerate((r.text or "").split("\n")) if x in lines)
    got = {(r.doc_id, r.number) for r in licenses.scan(docs).filter("kind = 'line' and dice = 1").collect()}
    assert len(want) > 30 and set(want) <= got
