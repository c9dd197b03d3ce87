import re

import pytest

from lexisift.llm import license_scan as ls

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "", None, "CC BY", "cc by cc by", "All rights reserved. all-rights RESERVED", "the GNU General Public License, version 3.", "ccby cc  by\n\nby cc",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */ x", "spdx-license-identifier: MIT AND\nnext", "é cc by é", "cc by " * 3000,
    "Released under the MIT License.", "ÀCC by\x85cc by",
]


def brute(text):
    words = PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in ls.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for frame in (docs, more):
        texts = {r.doc_id: r.text for r in frame.collect()}
        rows = ls.license_report(ls.scan_licenses(frame)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id]
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_expressions():
    assert ls.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert ls.postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert ls.evaluate("MIT OR GPL-2.0-only") == ({"mit", "gpl"}, 1.0)
    assert ls.evaluate("(MIT AND GPL-3.0+) OR proprietary") == ({"mit", "gpl", "proprietary"}, 0.3)
    assert ls.evaluate("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl"}, 0.4)
    for bad in ("", "and", "a b", "(a", "a)", "a or", "()", "a (b)"):
        with pytest.raises(ls.ExpressionError):
            ls.evaluate(bad)


def test_labels_of_the_method(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.license_report(ls.scan_licenses(docs)).collect()}
    assert got[7].labels == "apache,gpl,mit" and got[8].labels == "" and got[11].labels == "mit" and got[0].score == 0.5
    assert ls.license_report(ls.scan_licenses(docs.limit(0))).collect() == []


def test_a_very_long_text(spark):
    """Notices at the start, the middle and the end of two million words."""
    filler = "word " * 1_000_000
    text = f"CC-BY {filler}General  Public License {filler}all rights\nreserved"
    row = ls.license_report(ls.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (2_000_008, 3, 0, 2_000_005, "cc-by,gpl,reserved")
