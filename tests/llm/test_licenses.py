import hashlib
import os

import pytest

from vellumspark.llm.license_digest import canonical_plain, derived_texts, known_licenses, op6_license_digest, scan_licenses
from vellumspark.llm.license_texts import LICENSES, LONG_LICENSES, SPELLINGS, TITLES

from . import data


def test_known_texts_match_in_any_dress(spark, tmp_path):
    rows = []
    for i, (name, text) in enumerate(sorted(LICENSES.items())):
        dressed = "Copyright (c) 2001 Someone\n  (C) 2002 Other\nCopyright Someone Else, 1999.\n© Us\n\n" + text.upper().replace(" ", " \t " if name == "WTFPL" else "\n  ").replace("LICENSE", "LICENCE").replace(",", " ;")
        rows += [(3 * i, text, name, None, 0), (3 * i + 1, dressed, name, None, 0), (3 * i + 2, text + " more", None, None, 0)]
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS))
    got = {r["doc_id"]: r for r in op6_license_digest(spark, d).collect()}
    for doc_id, text, name, *_ in rows:
        assert got[doc_id]["license_id"] == name
        if doc_id % 3 != 1:
            assert got[doc_id]["text_digest"] == hashlib.sha256(canonical_plain(text).encode()).hexdigest()
    names = [k for k in sorted(LICENSES) for _ in ["", *TITLES.get(k, [])]]
    for doc_id, _ in derived_texts():
        i, kind = divmod(-1 - doc_id, 3)
        assert got[doc_id]["license_id"] == (None if kind == 2 else names[i])


def test_spellings_are_plain_words():
    for left, right in SPELLINGS.items():
        assert canonical_plain(f"a {left} b") == canonical_plain(f"A, {right.title()} b.")
    assert canonical_plain("licence licence sub-licence") == "license license sublicense"


def test_spellings_in_a_row(spark):
    rows = [(1, "licence licence, licences per cent per cent"), (2, "License license licenses percent percent"), (3, "sub licence non commercial")]
    got = {r["doc_id"]: r["text_digest"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()}
    assert got[1] == got[2]
    assert all(got[i] == hashlib.sha256(canonical_plain(t).encode()).hexdigest() for i, t in rows)


def test_list_items_are_not_copyright_lines():
    assert canonical_plain("(a) one\n(c) two\n(c) 2001 Us\nAll rights reserved.\nall rights reserved by us") == "a one c two all rights reserved by us"


LONG = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the system has no licence texts")
def test_long_licenses(spark):
    texts = [(name, open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()) for name, file in LONG.items()]
    docs = spark.createDataFrame([(i, f"COPYRIGHT 1999 Us\n{t.lower()}") for i, (_, t) in enumerate(texts)] + [(99, texts[0][1][:-30])], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(texts)} | {99: None}
    assert all(len(d) == 64 for ds in LONG_LICENSES.values() for d in ds)


@pytest.mark.parametrize("most_known", [50_000, 1])
def test_odd_rows_and_shuffled_join(spark, most_known):
    known = known_licenses(spark, {"x": "Alpha beta, gamma DELTA", "w": "alpha (beta) gamma delta", "none": "Copyright 2020"})
    got = {(r["doc_id"], r["license_id"]) for r in scan_licenses(data.clashing(spark), known, most_known=most_known).collect()}
    assert {(1, "w"), (2, "w"), (3, "w"), (None, "w"), (4, None), (5, None), (6, None), (8, None)} <= got


def test_empty(spark):
    assert scan_licenses(data.empty(spark), known_licenses(spark)).count() == 0
    assert {r["license_id"] for r in scan_licenses(data.odd(spark), known_licenses(spark).limit(0)).collect()} == {None}
