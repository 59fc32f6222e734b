import math
from collections import Counter

import pytest

from tidemill.llm.licenses import LEAST, TEMPLATES, Matcher, documents_as_files, license_scan, passages, tokens


def _cosine(df, n, a, b, all_words):
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if all_words or t in {w for f in TEMPLATES.values() for x in f for w in tokens(x)} else math.log((1 + n) / 2) + 1
    va, vb = ({t: (1 + math.log(c)) * idf(t) for t, c in Counter(x).items()} for x in (a, b))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(va[t] * vb.get(t, 0) for t in va) / (norm(va) * norm(vb))


@pytest.mark.parametrize("all_words", [False, True])
def test_scan_and_inheritance_by_brute_force(spark, all_words):
    prose = "Some prose about other things entirely, which goes on for a while. " * 3
    files = [
        (1, "a/LICENSE", "\n".join(TEMPLATES["MIT"])), (2, "a/b/x.txt", prose), (3, "a/b/c/COPYING.txt", TEMPLATES["GPL-3.0"][1] + "\n" + prose), (4, "a/b/c/d/e.txt", prose),
        (5, "z/y.txt", prose), (6, "top.txt", prose), (7, "a/own.txt", prose + "\nLicensed under the Apache License, Version 2.0.\n"), (8, None, prose), (9, "a/b/none.txt", None), (9, "a/b/none.txt", None),
        (10, "ab/c.txt", prose), (11, "a/b/own.txt", "All rights reserved.\n" + prose), (12, "q/lone", "Released under the MIT License."), (13, "q/r/s", "driver's license office " + prose),
    ]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), all_words=all_words).collect()}
    df = Counter(t for _, _, x in files for t in set(tokens(x or "")))
    matcher = Matcher(df, len(files))
    own = {}
    for i, _, text in files:
        best = max(((_cosine(df, len(files), p, tokens(f), all_words), n) for p in passages(text or "") for n, fs in TEMPLATES.items() for f in fs), default=(0, None))
        assert abs(got[i].similarity - best[0]) < 1e-9 and (all_words or abs(matcher.best(text or "")[1] - best[0]) < 1e-9)
        own[i] = best[1] if best[0] >= LEAST else None
    assert {i: own[i] for i in (1, 3, 7, 11, 12, 13)} == {1: "MIT", 3: "GPL-3.0", 7: "Apache-2.0", 11: "Proprietary", 12: "MIT", 13: None}
    assert {i: (r.licence, r.how, r.licence_dir) for i, r in got.items()} == {
        1: ("MIT", "own", "a"), 2: ("MIT", "inherited", "a"), 3: ("GPL-3.0", "own", "a/b/c"), 4: ("GPL-3.0", "inherited", "a/b/c"), 5: (None, "none", None), 6: (None, "none", None),
        7: ("Apache-2.0", "own", "a"), 8: (None, "none", None), 9: ("MIT", "inherited", "a"), 10: (None, "none", None), 11: ("Proprietary", "own", "a/b"), 12: ("MIT", "own", "q"), 13: ("MIT", "inherited", "q"),
    }


def test_top_directory(spark):
    rows = license_scan(spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c", "x"), (3, "d", "")], "doc_id long, path string, text string")).collect()
    assert {(r.doc_id, r.licence, r.how) for r in rows} == {(1, "MIT", "own"), (2, "MIT", "inherited"), (3, "MIT", "inherited")}


def test_notices_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {r.doc_id: n for r in docs.collect() for line, n in notices.items() if line in r.text.split("\n")}
    got = {r.doc_id: r.licence for r in license_scan(documents_as_files(docs)).where("how = 'own'").collect()}
    assert len(want) > 20 and all(got.get(d) == n for d, n in want.items())


def test_odd_rows(odd_docs, empty_docs):
    assert license_scan(documents_as_files(odd_docs)).count() == odd_docs.count()
    assert license_scan(documents_as_files(empty_docs)).count() == 0


def test_all_words_have_their_frequencies(spark, monkeypatch):
    import tidemill.llm.licenses as m

    monkeypatch.setattr(m, "FREQUENT", 2)
    texts = ["some about thing Released under a License.", "some about thing Released under the MIT License."] + [f"some about thing word{i} and so on" for i in range(199)] + [None]
    files = [(i, f"f/{i}", x) for i, x in enumerate(texts)]
    rows = license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), all_words=True).orderBy("doc_id").collect()
    df = Counter(t for x in texts for t in set(tokens(x or "")))
    idf = lambda t: math.log((1 + len(texts)) / (1 + df[t])) + 1
    vector = lambda words: {t: (1 + math.log(c)) * idf(t) for t, c in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = 0.0
    for p in passages(texts[0]):
        for fs in TEMPLATES.values():
            for f in fs:
                a, b = vector(p), vector(tokens(f))
                best = max(best, sum(a[t] * b.get(t, 0) for t in a) / (norm(a) * norm(b)))
    assert abs(rows[0].similarity - best) < 1e-9 and rows[0].how != "own"
    assert (rows[1].licence, rows[1].how) == ("MIT", "own") and rows[1].similarity > 0.9 and len(rows) == len(texts)
    assert all(r.similarity == 0 for r in rows[2:])


NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary",
}


def test_all_notices_of_documents(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cue = "(?i)licen[cs]ed? |copyright|rights reserved|creative commons"
    lines = {r.line for r in docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(cue)).distinct().collect()}
    assert lines <= NOTICES.keys() and "Licensed under CC BY-NC 4.0." in lines
    got = {r.doc_id: r.licence for r in license_scan(documents_as_files(docs), all_words=True).where("how = 'own'").collect()}
    want = {r.doc_id: {n for line, n in NOTICES.items() if line in (r.text or "").split("\n")} for r in docs.collect()}
    want = {d: x for d, x in want.items() if x}
    assert got.keys() == want.keys() and all(got[d] in x for d, x in want.items())


def test_versions_and_kinds_agree():
    header = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    bsd = "Copyright 2020 X. All rights reserved.\n" + TEMPLATES["BSD-3-Clause"][1]
    m = Matcher({}, 1000)
    for text, want in (
        *NOTICES.items(), (header.format(2), "GPL-2.0"), (header.format(3), "GPL-3.0"), (header.format(1), None), (header.format(2).replace("GNU General", "GNU Library General"), None),
        (header.format("2.1").replace("GNU General", "GNU Lesser General"), "LGPL-2.1"), (header.format(3).replace("GNU General", "GNU Affero General"), "AGPL-3.0"), ("Licensed under CC BY 3.0.", None),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Zlib License.", None),
        (bsd, "BSD-2-Clause"), (bsd + "\nNeither the name of X may be used to endorse or promote products.", "BSD-3-Clause"),
    ):
        name, cosine, _ = m.best(text)
        assert name == want, (text, name, cosine)


def test_notices_inside_lines_and_whole_texts(spark):
    from tidemill.llm.licenses import FULL_TEXTS

    prose = "Here is much else that one reads in long paragraphs of plain prose about rivers, towns and weather. " * 30
    header = TEMPLATES["GPL-2.0"][1]
    apache, gpl = (" ".join(FULL_TEXTS[n]) for n in ("Apache-2.0", "GPL-3.0"))
    lines = lambda t: "\n".join(t[i : i + 70] for i in range(0, len(t), 70))
    texts = {
        prose + "Released under the MIT License. " + prose: ("MIT", False), "Copyright 2024 Example Authors. Released under the MIT License.": ("MIT", None), prose + header + " " + prose: ("GPL-2.0", False),
        prose.strip() + "\n" + prose + " This work is licensed under the\n# GNU General Public\n# License, version 3. " + prose: ("GPL-3.0", False), prose: (None, False), prose + " her driver's license " + prose: (None, False),
        apache: ("Apache-2.0", True), lines(gpl): ("GPL-3.0", True), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + gpl.split("2007", 1)[1].replace("gnu general public", "gnu affero general public"): ("AGPL-3.0", True),
        " ".join(FULL_TEXTS["BSD-2-Clause"]): ("BSD-2-Clause", True), "Copyright (c) X. All rights reserved.\n" + " ".join(FULL_TEXTS["BSD-3-Clause"]): ("BSD-3-Clause", True),
    }
    files = [(i, f"f{i}/x", t) for i, t in enumerate(texts)]
    for all_words in (True, False):
        got = {r.doc_id: r for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), all_words=all_words).collect()}
        for i, (licence, most) in enumerate(texts.values()):
            assert got[i].licence == licence and most in (None, got[i].is_licence_file), (i, all_words, got[i])


def test_odd_rows_with_all_words(odd_docs, empty_docs):
    assert license_scan(documents_as_files(odd_docs), all_words=True).count() == odd_docs.count()
    assert license_scan(documents_as_files(empty_docs), all_words=True).count() == 0


def test_identifiers_and_denials():
    """SPDX lines are templates; what is said not to be licensed isn't."""
    matcher = Matcher(Counter(), 0)
    for name in TEMPLATES:
        if name != "Proprietary":
            for line in (f"# SPDX-License-Identifier: {name}\ncode()\n", f"/* SPDX-License-Identifier: {name} */"):
                assert matcher.best(line)[0] == name, line
    assert matcher.best("// SPDX-License-Identifier: LicenseRef-Other")[0] is None
    assert matcher.best("This software is NOT licensed under the MIT License.")[0] is None
    assert matcher.best("It isn't released under the Apache License, Version 2.0 or any other.\nReleased under the MIT License.")[0] == "MIT"
    assert matcher.best("This file is licensed under the MIT License.")[0] == "MIT"
