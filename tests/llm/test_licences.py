"""Licence digests: equivalent forms match, others don't, edge rows."""
import re
import textwrap

from stepcorpus.llm import licence_texts as T
from stepcorpus.llm import licences as L


def test_equivalent_forms_of_a_whole_text(spark):
    mit = dict(L.KNOWN[:1])["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 A. Nother\n\n" + mit.upper()), (3, mit.replace(",", " ;").replace("\n", "\r\n\r\n")), (4, mit + " more"), (5, mit.replace("sublicense", "sublicence")),
            (6, None), (7, ""), (8, "..."), (9, "text\n  released UNDER the MIT Licence!\nLicensed under CC BY-NC 4.0."), (10, "Released under the MIT License. And more"), (10, "SPDX-License-Identifier: ISC"), (None, "SPDX-License-Identifier: ISC")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, license_id string")
    got = sorted(((r.doc_id, r.license_id, r.n_notices, r.notices) for r in L.scan(docs).collect()), key=str)
    want = [(1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, "MIT", 0, ""), (4, None, 0, ""), (5, "MIT", 0, ""), (6, None, 0, ""), (7, None, 0, ""), (8, None, 0, ""),
            (9, None, 2, "CC-BY-NC-4.0,MIT"), (10, None, 0, ""), (10, "ISC", 1, "ISC"), (None, "ISC", 1, "ISC")]
    assert got == sorted(want, key=str)
    assert L.scan(docs.limit(0)).collect() == []


def test_callers_own_texts(spark):
    docs = spark.createDataFrame([(1, "House rules: be kind, whilst here."), (2, "house rules be kind while here")], "doc_id long, text string")
    assert {r.license_id for r in L.scan(docs, known=[("house", "House rules - be kind while here")]).collect()} == {"house"}


def _wrapped(text, width):
    """Paragraphs without a notice of their own, filled to ``width``."""
    return "\n\n".join(p if re.search(r"(?i)copyright (\(c\) |\[)", p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def _license_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license_id for r in sorted(L.scan(docs).collect(), key=lambda r: r.doc_id)]


def test_whole_public_texts_and_titles(spark):
    notice = "Copyright (c) 2020, A. Nother\nAll rights reserved.\n\n"
    cases = [("Apache-2.0", T.APACHE_2), ("GPL-2.0", T.GPL_2), ("GPL-3.0", T.GPL_3), ("MPL-2.0", T.MPL_2), ("CC0-1.0", T.CC0_1), ("BSD-3-Clause", T.BSD_REGENTS),
             ("Apache-2.0", T.APACHE_2.replace("[yyyy] [name of copyright owner]", "2020 A. Nother")), ("Apache-2.0", T.APACHE_2.partition("END OF TERMS")[0]),
             ("ISC", "ISC License\n\n" + notice + L._ISC), ("0BSD", "BSD Zero Clause License\n\n" + notice + L._0BSD),
             ("BSD-2-Clause", "BSD 2-Clause License\n\n" + notice + L._BSD_1 + L._BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + notice + L._BSD_1 + L._BSD_3 + L._BSD_END),
             (None, T.GPL_3 + "more"), (None, T.MPL_2.replace("Covered", "Coloured"))]
    assert _license_ids(spark, [t for _, t in cases]) == [n for n, _ in cases]


def test_hard_wrapped_texts(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + L._ISC_REST
    whole = list(dict.fromkeys((n, t) for n, t in L.KNOWN if len(t) > 500))
    wrapped = [(n, _wrapped(t, w)) for n, t in whole for w in (38, 60, 72, 80)]
    assert any(re.search(r"(?im)^copyright holders?", t) for _, t in wrapped) and any(re.search(r"(?m)^copyright notice", t) for _, t in wrapped)
    cases = [("ISC", isc), ("ISC", isc.upper()), *wrapped]
    assert _license_ids(spark, [t for _, t in cases]) == [n for n, _ in cases]


def test_notices_and_sentences(spark):
    dropped = ["Copyright (c) 2020 A", "# Copyright 2020 A", "(c) 2020 A", "(C) Copyright A", "\u00a9 A", "Copyright \u00a9 A", "Copyright A. Nother", "Copyright by The Authors", "Copyright: \u00c9. Autre",
               " * Copyright Ownly Ltd", "Copyright [yyyy] [name]", "All rights reserved.", "Copyright Lawson"]
    kept = ["copyright notice and", "COPYRIGHT HOLDERS BE LIABLE", "copyright owner\u2019s", "copyright, and", "copyright", "copyrighted by", '"Copyright" also means', "c) You must", "(c) under Patent Claims", "all rights reserved to us"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in dropped + kept], "t string").select("t", L.one_line(L.plain_lines(L.F.col("t"))).alias("x")).collect()}
    assert [t for t in dropped if got[t]] == [] and [t for t in kept if not got[t]] == []


def test_sql_gives_the_same(spark):
    import duckdb
    rows = [(i, t) for i, (_, t) in enumerate(L.KNOWN)] + [(1000 + i, _wrapped(t, 60)) for i, (_, t) in enumerate(L.KNOWN)] + [(2000, None), (2001, "Copyright owner\u2019s\nreleased under the MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with duckdb.connect() as con:
        con.register("documents", docs.toArrow())
        want = con.sql(L.SQL).fetchall()
    assert sorted(map(tuple, L.scan(docs).collect()), key=str) == sorted(want, key=str)
