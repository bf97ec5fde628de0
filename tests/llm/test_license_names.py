"""Expressions, references and headers, against what they say."""

import pytest

from kinfold.llm import licenses

CASES = {
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": "MIT,Apache-2.0",
    "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause": "GPL-2.0-or-later,Classpath-exception-2.0,BSD-3-Clause",
    "/* SPDX-License-Identifier: LGPL-2.1-only */": "LGPL-2.1-only",
    " * SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "SPDX-License-Identifier: Zlib": "Zlib",
    "This project is licensed under the Apache License, Version 2.0": "Apache-2.0",
    "The whole of it is distributed under the terms of the Boost Software License, Version 1.0. See the file.": "BSL-1.0",
    "All files are released under the Mozilla Public License 2.0 unless stated.": "MPL-2.0",
    "Available under CC0 1.0, a public domain dedication.": "CC0-1.0",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": "GPL-2.0-only",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.": "LGPL-3.0-or-later",
    "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": "Zlib",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "EPL-2.0",
    "We went under the bridge and found the software there.": "",
    "The licensed driver passed under the mitigation plan.": "",
}


def test_cases(spark):
    rows = list(enumerate(CASES))
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == CASES


def test_unknown_identifiers_are_reported(spark):
    r = licenses.scan(spark.createDataFrame([(1, "SPDX-License-Identifier: MIT AND LicenseRef-Own-1.0")], "doc_id long, text string")).first()
    assert (r.licenses, r.unmatched) == ("MIT", "spdx:licenseref-own-1-0")


def test_a_copyright_line_inside(spark):
    mit = [k.capitalize() + "." for k, v in licenses.SENTENCES.items() if v in ("mit_permission", "mit_notice")]
    r = licenses.scan(spark.createDataFrame([(1, f"{mit[0]}\n\nCopyright 2020 Somebody\n\n{mit[1]}")], "doc_id long, text string")).first()
    assert (r.licenses, r.unmatched) == ("MIT", "")


@pytest.mark.parametrize("i", range(0, 200, 7))
def test_every_identifier_is_found(i):
    ids = licenses.SPDX_IDS[i : i + 7]
    assert len(set(licenses.spdx_names())) == len(licenses.SPDX_IDS)
    assert all(v == f"spdx={k}" for k, v in zip(ids, [licenses.spdx_names()[s] for s in (licenses.re.sub("[^a-z0-9]+", " ", x.lower()).strip().replace(" or later", " orlater") for x in ids)]))


def test_same_in_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses, r.unmatched) for r in licenses.scan(df).collect()}
    assert got == {r[0]: r[1:] for r in duckdb.sql(licenses.oracle_sql(f"'{tmp_path}/d/*.parquet'")).fetchall()}
