"""The whole list of licence texts, under the titles and in the forms they come in."""

from pathlib import Path

import pytest

from evidence_engine.llm import licences


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    def run(texts):
        d = str(tmp_path_factory.mktemp("licences"))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        return [r.license_id for r in licences.op7(spark, d).orderBy("doc_id").collect()]

    return run


def test_full_texts_and_titles(found):
    known = dict(licences.KNOWN)
    full = {f.stem: f.read_text() for f in (Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    apache = full["Apache-2.0"]
    texts = [*full.values(), apache[: apache.index("APPENDIX")], "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + known["BSD-3-Clause"], "ISC License\n\n" + known["ISC"], apache[:5000]]
    assert found(texts) == [*full, "Apache-2.0", "BSD-3-Clause", "ISC", None] and len(full) == 15


def test_punctuation_wrapping_and_spelling(found):
    import textwrap

    known = dict(licences.KNOWN)
    mit, bsd, apache = known["MIT"], known["BSD-3-Clause"], (Path(licences.__file__).parent / "licence_texts/Apache-2.0.txt").read_text()
    curly = mit.replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”").replace("merge, publish", "merge—publish")
    wrapped = ["\n".join(textwrap.wrap(p, w)) for w in (30, 46, 61) for p in [" ".join(bsd.split())]]
    at_line_start = bsd.replace("above copyright notice", "above\ncopyright notice").replace("THE COPYRIGHT HOLDER", "THE\nCOPYRIGHT HOLDER")
    noticed = ["Copyright (c) 2020 A\n", "© 2021 B\n", "Copyright 1999-2020, C\n", "Copyright Jane Doe <j@x.org>\nAll rights reserved.\n", " * Copyright © D\n"]
    terms = " ".join(apache[: apache.index("APPENDIX")].split())
    reflowed = ["\n".join(textwrap.wrap(terms, w)) for w in range(40, 90, 3)]
    texts = [curly, *wrapped, at_line_start, *(n + "\n" + mit for n in noticed), *reflowed, mit.replace("sublicense", "sub-license"), mit + "\n• more"]
    assert found(texts) == ["MIT", *["BSD-3-Clause"] * 4, *["MIT"] * 5, *["Apache-2.0"] * 17, "MIT", None]


def test_lines_may_end_anywhere(found):
    import textwrap

    known = [(n, t) for n, t in dict(licences.KNOWN).items() if n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Zlib")]
    texts, want = [], []
    for name, text in known:
        for width in range(40, 121):
            texts.append("\n".join(textwrap.wrap(" ".join(text.split()), width)))
            want.append(name)
    assert found(texts) == want


def test_sql_has_the_same_rows(spark, tmp_path):
    import duckdb

    mit = dict(licences.KNOWN)["MIT"]
    texts = [mit, "Copyright (c) 2020 X\nAll rights reserved.\n\n" + mit, "copyright\u00a0notice and\n copyright 1999 Y\n© Z\nthe\ncopyright holders", "Ünï — “x” ١٢ 漢字", None, "", "all rights reserved", "  Copyright Jane\nreleased under the mit licence", "a\ncopyright laws apply\nlicences\u2028programme"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(licences.OP7_SQL).fetchall()) == sorted(map(tuple, licences.op7(spark, str(tmp_path)).collect()))
