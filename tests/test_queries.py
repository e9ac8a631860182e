"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lithos import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    rel = sql.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in rel.fetchall())
    assert got == want


#: Texts of one length and one CRC-32, two by two.
ALIKE = [("209452715 text", "995185855 text"), ("889543655 text", "315094915 text")]


def of_documents(spark, folder, name):
    """The query's rows and its SQL's over documents whose checksums collide."""
    (a, b), (c, d) = ALIKE
    texts = {3: a, 1: b, 11: a, 4: c, 2: d, 12: c, 14: a, 20: None, 13: None, 21: "", 15: ""}
    rows = [(k, t, "en" if k % 2 else "fr", "web", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    df = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    rel = con.sql(f"select {', '.join(df.columns)} from ({catalogue.ORACLES[name]})")
    return sorted(tuple(r) for r in df.collect()), sorted(rel.fetchall())


def test_install_state_of_other_contents_with_the_same_checksum(spark, tmp_path):
    got, want = of_documents(spark, tmp_path, "install_state")
    assert got == want
    assert dict(got) == {3: 1, 1: 0, 11: 1, 4: 2, 2: 0, 12: 2, 14: 1, 20: 0, 13: 0, 21: 2, 15: 2}


def test_install_summary_of_other_contents_with_the_same_checksum(spark, tmp_path):
    got, want = of_documents(spark, tmp_path, "install_summary")
    assert got == want
    assert got == [("en", 4, 6, False), ("fr", 3, 5, False)]
