"""Queries on odd texts equal their SQL."""

import duckdb
import pytest

from corpusloom.plans import registry

ODD = [
    "call 11 4444-5555 +54 11 4444-6666 now",
    "call 11 4444-5555,+54 11 4444-6666,11 4444-7777 +1 (555) 123-4567\n+1 (555) 123-4567",
    "at 9:30 11 4444-5555 +54 11 4444-6666 18:00 pm, x:+54 11 4444-5555 11 4444-6666/",
    "ñ12345678 año123456789 1234567ñ ñ9:30 11 4444-5555",
    "ñann@a.example.orgñ éES9121000418450200051332 ñ1234567890123456789012é @añob",
    "ñthe der derü üder THE the_ the² qué que theé",
    "",
    None,
]


def equal(spark, folder, name):
    docs = [(i, t) for i, t in enumerate([*ODD, *[f"{t} " * 12 + f"word{i} " * 90 for i, t in enumerate(ODD)]])]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'es' AS lang", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    got = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["q_all_masks", "q_link_masks", "q_number_masks"])
def test_masks(spark, tmp_path, name):
    equal(spark, tmp_path, name)


def test_chunks(spark, tmp_path):
    equal(spark, tmp_path, "q_document_chunks")


def test_names(spark, tmp_path):
    equal(spark, tmp_path, "q_name_masks")
