"""The queries that have SQL, against it, on the smallest test tables."""

import os
import re

import duckdb
import pytest

from corpusloom.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    theirs = connection.execute(ORACLE_SQL[name]).df()
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(repr, ours[columns].astype(object).itertuples(index=False, name=None))) == sorted(map(repr, theirs[columns].astype(object).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_base_columns_of_licenses(spark):
    """Words and phrases of every document by regular expressions."""
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    expected = []
    for doc, text in texts.items():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        found = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in found]
        expected.append((doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))))
    rows = QUERIES["op9_license_scan"](spark, SF_DIR).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows) == sorted(expected)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
