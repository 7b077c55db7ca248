"""Every registered query against its SQL in DuckDB, and the entry point."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REFERENCE = sorted(n for n in __spark_entry__.oracle_sql() if n != "pipeline")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def cells(rows):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", REFERENCE)
def test_query_equals_its_sql(spark, sql, name):
    found = __spark_entry__.queries()[name](spark, SF)
    names = sorted(found.columns)
    rows = sql.execute(f"SELECT {', '.join(f'{chr(34)}{n}{chr(34)}' for n in names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert cells(found.select(*names).collect()) == cells(rows)


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["detector_id", "level", "n", "sensitivity"] and got.count() > 0


def test_model_scores(spark):
    row = __spark_entry__.queries()["model_eval"](spark, SF).first()
    assert row.n > 0 and row.mae >= 0


def test_model_eval_scores_rows_that_are_made_already(spark):
    assert not [f for f in __spark_entry__.queries()["model_eval"](spark, SF).inputFiles() if "events" in f]
