"""Every query that has SQL agrees with it, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: SQL that inverts a matrix, which has not full rank with as few entities as here.
DEEP = ("impute_multivariate",)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")) and n not in DEEP])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda r: sorted((tuple(x) for x in r), key=str)
    places = [want.columns.index(c) for c in columns]
    assert rows([x[c] for c in columns] for x in got.collect()) == rows([x[i] for i in places] for x in want.fetchall())


@pytest.mark.parametrize("name", DEEP)
def test_deep_query(spark, name):
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = lambda r: sorted((tuple(x) for x in r), key=str)
    places = [want.columns.index(c) for c in columns]
    assert rows(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, sf).collect()) == rows([x[i] for i in places] for x in want.fetchall())


@pytest.mark.parametrize("name", ["impute_multivariate", "impute_multivariate_gd", "impute_consolidated_gd"])
def test_dense_imputers_fill_everything(spark, name):
    out = entry.queries()[name](spark, SF)
    assert out.where("score is null or isnan(score)").count() == 0 and out.where("not is_known").count() > 0


@pytest.mark.parametrize("name", ["impute_multivariate", "impute_multivariate_gd", "impute_consolidated_gd"])
def test_dense_imputers_take_the_whole_grid(spark, name):
    from scoreweave.plans import fixtures as X

    keys = lambda df: {(r.entity, r.metric) for r in df.select("entity", "metric").collect()}
    assert keys(entry.queries()[name](spark, SF)) == keys(X.grid(spark, SF))


@pytest.mark.parametrize("name", ["holdout_mse_mean_all", "holdout_mse_bivariate_all", "holdout_mse_observation"])
def test_accuracy_rests_on_all_holdouts(spark, name):
    assert entry.queries()[name](spark, SF).first().tests == 100


def test_refits_write_no_copies_for_hold_outs(spark):
    """100 copies of the grid were what filled the disk."""
    from pathlib import Path

    from scoreweave.plans import fixtures as X

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    assert entry.queries()["holdout_mse_bivariate_all"](spark, SF).first().tests == 100
    written = [spark.read.parquet(str(p)).count() for p in set(folder.iterdir()) - before]
    assert written and max(written) <= X.observations(spark, SF).count()
