"""The driver contract on the smallest tables."""

import __spark_entry__ as contract
from checks.compare import canonical, connect


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.count() == 9 and df.columns[:3] == ["symbol", "model", "split"]


def test_some_queries_equal_their_sql(spark, sf):
    con = connect(sf)
    for name in ("bars_by_supplier", "cleaned_features", "roc_auc", "blended_forecasts", "iqr_outliers"):
        got = contract.queries()[name](spark, sf).toPandas()
        assert canonical(got) == canonical(con.execute(contract.oracle_sql()[name]).df()), name
