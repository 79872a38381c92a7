import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "barline-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def make_bars(n=90, symbols=("A", "B"), seed=7):
    """Bars of a few series, rows shuffled, with one zero volume."""
    rng = np.random.default_rng(seed)
    frames = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.01, n)))
        low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.01, n)))
        frame = pd.DataFrame(
            {
                "symbol": s,
                "date": [dt.date(2023, 11, 1) + dt.timedelta(days=i) for i in range(n)],
                "open": open_, "high": high, "low": low, "close": close,
                "volume": rng.integers(1, 1000, n).astype(float),
            }
        )
        frame.loc[10, "volume"] = 0.0
        frames.append(frame)
    return pd.concat(frames).sample(frac=1, random_state=seed).reset_index(drop=True)


@pytest.fixture(scope="session")
def bars_pdf():
    return make_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return spark.createDataFrame(bars_pdf, "symbol string, date date, open double, high double, low double, close double, volume double")


def by_symbol(df, column):
    """Values of a column in time order, per symbol, as float arrays."""
    pdf = df.select("symbol", "date", column).toPandas().sort_values(["symbol", "date"])
    return {s: g[column].astype(float).to_numpy() for s, g in pdf.groupby("symbol")}
