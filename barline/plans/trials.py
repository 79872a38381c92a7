"""Trial lists of the sweeps.  Fixed values throughout this module."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Trial:
    """One configuration; ``trial_id`` is unique in its list, ``name`` is a label several trials may share."""

    trial_id: int
    family: str
    name: str
    trees: int
    depth: int
    leaf: int
    columns: str
    rate: float | None = None
    rows: float = 1.0


# The configurations of every sweep, in their order.
RIDGE_GRID = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
RIDGE_LEAN_GRID = (0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0)
RIDGE_ROUND_2 = (80, 90, 95, 100, 105, 110, 120, 150, 200, 250)
RIDGE_ROUND_3 = (300, 400, 500, 750, 1000, 1500, 2000, 3000)
LASSO_ALPHA = 0.01
ELASTIC_NET = (0.3, 0.5)
ELASTIC_NET_LEAN = (0.5, 0.5)

XGB_TRIALS = (
    Trial(0, "XGB", "XGB_100_4_50", trees=100, depth=4, leaf=2, columns="0.8", rate=0.05, rows=0.8),
    Trial(1, "XGB", "XGB_100_5_50", trees=100, depth=5, leaf=2, columns="0.8", rate=0.05, rows=0.8),
    Trial(2, "XGB", "XGB_100_6_50", trees=100, depth=6, leaf=2, columns="0.8", rate=0.05, rows=0.8),
    Trial(3, "XGB", "XGB_150_4_50", trees=150, depth=4, leaf=2, columns="0.8", rate=0.05, rows=0.8),
    Trial(4, "XGB", "XGB_100_4_70", trees=100, depth=4, leaf=1, columns="0.85", rate=0.07, rows=0.85),
    Trial(5, "XGB", "XGB_100_5_30", trees=100, depth=5, leaf=2, columns="0.8", rate=0.03, rows=0.8),
    Trial(6, "XGB", "XGB_75_5_50", trees=75, depth=5, leaf=2, columns="0.85", rate=0.05, rows=0.85),
    Trial(7, "XGB", "XGB_100_4_50", trees=100, depth=4, leaf=1, columns="0.9", rate=0.05, rows=0.9),
    Trial(8, "XGB", "XGB_120_4_40", trees=120, depth=4, leaf=2, columns="0.8", rate=0.04, rows=0.8),
    Trial(9, "XGB", "XGB_100_5_50", trees=100, depth=5, leaf=3, columns="0.8", rate=0.05, rows=0.8),
    Trial(10, "XGB", "XGB_100_4_50", trees=100, depth=4, leaf=2, columns="0.7", rate=0.05, rows=0.7),
    Trial(11, "XGB", "XGB_100_6_30", trees=100, depth=6, leaf=2, columns="0.8", rate=0.03, rows=0.8),
)
XGB_ROUND_2 = (
    Trial(0, "XGB", "XGB_100_5_50", trees=100, depth=5, leaf=2, columns="0.8", rate=0.05, rows=0.8),
    Trial(1, "XGB", "XGB_100_6_50", trees=100, depth=6, leaf=2, columns="0.8", rate=0.05, rows=0.8),
    Trial(2, "XGB", "XGB_100_7_40", trees=100, depth=7, leaf=2, columns="0.8", rate=0.04, rows=0.8),
    Trial(3, "XGB", "XGB_150_5_40", trees=150, depth=5, leaf=2, columns="0.8", rate=0.04, rows=0.8),
    Trial(4, "XGB", "XGB_100_5_60", trees=100, depth=5, leaf=2, columns="0.8", rate=0.06, rows=0.8),
)
LGB_TRIALS = (
    Trial(0, "LGB", "LGB_50_3_50", trees=50, depth=3, leaf=20, columns="0.8", rate=0.05, rows=0.8),
    Trial(1, "LGB", "LGB_40_3_50", trees=40, depth=3, leaf=20, columns="0.8", rate=0.05, rows=0.8),
    Trial(2, "LGB", "LGB_30_3_50", trees=30, depth=3, leaf=20, columns="0.8", rate=0.05, rows=0.8),
    Trial(3, "LGB", "LGB_50_2_50", trees=50, depth=2, leaf=25, columns="0.8", rate=0.05, rows=0.8),
    Trial(4, "LGB", "LGB_40_2_50", trees=40, depth=2, leaf=25, columns="0.8", rate=0.05, rows=0.8),
    Trial(5, "LGB", "LGB_30_2_50", trees=30, depth=2, leaf=30, columns="0.7", rate=0.05, rows=0.7),
    Trial(6, "LGB", "LGB_50_3_30", trees=50, depth=3, leaf=20, columns="0.8", rate=0.03, rows=0.8),
    Trial(7, "LGB", "LGB_50_3_50", trees=50, depth=3, leaf=25, columns="0.7", rate=0.05, rows=0.7),
    Trial(8, "LGB", "LGB_60_3_40", trees=60, depth=3, leaf=20, columns="0.8", rate=0.04, rows=0.8),
    Trial(9, "LGB", "LGB_50_3_50", trees=50, depth=3, leaf=30, columns="0.8", rate=0.05, rows=0.8),
    Trial(10, "LGB", "LGB_45_2_40", trees=45, depth=2, leaf=25, columns="0.75", rate=0.04, rows=0.75),
    Trial(11, "LGB", "LGB_35_3_50", trees=35, depth=3, leaf=22, columns="0.8", rate=0.05, rows=0.8),
)
RF_TRIALS = (
    Trial(0, "RF", "RF_100_8", trees=100, depth=8, leaf=8, columns="sqrt"),
    Trial(1, "RF", "RF_100_7", trees=100, depth=7, leaf=8, columns="sqrt"),
    Trial(2, "RF", "RF_100_6", trees=100, depth=6, leaf=8, columns="sqrt"),
    Trial(3, "RF", "RF_100_5", trees=100, depth=5, leaf=8, columns="sqrt"),
    Trial(4, "RF", "RF_100_8", trees=100, depth=8, leaf=10, columns="sqrt"),
    Trial(5, "RF", "RF_100_7", trees=100, depth=7, leaf=10, columns="sqrt"),
    Trial(6, "RF", "RF_100_6", trees=100, depth=6, leaf=12, columns="sqrt"),
    Trial(7, "RF", "RF_80_7", trees=80, depth=7, leaf=8, columns="sqrt"),
    Trial(8, "RF", "RF_120_7", trees=120, depth=7, leaf=8, columns="sqrt"),
    Trial(9, "RF", "RF_100_8", trees=100, depth=8, leaf=6, columns="log2"),
    Trial(10, "RF", "RF_100_7", trees=100, depth=7, leaf=9, columns="sqrt"),
    Trial(11, "RF", "RF_100_8", trees=100, depth=8, leaf=5, columns="sqrt"),
)
RF_ROUND_2 = (
    Trial(0, "RF", "RF_200_8", trees=200, depth=8, leaf=5, columns="sqrt"),
    Trial(1, "RF", "RF_250_8", trees=250, depth=8, leaf=5, columns="sqrt"),
    Trial(2, "RF", "RF_200_7", trees=200, depth=7, leaf=5, columns="sqrt"),
    Trial(3, "RF", "RF_200_9", trees=200, depth=9, leaf=5, columns="sqrt"),
    Trial(4, "RF", "RF_200_8", trees=200, depth=8, leaf=4, columns="sqrt"),
    Trial(5, "RF", "RF_200_8", trees=200, depth=8, leaf=6, columns="sqrt"),
    Trial(6, "RF", "RF_200_8", trees=200, depth=8, leaf=5, columns="log2"),
    Trial(7, "RF", "RF_200_8", trees=200, depth=8, leaf=5, columns="0.7"),
    Trial(8, "RF", "RF_300_8", trees=300, depth=8, leaf=5, columns="sqrt"),
    Trial(9, "RF", "RF_200_8", trees=200, depth=8, leaf=7, columns="sqrt"),
    Trial(10, "RF", "RF_180_8", trees=180, depth=8, leaf=5, columns="sqrt"),
    Trial(11, "RF", "RF_220_8", trees=220, depth=8, leaf=5, columns="sqrt"),
)
