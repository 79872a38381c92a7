"""Feature profiles, selection and data audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import audit, features, profile, select, split
from barline.session import materialise
from checks import panels as p
from checks.feature_queries import FEATURES, split_sql
from checks.registry import fixed, fixed_sql, query, shaped, shaped_sql

KEYS = ("symbol", "date")
LABEL = "next_5day_return"
SUPPLIER = p.bars_sql("l_suppkey")
#: Every column of the rich feature table that a model may read.
COLUMNS = ["open", "high", "low", "close", "volume", *[c for c in FEATURES if c != LABEL]]


def panel(spark, sf):
    """The rich feature table, NULLs included.

    Operators read it more than once. Its seven columns of bars are written, as its own 158 would fill the disks and
    take longer to write and read than to make again.
    """
    return features.feature_table(p.stored_indicators(spark, sf)).select(*KEYS, LABEL, *COLUMNS)


def panel_once(spark, sf):
    """The same table for an operator that reads it once: nothing is written."""
    return p.feature_panel(spark, sf).select(*KEYS, LABEL, *COLUMNS)


def train(spark, sf):
    return split.known_split(panel(spark, sf), only="train", in_order=True).drop("split")


PANEL = ",\n".join([SUPPLIER, p.indicators_sql(), p.features_sql(), "panel AS (SELECT * FROM feat)"])
KNOWN = " AND ".join(f'"{c}" IS NOT NULL' for c in (LABEL, *COLUMNS))
TRAIN = ",\n".join([PANEL, f"known AS (SELECT * FROM panel WHERE {KNOWN})", split_sql("known"),
                    "train AS (SELECT * FROM parted WHERE split = 'train')"])


def long_sql(source: str, ids: str = "", cte: str = "long") -> str:
    names = ", ".join(f"'{c}'" for c in COLUMNS)
    values = ", ".join(f'CAST("{c}" AS DOUBLE)' for c in COLUMNS)
    return f"{cte} AS (SELECT {ids} unnest([{names}]) AS feature, unnest([{values}]) AS value FROM {source})"


# --- profiles -----------------------------------------------------------------------------


@query(
    p.with_sql(PANEL) + "SELECT CAST(" + " + ".join(f'count(*) - count("{c}")' for c in (*KEYS, LABEL, *COLUMNS))
    + " AS BIGINT) AS n_null FROM panel"
)
def null_total(spark, sf):
    return profile.null_total(panel_once(spark, sf))


@query(
    p.with_sql(PANEL, long_sql("panel"),
               "x AS (SELECT feature, avg((value IS NULL)::INT) AS missing_ratio FROM long GROUP BY 1)",
               "z AS (SELECT *, missing_ratio < 0.9 AS kept FROM x)")
    + shaped_sql("z", ("feature",), ("missing_ratio",), ("kept",))
)
def missing_ratios(spark, sf):
    return shaped(profile.missing_filter(panel_once(spark, sf), COLUMNS), ("feature",), ("missing_ratio",), ("kept",))


@query(
    p.with_sql(TRAIN, long_sql("train"), "x AS (SELECT feature, var_samp(value) AS variance FROM long GROUP BY 1)",
               "z AS (SELECT feature, variance, log10(variance) AS size, variance > 0.001 AS kept FROM x)")
    + shaped_sql("z", ("feature",), ("size",), ("kept",))
)
def variances(spark, sf):
    df = profile.variance_filter(train(spark, sf), COLUMNS).withColumn("size", F.log10("variance"))
    return shaped(df, ("feature",), ("size",), ("kept",))


@query(
    p.with_sql(TRAIN, long_sql("train", f"{LABEL} AS y,"),
               "x AS (SELECT feature, coalesce(abs(corr(value, y)), 0) AS score FROM long GROUP BY 1)")
    + shaped_sql("x", ("feature",), ("score",))
)
def label_correlations(spark, sf):
    return shaped(profile.target_corr(train(spark, sf), COLUMNS), ("feature",), ("score",))


def pairs_sql(source: str, cte: str = "pairs") -> str:
    """Centred products of the rows of all pairs in one scan, then one row per pair."""
    names = [(i, j) for i in range(len(COLUMNS)) for j in range(i + 1, len(COLUMNS))]
    found = ", ".join(f'corr("{COLUMNS[i]}", "{COLUMNS[j]}")' for i, j in names)
    listed = ", ".join(f"'{c}'" for c in COLUMNS)
    return f"""one_{cte} AS (SELECT [{found}] AS r, [{listed}] AS names FROM {source}),
{cte} AS (SELECT names[i + 1] AS feature_i, names[j + 1] AS feature_j, i AS pos_i, j AS pos_j, CASE WHEN isfinite(x) THEN x END AS r
  FROM (SELECT names, unnest(r) AS x, unnest([{", ".join(str(i) for i, _ in names)}]) AS i, unnest([{", ".join(str(j) for _, j in names)}]) AS j FROM one_{cte}))"""


PAIR = ("feature_i", "feature_j")


@query(p.with_sql(TRAIN, pairs_sql("train")) + shaped_sql("pairs", PAIR, ("r",)))
def correlation_matrix(spark, sf):
    return shaped(profile.corr_matrix(train(spark, sf), COLUMNS), PAIR, ("r",))


RANKED = ",\n".join([
    "numbered AS (SELECT row_number() OVER () AS i, " + ", ".join(f"{fixed_sql(chr(34) + c + chr(34))} AS \"{c}\"" for c in COLUMNS) + " FROM train)",
    long_sql("numbered", "i,"),
    """placed AS (SELECT i, feature, rank() OVER (PARTITION BY feature ORDER BY value)
  + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM long)""",
    "ranked AS (SELECT i, " + ", ".join(f"max(r) FILTER (feature = '{c}') AS \"{c}\"" for c in COLUMNS) + " FROM placed GROUP BY i)",
])


@query(p.with_sql(TRAIN, RANKED, pairs_sql("ranked")) + shaped_sql("pairs", PAIR, ("r",)))
def rank_correlation_matrix(spark, sf):
    """Values are rounded first: values that differ in the last bit only are ties."""
    rows = train(spark, sf).select(*[fixed(c).alias(c) for c in COLUMNS])
    return shaped(profile.corr_matrix(rows, COLUMNS, "spearman"), PAIR, ("r",))


@query(
    p.with_sql(TRAIN, pairs_sql("train"), long_sql("train", f"{LABEL} AS y,"),
               "scores AS (SELECT feature, coalesce(abs(corr(value, y)), 0) AS score FROM long GROUP BY 1)",
               """grp AS (SELECT feature_j AS head, feature_i AS feature, pos_i AS pos FROM pairs WHERE abs(r) > 0.95
  UNION SELECT feature_j, feature_j, pos_j FROM pairs WHERE abs(r) > 0.95)""",
               """lost AS (SELECT DISTINCT feature FROM (SELECT g.feature,
  row_number() OVER (PARTITION BY head ORDER BY score DESC, pos) AS place FROM grp g JOIN scores USING (feature)) WHERE place > 1)""",
               "x AS (SELECT feature, score, feature NOT IN (SELECT feature FROM lost) AS kept FROM scores)")
    + shaped_sql("x", ("feature",), ("score",), ("kept",))
)
def correlated_pair_filter(spark, sf):
    rows = train(spark, sf)
    df = select.correlation_filter(rows, COLUMNS, profile.target_corr(rows, COLUMNS))
    return shaped(df, ("feature",), ("score",), ("kept",))


@query(
    p.with_sql(TRAIN, 'c AS (SELECT 1 / (1 - pow(corr("return_mean_5", "return_mean_20"), 2)) AS vif FROM train)')
    + f"SELECT f.feature, {fixed_sql('vif')} AS vif FROM c, (VALUES ('return_mean_5'), ('return_mean_20')) f(feature)"
)
def variance_inflation_of_a_pair(spark, sf):
    df = select.vif_table(train(spark, sf), ["return_mean_5", "return_mean_20"])
    return shaped(df, ("feature",), ("vif",))


@query()
def variance_inflation(spark, sf):
    return shaped(select.vif_table(train(spark, sf), COLUMNS), ("feature",), ("vif",), ("place",))


@query()
def variance_inflation_filter(spark, sf):
    df = select.vif_filter(train(spark, sf), COLUMNS, min_keep=5)
    return shaped(df, ("feature",), ("vif",), ("round", "kept"))


BINS = 16


def bin_sql(x: str, low: str, high: str, bins: int) -> str:
    return f"CAST(least({bins - 1}, floor(coalesce(({x} - {low}) / nullif({high} - {low}, 0), 0) * {bins})) AS INT)"


MI_SQL = (
    long_sql("train", f"{LABEL} AS y,"),
    f"""b AS (SELECT feature, {bin_sql('value', 'lo', 'hi', BINS)} AS bx, {bin_sql('y', 'ylo', 'yhi', BINS)} AS bl
  FROM (SELECT *, min(value) OVER f AS lo, max(value) OVER f AS hi, min(y) OVER f AS ylo, max(y) OVER f AS yhi
        FROM long WINDOW f AS (PARTITION BY feature)))""",
    "c AS (SELECT feature, bx, bl, count(*) AS n FROM b GROUP BY 1, 2, 3)",
    """mi AS (SELECT feature, sum(CAST(n AS DOUBLE) / a * ln(CAST(n AS DOUBLE) * a / (CAST(nx AS DOUBLE) * ny))) AS score FROM (
  SELECT *, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, bx) AS nx,
         sum(n) OVER (PARTITION BY feature, bl) AS ny FROM c) GROUP BY 1)""",
)


@query(p.with_sql(TRAIN, *MI_SQL) + shaped_sql("mi", ("feature",), ("score",)))
def mutual_information(spark, sf):
    df = profile.mi_scores(train(spark, sf), COLUMNS, bins=BINS).withColumnRenamed("mi", "score")
    return shaped(df, ("feature",), ("score",))


@query(
    p.with_sql(TRAIN, *MI_SQL, "x AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS place FROM mi)")
    + shaped_sql("x", ("feature",), ("score",), ("place",)) + f" WHERE place <= {len(COLUMNS) // 2}"
)
def best_half_of_features(spark, sf):
    scores = profile.mi_scores(train(spark, sf), COLUMNS, bins=BINS).withColumnRenamed("mi", "score")
    return shaped(select.top_fraction(scores, 0.5), ("feature",), ("score",), ("place",))


def selected(spark, sf):
    df = materialise(p.split_panel(spark, sf, "supplier"))
    rows = df.where(F.col("split") == "train")
    return df, select.select_features(rows, features.feature_columns(df))


@query()
def selection_report(spark, sf):
    df, found = selected(spark, sf)
    return found.report(df).select(F.col("step"), F.col("n_features").cast("bigint"), F.col("place").cast("bigint"))


SCALED = [c for c in COLUMNS if c not in p.CALENDAR_SQL and c not in p.CROSS_SQL]


@query(
    p.with_sql(TRAIN, "s AS (SELECT " + ", ".join(
        f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in SCALED) + " FROM train)",
        "x AS (SELECT symbol, date, split, " + ", ".join(
            f'("{c}" - "m_{c}") / CASE WHEN "s_{c}" = 0 THEN 1 ELSE "s_{c}" END AS "{c}"' for c in SCALED)
        + " FROM parted CROSS JOIN s)")
    + shaped_sql("x", (*KEYS, "split"), dict.fromkeys(SCALED, 5))
)
def standardised(spark, sf):
    """Statistics of the training rows, applied to all rows."""
    df = split.known_split(panel(spark, sf), in_order=True)
    scaler = profile.Standardizer(SCALED).fit(df.where(F.col("split") == "train"))
    return shaped(scaler.transform(df), (*KEYS, "split"), dict.fromkeys(SCALED, 5))


@query(
    p.with_sql(SUPPLIER, "x AS (SELECT symbol, date, " + ", ".join(
        f"({c} - min({c}) OVER s) / nullif(max({c}) OVER s - min({c}) OVER s, 0) AS {c}_scaled" for c in ("close", "volume"))
        + " FROM bars WINDOW s AS (PARTITION BY symbol))")
    + shaped_sql("x", KEYS, ("close_scaled", "volume_scaled"))
)
def minmax_scaled(spark, sf):
    df = profile.minmax(p.bars(spark, sf), ["close", "volume"], ["symbol"])
    return shaped(df, KEYS, ("close_scaled", "volume_scaled"))


# --- audit --------------------------------------------------------------------------------


@query(
    p.with_sql(PANEL, long_sql("panel"), """x AS (SELECT feature, count(*) AS n_rows, count(*) - count(value) AS n_null,
  min(value) AS low, max(value) AS high FROM long GROUP BY 1)""")
    + shaped_sql("x", ("feature",), {"low": 4, "high": 4}, ("n_rows", "n_null"))
)
def quality_report(spark, sf):
    df = audit.quality_report(panel(spark, sf), COLUMNS)
    return shaped(df, ("feature",), {"low": 4, "high": 4}, ("n_rows", "n_null"))


@query(
    """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""
)
def duplicate_keys(spark, sf):
    df = audit.duplicate_keys(p.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return shaped(df, (), (), ("l_orderkey", "l_linenumber", "n"))


@query(
    p.with_sql(SUPPLIER, f"g AS (SELECT symbol, date, lag(date) OVER {p.SERIES} AS previous FROM bars)",
               "x AS (SELECT *, date - previous AS days FROM g WHERE date - previous > 1)")
    + shaped_sql("x", (*KEYS, "previous"), (), ("days",))
)
def date_gaps(spark, sf):
    return shaped(audit.date_gaps(p.bars(spark, sf)), (*KEYS, "previous"), (), ("days",))


@query(
    p.with_sql(PANEL, long_sql("panel", "symbol, date,"), """q AS (SELECT feature, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)""",
               """x AS (SELECT symbol, date, feature, value, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END AS side
  FROM long JOIN q USING (feature) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""")
    + shaped_sql("x", (*KEYS, "feature", "side"), {"value": 2})
)
def iqr_outliers(spark, sf):
    return shaped(audit.iqr_outliers(panel(spark, sf), COLUMNS), (*KEYS, "feature", "side"), {"value": 2})


@query(p.with_sql(TRAIN, pairs_sql("train")) + shaped_sql("pairs", PAIR, ("r",)) + " WHERE abs(r) > 0.95")
def correlated_groups(spark, sf):
    return shaped(audit.correlated_groups(train(spark, sf), COLUMNS), PAIR, ("r",))


@query(
    p.with_sql(TRAIN, long_sql("train", f"{LABEL} AS y,"), "c AS (SELECT feature, corr(value, y) AS r FROM long GROUP BY 1)",
               "x AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS place FROM c)")
    + shaped_sql("x", ("feature",), ("r",), ("place",))
)
def label_ranking(spark, sf):
    return shaped(audit.label_ranking(train(spark, sf), COLUMNS), ("feature",), ("r",), ("place",))


@query(
    p.with_sql(SUPPLIER, p.indicators_sql(), f"""x AS (SELECT symbol, date,
  CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold' END AS rsi_signal,
  CASE WHEN lag(macd) OVER {p.SERIES} <= 0 AND macd > 0 THEN 'up'
       WHEN lag(macd) OVER {p.SERIES} >= 0 AND macd < 0 THEN 'down' END AS macd_cross FROM ind)""")
    + shaped_sql("x", (*KEYS, "rsi_signal", "macd_cross"))
)
def signals(spark, sf):
    return shaped(audit.signals(p.indicators(spark, sf)), (*KEYS, "rsi_signal", "macd_cross"))


SHAPE = {"mean": 4, "std": 4, "skew": 4, "low": 4, "q1": 4, "median": 4, "q3": 4, "high": 4}


@query(
    p.with_sql(PANEL, long_sql("panel"), """x AS (SELECT feature, count(value) AS n_values, avg(value) AS mean,
  stddev_samp(value) AS std, skewness(value) AS skew, quantile_cont(value, 0.0) AS low, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 1.0) AS high
  FROM long GROUP BY 1)""")
    + shaped_sql("x", ("feature",), SHAPE, ("n_values",))
)
def distribution(spark, sf):
    return shaped(audit.distribution(panel(spark, sf), COLUMNS), ("feature",), SHAPE, ("n_values",))


@query(
    p.with_sql(PANEL, long_sql("panel"), f"""x AS (SELECT feature, {bin_sql('value', 'lo', 'hi', 30)} AS bin, count(*) AS n
  FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM long)
  WHERE value IS NOT NULL GROUP BY 1, 2)""")
    + shaped_sql("x", ("feature",), (), ("bin", "n"))
)
def histograms(spark, sf):
    return shaped(audit.histogram(panel(spark, sf), COLUMNS, 30), ("feature",), (), ("bin", "n"))
