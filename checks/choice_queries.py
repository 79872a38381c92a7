"""Choosing and blending models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.names import family_kind, model_family, trial_name
from barline.operators import choose, ensemble, evaluate
from checks import forecasts as fc
from checks import panels as p
from checks.registry import query, shaped, shaped_sql

SYMBOL = ("symbol",)
KEYS = ("symbol", "model")
PREDS = fc.predictions_sql()
TM = fc.selection_sql()
BEST = "ORDER BY r2 DESC, model"


def tm(spark, sf):
    """Models are chosen on the validation rows that all of them cover."""
    return fc.selection_metrics(spark, sf)


def chosen_weights(spark, sf):
    return ensemble.power_weights(members(spark, sf), by=SYMBOL)


def with_blends(spark, sf):
    """Test metrics of the single models and of the blends chosen on validation rows, per symbol."""
    preds = fc.common(spark, sf).where(F.col("split") == "test")
    blends = evaluate.regression_metrics(ensemble.blend(preds, chosen_weights(spark, sf), SYMBOL), SYMBOL)
    return evaluate.regression_metrics(preds, SYMBOL).unionByName(blends)


# --- names --------------------------------------------------------------------------------


@query(
    p.with_sql(TM, f"f AS (SELECT symbol, model, {fc.FAMILY_SQL} AS family FROM tm)",
               """k AS (SELECT *, CASE WHEN family IN ('GRU', 'LSTM') THEN 'DL' WHEN family = 'Ridge' THEN 'Ridge'
  WHEN family IN ('XGB', 'LGB', 'RF') THEN 'Tree' ELSE 'Other' END AS kind FROM f)""")
    + shaped_sql("k", (*KEYS, "family", "kind"))
)
def model_families(spark, sf):
    df = tm(spark, sf).withColumn("family", model_family(F.col("model")))
    return shaped(df.withColumn("kind", family_kind(F.col("family"))), (*KEYS, "family", "kind"))


PARSED = f"""x AS (SELECT symbol, model, {fc.FAMILY_SQL} AS family, {fc.ROUND_SQL} AS round,
  coalesce(sizes[1], -1) AS size_1, coalesce(sizes[2], -1) AS size_2 FROM (SELECT *, {fc.SIZES_SQL} AS sizes FROM tm))"""


@query(p.with_sql(TM, PARSED) + shaped_sql("x", (*KEYS, "family"), (), ("size_1", "size_2", "round")))
def parsed_trial_names(spark, sf):
    df = choose.parse_trial_name(tm(spark, sf)).fillna(-1, ["size_1", "size_2"])
    return shaped(df, (*KEYS, "family"), (), ("size_1", "size_2", "round"))


@query(
    """WITH t AS (SELECT p_partkey, 'XGB_' || CAST(p_size * 10 AS VARCHAR) || '_' || CAST(p_size % 7 + 2 AS VARCHAR) || '_'
  || CAST(CAST(trunc(p_retailprice / 20000 * 1000) AS INT) AS VARCHAR) AS name FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, name FROM t"""
)
def composed_trial_names(spark, sf):
    """Names composed from parameters found in the part table."""
    part = p.table(spark, sf, "part")
    name = trial_name(F.lit("XGB"), F.col("p_size") * 10, F.col("p_size") % 7 + 2, F.col("p_retailprice") / 20000)
    return part.select(F.col("p_partkey").cast("bigint"), name.alias("name"))


# --- floors, ranks, picks -----------------------------------------------------------------


@query(
    p.with_sql(TM, f"f AS (SELECT *, {fc.FAMILY_SQL} AS family FROM tm)",
               """x AS (SELECT symbol, model, family, r2 FROM f JOIN (VALUES ('XGB', -0.2), ('LGB', -0.2), ('RF', -0.2),
  ('GRU', -0.5), ('LSTM', -0.5), ('Ridge', -0.1)) t(fam, floor) ON family = fam WHERE r2 > floor)""")
    + shaped_sql("x", (*KEYS, "family"), ("r2",))
)
def metric_floor(spark, sf):
    return shaped(choose.metric_floor(tm(spark, sf), choose.SWEEP_FLOORS), (*KEYS, "family"), ("r2",))


@query(
    p.with_sql(TM, f"""x AS (SELECT *, row_number() OVER (PARTITION BY symbol, family, round {BEST}) AS place
  FROM (SELECT *, {fc.FAMILY_SQL} AS family, {fc.ROUND_SQL} AS round FROM tm))""")
    + shaped_sql("x", (*KEYS, "family"), ("r2",), ("round", "place")) + " WHERE place <= 1"
)
def top_per_family(spark, sf):
    df = choose.top_per_family(tm(spark, sf), 1, SYMBOL)
    return shaped(df, (*KEYS, "family"), ("r2",), ("round", "place"))


@query(
    p.with_sql(TM, f"x AS (SELECT *, row_number() OVER (PARTITION BY symbol {BEST}) AS place FROM tm)",
               "z AS (SELECT *, place = 1 AS best FROM x)")
    + shaped_sql("z", KEYS, ("r2",), ("place", "best"))
)
def leaderboard(spark, sf):
    return shaped(choose.leaderboard(tm(spark, sf), SYMBOL), KEYS, ("r2",), ("place", "best"))


@query(
    p.with_sql(fc.selection_sql(split="test"), f"x AS (SELECT *, row_number() OVER (PARTITION BY symbol {BEST}) AS place FROM tm)",
               "z AS (SELECT *, place = 1 AS best FROM x)")
    + shaped_sql("z", KEYS, ("r2",), ("place", "best"))
)
def leaderboard_on_test(spark, sf):
    """The ranks on the test split, for reading only: nothing is chosen by them."""
    return shaped(choose.leaderboard(fc.selection_metrics(spark, sf, split="test"), SYMBOL), KEYS, ("r2",), ("place", "best"))


@query(p.with_sql(PREDS, fc.COMMON_SQL) + shaped_sql("common", ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5}))
def forecasts_on_common_rows(spark, sf):
    return shaped(fc.common(spark, sf), ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5})


TESTED = "pt AS (SELECT * FROM common WHERE split = 'test')"
PICK_SQL = f"""fam AS (SELECT *, {fc.FAMILY_SQL} AS family FROM tm),
gru AS (SELECT *, row_number() OVER (PARTITION BY symbol, family {BEST}) AS nth FROM fam WHERE r2 > -0.1 AND family <> 'Other'),
slot AS (
  SELECT *, 1 AS slot, row_number() OVER (PARTITION BY symbol ORDER BY CASE family WHEN 'GRU' THEN 1 ELSE 2 END) AS pref
  FROM gru WHERE nth = 1 AND family IN ('GRU', 'LSTM')
  UNION ALL SELECT *, 2, 1 FROM gru WHERE nth = 1 AND family = 'Ridge'
  UNION ALL SELECT *, 3, row_number() OVER (PARTITION BY symbol ORDER BY CASE family WHEN 'LGB' THEN 1 WHEN 'XGB' THEN 2
    ELSE 3 END) FROM gru WHERE nth = 1 AND family IN ('LGB', 'XGB', 'RF')),
kinds AS (SELECT *, CASE WHEN family IN ('GRU', 'LSTM') THEN 'DL' WHEN family = 'Ridge' THEN 'Ridge' ELSE 'Tree' END AS kind
  FROM fam WHERE family <> 'Other'),
first_picks AS (SELECT symbol, model, r2, family, CASE slot WHEN 1 THEN 'DL' WHEN 2 THEN 'Ridge' ELSE 'Tree' END AS kind, slot
  FROM slot WHERE pref = 1),
extra AS (SELECT symbol, model, r2, family, kind, 10 AS slot FROM (
  SELECT k.*, row_number() OVER (PARTITION BY symbol, kind {BEST}) AS nth FROM kinds k
  WHERE NOT EXISTS (SELECT 1 FROM first_picks f WHERE f.symbol = k.symbol AND f.kind = k.kind)) WHERE nth = 1),
picks AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY slot, r2 DESC, model) AS pick
  FROM (SELECT * FROM first_picks UNION ALL SELECT * FROM extra))"""


@query(p.with_sql(TM, PICK_SQL) + shaped_sql("picks", (*KEYS, "family", "kind"), ("r2",), ("pick",)))
def pick_heterogeneous(spark, sf):
    df = choose.pick_heterogeneous(tm(spark, sf), by=SYMBOL)
    return shaped(df, (*KEYS, "family", "kind"), ("r2",), ("pick",))


MEMBERS_SQL = """members AS (
  SELECT p.*, e.ensemble FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM picks) p
  JOIN (VALUES (2, 'Ensemble_R2³_2模型'), (3, 'Ensemble_R2³_3模型')) e(size, ensemble) ON p.pick <= e.size AND p.n >= e.size),
weights AS (SELECT *, pow(r2, 3) / nullif(sum(pow(r2, 3)) OVER (PARTITION BY symbol, ensemble), 0) AS weight FROM members)"""


def members(spark, sf):
    return ensemble.ensemble_sizes(choose.pick_heterogeneous(tm(spark, sf), by=SYMBOL), SYMBOL)


@query(p.with_sql(TM, PICK_SQL, MEMBERS_SQL) + shaped_sql("members", (*KEYS, "ensemble"), (), ("pick",)))
def ensemble_sizes(spark, sf):
    return shaped(members(spark, sf), (*KEYS, "ensemble"), (), ("pick",))


@query(p.with_sql(TM, PICK_SQL, MEMBERS_SQL) + shaped_sql("weights", (*KEYS, "ensemble"), ("weight",)))
def power_weights(spark, sf):
    df = ensemble.power_weights(members(spark, sf), by=SYMBOL)
    return shaped(df, (*KEYS, "ensemble"), ("weight",))


@query(
    p.with_sql(TM, PICK_SQL, MEMBERS_SQL, """clipped AS (SELECT *, pow(greatest(r2, 0), 3)
  / nullif(sum(pow(greatest(r2, 0), 3)) OVER (PARTITION BY symbol, ensemble), 0) AS w FROM members)""")
    + shaped_sql("(SELECT symbol, model, ensemble, w AS weight FROM clipped)", (*KEYS, "ensemble"), ("weight",))
)
def power_weights_clipped(spark, sf):
    df = ensemble.power_weights(members(spark, sf), by=SYMBOL, clip_negative=True)
    return shaped(df, (*KEYS, "ensemble"), ("weight",))


BLEND_SQL = """blended AS (
  SELECT ensemble AS model, split, symbol, date, first(y) AS y, sum(weight * yhat) AS yhat
  FROM (SELECT w.ensemble, t.*, w.weight, count(*) OVER (PARTITION BY w.ensemble, t.symbol, t.date) AS n, m
        FROM pt t JOIN (SELECT *, count(*) OVER (PARTITION BY symbol, ensemble) AS m FROM weights) w
        ON t.symbol = w.symbol AND t.model = w.model)
  WHERE n = m GROUP BY 1, 2, 3, 4)"""
ROW = ("model", "split", "symbol", "date")


@query(p.with_sql(TM, PICK_SQL, MEMBERS_SQL, TESTED, BLEND_SQL) + shaped_sql("blended", ROW, {"y": 5, "yhat": 4}))
def blended_forecasts(spark, sf):
    preds = fc.common(spark, sf).where(F.col("split") == "test")
    return shaped(ensemble.blend(preds, chosen_weights(spark, sf), SYMBOL), ROW, {"y": 5, "yhat": 4})


ALL_SQL = (TM, PICK_SQL, MEMBERS_SQL, TESTED, BLEND_SQL, fc.metrics_sql(SYMBOL, "blended", "bm"),
           "al AS (SELECT * FROM met WHERE split = 'test' UNION ALL BY NAME SELECT * FROM bm)")


@query(
    p.with_sql(*ALL_SQL, """fam2 AS (SELECT *, CASE WHEN contains(model, 'Ensemble') THEN 'Ensemble'
  WHEN contains(model, 'XGB') THEN 'XGB' WHEN contains(model, 'LGB') THEN 'LGB' WHEN contains(model, 'RF') THEN 'RF'
  WHEN contains(model, 'GRU') THEN 'GRU' WHEN contains(model, 'LSTM') THEN 'LSTM' WHEN contains(model, 'Ridge') THEN 'Ridge'
  ELSE 'Other' END AS family FROM al WHERE r2 >= -0.05)""",
               f"nth AS (SELECT *, row_number() OVER (PARTITION BY symbol, family {BEST}) AS nth FROM fam2)",
               f"""shown AS (SELECT *, row_number() OVER (PARTITION BY symbol {BEST}) AS place FROM nth
  WHERE family = 'Ridge' OR (family = 'Ensemble' AND nth <= 1) OR (family IN ('XGB', 'LGB', 'RF', 'GRU', 'LSTM') AND nth <= 2))""")
    + shaped_sql("shown", (*KEYS, "family"), {"r2": 5}, ("place",)) + " WHERE place <= 15"
)
def display_models(spark, sf):
    df = choose.display_models(with_blends(spark, sf), SYMBOL)
    return shaped(df, (*KEYS, "family"), {"r2": 5}, ("place",))


@query(
    p.with_sql(*ALL_SQL, """c AS (SELECT *, contains(model, 'Ensemble') AS blend,
  count(*) FILTER (contains(model, 'Ensemble')) OVER (PARTITION BY symbol) AS blends FROM al)""",
               f"""o AS (SELECT *, row_number() OVER (PARTITION BY symbol {BEST}) AS nth FROM c WHERE NOT blend AND r2 >= -0.05)""",
               """u AS (SELECT symbol, model, r2, 1 AS stage FROM c WHERE blend
  UNION ALL SELECT symbol, model, r2, 2 FROM o WHERE nth <= 5 - blends)""",
               "x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY stage, r2 DESC, model) AS place FROM u)")
    + shaped_sql("x", KEYS, {"r2": 5}, ("stage", "place"))
)
def classification_candidates(spark, sf):
    df = choose.classification_candidates(with_blends(spark, sf), SYMBOL)
    return shaped(df, KEYS, {"r2": 5}, ("stage", "place"))


def threshold_sql(threshold: float, capped: tuple[str, ...], floor: float | None) -> str:
    among = ", ".join(f"'{c}'" for c in capped)
    where = f"WHERE r2 > {floor}" if floor is not None else ""
    return f"""a AS (SELECT *, {fc.FAMILY_SQL} AS family FROM tm {where}),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol, family {BEST}) AS in_family FROM a),
able AS (SELECT *, row_number() OVER (PARTITION BY symbol {BEST}) AS rank FROM b
  WHERE r2 > {threshold} AND (family NOT IN ({among}) OR in_family = 1)),
chosen AS (SELECT * FROM able WHERE rank <= 5),
spare AS (SELECT b.*, row_number() OVER (PARTITION BY b.symbol ORDER BY b.r2 DESC, b.model) AS rank FROM b
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.symbol = b.symbol AND c.model = b.model)
    AND NOT (family IN ({among}) AND EXISTS (SELECT 1 FROM chosen c WHERE c.symbol = b.symbol AND c.family = b.family))),
u AS (SELECT symbol, model, family, r2, 1 AS stage FROM chosen
  UNION ALL SELECT symbol, model, family, r2, 2 FROM spare s
  WHERE rank <= 3 - (SELECT count(*) FROM chosen c WHERE c.symbol = s.symbol)),
x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY stage, r2 DESC, model) AS pick FROM u)"""


@query(p.with_sql(TM, threshold_sql(0.13, ("GRU",), 0.05)) + shaped_sql("x", (*KEYS, "family"), ("r2",), ("pick",)))
def pick_above_high_threshold(spark, sf):
    df = choose.pick_threshold(tm(spark, sf), 0.13, {"GRU": 1}, floor=0.05, by=SYMBOL)
    return shaped(df, (*KEYS, "family"), ("r2",), ("pick",))


@query(p.with_sql(TM, threshold_sql(0.05, ("GRU", "LSTM"), None)) + shaped_sql("x", (*KEYS, "family"), ("r2",), ("pick",)))
def pick_above_low_threshold(spark, sf):
    df = choose.pick_threshold(tm(spark, sf), 0.05, {"GRU": 1, "LSTM": 1}, by=SYMBOL)
    return shaped(df, (*KEYS, "family"), ("r2",), ("pick",))


# --- alignment, stacking ------------------------------------------------------------------

TRIO = ("GRU_R3_24_2", "Ridge_500", "LGB_30_2_50")


@query(
    p.with_sql(PREDS, """a AS (SELECT * FROM preds WHERE model IN ('GRU_R3_24_2', 'Ridge_500', 'LGB_30_2_50')),
x AS (SELECT a.* FROM a JOIN (SELECT split, symbol, date FROM a GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = 3) k
  ON a.split = k.split AND a.symbol = k.symbol AND a.date = k.date)""")
    + shaped_sql("x", ROW, {"y": 5, "yhat": 5})
)
def aligned_forecasts(spark, sf):
    return shaped(ensemble.align(fc.predictions(spark, sf), TRIO), ROW, {"y": 5, "yhat": 5})


PAIR = ("GRU_32_3", "Ridge_500")
STACK_SQL = """wide AS (SELECT split, symbol, date, first(y) AS y, max(yhat) FILTER (model = 'GRU_32_3') AS a,
  max(yhat) FILTER (model = 'Ridge_500') AS b FROM preds WHERE model IN ('GRU_32_3', 'Ridge_500')
  GROUP BY 1, 2, 3 HAVING count(*) = 2),
m AS (SELECT covar_pop(a, y) AS ay, covar_pop(b, y) AS wy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
  avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM wide WHERE split = 'val'),
coef AS (SELECT (ay * bb - wy * ab) / (aa * bb - ab * ab) AS ca, (wy * aa - ay * ab) / (aa * bb - ab * ab) AS cb,
  my, ma, mb FROM m),
stacked AS (SELECT 'Pair_OLS' AS model, split, symbol, date, y, my + ca * (a - ma) + cb * (b - mb) AS yhat
  FROM wide CROSS JOIN coef WHERE split = 'test')"""


@query(p.with_sql(PREDS, STACK_SQL) + shaped_sql("stacked", ROW, {"y": 5, "yhat": 5}))
def stacked_forecasts(spark, sf):
    preds = fc.predictions(spark, sf)
    model = ensemble.stack_fit(preds, PAIR)
    return shaped(ensemble.stack_apply(preds, PAIR, model, "Pair"), ROW, {"y": 5, "yhat": 5})


@query(
    p.with_sql(PREDS, STACK_SQL, """w AS (SELECT 'GRU_32_3' AS model, ca AS coefficient FROM coef
  UNION ALL SELECT 'Ridge_500', cb FROM coef)""",
               """x AS (SELECT *, coalesce(greatest(coefficient, 0) / nullif(sum(greatest(coefficient, 0)) OVER (), 0), 0)
  AS weight FROM w)""")
    + shaped_sql("x", ("model",), ("coefficient", "weight"))
)
def stack_weights(spark, sf):
    model = ensemble.stack_fit(fc.predictions(spark, sf), PAIR)
    return shaped(ensemble.stack_weights(spark, PAIR, model), ("model",), ("coefficient", "weight"))


@query(
    p.with_sql(PREDS, STACK_SQL, "pt AS (SELECT * FROM preds WHERE split = 'test' AND model = 'Ridge_500')",
               """both_sets AS (SELECT 'Pair' AS model, split, symbol, date, y, yhat FROM pt
  WHERE (symbol, date) IN (SELECT (symbol, date) FROM stacked) UNION ALL SELECT * FROM stacked)""",
               fc.metrics_sql(SYMBOL, "both_sets"), """x AS (SELECT a.symbol, a.model, a.r2 AS weighted_r2, b.r2 AS stacked_r2,
  b.r2 - a.r2 AS gain, abs(b.r2 - a.r2) > 1e-4 AS store_stacked,
  CASE WHEN b.r2 > a.r2 THEN 'stacked' WHEN b.r2 < a.r2 THEN 'weighted' ELSE 'equal' END AS winner
  FROM met a JOIN met b ON a.symbol = b.symbol AND a.model = 'Pair' AND b.model = 'Pair_OLS')""")
    + shaped_sql("x", (*KEYS, "winner"), {"weighted_r2": 5, "stacked_r2": 5, "gain": 5}, ("store_stacked",))
)
def compared_strategies(spark, sf):
    preds = fc.predictions(spark, sf)
    stacked = ensemble.stack_apply(preds, PAIR, ensemble.stack_fit(preds, PAIR), "Pair")
    single = ensemble.align(preds.where(F.col("split") == "test"), PAIR).where(F.col("model") == "Ridge_500")
    both = single.withColumn("model", F.lit("Pair")).unionByName(stacked)
    df = ensemble.compare_strategies(evaluate.regression_metrics(both, SYMBOL), SYMBOL)
    return shaped(df, (*KEYS, "winner"), {"weighted_r2": 5, "stacked_r2": 5, "gain": 5}, ("store_stacked",))


@query(
    p.with_sql(TM, """k AS (SELECT *, CASE WHEN starts_with(model, 'LSTM') OR starts_with(model, 'GRU') THEN 'DL'
  WHEN contains(model, 'Ridge') THEN 'Ridge' WHEN contains(model, 'XGB') OR contains(model, 'LGB') OR contains(model, 'RF')
  THEN 'Tree' ELSE 'Other' END AS kind FROM tm WHERE r2 > 0 AND NOT starts_with(model, 'Ensemble'))""",
               f"n AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind {BEST}) AS nth FROM k)",
               f"picks AS (SELECT *, row_number() OVER (PARTITION BY symbol {BEST}) AS pick FROM n WHERE nth = 1)",
               """weights AS (SELECT symbol, model, 'Ensemble_R2³_3模型' AS ensemble,
  pow(r2, 3) / nullif(sum(pow(r2, 3)) OVER (PARTITION BY symbol), 0) AS weight FROM picks WHERE pick <= 3)""",
               "pt AS (SELECT * FROM preds WHERE split = 'val')", BLEND_SQL)
    + shaped_sql("blended", ROW, {"y": 5, "yhat": 5})
)
def validation_blend(spark, sf):
    preds = fc.predictions(spark, sf)
    return shaped(ensemble.validation_blend(preds, tm(spark, sf), 3, SYMBOL), ROW, {"y": 5, "yhat": 5})


# --- relational forms ---------------------------------------------------------------------


@query(
    p.with_sql(PREDS, fc.metrics_sql(SYMBOL), "x AS (SELECT symbol, model, r2 FROM met WHERE split = 'val' AND model NOT LIKE 'GRU%' "
               "UNION ALL SELECT symbol, model, r2 FROM met WHERE split = 'test' AND model LIKE 'GRU%')")
    + shaped_sql("x", KEYS, ("r2",))
)
def merged_results_last_wins(spark, sf):
    """Two result tables merged; where both know a model, the second one counts."""
    metrics = fc.metrics(spark, sf).select("symbol", "model", "split", "r2")
    first = metrics.where(F.col("split") == "val").drop("split")
    second = metrics.where((F.col("split") == "test") & F.col("model").startswith("GRU")).drop("split")
    return shaped(choose.last_wins(first, second, key=("symbol", "model")), KEYS, ("r2",))


@query(
    p.with_sql(TM, PICK_SQL, "x AS (SELECT symbol, model, r2 FROM tm t WHERE NOT EXISTS "
               "(SELECT 1 FROM picks p WHERE p.symbol = t.symbol AND p.model = t.model))")
    + shaped_sql("x", KEYS, ("r2",))
)
def models_not_picked(spark, sf):
    metrics = tm(spark, sf)
    picks = choose.pick_heterogeneous(metrics, by=SYMBOL).select("symbol", "model")
    return shaped(metrics.join(picks, ["symbol", "model"], "left_anti"), KEYS, ("r2",))


@query(
    p.with_sql(TM, f"f AS (SELECT symbol, {fc.FAMILY_SQL} AS family, count(*) AS n, max(r2) AS best_r2 FROM tm GROUP BY 1, 2)")
    + shaped_sql("f", ("symbol", "family"), ("best_r2",), ("n",))
)
def models_per_family(spark, sf):
    named = tm(spark, sf).withColumn("family", model_family(F.col("model")))
    df = named.groupBy("symbol", "family").agg(F.count(F.lit(1)).alias("n"), F.max("r2").alias("best_r2"))
    return shaped(df, ("symbol", "family"), ("best_r2",), ("n",))
