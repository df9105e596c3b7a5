"""Experiment, uplift and panel queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiment as X
from ..operators import panel as P
from ..operators import promo
from ..sources.tables import experiment_units, sales_panel

ARMS, OUTCOMES = ["arm_a", "arm_b"], ["visit", "conversion", "spend"]

_U = """u AS (SELECT c_custkey AS unit, CASE c_custkey % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'arm_a' ELSE 'arm_b' END AS segment, c_acctbal AS acctbal, c_mktsegment AS mktsegment, c_nationkey AS nation,
CAST(top IS NOT NULL AS INT) AS visit, CAST(coalesce(top > 400000, false) AS INT) AS conversion, coalesce(spend, 0.0) AS spend
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
_LONG = f"{_U}, l AS (SELECT segment, 'visit' AS outcome, CAST(visit AS DOUBLE) AS value FROM u UNION ALL SELECT segment, 'conversion', CAST(conversion AS DOUBLE) FROM u UNION ALL SELECT segment, 'spend', spend FROM u), g AS (SELECT outcome, segment, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM l GROUP BY 1, 2)"
_ATE = f"""{_LONG}, ate AS (SELECT t.outcome, t.segment AS arm, t.m - c.m AS effect, sqrt(t.v / t.n + c.v / c.n) AS se, (t.m - c.m) / nullif(sqrt(t.v / t.n + c.v / c.n), 0) AS z, (t.m - c.m) / nullif(c.m, 0) AS relative, t.n AS n_treated, c.n AS n_control, sqrt(c.v) AS sd_control
FROM g t JOIN g c ON t.outcome = c.outcome AND c.segment = 'control' WHERE t.segment <> 'control')"""
_SC = f"{_U}, s AS (SELECT unit, nation % 5 + acctbal / 100000.0 AS score, CAST(visit AS DOUBLE) AS y, CAST(segment = 'arm_a' AS INT) AS t FROM u WHERE segment IN ('control', 'arm_a'))"
_RUN = f"{_SC}, r AS (SELECT row_number() OVER w AS r, sum(y * t) OVER w AS yt, sum(y * (1 - t)) OVER w AS yc, sum(t) OVER w AS nt, sum(1 - t) OVER w AS nc FROM s WINDOW w AS (ORDER BY score DESC, unit ROWS UNBOUNDED PRECEDING))"

_PANEL = """p AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS sku, split_part(p_brand, '#', 1) AS brand, sum(l_quantity) AS qty, max(CAST(l_discount >= 0.05 AS INT)) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
_FOLDS = f"{_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM p)), k AS (SELECT unnest(range(3)) AS fold), e AS (SELECT CAST(fold AS INT) AS fold, (SELECT max(n) FROM d) - 1 - (2 - fold) * 28 AS last FROM k), folds AS (SELECT fold, a.date AS train_end, b.date AS test_start, c.date AS test_end FROM e JOIN d a ON a.i = last - 28 JOIN d b ON b.i = last - 27 JOIN d c ON c.i = last)"
_NAIVE = f"{_FOLDS}, te AS (SELECT fold, p.date, sku, qty AS y_true FROM p, folds WHERE p.date BETWEEN test_start AND test_end)"
_SEAS = f"{_NAIVE}, pastd AS (SELECT fold, sku, dayofweek(p.date) AS wd, arg_max(qty, p.date) AS y_pred FROM p, folds WHERE p.date <= train_end GROUP BY 1, 2, 3), pred AS (SELECT te.*, y_pred FROM te LEFT JOIN pastd ON te.fold = pastd.fold AND te.sku = pastd.sku AND dayofweek(te.date) = wd)"


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _scored(s, d):
    u = X.two_arm(experiment_units(s, d), "arm_a")
    return u.select("unit", (F.col("nation") % 5 + F.col("acctbal") / 100000.0).alias("score"), F.col("visit").cast("double").alias("y"), "t")


def _folds(s, d):
    return P.folds(sales_panel(s, d), 3, 28, 28)


def _preds(s, d, seasonal):
    long = sales_panel(s, d)
    return P.baseline(long, P.folds(long, 3, 28, 28), seasonal)


def _score(s, d):
    long = sales_panel(s, d)
    f = P.folds(long, 3, 28, 28)
    return _r(P.scores(P.baseline(long, f, True), long, f), "rmse", "wape", "mase")


def _quantiles(s, d):
    preds = _preds(s, d, True).select("y_true", *[(F.col("y_pred") * k).alias(n) for n, k in (("y_q10", 0.5), ("y_q50", 1.0), ("y_q90", 1.6))])
    return P.rearranged(preds, ["y_q10", "y_q50", "y_q90"])


def _wide(s, d):
    long = sales_panel(s, d).withColumn("sku", F.regexp_replace("sku", "Brand#", "B_"))
    skus = [r[0] for r in long.select("sku").distinct().orderBy("sku").collect()]
    return P.to_long(long.groupBy(F.col("date").alias("DATE")).agg(*[F.coalesce(F.sum(F.when(F.col("sku") == x, F.col(c))), F.lit(0)).alias(f"{n}_{x}") for x in skus for n, c in (("QTY", "qty"), ("PROMO", "promo"))]))


def _calendar(s, d):
    return P.calendar(sales_panel(s, d).select("date").distinct()).drop("holiday", "holiday_eve")


def _uplift(s, d):
    u = X.two_arm(experiment_units(s, d), "arm_a").select("unit", "t", F.col("visit").cast("double").alias("y"), "acctbal", "nation")
    return X.uplift_scores(u, ["acctbal", "nation"], "x").select("unit", "score")


def _uplift_boosted(s, d):
    u = X.two_arm(experiment_units(s, d), "arm_a").select("unit", "t", F.col("visit").cast("double").alias("y"), "acctbal", "nation")
    return X.boosted_uplift(u, ["acctbal", "nation"], "x", "logistic").select("unit", "score")


def _lin(s, d):
    r = X.lin_adjustment(experiment_units(s, d), "spend", ["acctbal", "nation"], "arm_a")
    return s.createDataFrame([(r["effect"], r["se"], r["n"])], "effect double, se double, n long")


QUERIES = {
    "experiment_violations": lambda s, d: X.violations(experiment_units(s, d)),
    "design_matrix": lambda s, d: X.one_hot(experiment_units(s, d).select("unit", "mktsegment"), "mktsegment").drop("mktsegment"),
    "smd_balance": lambda s, d: _r(X.smd(experiment_units(s, d), ["acctbal", "nation"], ARMS), "smd"),
    "ate_grid": lambda s, d: _r(X.effects(experiment_units(s, d), OUTCOMES, ARMS), "effect", "se", "z", "relative", "sd_control"),
    "ate_tests": lambda s, d: X.with_tests(X.effects(experiment_units(s, d), OUTCOMES, ARMS)),
    "holm_bh": lambda s, d: _r(X.adjusted(X.effects(experiment_units(s, d), OUTCOMES, ARMS).select(F.concat_ws("/", "outcome", "arm").alias("id"), F.round(1 / (1 + F.abs(F.coalesce("z", F.lit(0.0)))), 6).alias("p"))), "holm", "bh"),
    "cuped": lambda s, d: _r(X.cuped(experiment_units(s, d), "spend", "acctbal", "arm_a"), "theta", "effect", "se", "raw_effect", "raw_se", "variance_reduction"),
    "lin_ols": _lin,
    "uplift_scores": _uplift,
    "uplift_boosted": _uplift_boosted,
    "uplift_deciles": lambda s, d: _r(X.deciles(_scored(s, d)), "uplift", "se"),
    "qini_curve": lambda s, d: _r(X.qini_curve(_scored(s, d)), "q"),
    "qini_coefficient": lambda s, d: _r(X.qini_coefficient(_scored(s, d)), "area", "perfect", "qini"),
    "incremental_topk": lambda s, d: _r(X.incremental(_scored(s, d), [0.1, 0.2, 0.3, 0.4, 0.5]), "uplift", "incremental"),
    "sales_panel": lambda s, d: sales_panel(s, d),
    "unpivot_panel": _wide,
    "calendar_features": _calendar,
    "holiday_flags": lambda s, d: P.calendar(sales_panel(s, d).select("date").distinct()).select("date", "holiday", "holiday_eve"),
    "panel_features": lambda s, d: _r(P.features(sales_panel(s, d)), "mean_7", "mean_28", "mean_91", "std_28", "zero_share_28", "promo_next7"),
    "make_folds": _folds,
    "naive": lambda s, d: _preds(s, d, False),
    "seasonal_naive": lambda s, d: _preds(s, d, True),
    "forecast_score": _score,
    "pinball": lambda s, d: _r(P.pinball(_quantiles(s, d).dropna(), {"y_q10": 0.1, "y_q50": 0.5, "y_q90": 0.9}), "pinball", "below"),
    "interval_coverage": lambda s, d: _r(P.coverage(_quantiles(s, d).dropna(), "y_q10", "y_q90"), "coverage"),
    "select_skus": lambda s, d: _r(P.select_series(sales_panel(s, d)), "mean", "zero_share"),
    "ppml": lambda s, d: promo.lift(sales_panel(s, d)),
    "promo_lift_ols": lambda s, d: promo.lift(sales_panel(s, d), estimator="ols"),
    "promo_lift_by_brand": lambda s, d: promo.lift(sales_panel(s, d), by="brand"),
}

_F = "feat AS (SELECT *, lag(qty, 28) OVER w AS base, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY sku ORDER BY date))"
ORACLE = {
    "experiment_violations": f"WITH {_U} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS not_binary, count(*) FILTER (WHERE spend < 0) AS negative_spend, count(*) FILTER (WHERE conversion = 1 AND spend <= 0) AS conversion_without_spend, count(*) FILTER (WHERE conversion = 1 AND visit = 0) AS conversion_without_visit, count(DISTINCT segment) AS arms FROM u",
    "design_matrix": "SELECT c_custkey AS unit, " + ", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mktsegment_{v}" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
    "smd_balance": f"WITH {_U}, l AS (SELECT segment, 'acctbal' AS covariate, acctbal AS v FROM u UNION ALL SELECT segment, 'nation', CAST(nation AS DOUBLE) FROM u), g AS (SELECT covariate, segment, avg(v) AS m, var_samp(v) AS s FROM l GROUP BY 1, 2) SELECT t.covariate, t.segment AS arm, round(CASE WHEN sqrt((t.s + c.s) / 2) > 0 THEN (t.m - c.m) / sqrt((t.s + c.s) / 2) ELSE 0 END, 6) AS smd FROM g t JOIN g c ON t.covariate = c.covariate AND c.segment = 'control' WHERE t.segment <> 'control'",
    "ate_grid": f"WITH {_ATE} SELECT outcome, arm, round(effect, 6) AS effect, round(se, 6) AS se, round(z, 6) AS z, round(relative, 6) AS relative, n_treated, n_control, round(sd_control, 6) AS sd_control FROM ate",
    "holm_bh": f"""WITH {_ATE}, q AS (SELECT outcome || '/' || arm AS id, round(1 / (1 + abs(coalesce(z, 0))), 6) AS p FROM ate), ordered AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM q)
SELECT id, p, round(least(max((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS holm, round(least((SELECT min(o2.m * o2.p / CAST(o2.k AS DOUBLE)) FROM ordered o2 WHERE o2.k >= ordered.k), 1.0::DOUBLE), 6) AS bh FROM ordered""",
    "cuped": f"""WITH {_U}, a AS (SELECT CAST(segment = 'arm_a' AS INT) AS t, spend AS y, acctbal AS x FROM u WHERE segment IN ('control', 'arm_a')), th AS (SELECT covar_samp(y, x) / var_samp(x) AS theta FROM a),
j AS (SELECT t, y, y - theta * x AS ya, theta FROM a, th), g AS (SELECT t, theta, avg(y) AS m, avg(ya) AS ma, var_samp(y) / count(*) AS v, var_samp(ya) / count(*) AS va FROM j GROUP BY 1, 2)
SELECT round(theta, 6) AS theta, round(sum(CASE t WHEN 1 THEN ma ELSE -ma END), 6) AS effect, round(sqrt(sum(va)), 6) AS se, round(sum(CASE t WHEN 1 THEN m ELSE -m END), 6) AS raw_effect, round(sqrt(sum(v)), 6) AS raw_se, round(1 - sum(va) / sum(v), 6) AS variance_reduction FROM g GROUP BY theta""",
    "uplift_deciles": f"""WITH {_SC}, k AS (SELECT y, t, row_number() OVER (ORDER BY score DESC, unit) AS r, count(*) OVER () AS n FROM s), b AS (SELECT y, t, CAST(greatest(1, ceil((r - 1) * 10 / CAST(n - 1 AS DOUBLE))) AS INT) AS bucket FROM k)
SELECT bucket, count(*) AS n, round(avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0), 6) AS uplift, round(sqrt(var_samp(y) FILTER (WHERE t = 1) / count(*) FILTER (WHERE t = 1) + var_samp(y) FILTER (WHERE t = 0) / count(*) FILTER (WHERE t = 0)), 6) AS se FROM b GROUP BY bucket""",
    "qini_curve": f"WITH {_RUN} SELECT r, round(CASE WHEN nc = 0 THEN 0 ELSE yt - yc * nt / nc END, 6) AS q FROM r UNION ALL SELECT 0, 0.0",
    "incremental_topk": f"""WITH {_RUN}, k AS (SELECT CAST(share AS DOUBLE) AS share, greatest(1, CAST(round_even(share * (SELECT max(r) FROM r), 0) AS BIGINT)) AS m FROM (VALUES (0.1), (0.2), (0.3), (0.4), (0.5)) v(share))
SELECT share, m, round(yt / nullif(nt, 0) - yc / nullif(nc, 0), 6) AS uplift, round((yt / nullif(nt, 0) - yc / nullif(nc, 0)) * m, 6) AS incremental FROM k JOIN r ON r.r = k.m""",
    "sales_panel": f"WITH {_PANEL} SELECT * FROM p",
    "unpivot_panel": f"WITH {_PANEL}, q AS (SELECT date, replace(sku, 'Brand#', 'B_') AS sku, qty, promo FROM p) SELECT d.date, s.sku, 'B' AS brand, CAST(coalesce(qty, 0) AS DOUBLE) AS qty, CAST(coalesce(promo, 0) AS INT) AS promo FROM (SELECT DISTINCT date FROM q) d CROSS JOIN (SELECT DISTINCT sku FROM q) s LEFT JOIN q ON q.date = d.date AND q.sku = s.sku",
    "calendar_features": f"WITH {_PANEL} SELECT DISTINCT date, CAST(isodow(date) - 1 AS INT) AS weekday, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day, CAST(week(date) AS INT) AS week, CAST(isodow(date) >= 6 AS INT) AS weekend FROM p",
    "panel_features": f"""WITH {_PANEL}, {_F} SELECT date, sku, qty, promo, {", ".join(f"lag(qty, {n}) OVER w AS lag_{n}" for n in P.LAGS)},
{", ".join(f"round(CASE WHEN count(base) OVER w{n} = {n} THEN avg(base) OVER w{n} END, 6) AS mean_{n}" for n in P.WINDOWS)}, round(CASE WHEN count(base) OVER w28 = 28 THEN stddev_samp(base) OVER w28 END, 6) AS std_28,
round(CASE WHEN r >= 28 THEN avg(coalesce(CAST(base = 0 AS DOUBLE), 0)) OVER w28 END, 6) AS zero_share_28, lag(promo) OVER w AS promo_lag1, lead(promo) OVER w AS promo_lead1, round(CASE WHEN r > 6 AND count(promo) OVER wf = 7 THEN avg(promo) OVER wf END, 6) AS promo_next7
FROM feat WINDOW w AS (PARTITION BY sku ORDER BY date), {", ".join(f"w{n} AS (PARTITION BY sku ORDER BY date ROWS {n - 1} PRECEDING)" for n in P.WINDOWS)}, wf AS (PARTITION BY sku ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)""",
    "make_folds": f"WITH {_FOLDS} SELECT * FROM folds",
    "naive": f"WITH {_NAIVE}, pastd AS (SELECT fold, sku, arg_max(qty, p.date) AS y_pred FROM p, folds WHERE p.date <= train_end GROUP BY 1, 2) SELECT te.*, y_pred FROM te LEFT JOIN pastd USING (fold, sku)",
    "seasonal_naive": f"WITH {_SEAS} SELECT * FROM pred",
    "forecast_score": f"""WITH {_SEAS}, m AS (SELECT sku, avg(qty) AS m FROM p GROUP BY sku), c AS (SELECT quantile_cont(m, 1 / 3.0::DOUBLE) AS c1, quantile_cont(m, 2 / 3.0::DOUBLE) AS c2 FROM m), n AS (SELECT sku, CASE WHEN m <= c1 THEN 1 WHEN m <= c2 THEN 2 ELSE 3 END AS tercile FROM m, c),
st AS (SELECT sku, date, abs(qty - lag(qty, 7) OVER (PARTITION BY sku ORDER BY date)) AS step FROM p), sc AS (SELECT fold, sku, avg(step) AS scale FROM st, folds WHERE st.date <= train_end GROUP BY 1, 2),
er AS (SELECT pred.*, tercile, abs(y_true - y_pred) AS e FROM pred JOIN n USING (sku)), s AS (SELECT fold, sku, tercile, avg(e) AS mae FROM er GROUP BY 1, 2, 3), sm AS (SELECT s.*, CASE WHEN scale >= 1e-9 THEN mae / scale END AS mase FROM s LEFT JOIN sc USING (fold, sku)),
a AS (SELECT tercile, count(*) AS n, sqrt(avg(e * e)) AS rmse, sum(e) / sum(abs(y_true)) AS wape FROM er GROUP BY GROUPING SETS ((), (tercile))), b AS (SELECT tercile, avg(mase) AS mase, count(mase) AS mase_defined FROM sm GROUP BY GROUPING SETS ((), (tercile)))
SELECT CAST(a.tercile AS INT) AS tercile, n, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(mase, 6) AS mase, mase_defined FROM a JOIN b ON a.tercile IS NOT DISTINCT FROM b.tercile""",
    "pinball": f"""WITH {_SEAS}, q AS (SELECT y_true, y_pred * k AS q, n AS quantile, al FROM pred, (VALUES ('y_q10', 0.5::DOUBLE, 0.1::DOUBLE), ('y_q50', 1.0, 0.5), ('y_q90', 1.6, 0.9)) v(n, k, al) WHERE y_pred IS NOT NULL)
SELECT quantile, round(avg(greatest(al * (y_true - q), (al - 1) * (y_true - q))), 6) AS pinball, round(avg(CAST(y_true <= q AS DOUBLE)), 6) AS below FROM q GROUP BY quantile""",
    "interval_coverage": f"WITH {_SEAS} SELECT round(avg(CAST(y_true BETWEEN y_pred * 0.5::DOUBLE AND y_pred * 1.6::DOUBLE AS DOUBLE)), 6) AS coverage, count(*) AS n FROM pred WHERE y_pred IS NOT NULL",
    "select_skus": f"WITH {_PANEL} SELECT sku, round(avg(qty), 6) AS mean, round(avg(CAST(qty = 0 AS DOUBLE)), 6) AS zero_share FROM p GROUP BY sku HAVING avg(CAST(qty = 0 AS DOUBLE)) <= 0.1 ORDER BY avg(qty) DESC, sku LIMIT 8",
}

_RANKED = "SELECT row_number() OVER w AS r, sum(y * t) OVER w AS yt, sum(y * (1 - t)) OVER w AS yc, sum(t) OVER w AS nt, sum(1 - t) OVER w AS nc FROM {0} WINDOW w AS (ORDER BY score DESC, unit ROWS UNBOUNDED PRECEDING)"
_AREA = "SELECT sum(q) - arg_max(q, r) / 2 - max(r) * arg_max(q, r) / 2 AS area FROM (SELECT r, CASE WHEN nc = 0 THEN 0 ELSE yt - yc * nt / nc END AS q FROM ({0}) UNION ALL SELECT 0, 0)"
ORACLE["qini_coefficient"] = f"""WITH {_SC}, best AS (SELECT unit, y, t, CASE WHEN t = 1 THEN y - m ELSE m - y END AS score FROM s, (SELECT avg(y) AS m FROM s WHERE t = 0)), a AS ({_AREA.format(_RANKED.format("s"))}), b AS ({_AREA.format(_RANKED.format("best"))})
SELECT round(a.area, 6) AS area, round(b.area, 6) AS perfect, round(a.area / nullif(b.area, 0), 6) AS qini FROM a, b"""
# Easter by the Gregorian computus, in SQL
ORACLE["holiday_flags"] = f"""WITH {_PANEL}, ds AS (SELECT DISTINCT date FROM p), ys AS (SELECT CAST(unnest(range((SELECT min(year(date)) FROM ds), (SELECT max(year(date)) FROM ds) + 2)) AS INT) AS y),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys), e2 AS (SELECT y, a, c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, b FROM e1), e3 AS (SELECT y, a, h, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS x FROM e3), easter AS (SELECT make_date(y, x // 31, x % 31 + 1) AS day FROM e4),
off AS (SELECT day FROM easter UNION SELECT CAST(day + INTERVAL 1 DAY AS DATE) FROM easter UNION SELECT make_date(y, m, d) FROM ys, (VALUES {", ".join(f"({m}, {d})" for m, d in P.FIXED_HOLIDAYS)}) v(m, d))
SELECT date, CAST(date IN (SELECT day FROM off) AS INT) AS holiday, CAST(CAST(date + INTERVAL 1 DAY AS DATE) IN (SELECT day FROM off) AS INT) AS holiday_eve FROM ds"""
