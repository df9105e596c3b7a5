"""Queries of the jobs around the operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import panel as P
from ..operators import recsys as R
from ..sources.tables import sales_panel, scored_labels, table
from .experiment import _NAIVE, _PANEL, _RUN, _scored
from .sessions import _SESS, _TARGET, _items, _warm, hash01_sql
from .tabular import _S

SIZES = [5, 10, 20, 40]
LADDER = ["view", "click", "purchase"]
#: The last days are so few that all items are known by then: what is cold is looked for after the first day.
FIRST_DAYS = 1


def _cold(s, d):
    pairs = _items(s, d)
    ends = pairs.agg((F.date_trunc("day", F.min("ts")) + F.expr(f"interval {FIRST_DAYS} days")).alias("t")).first()["t"]
    known = pairs.filter(F.col("ts") < F.lit(ends)).select("itemid").distinct()
    return pairs, ends, known, J.cold_targets(pairs, ends, known)


def _cold_eval(s, d):
    *_, targets = _cold(s, d)
    return targets.select("session", "target", F.size("prefix").cast("bigint").alias("n_prefix"))


def _cold_popularity(s, d):
    pairs, cut, _, targets = _cold(s, d)
    categories = pairs.select("itemid", F.pmod("itemid", F.lit(7)).alias("category")).distinct()
    ranks = J.cold_popularity_ranks(targets, pairs, J.cold_items(pairs, cut), categories)
    return J.metrics_of_ranks(ranks, (1, 5, 10)).withColumns({c: F.round(c, 6) for c in ("hit", "mrr")})


def _weighted(s, d):
    split, targets, hist = _warm(s, d)
    return J.weighted_negatives(targets, R.popularity(split.train), hist, "sessions", 10)


def _coverage(s, d):
    t = table(s, d, "pages").select(F.nullif(F.regexp_extract("url", "/([a-z]+)/", 1), F.lit("")).alias("section"), F.col("html").alias("page"))
    return J.coverage(t, ["section", "page"]).withColumn("known", F.round("known", 6))


def _risk(s, d):
    banded = J.risk_bands(scored_labels(s, d), 0.2)
    return banded.groupBy("risk", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"))


def _stats(s, d):
    return J.processing_stats(table(s, d, "documents"), "source", "text")


def _wide(s, d):
    # quantities net of 20, and promotions that count twice on days of more than 40, so that there is something to find
    long = sales_panel(s, d).select("date", "sku", (F.col("qty") - 20).alias("qty"), (F.col("promo") + (F.col("qty") > 40).cast("int")).alias("promo"))
    skus = [r["sku"] for r in long.select("sku").distinct().orderBy("sku").collect()]  # columns of the wide table
    cells = lambda x, c: F.coalesce(F.sum(F.when(F.col("sku") == x, F.col(c))), F.lit(0))
    wide = long.groupBy(F.col("date").alias("DATE")).agg(*[cells(x, c).alias(f"{n}_{x}") for x in skus for n, c in (("QTY", "qty"), ("PROMO", "promo"))])
    return J.wide_violations(wide)


def _example(s, d):
    long = sales_panel(s, d)
    last = P.folds(long, 3, 28, 28).filter("fold = 2")
    fold = P.baseline(long, last, False)
    return J.example_series(fold, long, "none", 1)


def _ablation(s, d):
    e = table(s, d, "events")
    out = J.ablation_summary(e, "event_type", "user_id", "value", "value", LADDER)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median_cost", "delta")})


def _policy(s, d):
    out = J.policy_table(_scored(s, d), [0.1, 0.3, 0.5], 10.0, 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("uplift", "incremental", "profit")})


QUERIES = {
    "cold_start_eval": _cold_eval,
    "cold_category_popularity": _cold_popularity,
    "weighted_negatives": _weighted,
    "feature_coverage": _coverage,
    "risk_bands": _risk,
    "processing_stats": _stats,
    "wide_violations": _wide,
    "example_series": _example,
    "ablation_summary": _ablation,
    "policy_table": _policy,
    "catalogue_scaling": lambda s, d: J.catalogue_sizes(_items(s, d), SIZES),
}

_COLD = f"""{_SESS}, cut0 AS (SELECT date_trunc('day', min(ts)) + INTERVAL {FIRST_DAYS} DAY AS t FROM si), known AS (SELECT DISTINCT itemid FROM si, cut0 WHERE ts < t),
cold AS (SELECT itemid FROM si GROUP BY itemid HAVING min(ts) >= (SELECT t FROM cut0) AND count(DISTINCT session) >= 2),
la AS (SELECT session, ts, itemid AS target FROM (SELECT si.*, row_number() OVER (PARTITION BY session ORDER BY ts DESC, itemid DESC) AS r FROM si, cut0 WHERE ts >= t) WHERE r = 1 AND itemid IN (SELECT itemid FROM cold)),
pre AS (SELECT la.session, la.target, la.ts, si.itemid FROM la JOIN si ON si.session = la.session AND si.ts <= la.ts AND si.itemid <> la.target AND si.itemid IN (SELECT itemid FROM known)),
ct AS (SELECT session, target, ts, count(DISTINCT itemid) AS n_prefix FROM pre GROUP BY ALL)"""
ORACLE = {
    "cold_start_eval": f"WITH {_COLD} SELECT session, target, n_prefix FROM ct",
    "cold_category_popularity": f"""WITH {_COLD}, md AS (SELECT session, category AS mode FROM (SELECT session, itemid % 7 AS category, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, itemid % 7) AS r FROM pre GROUP BY 1, 2) WHERE r = 1),
n AS (SELECT ct.session, si.itemid, count(*) AS n FROM ct JOIN si ON si.ts < ct.ts AND si.itemid IN (SELECT itemid FROM cold) GROUP BY 1, 2),
rk AS (SELECT ct.session, cold.itemid, ct.target, row_number() OVER (PARTITION BY ct.session ORDER BY coalesce(cold.itemid % 7 = md.mode, false) DESC, coalesce(n.n, 0) DESC, cold.itemid) AS rank FROM ct CROSS JOIN cold LEFT JOIN md ON md.session = ct.session LEFT JOIN n ON n.session = ct.session AND n.itemid = cold.itemid)
SELECT CAST(k AS INT) AS k, count(*) AS sessions, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr FROM rk, (VALUES (1), (5), (10)) v(k) WHERE itemid = target GROUP BY k""",
    "weighted_negatives": f"""WITH {_TARGET}, wt AS (SELECT session, target FROM tg WHERE cohort = 'warm'), pop AS (SELECT itemid, count(DISTINCT session) AS sessions FROM tr GROUP BY itemid),
o AS (SELECT wt.session, pop.itemid, round(-ln(greatest({hash01_sql("0", "wt.session", "pop.itemid")}, 1e-12)) / sessions, 12) AS time FROM wt CROSS JOIN pop LEFT JOIN hist h ON h.session = wt.session AND h.itemid = pop.itemid WHERE h.itemid IS NULL AND pop.itemid <> wt.target)
SELECT session, itemid FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY time, itemid) AS r FROM o) WHERE r <= 10""",
    "feature_coverage": "SELECT 'section' AS feature, round(avg(CAST(regexp_extract(url, '/([a-z]+)/', 1) <> '' AS DOUBLE)), 6) AS known FROM pages UNION ALL SELECT 'page', round(avg(CAST(html IS NOT NULL AS DOUBLE)), 6) FROM pages",
    "risk_bands": f"WITH {_S} SELECT CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.2 THEN 'Medium' ELSE 'Low' END AS risk, CAST(score >= 0.2 AS INT) AS prediction, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM s GROUP BY 1, 2",
    "processing_stats": "SELECT source, count(*) AS documents, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS characters, CAST(max(coalesce(length(text), 0)) AS INT) AS longest, CAST(count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS BIGINT) AS empty FROM documents GROUP BY source",
    "wide_violations": f"WITH {_PANEL} SELECT count(DISTINCT date) AS rows, CAST(0 AS BIGINT) AS repeated_dates, count(*) FILTER (WHERE qty < 20) AS negative_qty, count(*) FILTER (WHERE promo + CAST(qty > 40 AS INT) NOT IN (0, 1)) AS bad_promo FROM p",
    "example_series": f"WITH {_NAIVE}, f AS (SELECT p.sku, sum(p.qty) AS volume, sum(p.promo) AS days FROM p WHERE EXISTS (SELECT 1 FROM te WHERE te.fold = 2 AND te.sku = p.sku AND te.date = p.date) GROUP BY 1) SELECT sku, volume FROM f WHERE days >= 1 ORDER BY volume DESC, sku LIMIT 1",
    "ablation_summary": """WITH per AS (SELECT event_type AS arm, user_id AS q, avg(value) AS v, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS step FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)
SELECT a.arm, count(*) AS n, round(avg(a.v), 6) AS mean, round(quantile_cont(a.v, 0.5), 6) AS median_cost, round(avg(a.v - b.v), 6) AS delta FROM per a LEFT JOIN per b ON b.step = a.step - 1 AND b.q = a.q GROUP BY a.arm""",
    "policy_table": f"""WITH {_RUN}, k AS (SELECT CAST(share AS DOUBLE) AS share, greatest(1, CAST(round_even(share * (SELECT max(r) FROM r), 0) AS BIGINT)) AS m FROM (VALUES (0.1), (0.3), (0.5)) v(share)),
up AS (SELECT share, m, yt / nullif(nt, 0) - yc / nullif(nc, 0) AS u FROM k JOIN r ON r.r = k.m) SELECT share, m, round(u, 6) AS uplift, round(u * m, 6) AS incremental, round(u * m * 10.0 - m * 0.5, 6) AS profit FROM up""",
    "catalogue_scaling": f"""WITH {_SESS}, pop AS (SELECT itemid, row_number() OVER (ORDER BY count(DISTINCT session) DESC, itemid) AS place FROM si GROUP BY itemid)
SELECT CAST(size AS INT) AS size, count(DISTINCT si.itemid) AS items, count(DISTINCT session) AS sessions, count(*) AS pairs, count(DISTINCT si.itemid) * count(DISTINCT si.itemid) * 8 / 1e9::DOUBLE AS dense_gb FROM si JOIN pop USING (itemid), (VALUES {", ".join(f"({n})" for n in SIZES)}) v(size) WHERE place <= size GROUP BY size""",
}
