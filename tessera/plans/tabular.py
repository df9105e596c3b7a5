"""Curves, thresholds, splits and drift queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular as T
from ..sources.tables import scored_labels, table

_S = "s AS (SELECT doc_id AS id, CAST(quality AS INT) AS y, floor(least(n_chars, 9999) / 100.0) / 100.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_C = f"{_S}, b AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM s GROUP BY score), c AS (SELECT score, n, pos, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, (SELECT sum(y) FROM s) AS p, (SELECT count(*) FROM s) AS total FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
_CUT = "1998-07-01"
_O = f"o AS (SELECT *, o_orderdate < TIMESTAMP '{_CUT}' AS old FROM orders)"


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _orders(s, d):
    o = table(s, d, "orders")
    return o.filter(F.col("o_orderdate") < _CUT), o.filter(F.col("o_orderdate") >= _CUT)


def _model(s, d):
    lines = table(s, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), "o_totalprice", "o_orderpriority")
    model = T.pipeline(["o_totalprice"], ["o_orderpriority"]).fit(lines)
    from pyspark.ml.functions import vector_to_array

    return T.roc_auc(model.transform(lines).select(F.col("label").alias("y"), F.round(vector_to_array("probability")[1], 9).alias("score")))


def _align(s, d):
    made, report = T.align_schema(table(s, d, "orders"), ["o_orderkey", "o_totalprice", "o_missing"])
    return made


def _drift(s, d):
    old, new = _orders(s, d)
    return T.drift(old, new, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])


QUERIES = {
    "pr_curve": lambda s, d: _r(T.precision_recall(scored_labels(s, d)), "precision", "recall", "f1"),
    "roc_auc": lambda s, d: _r(T.roc_auc(scored_labels(s, d)), "auc", "average_precision"),
    "threshold_f1": lambda s, d: _r(T.threshold_f1(scored_labels(s, d)), "f1"),
    "threshold_recall": lambda s, d: _r(T.threshold_recall(scored_labels(s, d), 0.5), "recall", "precision"),
    "threshold_top": lambda s, d: _r(T.threshold_top(scored_labels(s, d), 0.2), "threshold"),
    "threshold_cost": lambda s, d: T.threshold_cost(scored_labels(s, d), 100.0, 10.0),
    "evaluate_threshold": lambda s, d: _r(T.at_threshold(scored_labels(s, d), 0.1), "accuracy", "precision", "recall", "f1"),
    "reference_stats": lambda s, d: _r(T.reference_numeric(table(s, d, "orders"), ["o_totalprice", "o_custkey"]), "mean", "std", "q25", "median", "q75", "missing_rate"),
    "category_shares": lambda s, d: _r(T.shares(table(s, d, "orders"), "o_orderpriority"), "share"),
    "psi": lambda s, d: _r(T.psi(*[T.shares(x, "o_orderpriority") for x in _orders(s, d)]), "psi"),
    "probability_histogram": lambda s, d: _r(T.histogram(scored_labels(s, d), "score"), "share"),
    "ks_statistic": lambda s, d: _r(T.ks(*_orders(s, d), "o_totalprice"), "d"),
    "prediction_drift": lambda s, d: _r(T.prediction_drift(0.5, scored_labels(s, d).withColumn("p", F.col("score") >= 0.1), "p"), "rate", "change"),
    "analyze_drift": _drift,
    "align_schema": _align,
    "coerce_numeric": lambda s, d: T.coerce(table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_acctbal").cast("string")).alias("total"), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("No").alias("churn")), ["total"], "churn"),
    "rule_violations": lambda s, d: T.rule_violations(table(s, d, "lineitem"), {"discount_range": F.col("l_discount").between(0, 0.05), "flag_known": F.col("l_returnflag").isin("A", "N"), "quantity_positive": F.col("l_quantity") > 0}),
    "stratified_split": lambda s, d: T.stratified_split(scored_labels(s, d), "y", "id").groupBy("y", "part").agg(F.count(F.lit(1)).alias("n")),
    "regression_metrics": lambda s, d: _r(T.regression_metrics(table(s, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p"), "rmse", "mae", "r2"),
    "model_auc": _model,
}
_STAT = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(avg(CAST(v IS NULL AS DOUBLE)), 6) AS missing_rate"
ORACLE = {
    "pr_curve": f"WITH {_C} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall, round(2 * tp / CAST(tp + fp + p AS DOUBLE), 6) AS f1 FROM c",
    "roc_auc": f"WITH {_C} SELECT round(CAST(sum((n - pos) * (tp - pos / 2.0)) AS DOUBLE) / (max(p) * (max(total) - max(p))), 6) AS auc, round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(p), 6) AS average_precision, CAST(max(total) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS positives FROM c",
    "threshold_f1": f"WITH {_C}, f AS (SELECT score, round(2 * tp / CAST(tp + fp + p AS DOUBLE), 12) AS f FROM c) SELECT score AS threshold, round(f, 6) AS f1 FROM f ORDER BY f DESC, score LIMIT 1",
    "threshold_recall": f"WITH {_C} SELECT score AS threshold, round(tp / CAST(p AS DOUBLE), 6) AS recall, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision FROM c WHERE tp / CAST(tp + fp AS DOUBLE) >= 0.5 ORDER BY tp DESC, tp / CAST(tp + fp AS DOUBLE) DESC, score DESC LIMIT 1",
    "threshold_top": f"WITH {_C} SELECT round(score - 1e-10, 6) AS threshold, CAST(floor(total * 0.2) AS BIGINT) AS k, CAST(tp + fp AS BIGINT) AS flagged FROM c WHERE tp + fp >= floor(total * 0.2) ORDER BY score DESC LIMIT 1",
    "threshold_cost": f"WITH {_C} SELECT score AS threshold, CAST(100.0 * (p - tp) + 10.0 * fp AS DOUBLE) AS cost FROM c ORDER BY 2, 1 LIMIT 1",
    "evaluate_threshold": f"WITH {_S}, m AS (SELECT count(*) FILTER (WHERE score >= 0.1 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.1 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.1 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.1 AND y = 0) AS tn FROM s) SELECT *, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM m",
    "reference_stats": f"SELECT 'o_totalprice' AS feature, {_STAT} FROM (SELECT o_totalprice AS v FROM orders) UNION ALL SELECT 'o_custkey', {_STAT} FROM (SELECT CAST(o_custkey AS DOUBLE) AS v FROM orders)",
    "category_shares": "SELECT o_orderpriority AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM orders GROUP BY 1",
    "psi": f"""WITH {_O}, e AS (SELECT o_orderpriority AS v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM o WHERE old GROUP BY 1), a AS (SELECT o_orderpriority AS v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM o WHERE NOT old GROUP BY 1),
j AS (SELECT greatest(coalesce(a.s, 0), 1e-4) AS a, greatest(coalesce(e.s, 0), 1e-4) AS e FROM e FULL JOIN a ON e.v IS NOT DISTINCT FROM a.v), r AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM j) SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS band FROM r""",
    "probability_histogram": f"WITH {_S} SELECT CAST(CAST(least(greatest(floor(score * 10), 0), 9) AS BIGINT) AS VARCHAR) AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM s GROUP BY 1",
    "ks_statistic": f"WITH {_O}, v AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE old) AS x, count(*) FILTER (WHERE NOT old) AS y FROM o GROUP BY 1), c AS (SELECT sum(x) OVER (ORDER BY v) AS cx, sum(y) OVER (ORDER BY v) AS cy, sum(x) OVER () AS n1, sum(y) OVER () AS n2 FROM v) SELECT round(max(abs(cx / CAST(n1 AS DOUBLE) - cy / CAST(n2 AS DOUBLE))), 6) AS d, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM c",
    "prediction_drift": f"WITH {_S}, r AS (SELECT avg(CAST(score >= 0.1 AS DOUBLE)) AS rate FROM s) SELECT round(rate, 6) AS rate, round(abs(rate - 0.5), 6) AS change, abs(rate - 0.5) > 0.1 AS drifted FROM r",
    "align_schema": "SELECT o_orderkey, o_totalprice, CAST(NULL AS DOUBLE) AS o_missing FROM orders",
    "coerce_numeric": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS total, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS churn FROM customer",
    "rule_violations": "SELECT 'discount_range' AS rule, count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) AS violations FROM lineitem UNION ALL SELECT 'flag_known', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'quantity_positive', count(*) FILTER (WHERE l_quantity <= 0) FROM lineitem",
    "stratified_split": f"WITH {_S}, n AS (SELECT y, count(*) AS n FROM s GROUP BY y), k AS (SELECT y, n, CAST(round(n * 0.2::DOUBLE) AS BIGINT) AS t FROM n), v AS (SELECT *, CAST(round((n - t) * 0.25::DOUBLE) AS BIGINT) AS v FROM k) SELECT y, 'test' AS part, t AS n FROM v UNION ALL SELECT y, 'validation', v FROM v UNION ALL SELECT y, 'train', n - t - v FROM v",
    "regression_metrics": "WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM e",
}
