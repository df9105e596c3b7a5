"""Relational queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import recsys as R
from ..operators import relational as L
from ..sources.tables import event_log, table

_EV = "ev AS (SELECT event_id, user_id AS visitorid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, event_type AS event, ts, value FROM events)"
KINDS = ["click", "error", "purchase", "signup", "view"]


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _encoded(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    known = L.vocabulary(c.filter("c_mktsegment != 'BUILDING'"), "c_mktsegment")
    return L.encode(c, known, "c_mktsegment", "code")


def _one_to_one(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return L.left_one_to_one(o.join(n.select("o_orderkey"), "o_orderkey", "left_semi"), n, ["o_orderkey"])


def _membership(s, d):
    e = event_log(s, d)
    return L.membership({k: e.filter(F.col("event") == k).select("visitorid").distinct() for k in KINDS}, "visitorid")


def _spearman(s, d):
    e = event_log(s, d)
    by = lambda k: e.filter(F.col("event") == k).groupBy("itemid").agg(F.count(F.lit(1)).alias("n"))
    return _r(R.spearman(by("view"), by("click"), "itemid", "n"), "rho")


def _comparison(s, d):
    o = table(s, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    return _r(M.comparison(o, "o_orderpriority", ["mean", "n"]), "value")


QUERIES = {
    "asof_snapshot": lambda s, d: L.as_of(event_log(s, d), "itemid", "ts", "event", F.lit("2024-01-15").cast("timestamp_ntz"), "event_id"),
    "vocabulary_codes": _encoded,
    "join_one_to_one": _one_to_one,
    "semi_join": lambda s, d: table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"),
    "anti_join": lambda s, d: table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"),
    "segment_rollup": lambda s, d: _r(L.with_total(table(s, d, "customer"), "c_mktsegment", n=F.count(F.lit(1)), mean=F.avg("c_acctbal")), "mean"),
    "set_membership": _membership,
    "cross_tab": lambda s, d: L.cross_tab(event_log(s, d), "itemid", "event", lambda c: F.count(F.when(c, 1)), KINDS),
    "seed_spread": lambda s, d: _r(L.spread(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), "mean", "std"),
    "stage_latency": lambda s, d: _r(L.latency(table(s, d, "events"), "event_type", "value"), "p50", "p95", "share"),
    "rank_correlation": _spearman,
    "best_by_metric": _comparison,
}
ORACLE = {
    "asof_snapshot": f"WITH {_EV} SELECT itemid, event FROM (SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1",
    "vocabulary_codes": "WITH v AS (SELECT c_mktsegment AS m, row_number() OVER (ORDER BY c_mktsegment) AS i FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')) SELECT c_custkey, c_mktsegment, CAST(coalesce(i, 0) AS INT) AS code FROM customer LEFT JOIN v ON m = c_mktsegment",
    "join_one_to_one": "SELECT o_orderkey, o_custkey, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "segment_rollup": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())",
    "set_membership": f"WITH {_EV} SELECT visitorid, " + ", ".join(f"CAST(max(CASE WHEN event = '{k}' THEN 1 ELSE 0 END) AS INT) AS {k}" for k in KINDS) + " FROM ev GROUP BY visitorid",
    "cross_tab": f"WITH {_EV} SELECT itemid, " + ", ".join(f"count(*) FILTER (WHERE event = '{k}') AS {k}" for k in KINDS) + " FROM ev GROUP BY itemid",
    "seed_spread": "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1, 2",
    "stage_latency": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type",
    "rank_correlation": f"""WITH {_EV}, c AS (SELECT itemid, count(*) FILTER (WHERE event = 'view') AS x, count(*) FILTER (WHERE event = 'click') AS y FROM ev GROUP BY itemid), p AS (SELECT * FROM c WHERE x > 0 AND y > 0),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) SELECT count(*) AS n, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS rho FROM r""",
    "best_by_metric": "WITH o AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS mean, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) SELECT 'mean' AS metric, (SELECT p FROM o ORDER BY round(mean, 12) DESC, p LIMIT 1) AS best, round((SELECT max(mean) FROM o), 6) AS value UNION ALL SELECT 'n', (SELECT p FROM o ORDER BY n DESC, p LIMIT 1), (SELECT max(n) FROM o)",
}
