"""Session and recommender queries over the event log, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import stored
from ..operators import recsys as R
from ..operators import sessions as S
from ..sources.tables import event_log

GAP = "12 hours"
DAYS = 7
MIN_ITEMS, MIN_SESSIONS = 2, 3

_EV = """ev AS (SELECT event_id, user_id AS visitorid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, event_type AS event, ts FROM events)"""
_SESS = f"""{_EV}, se0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM ev WINDOW w AS (PARTITION BY visitorid ORDER BY ts, event_id)),
se AS (SELECT event_id, visitorid, itemid, event, ts, CAST(visitorid * 1000000 + sum(f) OVER (PARTITION BY visitorid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM se0),
si AS (SELECT session, itemid, min(ts) AS ts, count(*) AS n_events FROM se GROUP BY session, itemid)"""


def _kcore_sql(source: str, name: str, rounds: int) -> str:
    out, prev = [], source
    for k in range(rounds):
        out.append(f"{name}a{k} AS (SELECT * FROM {prev} WHERE session IN (SELECT session FROM {prev} GROUP BY session HAVING count(*) >= {MIN_ITEMS}))")
        out.append(f"{name}b{k} AS (SELECT * FROM {name}a{k} WHERE itemid IN (SELECT itemid FROM {name}a{k} GROUP BY itemid HAVING count(*) >= {MIN_SESSIONS}))")
        prev = f"{name}b{k}"
    return ", ".join(out) + f", {name} AS (SELECT * FROM {prev})"


_CUT = f"{_SESS}, cut AS (SELECT date_trunc('day', max(ts)) - INTERVAL {DAYS} DAY AS t FROM si), span AS (SELECT session, min(ts) AS lo, max(ts) AS hi FROM si GROUP BY session)"
_SPLIT = f"""{_CUT}, tr0 AS (SELECT si.* FROM si JOIN span USING (session), cut WHERE hi < t), te AS (SELECT si.* FROM si JOIN span USING (session), cut WHERE lo >= t),
{_kcore_sql("tr0", "core", 5)}, vocab AS (SELECT DISTINCT itemid FROM core), tr1 AS (SELECT * FROM tr0 WHERE itemid IN (SELECT itemid FROM vocab)),
tr AS (SELECT * FROM tr1 WHERE session IN (SELECT session FROM tr1 GROUP BY session HAVING count(*) >= {MIN_ITEMS}))"""
_TARGET = f"""{_SPLIT}, tv AS (SELECT te.*, v.itemid IS NOT NULL AS known, row_number() OVER (PARTITION BY session ORDER BY te.ts DESC, te.itemid DESC) AS r FROM te LEFT JOIN vocab v ON te.itemid = v.itemid),
tg0 AS (SELECT session, max(CASE WHEN r = 1 THEN itemid END) AS target, bool_or(r = 1 AND known) AS warm, count(*) FILTER (WHERE r > 1 AND known) AS n_prefix FROM tv GROUP BY session),
tg AS (SELECT *, CASE WHEN n_prefix = 0 THEN 'insufficient' WHEN warm THEN 'warm' ELSE 'cold' END AS cohort FROM tg0),
hist AS (SELECT tv.session, tv.itemid FROM tv JOIN tg USING (session) WHERE r > 1 AND known AND cohort = 'warm')"""
_KNN = f"""{_TARGET}, sup AS (SELECT itemid, count(DISTINCT session) AS s FROM tr GROUP BY itemid),
co AS (SELECT a.itemid, b.itemid AS neighbour, count(*) AS both_n FROM tr a JOIN tr b ON a.session = b.session AND a.itemid <> b.itemid GROUP BY 1, 2),
sim AS (SELECT co.itemid, neighbour, both_n / (sqrt(CAST(s1.s AS DOUBLE) * s2.s) + 10.0) AS similarity FROM co JOIN sup s1 ON co.itemid = s1.itemid JOIN sup s2 ON co.neighbour = s2.itemid),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY similarity DESC, neighbour) AS rank FROM sim) WHERE rank <= 50),
sc AS (SELECT h.session, k.neighbour AS itemid, sum(similarity) AS score FROM hist h JOIN knn k ON h.itemid = k.itemid GROUP BY 1, 2),
sc1 AS (SELECT sc.* FROM sc LEFT JOIN hist h ON sc.session = h.session AND sc.itemid = h.itemid WHERE h.itemid IS NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(score, 9) DESC, itemid) AS rank FROM sc1),
wt AS (SELECT session, target FROM tg WHERE cohort = 'warm')"""
_POP = f"""{_KNN}, pop AS (SELECT itemid, count(DISTINCT session) AS sessions FROM tr GROUP BY itemid),
pr AS (SELECT wt.session, pop.itemid, sessions FROM wt CROSS JOIN pop LEFT JOIN hist h ON wt.session = h.session AND pop.itemid = h.itemid WHERE h.itemid IS NULL),
prk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sessions DESC, itemid) AS rank FROM pr)"""


def _items(spark, d):
    return S.session_items(S.sessionize(event_log(spark, d), GAP))


def _split(spark, d):
    return S.temporal_split(stored(_items(spark, d), "session-items"), DAYS, MIN_ITEMS, MIN_SESSIONS)


def _warm_lists(spark, d):
    """(split, warm sessions as (session, target, prefix))"""
    split = _split(spark, d)
    warm = S.prefix_target(split.test, split.vocabulary).filter("cohort = 'warm'").select("session", "target", "prefix")
    return split, stored(warm, "warm")


def _warm(spark, d):
    """(split, targets, histories of warm sessions as rows)"""
    split, warm = _warm_lists(spark, d)
    return split, warm.select("session", "target"), warm.select("session", F.explode("prefix").alias("itemid"))


def _knn(split):
    return R.item_knn(split.train, 50, 10.0)


def _ranked(spark, d, k):
    split, targets, hist = _warm(spark, d)
    return split, targets, hist, stored(R.recommend(hist, _knn(split), k), "recommended")


def _popular_ranked(split, targets, hist, k):
    return R.unseen_popular(R.popularity(split.train), targets, hist, k)


def _prefix(spark, d):
    split = _split(spark, d)
    t = S.prefix_target(split.test, split.vocabulary)
    return t.select("session", "target", "warm", F.size("prefix").cast("bigint").alias("n_prefix"), "cohort")


def _metrics(spark, d):
    _, targets, _, ranked = _ranked(spark, d, 50)
    m = R.rank_metrics(ranked, targets, (10, 20, 50))
    return m.select("k", "sessions", *[F.round(c, 6).alias(c) for c in ("hit", "ndcg", "mrr")])


def _operational(spark, d):
    split, targets, _, ranked = _ranked(spark, d, 20)
    cold = S.prefix_target(split.test, split.vocabulary).filter("cohort = 'cold'").select("session", "target")
    m = R.rank_metrics(ranked, targets.union(cold), (20,))
    return m.select("k", "sessions", *[F.round(c, 6).alias(c) for c in ("hit", "ndcg", "mrr")])


def _beyond(spark, d):
    split, _, _, ranked = _ranked(spark, d, 10)
    m = R.beyond_accuracy(ranked, split.train, 10)
    return m.select("k", *[F.round(c, 6).alias(c) for c in ("coverage", "gini", "popularity")])


def _both(spark, d, k):
    split, targets, hist, knn = _ranked(spark, d, k)
    pop = _popular_ranked(split, targets, hist, k)
    cols = ["session", "itemid", "rank"]
    return targets, stored(knn.select(F.lit("itemknn").alias("model"), *cols).union(pop.select(F.lit("popularity").alias("model"), *cols)), "both")


def _ceiling(spark, d):
    targets, both = _both(spark, d, 50)
    return R.retrieval_ceiling(both, targets, (5, 10, 50)).withColumn("recall", F.round("recall", 6))


def _blend(spark, d):
    targets, both = _both(spark, d, 10)
    blends = {"itemknn": ("itemknn",), "popularity": ("popularity",), "both": ("itemknn", "popularity")}
    return R.blend_ceiling(both, targets, blends, 10).withColumn("recall", F.round("recall", 6))


def _fill(spark, d):
    split, targets, hist, ranked = _ranked(spark, d, 10)
    out = R.fill_up(ranked, targets, hist, R.popularity(split.train), 10)
    return out.select("session", "itemid", "rank", "strategy", F.round("score", 6).alias("score"))


def _asof(spark, d):
    events = event_log(spark, d).select("itemid", "ts")
    at = S.session_items(S.sessionize(event_log(spark, d), GAP)).groupBy("session").agg(F.max("ts").alias("ts"))
    return R.asof_counts(events, at)


def _features(spark, d):
    split, targets, hist, ranked = _ranked(spark, d, 20)
    cats = split.vocabulary.select("itemid", F.pmod("itemid", F.lit(7)).alias("category"))
    f = R.ranker_features(ranked, hist, R.popularity(split.train), cats)
    return f.select("session", "itemid", F.round("score", 6).alias("score"), "rank0", F.round("log_popularity", 6).alias("log_popularity"), "length", "n_categories", "category_seen", F.round("category_share", 6).alias("category_share"))


def _sampled(spark, d):
    split, targets, hist = _warm(spark, d)
    scored = R.score_histories(hist, _knn(split))
    return R.sampled_ranks(scored, targets, split.vocabulary, hist, 20)


def _disagreement(spark, d):
    targets, both = _both(spark, d, 50)
    full = R.retrieval_ceiling(both, targets, (10,)).select("model", F.round("recall", 6).alias("recall"))
    short = R.retrieval_ceiling(both, targets, (5,)).select("model", F.round("recall", 6).alias("recall_5"))
    return full.join(short, "model")


def _cold(spark, d):
    pairs = _items(spark, d)
    cut = S.cutoff_before(pairs, DAYS)
    old = pairs.filter(F.col("ts") < F.lit(cut)).select("itemid").distinct()
    test = pairs.filter(F.col("ts") >= F.lit(cut)).join(old.withColumn("old", F.lit(1)), "itemid", "left")
    return test.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session").alias("sessions"), F.round(F.avg(F.col("old").isNull().cast("double")), 6).alias("cold_share"))


def _bootstrap(spark, d):
    _, targets, _, ranked = _ranked(spark, d, 20)
    hit = targets.join(ranked.withColumnRenamed("itemid", "target"), ["session", "target"], "left").select("session", F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0).alias("hit"))
    return R.bootstrap_ci(hit, "hit", "session", 200)


def _paired(spark, d):
    split, targets, hist, knn = _ranked(spark, d, 20)
    hit = lambda r: targets.join(r.select("session", F.col("itemid").alias("target"), "rank"), ["session", "target"], "left").select("session", F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0).alias("hit"))
    return R.paired_bootstrap(hit(knn), hit(_popular_ranked(split, targets, hist, 20)), "hit", "session", 200)


def _ease(spark, d):
    split, targets, hist = _warm(spark, d)
    return R.recommend(hist, R.ease(split.train, 50.0), 10)


def _als(spark, d):
    split, targets, hist = _warm(spark, d)
    y = R.als_factors(split.train)
    u = R.fold_in(hist, y)
    from ..operators.text import vector_top_k

    return vector_top_k(y, u, "itemid", "y", "session", "u", 10)


def _loo(spark, d):
    return S.leave_one_out(_items(spark, d)).groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("sessions"))


QUERIES = {
    "load_report": lambda s, d: S.load_report(event_log(s, d)),
    "dedup_exact": lambda s, d: S.clean_events(event_log(s, d)),
    "sessionize": lambda s, d: S.sessionize(event_log(s, d), GAP),
    "sessionize_30min": lambda s, d: S.sessionize(event_log(s, d)).select("event_id", "session"),
    "session_items": lambda s, d: _items(s, d),
    "popularity_topk": lambda s, d: R.popularity_top_k(_items(s, d), 20),
    "kcore": lambda s, d: S.k_core(_items(s, d), MIN_ITEMS, MIN_SESSIONS)[0].select("session", "itemid"),
    "temporal_split": lambda s, d: (lambda x: x.train.select("session", "itemid", F.lit("train").alias("part")).union(x.test.select("session", "itemid", F.lit("test"))))(_split(s, d)),
    "validation_split": lambda s, d: S.validation_sessions(_items(s, d), DAYS).select("session", "itemid"),
    "nested_split": lambda s, d: S.nested_windows(_items(s, d), DAYS).select("session", "itemid", "window"),
    "leave_one_out": _loo,
    "prefix_target": _prefix,
    "cohort_report": lambda s, d: S.cohort_report(_prefix(s, d)).withColumn("share", F.round("share", 6)),
    "sequences": lambda s, d: (lambda p: S.sequences(p, p.select("session").distinct()).select("session", F.array_join("items", ",").alias("items")))(_items(s, d)),
    "itemknn_topk": lambda s, d: _knn(_split(s, d)).select("itemid", "neighbour", F.round("similarity", 6).alias("similarity"), "rank"),
    "itemknn_recommend": lambda s, d: _ranked(s, d, 20)[3].select("session", "itemid", F.round("score", 6).alias("score"), "rank"),
    "rank_metrics": _metrics,
    "operational_metrics": _operational,
    "beyond_accuracy": _beyond,
    "retrieval_ceiling": _ceiling,
    "blend_ceiling": _blend,
    "popularity_fallback": _fill,
    "asof_cold_counts": _asof,
    "ranker_features": _features,
    "sampled_ranks": _sampled,
    "protocol_disagreement": _disagreement,
    "cold_share": _cold,
    "bootstrap_ci": _bootstrap,
    "paired_bootstrap": _paired,
    "ease_topk": _ease,
    "als_topk": _als,
}

_METRIC = "round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(CASE WHEN rank <= k THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg, round(avg(CASE WHEN rank <= k THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr"

ORACLE = {
    "load_report": f"""WITH {_EV}, g AS (SELECT visitorid, itemid, event, ts, count(*) AS n FROM ev GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows_read, CAST(coalesce(sum(n) FILTER (WHERE visitorid IS NULL OR itemid IS NULL OR event IS NULL OR ts IS NULL), 0) AS BIGINT) AS null_keys,
CAST(coalesce(sum(n) FILTER (WHERE event NOT IN ('view', 'click', 'purchase')), 0) AS BIGINT) AS other_kinds, CAST(coalesce(sum(n - 1) FILTER (WHERE event IN ('view', 'click', 'purchase')), 0) AS BIGINT) AS repeats,
count(*) FILTER (WHERE event IN ('view', 'click', 'purchase')) AS rows_kept, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts FROM g""",
    "dedup_exact": f"WITH {_EV} SELECT visitorid, itemid, event, ts, min(event_id) AS event_id FROM ev WHERE event IN ('view', 'click', 'purchase') AND itemid IS NOT NULL GROUP BY ALL",
    "sessionize": f"WITH {_SESS} SELECT * FROM se",
    "sessionize_30min": f"WITH {_SESS.replace('INTERVAL 12 HOUR', 'INTERVAL 30 MINUTE')} SELECT event_id, session FROM se",
    "session_items": f"WITH {_SESS} SELECT * FROM si",
    "popularity_topk": f"WITH {_SESS} SELECT * FROM (SELECT itemid, count(DISTINCT session) AS sessions, CAST(row_number() OVER (ORDER BY count(DISTINCT session) DESC, itemid) AS INT) AS rank FROM si GROUP BY itemid) WHERE rank <= 20",
    "kcore": f"WITH {_SESS}, {_kcore_sql('si', 'core', 5)} SELECT session, itemid FROM core",
    "temporal_split": f"WITH {_SPLIT} SELECT session, itemid, 'train' AS part FROM tr UNION ALL SELECT session, itemid, 'test' FROM te",
    "validation_split": f"WITH {_CUT} SELECT session, itemid FROM si JOIN span USING (session), cut WHERE hi < t",
    "nested_split": f"WITH {_CUT} SELECT session, itemid, CASE WHEN ts < t - INTERVAL {DAYS} DAY THEN 'A' WHEN ts < t THEN 'B' ELSE 'C' END AS \"window\" FROM si, cut",
    "leave_one_out": f"WITH {_SESS} SELECT true AS held_out, count(DISTINCT session) AS n, count(DISTINCT session) AS sessions FROM si UNION ALL SELECT false, count(*) - count(DISTINCT session), (SELECT count(*) FROM (SELECT session FROM si GROUP BY session HAVING count(*) > 1)) FROM si",
    "prefix_target": f"WITH {_TARGET} SELECT * FROM tg",
    "cohort_report": f"WITH {_TARGET} SELECT cohort, count(*) AS sessions, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM tg GROUP BY cohort",
    "sequences": f"WITH {_SESS} SELECT session, string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY ts, itemid) AS items FROM si GROUP BY session",
    "itemknn_topk": f"WITH {_KNN} SELECT itemid, neighbour, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM knn",
    "itemknn_recommend": f"WITH {_KNN} SELECT session, itemid, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 20",
    "rank_metrics": f"WITH {_KNN} SELECT CAST(k AS INT) AS k, count(*) AS sessions, {_METRIC} FROM wt LEFT JOIN rk ON wt.session = rk.session AND wt.target = rk.itemid AND rk.rank <= 50, (VALUES (10), (20), (50)) AS ks(k) GROUP BY k",
    "operational_metrics": f"WITH {_KNN}, w2 AS (SELECT session, target FROM tg WHERE cohort IN ('warm', 'cold')) SELECT CAST(20 AS INT) AS k, count(*) AS sessions, {_METRIC.replace('<= k', '<= 20')} FROM w2 LEFT JOIN rk ON w2.session = rk.session AND w2.target = rk.itemid AND rk.rank <= 20",
    "beyond_accuracy": f"""WITH {_POP}, x AS (SELECT itemid, count(*) AS x FROM rk WHERE rank <= 10 GROUP BY itemid), it AS (SELECT pop.itemid, coalesce(x, 0) AS x, sessions FROM pop LEFT JOIN x USING (itemid)),
m AS (SELECT x, row_number() OVER (ORDER BY x, itemid) AS i, (row_number() OVER (ORDER BY sessions, itemid) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS pct, count(*) OVER () AS n FROM it)
SELECT CAST(10 AS INT) AS k, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(coalesce(CAST(sum((2 * i - n - 1) * x) AS DOUBLE) / nullif(max(n) * sum(x), 0), 0), 6) AS gini, round(sum(pct * x) / sum(x), 6) AS popularity FROM m""",
    "retrieval_ceiling": f"""WITH {_POP}, b AS (SELECT 'itemknn' AS model, session, itemid, rank FROM rk WHERE rank <= 50 UNION ALL SELECT 'popularity', session, itemid, rank FROM prk WHERE rank <= 50)
SELECT model, CAST(n AS INT) AS n, round(avg(CASE WHEN rank <= n THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT * FROM wt, (SELECT DISTINCT model FROM b)) t LEFT JOIN b ON b.model = t.model AND b.session = t.session AND b.itemid = t.target, (VALUES (5), (10), (50)) v(n) GROUP BY model, n""".replace("SELECT model, CAST", "SELECT t.model, CAST").replace("GROUP BY model, n", "GROUP BY t.model, n"),
    "blend_ceiling": f"""WITH {_POP}, h AS (SELECT wt.session, bool_or(coalesce(rk.rank <= 10, false)) AS a, bool_or(coalesce(prk.rank <= 10, false)) AS b FROM wt LEFT JOIN rk ON wt.session = rk.session AND wt.target = rk.itemid LEFT JOIN prk ON wt.session = prk.session AND wt.target = prk.itemid GROUP BY wt.session)
SELECT 'itemknn' AS blend, round(avg(CAST(a AS DOUBLE)), 6) AS recall FROM h UNION ALL SELECT 'popularity', round(avg(CAST(b AS DOUBLE)), 6) FROM h UNION ALL SELECT 'both', round(avg(CAST(a OR b AS DOUBLE)), 6) FROM h""",
    "popularity_fallback": f"""WITH {_POP}, r10 AS (SELECT * FROM rk WHERE rank <= 10), n AS (SELECT wt.session, coalesce(max(rank), 0) AS n FROM wt LEFT JOIN r10 USING (session) GROUP BY wt.session),
o AS (SELECT prk.session, prk.itemid, n.n, row_number() OVER (PARTITION BY prk.session ORDER BY sessions DESC, prk.itemid) AS r FROM prk JOIN n USING (session) LEFT JOIN r10 ON prk.session = r10.session AND prk.itemid = r10.itemid WHERE r10.itemid IS NULL AND n.n < 10)
SELECT session, itemid, CAST(rank AS INT) AS rank, 'similar' AS strategy, round(score, 6) AS score FROM r10 UNION ALL SELECT session, itemid, CAST(r + n AS INT), 'popular', CAST(NULL AS DOUBLE) FROM o WHERE r + n <= 10""",
    "asof_cold_counts": f"WITH {_SESS}, ends AS (SELECT session, max(ts) AS t FROM si GROUP BY session) SELECT session, itemid, count(*) AS n FROM ev JOIN ends ON ev.ts < ends.t GROUP BY session, itemid",
    "ranker_features": f"""WITH {_POP}, hc AS (SELECT session, itemid, itemid % 7 AS category FROM hist), hs AS (SELECT session, count(*) AS length, count(DISTINCT category) AS n_categories FROM hc GROUP BY session), hcat AS (SELECT session, category, count(*) AS same FROM hc GROUP BY 1, 2)
SELECT r.session, r.itemid, round(score, 6) AS score, CAST(rank - 1 AS INT) AS rank0, round(ln(1 + coalesce(sessions, 0)), 6) AS log_popularity, length, n_categories, CAST(coalesce(same, 0) > 0 AS INT) AS category_seen, round(coalesce(same, 0) / CAST(length AS DOUBLE), 6) AS category_share
FROM (SELECT * FROM rk WHERE rank <= 20) r LEFT JOIN pop USING (itemid) LEFT JOIN hs ON r.session = hs.session LEFT JOIN hcat ON r.session = hcat.session AND r.itemid % 7 = hcat.category""",
    "protocol_disagreement": f"""WITH {_POP}, b AS (SELECT 'itemknn' AS model, session, itemid, rank FROM rk UNION ALL SELECT 'popularity', session, itemid, rank FROM prk)
SELECT m.model, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5 FROM wt CROSS JOIN (VALUES ('itemknn'), ('popularity')) m(model) LEFT JOIN b ON b.model = m.model AND b.session = wt.session AND b.itemid = wt.target GROUP BY m.model""",
    "cold_share": f"WITH {_CUT} SELECT count(*) AS rows, count(DISTINCT session) AS sessions, round(avg(CASE WHEN itemid IN (SELECT itemid FROM si, cut WHERE ts < t) THEN 0.0 ELSE 1.0 END), 6) AS cold_share FROM si, cut WHERE ts >= t",
}



def hash01_sql(*values: str) -> str:
    """The number in [0, 1) that ``functions.common.hash01`` gives."""
    h = "CAST(0 AS BIGINT)"
    for v in values:
        h = f"(({h} * 31 + {v}) % 4294967296 * 1103515245 + 12345) % 4294967296"
    return f"{h} / 4294967296.0::DOUBLE"


ORACLE["sampled_ranks"] = f"""WITH {_KNN}, off AS (SELECT wt.session, v.itemid, wt.target FROM wt CROSS JOIN vocab v LEFT JOIN hist h ON h.session = wt.session AND h.itemid = v.itemid WHERE h.itemid IS NULL AND v.itemid <> wt.target),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {hash01_sql("0", "session", "itemid")}, itemid) AS r FROM off) WHERE r <= 20),
s9 AS (SELECT session, itemid, round(score, 9) AS score FROM sc1), j AS (SELECT dr.session, dr.itemid, dr.target, coalesce(a.score, 0) AS score, coalesce(b.score, 0) AS own FROM dr LEFT JOIN s9 a ON a.session = dr.session AND a.itemid = dr.itemid LEFT JOIN s9 b ON b.session = dr.session AND b.itemid = dr.target)
SELECT session, CAST(1 + sum(CASE WHEN score > own OR (score = own AND itemid < target) THEN 1 ELSE 0 END) AS BIGINT) AS rank FROM j GROUP BY session"""


def kcore_grid_sql(name: str, sessions: int, items: int, rounds: int = 8) -> str:
    out, prev = [], "si"
    for k in range(rounds):
        out.append(f"{name}a{k} AS MATERIALIZED (SELECT * FROM {prev} WHERE session IN (SELECT session FROM {prev} GROUP BY session HAVING count(*) >= {sessions}))")
        out.append(f"{name}b{k} AS MATERIALIZED (SELECT * FROM {name}a{k} WHERE itemid IN (SELECT itemid FROM {name}a{k} GROUP BY itemid HAVING count(*) >= {items}))")
        prev = f"{name}b{k}"
    return ", ".join(out) + f", {name} AS (SELECT * FROM {prev})"
