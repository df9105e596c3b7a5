"""Steps that many queries share: what they read, shuffle and give."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import recsys, sessions
from tessera.plans import rag
from tessera.plans import sessions as plans

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def histories(spark, r):
    rows = sorted({(int(s), int(i)) for s, i in zip(r.integers(0, 40, 150), r.integers(0, 30, 150), strict=True)})
    return rows, spark.createDataFrame(rows, "session long, itemid long")


@tables
def test_parts_of_a_split_are_read_from_what_is_stored(spark):
    split, targets, seen = plans._warm(spark, SF)
    for df in (split.train, split.test, split.vocabulary, targets, seen):
        assert "events.parquet" not in plan(df)


@tables
def test_both_rankings_are_made_once(spark):
    _, both = plans._both(spark, SF, 10)
    assert "Exchange" not in plan(both)


def test_recommendations_shuffle_histories_only(spark):
    r = np.random.default_rng(5)
    rows, hist = histories(spark, r)
    near = [(i, j, float(x)) for i in range(30) for j, x in zip(range(25), r.random(25).round(3), strict=True) if i != j]
    similar = spark.createDataFrame(near, "itemid long, neighbour long, similarity double")
    got = recsys.recommend(hist, similar, 5)
    text = plan(got)
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text
    want = Counter()
    for s, i in rows:
        for a, b, x in near:
            if a == i and (s, b) not in rows:
                want[s, b] += x
    best = {(s, i, k + 1) for s in {s for s, _ in rows} for k, (_, i) in enumerate(sorted((-round(x, 9), i) for (t, i), x in want.items() if t == s)[:5])}
    assert {(x["session"], x["itemid"], x["rank"]) for x in got.collect()} == best


def test_popular_items_without_pairs(spark):
    r = np.random.default_rng(6)
    rows, hist = histories(spark, r)
    order = [(int(i), int(n)) for i, n in enumerate(r.integers(1, 6, 30))]
    popular, targets = spark.createDataFrame(order, "itemid long, sessions long"), spark.createDataFrame([(s,) for s in range(45)], "session long")
    got = recsys.unseen_popular(popular, targets, hist, 4)
    assert "Exchange hashpartitioning" not in plan(got)
    ranked = [i for _, i in sorted((-n, i) for i, n in order)]
    want = {(s, i, k + 1) for s in range(45) for k, i in enumerate([i for i in ranked if (s, i) not in rows][:4])}
    assert {tuple(x) for x in got.select("session", "itemid", "rank").collect()} == want


def test_filling_up_skips_seen_and_given(spark):
    given = spark.createDataFrame([(1, 5, 0.5, 1), (1, 6, 0.4, 2), (1, 7, 0.3, 3), (2, 1, 0.2, 1)], "session long, itemid long, score double, rank int")
    targets, seen = spark.createDataFrame([(1,), (2,), (3,)], "session long"), spark.createDataFrame([(2, 0), (2, 3), (3, 0)], "session long, itemid long")
    popular = spark.createDataFrame([(i, 100 - i) for i in range(9)], "itemid long, sessions long")
    got = recsys.fill_up(given, targets, seen, popular, 3)
    more = {tuple(x) for x in got.filter("strategy = 'popular'").select("session", "itemid", "rank").collect()}
    assert more == {(2, 2, 2), (2, 4, 3), (3, 1, 1), (3, 2, 2), (3, 3, 3)}
    assert got.count() == 9 and "SortMergeJoin" not in plan(got.filter("strategy = 'popular'"))


def test_a_round_of_the_core_is_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sessions, "stored", lambda df, name, real=sessions.stored: written.append(name) or real(df, name))
    pairs = spark.createDataFrame([(s, i) for s in range(6) for i in range(3)] + [(9, None), (9, 0)], "session long, itemid long")
    core, trace = sessions.k_core(pairs, 2, 3)
    assert core.count() == 18 and trace[-1] == trace[-2] == 18 and 1 <= len(written) <= 3


@tables
def test_the_grid_counts_distinct_things_once(spark):
    assert "Expand" not in plan(rag._eda(spark, SF))
