"""Operators on small literal inputs: edge cases that the tables don't have."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import config
from tessera.functions.common import hash01, ordered_sums
from tessera.operators import experiment, panel, recsys, sessions, tabular, text
from tessera.sources import formats, store


def ts(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_session_gap_is_strict(spark):
    e = spark.createDataFrame([(1, 7, 1, ts(0)), (2, 7, 1, ts(30)), (3, 7, 2, ts(60.0001)), (4, 8, 1, ts(0))], "event_id long, visitorid long, itemid long, ts timestamp_ntz")
    got = {r["event_id"]: r["session"] for r in sessions.sessionize(e).collect()}
    assert got[1] == got[2] != got[3] and got[4] == 8_000_001


def test_k_core_reaches_a_fixed_point(spark):
    pairs = [(s, i) for s in range(4) for i in range(3)] + [(9, 0), (9, 77), (8, 77)]
    core, trace = sessions.k_core(spark.createDataFrame(pairs, "session long, itemid long"), 2, 3)
    assert sorted(map(tuple, core.select("session", "itemid").collect())) == [(s, i) for s in range(4) for i in range(3)]
    assert trace[-1] == trace[-2] == 12


def test_relevance_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "a")], "query string, item string")
    r = recsys.relevance_metrics(ranked, relevant, (2,), "all").first()
    ideal = 1 + 1 / math.log2(3)
    assert (r["queries"], r["recall"], r["precision"], r["mrr"]) == (2, 0.25, 0.25, 0.25)
    assert math.isclose(r["ndcg"], (1 / math.log2(3)) / ideal / 2)


def test_holm_and_bh(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "id string, p double")
    got = {r["id"]: (round(r["holm"], 6), round(r["bh"], 6)) for r in experiment.adjusted(p).collect()}
    assert got == {"d": (0.02, 0.02), "a": (0.03, 0.02), "c": (0.06, 0.04), "b": (0.06, 0.04)}


def test_lin_adjustment_equals_least_squares(spark):
    r = np.random.default_rng(0)
    x, t = r.normal(size=400), r.integers(0, 2, 400)
    y = 1 + 2 * t + 0.5 * x + r.normal(size=400)
    df = spark.createDataFrame([(k, "arm" if t[k] else "control", float(x[k]), float(y[k])) for k in range(400)], "unit long, segment string, x double, y double")
    got = experiment.lin_adjustment(df, "y", ["x"], "arm")
    c = x - x.mean()
    d = np.column_stack([np.ones(400), t, c, c * t])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    inv, e = np.linalg.inv(d.T @ d), y - d @ beta
    cov = inv @ (d.T * e**2) @ d @ inv * 400 / 396
    assert math.isclose(got["effect"], beta[1], rel_tol=1e-6) and math.isclose(got["se"], math.sqrt(cov[1, 1]), rel_tol=1e-6)


def test_uplift_learners_find_the_effect(spark):
    r = np.random.default_rng(1)
    rows = [(k, int(k % 2), float(x := r.normal()), float((k % 2) * 2 * x + r.normal() * 0.1)) for k in range(600)]
    df = spark.createDataFrame(rows, "unit long, t int, x double, y double")
    for kind in ("s", "t", "x"):
        assert experiment.uplift_scores(df, ["x"], kind).select(F.corr("score", "x")).first()[0] > 0.99


def test_easter_and_holidays():
    assert [panel.easter(y) for y in (1999, 2000, 2024, 2038)] == [datetime.date(1999, 4, 4), datetime.date(2000, 4, 23), datetime.date(2024, 3, 31), datetime.date(2038, 4, 25)]
    assert datetime.date(2024, 4, 1) in panel.holidays([2024])


def test_folds_are_checked(spark):
    long = spark.createDataFrame([(datetime.date(2024, 1, 1) + datetime.timedelta(days=k), "a", 1.0, 0) for k in range(10)], "date date, sku string, qty double, promo int")
    assert panel.folds(long, 2, 3, 3).count() == 2
    with pytest.raises(ValueError):
        panel.folds(long, 3, 4, 3)
    with pytest.raises(ValueError):
        panel.folds(long, 0, 4, 3)


def test_curves_with_ties_and_none(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.5), (3, 1, 0.5), (4, 0, 0.1)], "id long, y int, score double")
    r = tabular.roc_auc(s).first()
    assert r["auc"] == 0.875
    assert tabular.threshold_f1(s).first()["threshold"] == 0.5
    assert tabular.threshold_recall(s, 0.99).first()["threshold"] == 0.9
    assert tabular.threshold_recall(s.filter("y = 0"), 0.5).count() == 0
    assert tabular.roc_auc(s.filter("y = 1")).first()["auc"] is None


def test_psi_with_nulls_and_missing_values(spark):
    a = spark.createDataFrame([("x", 0.5), (None, 0.5)], "value string, share double")
    b = spark.createDataFrame([("x", 0.5), (None, 0.5)], "value string, share double")
    assert abs(tabular.psi(a, b).first()["psi"]) < 1e-12
    assert tabular.psi(a, b.filter("value = 'x'")).first()["band"] == "major"


def test_ks_p_value():
    assert tabular.ks_p_value(0.0, 100, 100) == 1.0 and tabular.ks_p_value(0.5, 200, 200) < 1e-6


def test_chunkers():
    assert text.pack_units(["a b", "c d", "e f g h i"], 4, " ") == ["a b c d", "e f g h", "i"]
    assert text.split_by_sections("intro One x Two y", ["One", "Nope", "Two"]) == [(None, "intro"), ("One", "One x"), ("Two", "Two y")]
    title, content, heads = text.extract_page("<html><title>T</title><body><nav>skip</nav><h1>Head</h1><p>Some <b>bold</b> text</p><h2>Sub</h2><script>x</script></body></html>")
    assert (title, content, heads) == ("Head", "Head Some bold text Sub", ["Head", "Sub"])


def test_pack_context_skips_and_cuts(spark):
    c = spark.createDataFrame([(1, 1, "a" * 6), (1, 2, "b" * 9), (1, 3, "c" * 4), (2, 1, "d" * 30)], "k long, r int, c string")
    got = sorted((x["k"], x["rank"], x["citation"], len(x["content"])) for x in text.pack_context(c, "k", "r", "c", 10).collect())
    assert got == [(1, 1, 1, 6), (1, 3, 2, 4), (2, 1, 1, 10)]


def test_judge_scores(spark):
    t = spark.createDataFrame([("Score: 4.5",), ("I give 9/5",), ("2 out of 5",), ("none",), (None,)], "t string")
    assert [r[0] for r in t.select(text.judge_score("t")).collect()] == [4.5, 5.0, 2.0, 3.0, None]


def test_arff_and_questions(spark, tmp_path):
    (tmp_path / "d.arff").write_text("% c\n@relation r\n@attribute 'a b' NUMERIC\n@attribute c {x,y}\n@data\n1.5,x\n?,'y'\n")
    assert [tuple(r) for r in formats.read_arff(spark, str(tmp_path / "d.arff")).collect()] == [(1.5, "x"), (None, "y")]
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "question": "a?", "expected_topics": [], "relevant_doc_ids": ["d"]}, {"question": "b?"}]}')
    q = formats.read_questions(spark, str(tmp_path / "q.json"))
    assert q.count() == 1 and formats.question_problems(q).first()["no_topics"] == 1


def test_events_and_documents(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1433221332117,1,view,2,\n")
    assert formats.read_events(spark, str(tmp_path / "e.csv")).first()["ts"].year == 2015
    (tmp_path / "bad.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1433221332117,,view,2,\n")
    with pytest.raises(ValueError):
        formats.read_events(spark, str(tmp_path / "bad.csv"))
    formats.write_documents(spark.createDataFrame([("d", "api", "t")], "doc_id string, doc_type string, content string"), str(tmp_path / "docs"))
    (tmp_path / "docs" / "doc_type=api" / "x.json").write_text("{broken\n")
    good, bad = formats.read_documents(spark, str(tmp_path / "docs"), "doc_id string, content string")
    assert good.count() == 1 and bad.count() == 1


def test_vector_store_and_manifest(spark, tmp_path):
    s = store.VectorStore(spark, f"file://{tmp_path}/v")
    chunks = spark.createDataFrame([("c", [1.0, 0.0], {"a": None, "b": "x"})], "chunk_id string, embedding array<double>, metadata map<string,string>")
    assert s.read("one") is None and s.collections() == []
    s.add("one", chunks, 2)
    with pytest.raises(ValueError):
        s.add("one", chunks, 3)
    assert s.collections() == ["one"] and store.is_indexed(s, "one", 1) and not store.is_indexed(s, "one", 2)
    assert s.read("one").first()["metadata"] == {"b": "x"}
    s.delete("one")
    assert not s.exists("one")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "f").write_text("x")
    assert store.verify_manifest(str(tmp_path / "m")) is False
    store.write_manifest(str(tmp_path / "m"))
    assert store.verify_manifest(str(tmp_path / "m"))
    (tmp_path / "m" / "f").write_text("y")
    with pytest.raises(ValueError):
        store.verify_manifest(str(tmp_path / "m"))


def test_config():
    assert config.build(config.RetrievalConfig, {"top_k": 5, "alpha": 1}) == config.RetrievalConfig(top_k=5, alpha=1.0)
    for bad in ({"nope": 1}, {"top_k": "5"}, {"top_k": True}):
        with pytest.raises(ValueError):
            config.build(config.RetrievalConfig, bad)


def test_entry_works_without_llm():
    import subprocess
    import sys

    code = "import re, sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; assert 'sessionize' in e.queries() and not any(re.match('op[0-9]+_', k) for k in e.queries()); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_pairs_of_huge_sessions(spark, monkeypatch):
    monkeypatch.setattr(recsys, "PAIR_BLOCK", 4)
    rows = [(1, i) for i in range(19)] + [(2, 3), (2, 5), (3, 7)]
    got = sorted(map(tuple, recsys.item_pairs(spark.createDataFrame(rows, "session long, itemid long")).collect()))
    assert got == sorted([(a, b) for a in range(19) for b in range(a + 1, 19)] + [(3, 5)])


def test_ordered_sums_and_numbers(spark):
    rows = [(k * 37 % 101, k) for k in range(300)]
    df = spark.createDataFrame(rows, "x long, y long").repartition(5)
    got = {r["y"]: (r["n"], r["s"]) for r in ordered_sums(df, [F.desc("x"), F.col("y")], {"n": F.lit(1), "s": F.col("y")}).collect()}
    total = 0
    for n, (_, y) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += y
        assert got[y] == (n, total)
    assert ordered_sums(df.limit(0), [F.col("x")], {"n": F.lit(1)}).count() == 0


def test_bootstrap_equals_plain_resampling(spark):
    """The replicates' weights are drawn by the same arithmetic as hash01, row by row."""
    values = [(k, float(k % 7)) for k in range(40)]
    df = spark.createDataFrame(values, "id long, v double")
    got = recsys.bootstrap_ci(df, "v", "id", 50).first()
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    drawn = df.select("v", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("h")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(50)))).select("b", "v", hash01("b", "h").alias("u")).collect()
    means = []
    for b in range(1, 51):
        w = [(int(np.searchsorted(steps, r["u"], side="right")), r["v"]) for r in drawn if r["b"] == b]
        means.append(sum(n * v for n, v in w) / sum(n for n, _ in w))
    assert math.isclose(got["mean"], sum(v for _, v in values) / 40)
    assert math.isclose(got["lo"], np.percentile(means, 2.5)) and math.isclose(got["hi"], np.percentile(means, 97.5))
