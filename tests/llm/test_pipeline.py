"""The corpus pipeline's stages, each on its own input, against brute force."""

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import mixing

from .conftest import SCHEMA, make_docs
from .test_dedup import brute_bytes, brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = make_docs(5, 80)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 0, int(k % 6 == 0)) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == columns and kept.count() <= docs.count()
    rows = [tuple(r) for r in docs.collect()]
    near = stages["near_dedup"](spark, docs, folder)
    want = brute_components(rows)
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    cut = stages["suffix_dedup"](spark, docs, folder)
    whole = brute_bytes(rows)
    assert cut.columns == columns
    for r in cut.collect():
        n, gone, digest = whole[r["doc_id"]]
        left = (r["text"] or "").encode()
        assert n - gone <= len(left) <= n and r["n_chars"] in (len(r["text"] or ""), None)
        if (r["text"] or "").isascii():
            assert hashlib.sha256(left).hexdigest() == digest
    mixed = stages["mixing"](spark, docs, folder)
    plan = {r["doc_id"]: len(r["positions"]) for r in mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("size"), F.xxhash64("text").alias("row"))).collect()}
    assert mixed.columns == columns and mixed.count() == sum(plan.values())
    coded = stages["encode"](spark, docs, folder)
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in coded.collect())


def test_near_duplicates_from_80_percent(spark, folder):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:30], *(["changed"] * n), *base[30 + n :]]) for n in (0, 1, 2, 3, 9)]
    rows = [(d, t, "en", "s", len(t)) for d, t in enumerate(texts)]
    rows += [(10 + d, " ".join(f"v{k}" if k != 24 or not d else "other" for k in range(49)), "en", "s", 0) for d in range(2)]
    want, narrow = brute_components(rows, 80), brute_components(rows, 85)
    assert want != narrow  # the rows have a link between the two thresholds
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def odd_rows():
    """Null ids, rows that share a doc_id with equal and other texts, nulls in each column, a very long text."""
    rows = make_docs(9, 40)
    long = " ".join(f"w{k % 977}{k % 31}" for k in range(40_000))
    return rows + rows[:6] + [(None, "null id one two three", "en", "s1", 5), (None, "null id one two three", "en", "s1", 5), (None, None, None, None, None)] + [
        (rows[20][0], "another text for this id " * 9, "en", None, 0), (500, long, None, "s2", None), (501, None, "en", "s0", 0)]


def brute_near(rows):
    """Groups of near copies over distinct (doc_id, text); the smallest doc_id stays, all texts of a doc_id but one coming last."""
    shared = {}
    for d, t, *_ in rows:
        if d is not None:
            shared.setdefault(d, set()).add(t)
    named = {(d, t): (d, None) for d, ts in shared.items() for t in ts}
    keys = sorted(named, key=repr)
    n = {k: j for j, k in enumerate(keys)}
    found = brute_components([(n[k], k[1]) for k in keys], 80)
    groups = {}
    for k in keys:
        groups.setdefault(found[n[k]][1], []).append(k)
    return groups, shared


def check_near(got, rows):
    """Each group keeps one row, and one of a smallest doc_id if that has a single text; null doc_ids all stay."""
    groups, shared = brute_near(rows)
    nulls = lambda rs: sorted((r for r in rs if r[0] is None), key=repr)
    assert nulls(got) == nulls(rows) and set(got) <= set(rows)
    kept = [(r[0], r[1]) for r in got if r[0] is not None]
    assert len(kept) == len(set(kept)) == len(groups)
    for members in groups.values():
        stays = [k for k in members if k in set(kept)]
        assert len(stays) == 1
        single = [d for d, _ in members if len(shared[d]) == 1]
        if len(single) == len(members):
            assert stays[0][0] == min(single)


def test_near_duplicates_keep_other_texts_of_a_doc_id(spark, folder):
    r = random.Random(11)
    one, two = (" ".join(r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(80)) for _ in range(2))
    near = " ".join([*one.split()[:-1], "end"])
    rows = [(1, ""), (1, one), (2, two), (2, None), (3, near), (3, two.upper()), (1, one), (2**63 - 1, "last words"), (2**63 - 1, "other last words here")]
    rows = [(d, t, "en", "s", 0) for d, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("sid", F.lit(2)).withColumn("t1", F.lit(3))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    got = [tuple(x)[:5] for x in out.collect()]
    check_near(got, rows)
    texts = {t for _, t, *_ in got}
    assert {"", None} < texts and (one in texts) != (near in texts) and (two in texts) != (two.upper() in texts)
    one_id = spark.createDataFrame([(4, f"text number {k} of one doc id {k * k}", "en", "s", 0) for k in range(300)], SCHEMA)
    assert corpus_pipeline.drop_near_duplicates(spark, one_id, folder).count() == 300


def test_stages_with_odd_rows(spark, folder):
    """Extra columns whose names the stages use themselves pass through, and no stage fails on odd rows."""
    stages, rows = dict(corpus_pipeline.STAGES), odd_rows()
    clash = ["score", "__toxicity", "starts", "windows", "row", "key", "position", "positions", "__at", "k1", "c0", "component", "z", "sid", "t1", "own", "part"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in clash:
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.withColumn("a.b", F.lit("dot")).cache()
    plain = lambda df: sorted((tuple(r)[:5] for r in df.collect()), key=repr)
    for name in ("toxicity", "near_dedup", "suffix_dedup", "mixing"):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.select(*clash).collect() for c in clash)
    assert stages["encode"](spark, docs, folder).count() == len(rows)
    assert set(plain(stages["toxicity"](spark, docs, folder))) <= set(rows)
    check_near(plain(stages["near_dedup"](spark, docs, folder)), rows)
    mixed = stages["mixing"](spark, docs, folder).collect()
    plan = mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("size"), F.xxhash64("text").alias("row"))).collect()
    words = lambda t: len((t or "").split())
    assert len(mixed) == sum(len(r["positions"]) for r in plan)
    assert sum(words(r["text"]) for r in mixed) == sum(r["taken"] for r in plan)
    assert not any(r["text"] is None for r in mixed)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty(spark, folder, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
