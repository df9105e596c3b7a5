"""Question answering around retrieval: query modes, rewriting, answers with sources, judging and evaluation.

Language models and embedders are protocols: anything with the right call may stand in. The defaults need no network:
rule-based rewriting, and an extractive answer."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .recsys import METRICS, relevance_by_query


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


#: Words that a rewritten query loses, and abbreviations that it spells out.
FILLERS = "please can could you tell me explain what is are how do does i want to know about".split()
ABBREVIATIONS = {"ml": "machine learning", "cv": "cross validation", "svm": "support vector machine", "pca": "principal component analysis", "knn": "nearest neighbors", "rf": "random forest"}


def rewrite(query: str) -> Column:
    """Fillers out, abbreviations spelled out; the query itself if nothing or more than 512 characters is left."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.trim(query)), "[?!.,]", ""), "\\s+"), lambda w: ~w.isin(FILLERS))
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    made = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")
    return F.when((F.length(made) > 0) & (F.length(made) <= 512), made).otherwise(F.col(query))


def search(semantic: DataFrame, keyword: DataFrame, key: str, mode: str = "hybrid", top: int = 20, alpha: float = 0.7, rrf_k: int = 60) -> DataFrame:
    """One list of (query, key, rrf_score, rank) by mode: hybrid, semantic or keyword. Without keyword results hybrid
    search is semantic search."""
    if mode == "hybrid" and not keyword.isEmpty():
        return T.fuse(semantic, keyword, key, alpha, rrf_k, top).select("query", key, "rrf_score", "rank")
    if mode not in ("hybrid", "semantic", "keyword"):
        raise ValueError(f"no such mode: {mode}")
    one = keyword if mode == "keyword" else semantic
    return one.filter(F.col("rank") <= top).select("query", key, (1 / (rrf_k + F.col("rank"))).alias("rrf_score"), "rank")


def above(results: DataFrame, least: float) -> DataFrame:
    return results.filter(F.col("similarity") >= least)


def documents_of(ranked: DataFrame, chunk_documents: DataFrame, chunk: str, document: str) -> DataFrame:
    """(query, item, rank): each document at its first chunk's place, ranks closed up."""
    first = ranked.join(chunk_documents.select(chunk, document), chunk).groupBy("query", F.col(document).alias("item")).agg(F.min("rank").alias("r"))
    return T.top_k(first, ["query"], ["r", "item"], 1 << 30).drop("r")


def prompts(packed: DataFrame, questions: DataFrame, key: str, question: str) -> DataFrame:
    """(key, prompt): numbered context, then the question."""
    blocks = packed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("citation", "content"))).alias("b"))
    context = F.array_join(F.transform("b", lambda x: F.concat(F.lit("["), x["citation"].cast("string"), F.lit("] "), x["content"])), "\n\n")
    return blocks.join(questions, key).select(key, F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), F.col(question), F.lit("\nAnswer with citations:")).alias("prompt"))


def answers(prompted: DataFrame, key: str, generator: Generator | None = None) -> DataFrame:
    """(key, answer, failed): the generator's answer, or the first sentence of the context with its citation. An error
    gives a flagged row, not a failed job."""
    import pandas as pd

    def rows(batches):
        for b in batches:
            out = []
            for k, p in zip(b[key], b["prompt"], strict=True):
                try:
                    found = re.search(r"\[1\] (.*?[.!?])(?:\s|$)", p, re.DOTALL)
                    out.append((k, generator.generate(p) if generator else f"{found[1] if found else p[:200]} [1]", False))
                except Exception as e:  # noqa: BLE001
                    out.append((k, str(e), True))
            yield pd.DataFrame(out, columns=[key, "answer", "failed"])

    return prompted.select(key, "prompt").mapInPandas(rows, f"`{key}` {prompted.schema[key].dataType.simpleString()}, answer string, failed boolean")


def with_sources(answered: DataFrame, packed: DataFrame, key: str, source: str) -> DataFrame:
    """(key, answer): a list of the sources that the answer cites, in order of first use, after it."""
    cited = answered.select(key, "answer", F.posexplode_outer(T.citations("answer")).alias("p", "citation"))
    lines = cited.join(packed.select(key, "citation", F.col(source).alias("__s")), [key, "citation"], "left")
    lines = lines.groupBy(key, "answer").agg(F.array_sort(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct("p", F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.col("__s").cast("string")).alias("l"))))).alias("l"))
    listed = F.concat(F.col("answer"), F.lit("\n\nSources:\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n"))
    return lines.select(key, F.when(F.size("l") > 0, listed).otherwise(F.col("answer")).alias("answer"))


def judgments(judged: DataFrame, by: str, score: str) -> DataFrame:
    """(by, n, mean, min, max) of each criterion; missing scores don't count."""
    return judged.groupBy(by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"))


def evaluate(ranked: DataFrame, relevant: DataFrame, attributes: DataFrame, by: str, ks=(5, 10, 20)) -> DataFrame:
    """(by, k, metrics): retrieval metrics over all questions (``by`` null) and for each value of an attribute
    (query, by)."""
    return evaluated(relevance_by_query(ranked, relevant, ks, "all"), attributes, by)


def evaluated(per: DataFrame, attributes: DataFrame, by: str) -> DataFrame:
    """``evaluate`` of metrics by query."""
    per = per.join(attributes.select("query", by), "query", "left")
    made = per.groupingSets([["k"], ["k", by]], "k", by).agg(F.grouping(by).alias("__all"), F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS])
    return made.filter(F.col("__all").cast("boolean") | F.col(by).isNotNull()).select("k", "queries", *METRICS, by)


def summary_table(rows: DataFrame, metric: str, strategy: str, value: str, strategies: list[str]) -> DataFrame:
    """metric x strategy."""
    return rows.groupBy(metric).agg(*[F.max(F.when(F.col(strategy) == s, F.col(value))).alias(s) for s in strategies])


def insights(best: list[tuple[str, str, float]]) -> list[str]:
    """Sentences from (metric, best strategy, value)."""
    return [f"{s} is best on {m} ({v:.3f})" for m, s, v in best] or ["no strategies to compare"]
