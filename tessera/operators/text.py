"""Text retrieval: cleaning, chunking, keyword and vector search, fusion, reranking and prompt packing."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import portions, small, stored, top_k
from ..functions.stem import stem
from . import html as html_tree
from . import topk

#: English stop words of keyword search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very "
    "s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
#: Okapi parameters; a negative idf becomes EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words for a token: chunk sizes are given in tokens.
WORDS_PER_TOKEN = 0.75


def clean(text: str) -> Column:
    """Blanks and tabs collapsed, three and more line ends to two, trimmed."""
    spaced = F.regexp_replace(F.col(text), "[ \\t]+", " ")
    return F.trim(F.regexp_replace(spaced, "\\n{2,}", "\n\n"))


def document_id(path: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(path), "\\.html$", ""), "/", "__")


def document_type(path: str) -> Column:
    parts = F.split(F.col(path), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.when(has("api", "modules", "generated"), "api").when(has("guide", "user_guide", "tutorial"), "guide").when(has("examples", "auto_examples"), "example").otherwise("other")


extract_page = html_tree.page


def extract_html(pages: DataFrame, html: str, least: int = 50, site: str | None = None) -> DataFrame:
    """``pages`` with (title, content, sections) in place of ``html``; pages of under ``least`` characters go. ``site``: a name that
    titles end with."""
    keep = [c for c in pages.columns if c != html]

    def rows(batches):
        for b in portions(batches, html):
            made = list(zip(*[extract_page(x, site) for x in b[html].to_pylist()], strict=True))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], [*keep, "title", "content", "sections"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["title string", "content string", "sections array<string>"])
    return pages.select(*keep, html).mapInArrow(rows, schema).filter(F.length("content") >= least)


def fixed_chunks(docs: DataFrame, key: str, text: str, tokens: int = 512, overlap: int = 50) -> DataFrame:
    """(key, chunk_id, chunk_index, content, n_words): windows of words; the step is size less overlap, and the last
    window is the first that reaches the end."""
    size, lap = int(tokens * WORDS_PER_TOKEN), int(overlap * WORDS_PER_TOKEN)
    step = size - lap
    if step < 1:
        raise ValueError("the overlap must be smaller than the chunk")
    words = docs.select(key, F.filter(F.split(text, "\\s+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    n = 1 + F.ceil(F.greatest(F.size("w") - size, F.lit(0)) / step)
    made = words.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))).withColumn("part", F.slice("w", F.col("chunk_index") * step + 1, F.lit(size)))
    return made.select(key, F.concat(F.col(key).cast("string"), F.lit("__chunk_"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.array_join("part", " ").alias("content"), F.size("part").alias("n_words"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_PARAGRAPH = re.compile(r"\n\s*\n")


def pack_units(units: list[str], most: int, joiner: str, split_long: bool = True) -> list[str]:
    """Units packed greedily into chunks of at most ``most`` words; longer units are cut by words or stay whole."""
    out, held, n = [], [], 0
    for u in units:
        words = u.split()
        pieces = [" ".join(words[k : k + most]) for k in range(0, len(words), most)] if split_long and len(words) > most else [u.strip()] if words else []
        for p in pieces:
            m = len(p.split())
            if held and n + m > most:
                out.append(joiner.join(held))
                held, n = [], 0
            held.append(p)
            n += m
    return out + ([joiner.join(held)] if held else [])


def split_by_sections(content: str, sections: list[str]) -> list[tuple[str | None, str]]:
    """(heading, text): headings looked for from left to right; those not found are skipped, text before the first
    has none."""
    cuts, at = [], 0
    for s in sections:
        found = content.find(s, at)
        if found >= 0:
            cuts.append((found, s))
            at = found + len(s)
    if not cuts:
        return [(None, content)]
    out = [(None, content[: cuts[0][0]].strip())] if content[: cuts[0][0]].strip() else []
    return out + [(s, content[a:b].strip()) for (a, s), b in zip(cuts, [c[0] for c in cuts[1:]] + [len(content)], strict=True)]


def chunk_text(content: str | None, sections: list[str] | None, kind: str, most: int) -> list[tuple[str | None, str]]:
    content = content or ""
    if kind == "sentences":
        return [(None, c) for c in pack_units(_SENTENCE.split(content), most, " ")]
    if kind == "paragraphs":
        return [(None, c) for c in pack_units(_PARAGRAPH.split(content), most, "\n\n")]
    out = []
    for heading, part in split_by_sections(content, sections or []):
        fits = len(part.split()) <= most
        out += [(heading, c) for c in ([part] if fits and part else pack_units(_PARAGRAPH.split(part), most, "\n\n", split_long=False))]
    return out


def semantic_chunks(docs: DataFrame, key: str, text: str, kind: str = "sentences", most: int = 1000, sections: str | None = None) -> DataFrame:
    """(key, chunk_id, chunk_index, heading, content) by sentences, paragraphs or sections (``kind``)."""

    kind_of_key = docs.schema[key].dataType.simpleString()

    def rows(batches):
        for b in portions(batches, "t"):
            of_key = b["k"].type
            columns = zip(*(b[c].to_pylist() for c in "kts"), strict=True)
            out = [(k, f"{k}__chunk_{i}", i, h, c) for k, t, s in columns for i, (h, c) in enumerate(chunk_text(t, s, kind, most))]
            made = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (of_key, pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], [key, "chunk_id", "chunk_index", "heading", "content"])

    s = F.col(sections) if sections else F.array().cast("array<string>")
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), s.alias("s")).mapInArrow(rows, f"`{key}` {kind_of_key}, chunk_id string, chunk_index int, heading string, content string")


def tokens(text: str) -> Column:
    """Lower-cased ASCII words of two and more characters that aren't stop words."""
    runs = F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}_]+")
    return F.filter(runs, _is_token)


def _is_token(t: Column) -> Column:
    return t.rlike("^[a-z0-9_]{2,}$") & ~t.isin(STOP_WORDS)


#: The tables of a stored keyword index.
INDEX_PARTS = ("postings", "terms", "lengths")


#: Stems that a Python worker remembers.
STEMS = 300_000
_known: dict[str, str] = {}


def _stem(term: str) -> str:
    if term not in _known:
        if len(_known) >= STEMS:
            _known.clear()
        _known[term] = stem(term)
    return _known[term]


def stemmed(postings: DataFrame, *by: str, count: str = "tf") -> DataFrame:
    """Rows of (by, term, count) with stems for terms, counts added up. A batch's terms are stemmed where its rows are, each once, so
    that rows aren't shuffled by term, whose frequent ones would share a task."""
    rows = postings.select(*by, "term", count)

    def run(batches):
        for b in batches:
            terms = b["term"].dictionary_encode()
            made = pa.array([_stem(t) for t in terms.dictionary.to_pylist()], pa.string()).take(terms.indices)
            yield pa.RecordBatch.from_arrays([made if c == "term" else b[c] for c in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, rows.schema).groupBy(*by, "term").agg(F.sum(count).alias(count))


def bm25_index(docs: DataFrame, key: str, text: str, stems: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings (key, term, tf), terms (term, idf), lengths (key, length)); texts without tokens have length 0. With ``stems``
    the terms are Porter stems. The postings are stored; the rest is computed from them."""
    # with a key's texts in one partition, its words are counted there and not shuffled
    words = docs.select(key, text).repartition(key).select(key, F.explode(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}_]+")).alias("term")).filter(_is_token(F.col("term")))
    postings = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    postings = stored(stemmed(postings, key) if stems else postings, "postings")
    found = postings.groupBy(key).agg(F.sum("tf").alias("length"))
    lengths = docs.select(key).join(found, key, "left").select(key, F.coalesce("length", F.lit(0)).alias("length"))
    n = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n")))
    raw = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
    return postings, raw.crossJoin(mean).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")), lengths


def save_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """A keyword index as three Parquet tables; what was there before is replaced."""
    for name, part in zip(INDEX_PARTS, index, strict=True):
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether all tables of an index were written to the end."""
    files = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS") for name in INDEX_PARTS]
    return all(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in files)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a stored index; FileNotFoundError if one isn't there."""
    if not index_exists(spark, path):
        raise FileNotFoundError(path)
    return tuple(spark.read.parquet(f"{path}/{name}") for name in INDEX_PARTS)


def _asked(terms: DataFrame, queries: DataFrame, query_key: str, query_text: str, stems: bool) -> DataFrame:
    """(query, term, weight): idf times how often the query has the term."""
    asked = queries.select(F.col(query_key).alias("query"), F.explode(tokens(query_text)).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    if stems:
        asked = stemmed(stored(asked, "asked"), "query", count="times")
    return asked.join(terms, "term").select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))


def search_index(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, key: str, query_key: str, query_text: str, k: int = 50, stems: bool = False) -> DataFrame:
    """(query, key, score, rank): the k best of each query; scores of 0 and less are dropped, repeated query terms
    count each time, ties by smaller key. ``stems``: as the index was made."""
    postings, terms, lengths = index
    mean = F.broadcast(lengths.agg(F.avg("length").alias("mean")))
    asked = _asked(terms, queries, query_key, query_text, stems)
    hits = postings.join(small(asked), "term").join(lengths, key).crossJoin(mean)
    scored = hits.groupBy("query", key).agg(F.sum(F.col("weight") * _impact()).alias("score"))
    return top_k(scored, ["query"], [F.desc(F.round("score", 9)), key], k).filter("score > 0")


def _impact() -> Column:
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("length") / F.col("mean"))
    return tf * (K1 + 1) / (tf + norm)


#: Documents of a segment, about; a posting block has a term's documents of one segment.
SEGMENT_DOCS = 1024
#: Segments of each query that are scored before any are skipped.
FIRST_SEGMENTS = 4


def query_terms(queries: DataFrame, query_text: str, stems: bool = False) -> DataFrame:
    """(term): the distinct terms of all queries."""
    terms = queries.select(F.explode(tokens(query_text)).alias("term")).distinct()
    return stemmed(terms.withColumn("tf", F.lit(1)), count="tf").select("term") if stems else terms


def block_index(index: tuple[DataFrame, DataFrame, DataFrame], key: str, segment_docs: int = SEGMENT_DOCS, only: DataFrame | None = None) -> DataFrame:
    """(term, segment, best, entries (key, impact)): postings in blocks, each with the largest impact that a document of it has.
    All terms share the segments, so that a query's bounds of a segment add up. ``only`` (term): blocks of other terms aren't made,
    for an index that serves known queries once."""
    postings, _, lengths = index
    if only is not None:
        postings = postings.join(small(only), "term", "left_semi")
    mean = F.broadcast(lengths.agg(F.avg("length").alias("mean"), F.ceil(F.count(F.lit(1)) / segment_docs).alias("n")))
    placed = postings.join(lengths, key).crossJoin(mean).select("term", F.pmod(F.xxhash64(key), F.greatest(F.col("n"), F.lit(1))).alias("segment"), F.col(key).alias("key"), _impact().alias("impact"))
    return placed.repartition("segment").groupBy("term", "segment").agg(F.max("impact").alias("best"), F.collect_list(F.struct("key", "impact")).alias("entries"))


def search_blocks(blocks: DataFrame, terms: DataFrame, queries: DataFrame, key: str, query_key: str, query_text: str, k: int = 50, stems: bool = False) -> DataFrame:
    """What ``search_index`` gives, without reading all blocks: the segments of a query with the largest bounds are scored first,
    and then only those whose bound reaches the k-th best score by then."""
    rows, asked = _search_rows(blocks, terms, queries, query_key, query_text, k, stems)
    scored = _scored(rows, asked, blocks)
    return top_k(scored.withColumnRenamed("key", key), ["query"], [F.desc(F.round("score", 9)), key], k).filter("score > 0")


def _scored(rows: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query, key, score) in the segments of ``rows`` (query, segment). A segment's blocks meet in one task, which adds up the scores of
    its documents: blocks are shuffled once and not for each query, and scores aren't shuffled."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = rows.groupBy("segment").agg(F.collect_set("query").alias("queries"))
    hits = blocks.repartition(parts, "segment").join(wanted, "segment").join(small(asked), "term").filter(F.array_contains("queries", F.col("query")))
    scored = hits.select("segment", "query", "weight", F.inline("entries")).groupBy("segment", "query", "key").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    return scored.drop("segment")


def _search_rows(blocks: DataFrame, terms: DataFrame, queries: DataFrame, query_key: str, query_text: str, k: int, stems: bool) -> tuple[DataFrame, DataFrame]:
    """((query, segment) to score, (query, term, weight))."""
    asked = stored(_asked(terms, queries, query_key, query_text, stems), "asked")
    bounds = blocks.select("term", "segment", "best").join(asked, "term")
    bounds = bounds.groupBy("query", "segment").agg(F.sum(F.greatest(F.col("weight") * F.col("best"), F.lit(0.0))).alias("bound")).filter("bound > 0")
    bounds = stored(bounds.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "segment"))), "bounds")
    first = bounds.filter(F.col("place") <= FIRST_SEGMENTS)
    reached = top_k(_scored(first, asked, blocks), ["query"], [F.desc("score")], k).filter(F.col("rank") == k).select("query", F.col("score").alias("reached"))
    rest = bounds.filter(F.col("place") > FIRST_SEGMENTS).join(reached, "query", "left")
    # scores are compared by nine digits
    rest = rest.filter(F.col("bound") >= F.coalesce(F.col("reached"), F.lit(0.0)) - 1e-8)
    return first.select("query", "segment").union(rest.select("query", "segment")), asked


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 50) -> DataFrame:
    """``search_index`` over an index of ``docs``."""
    return search_index(bm25_index(docs, key, text), queries, key, query_key, query_text, k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """(query, key, similarity, rank): exact search by inner product; ties by smaller key. ``where`` filters on the
    vectors' own columns. Rows with integer keys meet the queries in blocks (``topk``); of others Spark keeps k rows of each query
    before the shuffle."""
    vectors = vectors.filter(where) if where is not None else vectors
    order = [F.desc(F.round("similarity", 9)), key]
    if topk.fits(vectors, key, vector, queries, query_key, query_vector):
        pick = lambda df, c, v: df.select(F.col(c).alias("key"), F.col(v).alias("v"), F.lit(None).cast("array<bigint>").alias("codes"))
        found = topk.best_rows(pick(vectors, key, vector).withColumn("key", F.col("key").cast("bigint")), pick(queries, query_key, query_vector), k)
        return top_k(found.select("query", F.col("key").cast(vectors.schema[key].dataType).alias(key), "similarity"), ["query"], order, k)
    q = small(queries.select(F.col(query_key).alias("query"), F.col(query_vector).alias("__q")))
    scored = vectors.select(key, vector).crossJoin(q).select("query", key, dot(vector, "__q").alias("similarity"))
    return top_k(scored, ["query"], order, k)


def distance_to_similarity(distance: Column) -> Column:
    """Of the squared distance of unit vectors."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def fuse(semantic: DataFrame, keyword: DataFrame, key: str, alpha: float = 0.7, k: int = 60, top: int = 20) -> DataFrame:
    """(query, key, semantic_rank, bm25_rank, rrf_score, rank): reciprocal-rank fusion over the union."""
    a = min(max(alpha, 0.0), 1.0)
    s, w = semantic.select("query", key, F.col("rank").alias("semantic_rank")), keyword.select("query", key, F.col("rank").alias("bm25_rank"))
    score = F.coalesce(a / (k + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce((1 - a) / (k + F.col("bm25_rank")), F.lit(0.0))
    return top_k(s.join(w, ["query", key], "full").withColumn("rrf_score", score), ["query"], [F.desc(F.round("rrf_score", 12)), key], top)


def rerank(candidates: DataFrame, key: str, query_text: str, content: str, k: int = 10) -> DataFrame:
    """``candidates`` with a lexical score (share of the query's tokens that the text has), best k by it, earlier rank
    first on ties. The scorer is an expression; a model's scores can take its place."""
    q, c = F.array_distinct(tokens(query_text)), tokens(content)
    score = F.coalesce(F.size(F.array_intersect(q, c)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))
    return top_k(candidates.withColumn("rerank_score", score).withColumnRenamed("rank", "first_rank"), ["query"], [F.desc("rerank_score"), "first_rank", key], k)


def normalize_query(text: str, most: int = 1000) -> Column:
    """Trimmed, white space collapsed, at most ``most`` characters; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.col(text), "\\s+", " "))
    return F.when(t != "", F.substring(t, 1, most))


def excerpt(text: str, most: int) -> Column:
    """At most ``most`` characters, cut after the last sentence end beyond 70 % of them, else before the last word."""
    t = F.col(text)
    head = F.substring(t, 1, most)
    end = F.length(head) - F.locate(".", F.reverse(head)) + 1
    word = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.instr(head, ".") > 0) & (end > 0.7 * most), F.left(head, end.cast("int"))).when(F.instr(head, " ") > 0, F.concat(F.left(head, word.cast("int")), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(t) <= most, t).otherwise(cut)


def citations(text: str) -> Column:
    """Distinct [n] in order of first use."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("\\[(\\d+)\\]"), F.lit(1))), lambda x: x.cast("int"))


def topic_coverage(rows: DataFrame, key: str, content: str, topics: str) -> DataFrame:
    """(key, coverage): share of topics that the texts of a key contain, lower-cased; 0 without topics."""
    joined = rows.groupBy(key, topics).agg(F.lower(F.array_join(F.collect_list(content), " ")).alias("__t"))
    found = F.size(F.filter(topics, lambda t: F.contains(F.col("__t"), F.lower(t))))
    return joined.select(key, F.coalesce(found / F.nullif(F.size(topics), F.lit(0)), F.lit(0.0)).alias("coverage"))


def pack_context(chunks: DataFrame, key: str, rank: str, content: str, budget: int = 4000) -> DataFrame:
    """(key, rank, citation, content): in order of rank, chunks that fit into what is left of the budget; others are
    skipped, but the first one is cut. A fold over each key's ranked list, so a key's list must be bounded."""
    lists = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c")))).alias("l"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<r:int,n:int,c:string>>").alias("out"))
    def step(a, x):
        n = F.size(a["out"]) + 1
        fits = a["used"] + F.length(x["c"]) <= budget
        add = F.struct((a["used"] + F.length(x["c"])).alias("used"), F.concat(a["out"], F.array(F.struct(x["r"].cast("int").alias("r"), n.alias("n"), x["c"].alias("c")))).alias("out"))
        cut = F.struct(F.lit(budget).alias("used"), F.array(F.struct(x["r"].cast("int").alias("r"), F.lit(1).alias("n"), F.substring(x["c"], 1, budget).alias("c"))).alias("out"))
        return F.when(fits, add).when(F.size(a["out"]) == 0, cut).otherwise(a)
    packed = lists.select(key, F.explode(F.aggregate("l", zero, step)["out"]).alias("o"))
    return packed.select(key, F.col("o.r").alias("rank"), F.col("o.n").alias("citation"), F.col("o.c").alias("content"))


def judge_score(text: str) -> Column:
    """Score of a judgment: "score: n", "n/5", "n out of 5", else the first number; 3.0 if none; kept within 1 to 5."""
    t = F.col(text)
    first = lambda p: F.expr(f"try_cast(nullif(regexp_extract({text}, '{p}', 1), '') as double)")
    found = F.coalesce(first("(?i)score\\\\s*[:=]\\\\s*(\\\\d+(?:\\\\.\\\\d+)?)"), first("(\\\\d+(?:\\\\.\\\\d+)?)\\\\s*/\\\\s*5"), first("(?i)(\\\\d+(?:\\\\.\\\\d+)?)\\\\s+out\\\\s+of\\\\s+5"), first("(\\\\d+(?:\\\\.\\\\d+)?)"), F.lit(3.0))
    return F.when(t.isNotNull(), F.least(F.greatest(found, F.lit(1.0)), F.lit(5.0)))
