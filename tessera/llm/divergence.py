"""Source divergence audit: which sources of a language differ from each other, and by which terms.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Two passes over the texts: the first finds
exact document frequencies, and a language keeps the terms of at least MIN_DOCS of its documents. The second recounts
the kept terms by Aho-Corasick automata over terms that are padded with a blank on both sides. A vocabulary grows with
the corpus, so it is cut into blocks of about BLOCK_TERMS terms by a hash; the words of the texts, put together by
(language, source, block), go to the automaton of their block, in portions of about PORTION bytes, so that a frequent
language, source or word is spread over as many tasks as its text needs. No vocabulary is broadcast or collected.

The counts make sparse postings (language, source, term, count). With p = 1 + floor(SCALE * (count + 1) / (N + V)) every
term that a group doesn't have gets the same p, so the sum over all kept terms of a pair of sources is put together from
three sparse parts: postings of the one against the other's constant (by distinct p), the same the other way round, and
a correction over the terms that both have. Nothing dense is built, and a pair is a row of the result only. All
arithmetic is on integers: sums stay below 2^63 for up to 2 * 10^9 kept terms of a language, counts may be any long.

Defined results: null text, lang and source count as ''; a document is a row, so repeated rows and rows that share a
doc_id count each; groups without terms are there with their pairs; a language without kept terms has pairs of value
0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, pieces, staged, tidy, unstage, utf8
from .flat import hash_spans, lower

#: A term is kept from so many documents of its language.
MIN_DOCS = 3
#: Ranks of terms that are reported.
TOP = 200
SCALE = 1_000_000_000
#: Terms of an automaton, about.
BLOCK_TERMS = 60_000
#: Bytes of words that an automaton reads in one group, about, and of one row of them.
PORTION, ROW = 12 << 20, 128 << 10
#: Characters of a term that the automaton reads; longer ones, whose nodes would nest too deeply for it, are looked up whole.
LONG = 1000
#: Rows of document frequencies that a task adds up before it gives them away, about.
MERGED_ROWS = 1 << 20

_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[[*range(65, 91), *range(97, 123)]] = True


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of each term of a binary column, and the terms as a dictionary column."""
    data = np.frombuffer(b"\0".join(texts.to_pylist()) + b"\0", np.uint8)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    inside = _TERM[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]  # the last byte is none of a term
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(lower(data[inside]))])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return np.repeat(np.arange(len(ends)), counts), words.dictionary_encode()


def _number(terms: pa.Array) -> np.ndarray:
    """A hash of each term, of 63 bits, that deals the terms out to blocks."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return (hash_spans(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]) >> np.uint64(1)).astype(np.int64)


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    made = column.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary.to_pylist()


def prepared(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), utf8().alias("text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many rows of the language the term occurs. Tasks count their batches before the shuffle."""

    def merged(parts):
        return pa.Table.from_batches(parts).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])

    def count(batches):
        parts, held = [], 0
        for b in pieces(batches, "text"):
            row, words = _terms(b["text"])
            if not len(words):
                continue
            terms, (lang, langs) = words.dictionary, _codes(b["lang"])
            key = np.sort(row * len(terms) + words.indices.to_numpy(zero_copy_only=False))
            key = key[np.diff(key, prepend=-1) != 0]  # a term once a row
            found, n = np.unique(lang[key // len(terms)] * len(terms) + key % len(terms), return_counts=True)
            made = [pa.array(langs, pa.string()).take(pa.array(found // len(terms))), terms.take(pa.array(found % len(terms))).cast(pa.string()), pa.array(n, pa.int64())]
            parts.append(pa.RecordBatch.from_arrays(made, ["lang", "term", "n"]))
            held += len(n)
            if held > MERGED_ROWS:
                parts = merged(parts).to_batches()
                held = sum(map(len, parts))
                if held > MERGED_ROWS // 2:
                    yield from parts
                    parts, held = [], 0
        if parts:
            yield from merged(parts).to_batches(max_chunksize=200_000)

    return rows.mapInArrow(tidy(count), "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("docs"))


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, source, block, portion, words) of texts with their language's numbers of blocks and portions: the words of a
    batch by language, source and block of their hash, joined by blanks, in rows of about ROW bytes."""

    def deal(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in pieces(batches, "text"):
            row, words = _terms(b["text"])
            if not len(words):
                continue
            terms, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            (lang, langs), (source, sources) = _codes(b["lang"]), _codes(b["source"])
            n_blocks, n_portions = (b[c].to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in ("blocks", "portions"))
            block = _number(terms)[code] % n_blocks
            key = (lang[row] * len(sources) + source[row]) * (int(n_blocks.max()) + 1) + block
            size = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")  # 16 bits are sorted by radix
            key, code, row = key[order], code[order], row[order]
            ends = np.cumsum(size[code] + 1)
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            # a new row at each new key, and within a key after every ROW bytes
            inside = (ends - np.repeat(ends[cut] - size[code[cut]] - 1, np.diff(cut, append=len(key)))) // ROW
            cut = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(inside, prepend=-1) != 0))
            bounds = pa.array(np.append(cut, len(code)).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, terms.take(pa.array(code))), b" ")
            r = row[cut]
            numbers = number + np.arange(len(cut))
            number += len(cut)
            portion = np.array([crc32(b"%d %d" % (part, k)) for k in numbers.tolist()], np.int64) % n_portions[order][cut]
            made = [
                b["lang"].take(pa.array(r)), b["source"].take(pa.array(r)), pa.array((block[order])[cut], pa.int64()), pa.array(portion, pa.int64()),
                joined.cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(made, ["lang", "source", "block", "portion", "words"])

    return rows.join(blocks, "lang").select("lang", "source", "text", "blocks", "portions").mapInArrow(tidy(deal), "lang string, source string, block long, portion long, words string")


def _with_block(batches):
    for b in batches:
        block = pa.array(_number(b["term"].cast(pa.binary())) % b["blocks"].to_numpy())
        yield pa.RecordBatch.from_arrays([b["lang"], b["term"], b["portions"], block], ["lang", "term", "portions", "block"])


def _recounted(key, texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """Occurrences of one block's kept terms in one portion of words, by source. Padded terms overlap in their blanks, and the
    automaton finds overlapping matches."""
    import ahocorasick

    terms = [t for c in vocabulary["terms"].to_pylist() for t in c]
    names = pa.array([], pa.string())
    source, found, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    if terms and texts.num_rows:
        machine, whole = ahocorasick.Automaton(), {t: k for k, t in enumerate(terms) if len(t) > LONG}
        for k, t in enumerate(terms):
            if len(t) <= LONG:
                machine.add_word(f" {t} ", k)
        machine.make_automaton()
        by_source: dict[str, list[str]] = {}
        for s, words in zip(texts["source"].to_pylist(), texts["words"].to_pylist(), strict=True):
            by_source.setdefault(s, []).append(words)
        parts = []
        for s, several in by_source.items():
            total = np.zeros(len(terms), np.int64)
            for words in several:
                if len(machine):
                    total += np.bincount(np.fromiter(map(itemgetter(1), machine.iter(f" {words} ")), np.int64), minlength=len(terms))
                for t in words.split(" ") if whole else ():
                    if t in whole:
                        total[whole[t]] += 1
            hit = np.flatnonzero(total)
            parts.append((hit, total[hit]))
            source += [s] * len(hit)
        found, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        names = pa.array(terms, pa.string())
    lang = pa.array([key[0].as_py()] * len(source), pa.string())
    return pa.table([lang, pa.array(source, pa.string()), names.take(pa.array(found)), pa.array(counts)], ["lang", "source", "term", "n"])


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept, counts): every (lang, source); the kept terms (lang, term); and (lang, source, term, n) of the kept
    terms that occur in a group."""
    rows = prepared(docs)
    groups = staged(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "audit-groups")
    kept = staged(document_frequencies(rows).filter(F.col("docs") >= min_docs).select("lang", "term"), "audit-kept")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    # what a language's texts are cut into; languages without kept terms have nothing to recount
    blocks = groups.groupBy("lang").agg(F.sum("bytes").alias("bytes")).join(vocabulary, "lang")
    blocks = blocks.withColumn("blocks", F.ceil(F.col("v") / BLOCK_TERMS)).withColumn("portions", F.ceil(F.col("bytes") / F.col("blocks") / PORTION)).drop("bytes", "v")
    blocks = staged(blocks, "audit-blocks")
    terms = kept.join(blocks, "lang").mapInArrow(_with_block, "lang string, term string, portions long, block long")
    terms = terms.groupBy("lang", "block", "portions").agg(F.collect_list("term").alias("terms"))
    terms = terms.withColumn("portion", F.explode(F.expr("sequence(0L, portions - 1)"))).select("lang", "block", "portion", "terms")
    by = ["lang", "block", "portion"]
    counted = _dealt(rows, blocks).groupBy(*by).cogroup(terms.groupBy(*by)).applyInArrow(_recounted, "lang string, source string, term string, n long")
    counts = staged(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "audit-counts")
    unstage(blocks)
    return groups.select("lang", "source"), kept, counts


def _share(count, total, v):
    """1 + floor(SCALE * (count + 1) / (total + v)), exactly."""
    return 1 + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + v).cast("decimal(20,0)"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks the other sources of the language by their divergence, part
    'term' the terms by which a source stands out of its language, to rank ``top``."""
    groups, kept, counts = postings(docs, min_docs)
    f = lambda p, q: F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")
    key, zero = ["lang", "source"], F.lit(0).cast("long")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    per_group = counts.groupBy(*key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("here"))
    groups = groups.join(size, "lang", "left").join(per_group, key, "left").na.fill(0, ["v", "total", "here"])
    none = F.when(F.col("v") > 0, _share(zero, F.col("total"), F.col("v"))).otherwise(1)
    groups = staged(groups.withColumn("none", none), "audit-totals")
    # a row for each term, with all sources that have it: pairs, steps and outstanding terms come from the same rows
    with_p = counts.join(groups.select(*key, "total", "v", "none"), key).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    by_term = with_p.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "p", "none")).alias("all"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    by_term = by_term.join(langs, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"), "all")
    by_term = staged(by_term, "audit-terms")
    each = by_term.select("lang", "term", "q", F.inline("all"))

    side = lambda df, s, *cols: df.select("lang", *[F.col(c).alias(c + s) for c in cols])
    # a: the group, b: the other source; values by distinct p, of which a group has far fewer than terms
    steps = each.groupBy(*key, "p").agg(F.count(F.lit(1)).alias("times"))
    one = side(steps, "_a", "source", "p", "times").join(side(groups, "_b", "source", "none"), "lang").filter("source_a != source_b")
    one = one.select("lang", "source_a", "source_b", (F.col("times_a") * f("p_a", "none_b")).alias("value"))
    two = side(steps, "_b", "source", "p", "times").join(side(groups, "_a", "source", "none"), "lang").filter("source_a != source_b")
    two = two.select("lang", "source_a", "source_b", (F.col("times_b") * f("none_a", "p_b")).alias("value"))
    both = by_term.select("lang", "all", F.explode("all").alias("a")).select("lang", "a", F.explode("all").alias("b"))
    both = both.select("lang", *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("source", "p", "none")]).filter("source_a != source_b")
    both = both.select("lang", "source_a", "source_b", (f("p_a", "p_b") - f("p_a", "none_b") - f("none_a", "p_b") + f("none_a", "none_b")).alias("value"))
    rest = side(groups, "_a", "source", "none", "here", "v").join(side(groups, "_b", "source", "none", "here"), "lang").filter("source_a != source_b")
    rest = rest.select("lang", "source_a", "source_b", ((F.col("v_a") - F.col("here_a") - F.col("here_b")) * f("none_a", "none_b")).alias("value"))
    # summed apart first, so that the many rows of ``both`` meet their few pairs inside a task
    summed = [x.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")) for x in (one, two, both)]
    pairs = summed[0].unionByName(summed[1]).unionByName(summed[2]).unionByName(rest).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")

    terms = each.filter("p > q")
    terms = terms.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), f("p", "q").alias("value"))

    w = W.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    ranked = terms.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(ranked)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
hits as (
  select d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term from hits group by lang, term having count(distinct d) >= 3),
v as (select lang, count(*) as v from kept group by lang),
n as (select lang, source, term, count(*) as n from hits join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
dense as (select lang, source, term, coalesce(n, 0) as n from groups join kept using (lang) left join n using (lang, source, term)),
p as (
  select lang, source, term, n, 1 + (1000000000 * (n + 1)::hugeint) // ((sum(n) over (partition by lang, source))::hugeint + v) as p from dense join v using (lang)),
whole as (select lang, term, sum(n) as n from n group by lang, term),
q as (select lang, term, 1 + (1000000000 * (n + 1)::hugeint) // ((sum(n) over (partition by lang))::hugeint + v) as q from whole join v using (lang)),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source != b.source
  left join (select x.lang, x.source, y.source as other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source != y.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.other = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""
