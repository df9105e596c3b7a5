"""Packing by concatenate and cut: all documents' tokens form one stream that fixed windows cut into sequences.

Two passes make the global offsets. The first deals the documents by range of doc_id, encodes them and counts, inside
its partition, the tokens before each document; the partitions' totals (one row each) then give by a prefix sum what
lies before a partition. The second pass cuts each document at the multiples of the sequence length: a piece is a
boundary record that says which part of which document stands where in which sequence. Every sequence but the last is
full, so padding is below one sequence for the whole corpus. A last sequence whose length is a power of two stays as it
is; any other is padded to the full length.

Defined results: a null or empty text is its end id alone; rows of null doc_ids come first; rows that share a doc_id are
documents of their own, in order of their texts; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, input_bytes, pieces, staged, tidy, utf8
from .records import SHARD_BYTES
from .records import _encoder as library_encoder

END_ID = 1
#: Tokens of a sequence.
LENGTH = 2048


def token_stream(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """(doc_id, ids, width, n_tokens, first): each document's ids with the end id as little-endian unsigned integers of
    ``width`` bytes, and the number of tokens of all documents before it, by ascending doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs, "text") // SHARD_BYTES, 1)
    docs = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def rows(batches):
        encoder, part, before = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u4" if encoder.wide else "<u2")
        for b in pieces(batches, "text"):
            ids = [np.append(x, np.uint32(end_id)).astype(kind) for x in encoder.encode(b["text"].to_pylist())]
            n = np.array([len(x) for x in ids], np.int64)
            inside = before + np.cumsum(n) - n
            before += int(n.sum())
            made = [b["doc_id"], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.full(len(n), kind.itemsize, np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*made, pa.array(np.full(len(n), part, np.int32)), pa.array(inside)], ["doc_id", "ids", "width", "n_tokens", "part", "inside"])

    encoded = staged(docs.mapInArrow(tidy(rows), "doc_id long, ids binary, width int, n_tokens long, part int, inside long"), "pack-ids")
    # one row for each of the shards
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return encoded.join(F.broadcast(before), "part").select("doc_id", "ids", "width", "n_tokens", (F.col("before") + F.col("inside")).alias("first"))


def cut(stream: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of a token stream: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and their ids as
    little-endian unsigned 32-bit integers if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{c} long" for c in names) + (", ids binary" if with_ids else "")

    def rows(batches):
        for b in pieces(batches, "ids"):
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(b["ids"].to_pylist(), b["width"].to_pylist(), strict=True)]
            n, first = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "first"))
            sequence = first // length
            count = (first + n - 1) // length - sequence + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = sequence[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = np.maximum(sequence * length, first[row])  # where the piece starts and ends in the stream
            end = np.minimum((sequence + 1) * length, (first + n)[row])
            start = at - first[row]
            bodies = [ids[r][s:e].tobytes() for r, s, e in zip(row.tolist(), start.tolist(), (end - first[row]).tolist(), strict=True)]
            sums = pa.array([zlib.crc32(x) for x in bodies], pa.int64())
            made = [b["doc_id"].take(pa.array(row)), pa.array(start), pa.array(end - at), sums, pa.array(n[row]), pa.array(sequence), pa.array(at - sequence * length)]
            yield pa.RecordBatch.from_arrays([*made, pa.array(bodies, pa.binary())][: len(names) + with_ids], [*names, "ids"][: len(names) + with_ids])

    return stream.mapInArrow(tidy(rows), schema)


def padded_length(used, length: int = LENGTH):
    """The length of a sequence with ``used`` tokens: a power of two stays, anything else is padded to ``length``."""
    return F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(F.lit(length).cast("long"))


def sequences(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """What a trainer reads: (sequence_id, ids, used, pieces), the ids padded, and the boundary records by ascending offset, of
    which a sequence has at most ``length``."""
    made = cut(token_stream(docs, tokenizer, end_id), length, with_ids=True)
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    whole = made.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(piece)).alias("all"))
    pad = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast(total - used as int)))")
    ids = F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x.ids))")
    whole = whole.withColumn("total", padded_length(F.col("used"), length))
    return whole.select("sequence_id", F.concat(ids, pad).alias("ids"), "used", F.transform("all", lambda x: x.dropFields("ids")).alias("pieces"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents, with the padded length of their sequence."""
    stream = token_stream(docs, tokenizer, end_id)
    total = stream.agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    used = F.least(F.lit(length).cast("long"), F.col("total") - F.col("sequence_id") * length)
    return cut(stream, length).crossJoin(F.broadcast(total)).withColumn("sequence_length", padded_length(used, length)).drop("total")


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
