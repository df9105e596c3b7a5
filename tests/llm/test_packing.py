"""Packing against a plain concatenation of the library's ids."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tessera.llm import packing, registry

JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, length):
    from tokenizers import Tokenizer

    tk, at, found = Tokenizer.from_file(JSON), 0, []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        s = 0
        while s < len(ids):
            n = min(length - at % length, len(ids) - s)
            found.append((d, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), at // length, at % length))
            at, s = at + n, s + n
    return found


def test_op13_over_table(spark, tmp_path, rows):
    more = [(7, "twice", None, None, None), (7, "twice", None, None, None), (7, "other", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None), (9000, "é日 " * 20_000, "x", "y", 1)]
    everything = rows + more
    spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["op13_packing"](spark, str(tmp_path))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want = brute([(d, t) for d, t, *_ in everything], 2048)
    assert sorted(map(tuple, got.select(names).collect()), key=lambda x: x[-2:]) == want
    last = sum(x[2] for x in want) % 2048
    assert {r[0] for r in got.filter(F.col("sequence_id") < want[-1][5]).select("sequence_length").distinct().collect()} == {2048}
    assert got.filter(F.col("sequence_id") == want[-1][5]).first()["sequence_length"] == (last if last & (last - 1) == 0 else 2048)


def test_sequences(spark, docs, rows, empty):
    want = brute([(d, t) for d, t, *_ in rows], 64)
    got = {r["sequence_id"]: r for r in packing.sequences(docs.withColumn("ids", F.lit(1)), JSON, length=64, pad_id=3).collect()}
    for s, r in got.items():
        mine = [x for x in want if x[5] == s]
        ids = np.frombuffer(r["ids"], "<u4")
        assert [tuple(p) for p in r["pieces"]] == [(x[6], x[2], x[0], x[1]) for x in mine] and r["used"] == sum(x[2] for x in mine)
        assert len(ids) == 64 or len(ids) == r["used"] and len(ids) & (len(ids) - 1) == 0
        assert (ids[r["used"] :] == 3).all() and all(zlib.crc32(ids[x[6] : x[6] + x[2]].tobytes()) == x[3] for x in mine)
    assert sorted(got) == list(range(want[-1][5] + 1))
    assert packing.packed(empty, JSON).count() == 0 and packing.sequences(empty, JSON).count() == 0


def test_padded_length(spark):
    got = spark.createDataFrame([(k,) for k in (1, 2, 3, 64, 100, 1024, 2047, 2048)], "n long").select("n", packing.padded_length(F.col("n")).alias("p"))
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 2, 3: 2048, 64: 64, 100: 2048, 1024: 1024, 2047: 2048, 2048: 2048}
