"""Token records, byte-level BPE and AVI media against the libraries and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import avi, bpe, records
from tessera.llm.common import new_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t\r\x0b\x1c\x85  aabbthe'srellé日本🙂1²٣.,!-_́"


def odd_texts(n=400):
    r = random.Random(1)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * 3000, " " * 200 + "x", "<|endoftext|> b"]


def test_crc32c():
    assert records.crc32c(b"123456789") == 0xE3069283
    data = bytes(range(256)) * 9
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    assert records.crc32c(data) == crc ^ 0xFFFFFFFF


def test_library_encoder_equals_library():
    from tokenizers import Tokenizer

    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in records.LibraryEncoder(JSON).encode([t.encode() for t in texts])] == want


def test_segment_tree_equals_tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree, table = bpe.encoder(RANKS)
    texts = odd_texts()
    got = table.encode_each([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert all(tree.decode(x) == t.encode() for x, t in zip(got, texts, strict=True))
    assert tree.merge_one(b"abcabcabc") == tree.merge_many([b"abcabcabc"], 16)[0]


def test_records(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tk, start = Tokenizer.from_file(JSON), 0
    path = new_path(spark, "t")
    got = {r["doc_id"]: r for r in records.token_records(docs, path, JSON).collect()}
    shards = {}
    for doc, text, *_ in sorted(rows):
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        folder = f"{path}/shards/{r['shard']}".removeprefix("file://")
        data = shards.setdefault(folder, open(folder, "rb").read())
        one = data[r["offset"] : r["offset"] + r["length"]]  # a shuffled read of one record
        assert next(records.parse(one))[3].tolist() == ids.tolist()
    assert records.token_records(empty, new_path(spark, "t"), JSON).count() == 0
    bad = bytearray(data)
    bad[20] ^= 1
    with pytest.raises(ValueError):
        list(records.parse(bytes(bad)))


def test_bpe_documents(docs, rows, empty):
    made = {r["doc_id"]: r for r in bpe.encode_documents(docs.withColumnRenamed("lang", "ids_extra"), RANKS).collect()}
    assert all(bytes(made[d]["decoded"]) == (t or "").encode() for d, t, *_ in rows)
    digests = {r["doc_id"]: r for r in bpe.encode_documents(docs, RANKS, digests=True).collect()}
    assert all(digests[d]["ids_sha256"] == hashlib.sha256(made[d]["ids"]).hexdigest() for d in made)
    assert bpe.encode_documents(empty, RANKS).count() == 0


def test_avi(docs, rows, empty):
    r = random.Random(2)
    payloads = [avi.payload(bytes(r.randrange(256) for _ in range(n))) for n in (0, 1, 63, 64, 65, 1023, 1024, 9000)] + [bytes(range(256)) * 5]
    for want, (data, hist, fps) in zip(payloads, avi.read(avi.write(payloads)), strict=True):
        assert data == want and fps == 25 and abs(hist.sum(1) - 1).max() < 1e-9
    assert avi.shots(np.array([[1.0, 0.0]] * 6 + [[0.0, 1.0]] * 5)) == [(0, 5), (6, 10)]
    with pytest.raises(ValueError):
        avi.parse(b"no such file")
    media = avi.store(docs)
    got = {x["doc_id"]: x for x in avi.digest(media).collect()}
    for d, t, *_ in rows:
        p = avi.payload((t or "").encode())
        assert (got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert avi.clips(media).filter("start_ms >= end_ms").count() == 0
    assert avi.digest(avi.store(empty)).count() == 0
