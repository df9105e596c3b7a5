"""Registered queries over a whole small table, with null ids, shared ids, nulls and repeated rows, against the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import avi, registry

from .conftest import SCHEMA
from .test_dedup import brute_components

MORE = [(7, "shared id", None, None, None), (7, "another text of it", "en", "s", 1), (7, "shared id", None, None, None), (None, "no id here", "en", "s", 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame([*rows, *MORE], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, folder, name, *columns):
    return sorted((tuple(r) for r in registry.queries()[name](spark, folder).select(*columns).collect()), key=repr)


def test_op1(spark, folder, rows):
    from tokenizers import Tokenizer

    tk, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t, *_ in sorted([*rows, *MORE], key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert run(spark, folder, "op1_token_records", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_op4(spark, folder, rows):
    import tiktoken

    lines = map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, *_ in [*rows, *MORE]:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), sha(ids.tobytes()), sha((t or "").encode())))
    assert run(spark, folder, "op4_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op5(spark, folder, rows):
    want = []
    for d, t, *_ in [*rows, *MORE]:
        p = avi.payload((t or "").encode())
        assert len(p) % 64 == 0 and len(p) >= 64
        want.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert run(spark, folder, "op5_avi", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    media = run(spark, folder, "op5_avi", "payload_sha256", "media_bytes", "media_sha256", "feature")
    assert len(set(media)) == len({x[0] for x in media}) and all(x[1] > 0 and len(x[2]) == 64 for x in media)


def test_op10(spark, folder, rows):
    found = run(spark, folder, "op10_near_dedup", "doc_id", "n_shingles", "component_id", "kept")
    want = brute_components([r for r in rows])
    mine = {x[0]: x[1:] for x in found if x[0] is not None and x[0] != 7}
    assert mine == {d: (n, c, c == d) for d, (n, c) in want.items() if d != 7}
    assert sum(x[0] == 7 for x in found) == sum(r[0] == 7 for r in [*rows, *MORE]) and sum(x[0] is None for x in found) == 2
