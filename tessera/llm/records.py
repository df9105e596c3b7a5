"""Token-ID output as length-delimited binary records with a separate offset index.

A record frames one serialized sequence:

    8 bytes  length of the payload, little-endian
    4 bytes  masked CRC-32C of those 8 bytes
    payload  flag (1 byte: 2 or 4 bytes an id), has_id (1 byte), doc_id (8 bytes), ids, all little-endian
    4 bytes  masked CRC-32C of the payload

which is the framing that TFRecord readers read. Shards are files of records in ascending doc_id order (nulls
first); every shard ends with one record that holds no sequence. Spark's text writer makes the files, so any file
system that Spark writes works and a lost task leaves nothing behind: the writer ends each row with a separator of
one zero byte, the highest byte of a length is always zero, and so rows are cut right before those bytes. The last
record's payload is chosen so that the file's last byte is a zero as well.

The index (Parquet) has the shard, offset, length, token count and checksum of each record, for shuffled reads of
single records.

Defined results: a null or empty text is a record with the end id alone; repeated rows are records of their own; no
documents give no records. Decoding checks both checksums of each record and raises ValueError where one is wrong.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import ChunkTable, ranges
from .common import documents, input_bytes, new_path, pieces, utf8

END_ID = 0
#: Input bytes of text to one shard, about.
SHARD_BYTES = 24 << 20

_POLY = 0x82F63B78
_BLOCK = 512


def _tables() -> tuple[list[int], np.ndarray]:
    """Byte table of CRC-32C, and for each distance from the end of a block of _BLOCK bytes what a byte there adds."""
    one = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLY if n & 1 else 0)
        one.append(n)
    t = np.array(one, np.uint32)
    far = np.empty((_BLOCK, 256), np.uint32)
    far[_BLOCK - 1] = t
    for k in range(_BLOCK - 2, -1, -1):
        far[k] = far[k + 1] >> 8 ^ t[far[k + 1] & 0xFF]
    return one, far


_ONE, _FAR = _tables()
_ROWS = np.arange(_BLOCK) * 256
_FLAT = _FAR.ravel()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli); whole blocks are summed by table look-ups in NumPy."""
    crc, whole = 0xFFFFFFFF, len(data) // _BLOCK * _BLOCK
    if whole:
        sums = np.bitwise_xor.reduce(_FLAT[np.frombuffer(data, np.uint8, whole).reshape(-1, _BLOCK) + _ROWS], axis=1).tolist()
        far = _FAR
        for s in sums:  # the running value passes through the block like its first four bytes
            crc = s ^ int(far[0, crc & 255]) ^ int(far[1, crc >> 8 & 255]) ^ int(far[2, crc >> 16 & 255]) ^ int(far[3, crc >> 24])
    for b in data[whole:]:
        crc = crc >> 8 ^ _ONE[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def closing() -> bytes:
    """A record without a sequence whose last byte is zero."""
    return next(f for k in range(1 << 16) if (f := frame(b"\0" + struct.pack("<H", k)))[-1] == 0)


def payload(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """Ids take 16 bits each where the vocabulary allows it."""
    return struct.pack("<BBq", 4 if wide else 2, doc_id is not None, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(data: bytes):
    """(doc_id, offset, length, ids as unsigned 32-bit) of each record that holds a sequence."""
    at, end = 0, len(data)
    while at < end:
        if end - at < 16 or struct.unpack_from("<I", data, at + 8)[0] != masked(data[at : at + 8]):
            raise ValueError(f"length checksum fails at byte {at}")
        (n,) = struct.unpack_from("<Q", data, at)
        body = data[at + 12 : at + 12 + n]
        if len(body) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(body):
            raise ValueError(f"payload checksum fails at byte {at}")
        if body[:1] != b"\0":
            width, has, doc = struct.unpack_from("<BBq", body)
            yield doc if has else None, at, n + 16, np.frombuffer(body, f"<u{width}", offset=10).astype("<u4")
        at += n + 16


_encoders: dict = {}


class LibraryEncoder:
    """The tokenizers library behind a table of known chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.wide = self.tk.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.line = self._ids("\n")
        # strings of special tokens are cut out of a text first; texts with one are encoded whole
        self.special = [t.content.encode() for t in self.tk.get_added_tokens_decoder().values()]
        self.table = ChunkTable(self.encode_chunks, lambda t: self._ids(t.decode()))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tk.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with one blank go through the library as lines of one text, those that begin with one
        line feed are such lines themselves; the line feed's id parts them again. The rest go one by one."""
        sizes, out, order = np.zeros(len(chunks), np.int64), [np.zeros(0, np.uint32)], []
        single = lambda c, lead: c[:1] == lead and c[1:2] not in (b" ", b"\n", b"")
        for some, lead in (([k for k, c in enumerate(chunks) if single(c, b" ")], b"\n"), ([k for k, c in enumerate(chunks) if single(c, b"\n")], b"")):
            for lo in range(0, len(some) if len(self.line) == 1 else 0, 4000):
                part = some[lo : lo + 4000]
                ids = self._ids((lead + lead.join([chunks[k] for k in part])).decode())
                cuts = np.flatnonzero(ids == self.line[0])
                if len(cuts) == len(part):
                    n = np.diff(cuts, append=len(ids))
                    if lead:
                        ids, n = np.delete(ids, cuts), n - 1
                    out.append(ids)
                    order += part
                    sizes[part] = n
        got = np.zeros(len(chunks), bool)
        got[order] = True
        for k in np.flatnonzero(~got).tolist():
            out.append(self._ids(chunks[k].decode()))
            order.append(k)
            sizes[k] = len(out[-1])
        at = np.zeros(len(chunks), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(out)[ranges(at, sizes)], sizes

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.table.encode_each(texts, {k for k, t in enumerate(texts) if any(s in t for s in self.special)})


def _encoder(path: str) -> LibraryEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode (doc_id, text) and write the shards under ``path``; one range shuffle on doc_id puts them in order."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs, "text") // SHARD_BYTES, 1)
    docs = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def rows(batches):
        encoder = _encoder(tokenizer)
        last = b""
        for b in pieces(batches, "text"):
            framed = []
            for doc, ids in zip(b["doc_id"].to_pylist(), encoder.encode(b["text"].to_pylist()), strict=True):
                f = frame(payload(doc, np.append(ids, np.uint32(end_id)), encoder.wide))
                framed.append(last + f[:7])  # the separator takes the place of f[7], a zero
                last = f[8:]
            yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["row"])
        if last:
            f = closing()
            yield pa.RecordBatch.from_arrays([pa.array([last + f[:7], f[8:-1]], pa.binary())], ["row"])

    docs.mapInArrow(rows, "row binary").select(F.col("row").cast("string").alias("value")).write.text(path, lineSep="\0")


def read_records(spark, path: str) -> DataFrame:
    """The index of the shards, from the files' bytes: (shard, record, doc_id, offset, length, n_tokens, ids_crc32)."""

    def rows(batches):
        for b in pieces(batches, "content"):
            for name, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                found = [(doc, at, n, len(ids), zlib.crc32(ids.tobytes())) for doc, at, n, ids in parse(data)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                arrays = [pa.array([name.rpartition("/")[2]] * len(found)), pa.array(range(len(found)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "record", "doc_id", "offset", "length", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(rows, "shard string, record long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Shards under ``path``/shards and index under ``path``/index; returns the index with each record's ``start``,
    the number of ids in all records before it."""
    spark = docs.sparkSession
    write_records(docs, f"{path}/shards", tokenizer, end_id)
    read_records(spark, f"{path}/shards").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    # one row a shard, so these sums stay small; the rank of a shard is its name's (partition number)
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("shard")) - F.col("n"))
    inside = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("record")) - F.col("n_tokens")
    return index.withColumn("inside", inside).join(sums.select("shard", "before"), "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "record", "offset", "length")


def op1_token_records(spark, sf_dir: str) -> DataFrame:
    return token_records(documents(spark, sf_dir), new_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"))
