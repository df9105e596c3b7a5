"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Leaf i of a piece's tree holds the rank of the pair that starts at live byte position i together with i (no pair:
infinity), inner nodes hold the minimum, so the root is the leftmost pair of least rank. A merge joins a position
with the next live one and updates three leaves: its own, the one that died and its left neighbour's; each update
walks up the tree. Encoding a piece of n bytes takes O(n log n).

Two forms of that tree: ``merge_one`` for single long pieces, and ``merge_many``, which keeps the trees of many
short pieces of one width as rows of a NumPy array and merges in all rows at once.

Defined results: a null or empty text has no ids and decodes to no bytes; any bytes decode to themselves.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, ranges
from .common import PIECE, documents, pieces, tidy, utf8

_INF = np.int32(2**31 - 1)
#: Pieces of up to this many bytes are merged in rows.
_WIDEST = 64
_POS_BITS = 7


class SegmentTreeBpe:
    """Ranks from a file of ``base64 rank`` lines; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        get = self.ranks.get
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = get(t[:k]), get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of ids (a, b) at positions pos; infinity where not ok or no such pair."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(ok & (self.keys[at] == key), self.values[at] << _POS_BITS | pos.astype(np.int32), _INF)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of pieces of at most ``width`` bytes, a power of two."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        tok = np.empty((n, width + 1), np.int32)
        tok[:, :width], tok[:, width] = self.byte_id[raw], 0
        nxt = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        prv = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        pos = np.arange(width)
        tree = np.full((n, 2 * width), _INF, np.int32)
        tree[:, width : 2 * width - 1] = self._pair_ranks(tok[:, : width - 1], tok[:, 1:width], pos[None, :-1], pos[None, :-1] + 1 < size[:, None])
        w = width
        while w > 1:
            w //= 2
            tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
        dead = pos[None, :] >= size[:, None]
        flat, levels = tree.ravel(), width.bit_length() - 1
        rows = np.flatnonzero(tree[:, 1] < _INF)
        while len(rows):
            top = tree[rows, 1]
            i = (top & ((1 << _POS_BITS) - 1)).astype(np.int64)
            j = nxt[rows, i]
            k = nxt[rows, j]
            tok[rows, i] = top >> _POS_BITS
            dead[rows, j] = True
            nxt[rows, i] = k
            prv[rows, np.minimum(k, width)] = i
            h = prv[rows, i]
            end = size[rows]
            base = rows * (2 * width)
            flat[base + width + j] = _INF
            flat[base + width + i] = self._pair_ranks(tok[rows, i], tok[rows, np.minimum(k, width)], i, k < end)
            left = h >= 0
            lr, lh = rows[left], h[left]
            flat[lr * (2 * width) + width + lh] = self._pair_ranks(tok[lr, lh], tok[lr, i[left]], lh, np.ones(len(lr), bool))
            for b, leaf in ((base, width + j), (base, width + i), (lr * (2 * width), width + lh)):
                for _ in range(levels):
                    leaf = leaf >> 1
                    flat[b + leaf] = np.minimum(flat[b + 2 * leaf], flat[b + 2 * leaf + 1])
            rows = rows[tree[rows, 1] < _INF]
        live = ~dead
        ids, ends = tok[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(n - 1, 1).bit_length()
        tok = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv, pair = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        none = 1 << 60
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = nxt[i]
            r = pair(tok[i] << 20 | tok[j]) if j < n else None
            return none if r is None else r << 32 | i

        tree[width : width + n] = [leaf(i) for i in range(n)]
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def update(i: int, value: int) -> None:
            at = width + i
            tree[at] = value
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        alive = [True] * n
        while tree[1] < none:
            i, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            j = nxt[i]
            tok[i], nxt[i], alive[j] = rank, nxt[j], False
            if nxt[j] < n:
                prv[nxt[j]] = i
            update(j, none)
            update(i, leaf(i))
            if prv[i] >= 0:
                update(prv[i], leaf(prv[i]))
        return np.array([t for t, a in zip(tok, alive, strict=True) if a], "<u4").tobytes()

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        out: list = [None] * len(matches)
        by_width: dict[int, list[int]] = {}
        raw = [m.encode() for m in matches]
        for k, p in enumerate(raw):
            if (r := self.ranks.get(p)) is not None:
                out[k] = r.to_bytes(4, "little")
            elif len(p) > _WIDEST:
                out[k] = self.merge_one(p)
            else:
                by_width.setdefault(1 << max(len(p) - 1, 1).bit_length(), []).append(k)
        for width, some in by_width.items():
            for lo in range(0, len(some), 20_000):
                part = some[lo : lo + 20_000]
                for k, ids in zip(part, self.merge_many([raw[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has; equal pattern matches are merged once."""
        found = [_PATTERN.findall(c.decode()) for c in chunks]
        place = {m: k for k, m in enumerate(dict.fromkeys(m for f in found for m in f))}
        merged = self.encode_matches(list(place))
        flat, size = np.frombuffer(b"".join(merged), "<u4"), np.array([len(m) // 4 for m in merged], np.int64)
        which = np.array([place[m] for f in found for m in f], np.int64)
        sizes = np.add.reduceat(np.append(size[which], 0), np.cumsum([0, *map(len, found)])[:-1]) if len(found) else np.zeros(0, np.int64)
        sizes[[not f for f in found]] = 0
        return flat[ranges((np.cumsum(size) - size)[which], size[which])], sizes

    def encode_whole(self, text: bytes) -> np.ndarray:
        return self.encode_chunks([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_PATTERN = regex.compile(public_tokenizers.PATTERN)
_loaded: dict = {}


#: Chunks that a worker remembers at most, of some 50 bytes each.
KNOWN = 2_000_000


def encoder(path: str, known: int = KNOWN) -> tuple[SegmentTreeBpe, ChunkTable]:
    """One for each worker process, rank file and size of its table."""
    if (path, known) not in _loaded:
        bpe = SegmentTreeBpe(path)
        _loaded[path, known] = bpe, ChunkTable(bpe.encode_chunks, bpe.encode_whole, known)
    return _loaded[path, known]


def encode_documents(docs: DataFrame, ranks: str, digests: bool = False, portion: int = PIECE, known: int = KNOWN) -> DataFrame:
    """Each document's ids and their decoded bytes, after all columns of ``docs``: (ids, decoded), both binary, ids as
    little-endian unsigned 32-bit integers; or with ``digests`` (n_tokens, ids_sha256, decoded_sha256), taken where
    the ids are made, so that no ids cross to the JVM. ``portion``: bytes of texts encoded at once, of which each takes some 50
    bytes meanwhile. No shuffle."""
    extra = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("ids", "binary"), ("decoded", "binary")]
    names, kept = [f"c{k}" for k in range(len(docs.columns))], [f.dataType.simpleString() for f in docs.schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*zip(names, kept, strict=True), *extra])

    def rows(batches):
        bpe, table = encoder(ranks, known)
        for b in pieces(batches, "__text", portion):
            ids = table.encode_each(b.column(len(names)).to_pylist())
            raw, decoded = [x.astype("<u4").tobytes() for x in ids], [bpe.decode(x) for x in ids]
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            made = [pa.array(map(len, ids), pa.int64()), sha(raw), sha(decoded)] if digests else [pa.array(raw, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *made], [*names, *(n for n, _ in extra)])

    text = utf8("text").alias("__text")
    wide = docs.select(*[F.col(f"`{c}`") for c in docs.columns], text).toDF(*names, "__text")
    return wide.mapInArrow(tidy(rows), schema).toDF(*docs.columns, *(n for n, _ in extra))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    # the digests need doc_id and text alone; the text itself is not returned
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True).drop("text")
