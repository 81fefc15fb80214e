"""Byte-level BPE by ranks, merging with a segment tree over byte positions.

The leaves of a piece's tree are its byte positions; a leaf holds the rank of
the pair that starts there and a node the smallest rank below it.  The root's
leftmost minimum is the next merge, which changes the pairs of two live
neighbours and ends one: three point updates of logarithmic cost.  Pieces of
like length share one array of trees, so each numpy step serves all of them.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

NONE = np.int32(2**31 - 1)
CACHED_PIECES = 300_000
TREE_CELLS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pieces by ranks and decodes ids; ``special_ids`` are never produced."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.cache: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
        if not len(self.pair_keys):
            return np.full(len(keys), NONE)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE).astype(np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces that are no tokens themselves, all with at most as many bytes as leaves."""
        leaves = 1
        while leaves < max(map(len, pieces)):
            leaves *= 2
        depth, count = leaves.bit_length() - 1, len(pieces)
        ids = np.full((count, leaves + 1), -1, np.int64)  # the last column stays empty: the end of every list
        for i, piece in enumerate(pieces):
            ids[i, : len(piece)] = self.byte_ids[np.frombuffer(piece, np.uint8)]
        after = np.broadcast_to(np.arange(1, leaves + 2), ids.shape).copy()
        after[:, -1] = leaves
        before = np.broadcast_to(np.arange(-1, leaves), ids.shape).copy()
        before[:, 0] = leaves
        tree = np.full((count, 2 * leaves), NONE)
        tree[:, leaves:] = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, leaves)
        for level in range(depth - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best, node = tree[live, 1], np.ones(len(live), np.int64)
            for _ in range(depth):
                node *= 2
                node += tree[live, node] != best
            at = node - leaves
            gone = after[live, at]
            far, near = after[live, gone], before[live, at]
            ids[live, at] = best
            ids[live, gone] = -1
            after[live, at] = far
            before[live, far] = at  # on the empty last column this is never read
            who = np.concatenate([live, live, live])
            leaf = np.concatenate([at, gone, np.where(near < leaves, near, at)])
            value = np.concatenate([self.rank_of(ids[live, at], ids[live, far]), np.full(len(live), NONE), np.zeros(len(live), np.int32)])
            value[2 * len(live) :] = np.where(near < leaves, self.rank_of(ids[live, near], ids[live, at]), value[: len(live)])
            node = leaf + leaves
            tree[who, node] = value
            for _ in range(depth):
                node >>= 1
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        return [row[row >= 0] for row in ids[:, :-1]]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the cache."""
        if len(self.cache) + len(pieces) > CACHED_PIECES:
            self.cache.clear()
        rest = []
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append((len(raw), piece, raw))
            else:
                self.cache[piece] = whole.to_bytes(4, "little")
        rest.sort(key=lambda x: x[0])
        lo = 0
        while lo < len(rest):
            leaves = 1 << (rest[lo][0] - 1).bit_length()
            hi = lo
            while hi < len(rest) and rest[hi][0] <= leaves and (hi - lo) * leaves < TREE_CELLS:
                hi += 1
            for (_, piece, _), found in zip(rest[lo:hi], self.merge([raw for _, _, raw in rest[lo:hi]])):
                self.cache[piece] = found.astype("<u4").tobytes()
            lo = hi

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        split = [self.pattern.findall(text) for text in texts]
        new = {piece for pieces in split for piece in pieces}
        if not new <= self.cache.keys():
            self.learn({x for x in new if x not in self.cache} if len(self.cache) + len(new) <= CACHED_PIECES else new)
        return [b"".join([self.cache[piece] for piece in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode_documents(documents: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encode whole texts by the rank file at ``path`` (read on the driver) and decode them again.

    Each match of ``pattern`` is encoded by itself, without special tokens.
    Returns one row per input row: the ``keep`` columns, doc_id, n_tokens,
    ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256,
    and ``ids`` (array of int) with ``with_ids``.

    A null text is empty; empty texts have no ids.  Repeated rows, null doc_id
    and other columns pass as they are; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))  # a vocabulary file: fixed size
    key = f"{path}\n{pattern}"

    def encode(batches):
        encoder = encoder_of(key, ranks.value, pattern)
        for batch in batches:
            for part in W.slices(batch, size=W.SMALL_SLICE):
                texts = [text or "" for text in part.column("text").to_pylist()]
                found = encoder.encode_all(texts)
                columns = [part.column(c) for c in (*keep, "doc_id")]
                columns += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found])]
                columns += [pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in found])]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    kept = documents.select(*keep, "doc_id", "text") if "doc_id" not in keep and "text" not in keep else documents.select(*[c for c in keep if c not in ("doc_id", "text")], "doc_id", "text")
    keep = tuple(c for c in keep if c not in ("doc_id", "text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(encode, fields + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
