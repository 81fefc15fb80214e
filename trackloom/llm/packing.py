"""Token-id packing: best-fit-decreasing into fixed-length rows.

Texts are encoded and cut into segments of at most ``length`` ids, losing
none.  Every task packs its own rows in chunks of bounded size: segments go by
falling length into the fullest row that still has room, found by descending a
segment tree over free capacities.  Nothing is shuffled; a lost task packs the
same rows again.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W


class Capacities:
    """How many open rows have each free capacity; finds the smallest sufficient one in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += n
            node >>= 1

    def smallest_from(self, size: int) -> int:
        """The smallest capacity >= size that some row has, or -1."""
        counts, node = self.counts, size + self.leaves
        while not counts[node]:
            while node & 1:  # up while this is a right child: nothing larger under the parent
                node >>= 1
            if not node:
                return -1
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of the level
                return -1
        while node < self.leaves:
            node *= 2
            if not counts[node]:
                node += 1
        return node - self.leaves


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of segment numbers; equal sizes go in input order, equal capacities to the latest row."""
    free, stacks, rows = Capacities(length), [[] for _ in range(length + 1)], []
    for segment in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[segment]
        capacity = free.smallest_from(size)
        if capacity < 0:
            row, left = len(rows), length
            rows.append([])
        else:
            row, left = stacks[capacity].pop(), capacity
            free.add(capacity, -1)
        rows[row].append(segment)
        stacks[left - size].append(row)
        free.add(left - size, 1)
    return rows


def pack(documents: DataFrame, path: str, pattern: str, length: int = 2048, end_id: int = 50256, chunk_ids: int = 1 << 21) -> DataFrame:
    """Pack the ids of whole texts into rows of ``length``; one output row per packed row.

    pack_id; n_segments; n_ids (without padding); ids (the row of the matrix,
    little-endian unsigned 16-bit, padded with ``end_id``); cu_seqlens (0 and
    the end of every segment); positions (as ids, restarting at 0 in every
    segment); doc_ids, parts (number of the segment within its document).

    Every document ends in ``end_id``, so null and empty texts are one id.
    Rows of a null doc_id keep null among doc_ids; repeated rows are packed
    each.  Documents longer than a row become consecutive parts, all but the
    last full.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    with open(path, "rb") as lines:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(end_id, *vocabulary.values()) > 0xFFFF or length > 0xFFFF:
        raise ValueError("ids and positions are written as 16-bit numbers")
    ranks = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file: fixed size

    def rows_of(held, first):
        doc_ids, parts, segments = [], [], []
        for doc_id, ids in held:
            for part, lo in enumerate(range(0, len(ids), length)):
                doc_ids.append(doc_id), parts.append(part), segments.append(ids[lo : lo + length])
        packed = best_fit_decreasing([len(s) for s in segments], length)
        out = [[] for _ in range(8)]
        for i, row in enumerate(packed):
            sizes = [len(segments[s]) for s in row]
            matrix, places = np.full(length, end_id, "<u2"), np.zeros(length, "<u2")
            body = np.concatenate([segments[s] for s in row])
            matrix[: len(body)] = body
            places[: len(body)] = np.concatenate([np.arange(n, dtype="<u2") for n in sizes])
            values = (first + i, len(row), len(body), matrix.tobytes(), [0, *np.cumsum(sizes).tolist()], places.tobytes(), [doc_ids[s] for s in row], [parts[s] for s in row])
            for column, value in zip(out, values):
                column.append(value)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["pack_id", "n_segments", "n_ids", "ids", "cu_seqlens", "positions", "doc_ids", "parts"]
        for lo in range(0, len(packed), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 512], t) for c, t in zip(out, types)], names)

    def task(batches):
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        pack_id, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for part in W.slices(batch, size=W.SMALL_SLICE):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encoding.encode_ordinary(text or ""), end_id], "<u2")
                    held.append((doc_id, ids))
                    size += len(ids)
                    if size >= chunk_ids:
                        for out in rows_of(held, pack_id):
                            pack_id += out.num_rows
                            yield out
                        held, size = [], 0
        if held:
            yield from rows_of(held, pack_id)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(task, "pack_id long, n_segments int, n_ids int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, parts array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices with their segment ends and positions as Parquet."""
    packed.write.mode("overwrite").parquet(path)
