"""Exact removal of repeated word windows behind a count-min prefilter.

A window of ``size`` words is represented by its *anchor*, the smallest hash
among its ``gram``-word runs.  Equal windows have equal anchors, so the count
of an anchor is never below the count of a window that it stands for.

1. Every task counts the anchors of its rows in a count-min sketch; the
   partition sketches are summed on the executors and only one bit per counter
   (two or more) comes back, ``depth`` x 2^``width_bits`` bits in all.
2. The same is done for whole windows, but only those whose anchor may repeat.
3. Windows that may repeat are grouped exactly, by anchor and a 64-bit hash independent of it.  A task
   settles first what its own rows decide (a smaller document with the same
   window in the same slice) and ships one row per distinct window otherwise,
   so a passage in a third of all documents never meets in one task.

The sketches only overestimate: a full sketch costs time, never a window.  They
have a counter for every ``SPARSE`` bytes of text, up to 2^``MOST_BITS``; beyond
some 8 GB of text they fill up slowly and more windows go to the exact step.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import written

CHUNK_BITS = 16
#: Bytes of text to a counter (an anchor stands for about 130), and the widest sketch that is sent to every task.
SPARSE, MOST_BITS = 16, 29
_MULTIPLIERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def cells(keys: np.ndarray, depth: int, width_bits: int) -> list[np.ndarray]:
    return [(W.mix(keys * np.uint64(_MULTIPLIERS[row])) >> np.uint64(64 - width_bits)).astype(np.int64) for row in range(depth)]


def sketch_rows(keys: list[np.ndarray], depth: int, width_bits: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch as (chunk, sorted 16-bit counters); a counter at two or more is there twice."""
    found = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    chunks, bodies = [], []
    for row, at in enumerate(cells(found, depth, width_bits)):
        at, counts = np.unique(at, return_counts=True)
        at = np.repeat(at, np.minimum(counts, 2))
        which, first = np.unique(at >> CHUNK_BITS, return_index=True)
        low = (at & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
        for chunk, lo, hi in zip(which, first, [*first[1:], len(at)]):
            chunks.append((row << (width_bits - CHUNK_BITS)) + int(chunk))
            bodies.append(low[lo:hi].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(bodies, pa.binary())], ["chunk", "counters"])


def merged_bits(sketches: DataFrame, depth: int, width_bits: int) -> np.ndarray:
    """Sum partition sketches by chunk; a (depth, bytes) bitmap of the counters at two or more."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for body in rows["counters"]:
            total += np.bincount(np.frombuffer(body, np.uint16), minlength=1 << CHUNK_BITS)
        return pd.DataFrame({"chunk": rows["chunk"][:1].to_numpy(), "bits": [np.packbits(total >= 2).tobytes()]})

    bits = np.zeros((depth << (width_bits - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    for chunk, body in sketches.groupBy("chunk").applyInPandas(add, "chunk int, bits binary").collect():
        bits[chunk] = np.frombuffer(body, np.uint8)
    return bits.reshape(depth, -1)


def may_repeat(keys: np.ndarray, bits: np.ndarray, width_bits: int) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for row, at in enumerate(cells(keys, len(bits), width_bits)):
        hit &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def anchors(found: W.Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, first word) of every window: a sliding minimum over the hashes of its grams."""
    n, span = len(found.hashes), size - gram + 1
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, _ = W.rolling(found.hashes, np.array([0, n]), gram, 7)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    whole = np.repeat(found.bounds[1:], np.diff(found.bounds))[: n - size + 1]
    at = np.arange(n - size + 1)
    at = at[at + size <= whole]
    return low[at], at


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive integers in a sorted array."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cut + 1]] if len(at) else at, at[np.r_[cut, len(at) - 1]] if len(at) else at


def repeated_windows(documents: DataFrame, size: int = 50, gram: int = 8, width_bits: int | None = None, depth: int = 2) -> DataFrame:
    """Per text key, the runs of windows that also start in a document with a smaller id.

    ``documents`` has doc_id, key (64-bit text hash) and text.  Returns doc_id,
    key, firsts and lasts (arrays of word positions of window starts).  Windows
    are equal if they share an anchor and a 64-bit hash of their words that is
    independent of it; both rest on hashes of words under a secret that is drawn
    for the call, so no text can be made to collide.
    """
    spark, gram, secret = documents.sparkSession, min(gram, size), secrets.token_bytes(16)
    if width_bits is None:
        volume = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width_bits = min(MOST_BITS, max(CHUNK_BITS, (int(volume) // SPARSE).bit_length()))

    def sliced(batches):
        for batch in batches:
            for part in W.slices(batch):
                yield part, W.words_of(part.column("text"), secret=secret)

    def count_anchors(batches):
        keys = []
        for _, found in sliced(batches):
            low, at = anchors(found, size, gram)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (np.diff(at) != 1)
            keys.append(low[new])
        yield from sketch_rows(keys, depth, width_bits)

    texts = documents.select("doc_id", "key", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * size - 1))
    schema = "chunk int, counters binary"
    anchor_bits = spark.sparkContext.broadcast(merged_bits(texts.select("text").mapInArrow(count_anchors, schema), depth, width_bits))

    def windows(found):
        low, at = anchors(found, size, gram)
        keep = may_repeat(low, anchor_bits.value, width_bits)
        low, at = low[keep], at[keep]
        if not len(at):
            return low, low, at
        every, _ = W.rolling(found.second, found.bounds, size, 11)
        return low, every[keep], at

    def count_windows(batches):
        yield from sketch_rows([windows(found)[1] for _, found in sliced(batches)], depth, width_bits)

    window_bits = spark.sparkContext.broadcast(merged_bits(texts.select("text").mapInArrow(count_windows, schema), depth, width_bits))

    fields = [("anchor", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.list_(pa.int32())), ("window", pa.list_(pa.int64()))]

    def ship(batches):
        for part, found in sliced(batches):
            low, window, at = windows(found)
            keep = may_repeat(window, window_bits.value, width_bits)
            low, window, at = low[keep], window[keep], at[keep]
            if not len(at):
                continue
            row = np.searchsorted(found.bounds, at, side="right") - 1
            ids, keys = part.column("doc_id").to_numpy(), part.column("key").to_numpy()
            order = np.lexsort((ids[row], low, window))
            new = np.ones(len(order), bool)
            new[1:] = (window[order][1:] != window[order][:-1]) | (low[order][1:] != low[order][:-1])
            least = np.empty(len(order), np.int64)
            least[order] = ids[row][order][np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = least < ids[row]
            own = at - found.bounds[row]
            # what a smaller document of this slice has: decided here, as runs under no anchor
            columns = [[], [], [], [], []]
            edge = np.flatnonzero(np.r_[True, np.diff(row[settled]) != 0]) if settled.any() else []
            for lo, hi in zip(edge, [*edge[1:], int(settled.sum())]):
                first, last = runs_of(own[settled][lo:hi])
                r = row[settled][lo]
                for column, value in zip(columns, (None, ids[r], keys[r], first.astype(np.int32), last.astype(np.int64))):
                    column.append(value)
            # the rest goes by anchor, one row per stretch of windows
            row, own, low, window = row[~settled], own[~settled], low[~settled], window[~settled]
            edge = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (low[1:] != low[:-1])]) if len(row) else []
            for lo, hi in zip(edge, [*edge[1:], len(row)]):
                for column, value in zip(columns, (int(low[lo].astype(np.int64)), ids[row[lo]], keys[row[lo]], own[lo:hi].astype(np.int32), window[lo:hi].view(np.int64))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    shipped = written(texts.mapInArrow(ship, "anchor long, doc_id long, key long, at array<int>, window array<long>"))

    def settle(batches):
        """Rows come sorted by anchor; only the last, unfinished anchor is carried on."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = table.column("anchor")[-1].as_py() if len(table) else None
            done = int(np.searchsorted(table.column("anchor").to_numpy(), last)) if len(table) else 0
            held = table.slice(done)
            yield from decide(table.slice(0, done))
        if held is not None:
            yield from decide(held)

    def decide(table):
        if not len(table):
            return
        table = table.combine_chunks()
        sizes = pc.list_value_length(table.column("at")).to_numpy()
        row = np.repeat(np.arange(len(table)), sizes)
        at = pc.list_flatten(table.column("at")).to_numpy()
        window = pc.list_flatten(table.column("window")).to_numpy()
        low, ids = table.column("anchor").to_numpy()[row], table.column("doc_id").to_numpy()[row]
        order = np.lexsort((ids, low, window))
        new = np.ones(len(order), bool)
        new[1:] = (window[order][1:] != window[order][:-1]) | (low[order][1:] != low[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        over = least < ids
        row, at = row[over], at[over]
        if not len(row):
            return
        cut = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(at) != 1)])
        last = np.r_[cut[1:], len(row)] - 1
        who = table.select(["doc_id", "key"]).take(pa.array(row[cut]))
        yield pa.RecordBatch.from_arrays([who.column(0).combine_chunks(), who.column(1).combine_chunks(), pa.array(at[cut], pa.int32()), pa.array(at[last], pa.int32())], ["doc_id", "key", "first", "last"])

    there = shipped.where("anchor is null").select("doc_id", "key", F.explode(F.arrays_zip(F.col("at").alias("first"), F.col("window").alias("last"))).alias("r")).select("doc_id", "key", "r.first", F.col("r.last").cast("int").alias("last"))
    elsewhere = shipped.where("anchor is not null").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(settle, "doc_id long, key long, first int, last int")
    return there.unionByName(elsewhere).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("runs")).select("doc_id", "key", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"))


def substring_dedup(documents: DataFrame, size: int = 50, keep: tuple[str, ...] = (), keep_text: bool = False, width_bits: int | None = None) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Words are maximal runs of bytes other than ASCII white space, unchanged; a
    window is ``size`` consecutive words of one document, judged on the input.
    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space), the ``keep`` columns, and with
    ``keep_text`` the ``text`` that is left (as it was if nothing went).  A
    ``keep`` column takes the place of one of the others of the same name.

    Null and empty texts have no words.  A row without doc_id keeps its words
    and removes none elsewhere.  Rows with one doc_id are one document as far
    as "smaller" goes, so they never remove from each other.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    others = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others).withColumn("key", F.xxhash64("text"))
    found = repeated_windows(texts, size, width_bits=width_bits)
    carried = [f"keep_{i}" for i in range(len(keep))]
    joined = texts.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "firsts", "lasts", *carried)

    def cut(batches):
        for batch in batches:
            for part in W.slices(batch):
                found = W.words_of(part.column("text"))
                out = [[], [], [], []]
                firsts, lasts = part.column("firsts").to_pylist(), part.column("lasts").to_pylist()
                raw = found.data.tobytes()
                for i in range(part.num_rows):
                    lo, hi = int(found.bounds[i]), int(found.bounds[i + 1])
                    edges = np.zeros(hi - lo + 1, np.int64)
                    if firsts[i]:
                        np.add.at(edges, np.array(firsts[i]), 1)
                        np.add.at(edges, np.array(lasts[i]) + size, -1)
                    kept = np.flatnonzero(np.cumsum(edges)[:-1] == 0) + lo
                    body = b" ".join([raw[s:e] for s, e in zip(found.starts[kept].tolist(), found.ends[kept].tolist())])
                    out[0].append(hi - lo)
                    out[1].append(hi - lo - len(kept))
                    out[2].append(hashlib.sha256(body).hexdigest())
                    if keep_text:
                        out[3].append(body.decode() if len(kept) < hi - lo else part.column("text")[i].as_py())
                columns = [part.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out[3], pa.string())] * keep_text + [part.column(c) for c in carried], ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text + carried)

    fields = "".join(f", {c} {joined.schema[c].dataType.simpleString()}" for c in carried)
    result = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text + fields)
    own = [c for c in result.columns if c not in carried and c not in keep]
    return result.select(*own, *[F.col(c).alias(name) for c, name in zip(carried, keep)])
