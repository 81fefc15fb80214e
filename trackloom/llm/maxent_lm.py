"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) P(word | class).  The class of a word is
a hash of its last two bytes (the end token has its own).  The first factor is
a softmax over features of the history that are hashed into tables: the
previous word, the class two words back (a skip feature) and both together.
The tables grow with the cube root of the text volume.  The second is the maximum-likelihood solution of a bias-only softmax within
the class, smoothed by 0.1 a word and one unknown word per class.

Documents are encoded in blocks of a few megabytes: each block has its own
dictionary, sorted by word hash, and its dictionary meets the other blocks'
by ranges of hashes, so global counts come back to every block without a row
per token.  The class model's sufficient statistics are counts of (history
features, class) over all training words; every update is the sum of gradients
that tasks compute on their share of them.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import written
from .toxicity import held_out

END_HASH = np.uint64(0xE4D0E4D0E4D0E4D1)
CLASSES, SKIPS = 64, 16
END_CLASS = CLASSES - 1
SMOOTH = 0.1
#: Gaussian prior on the weights, in counts: rare features of a small corpus stay near zero.
PENALTY = 20.0
#: Bytes of text up to which there are 256 buckets of previous words and 256 ranges of hashes.
SMALL = 1 << 30


def id_bytes(words: int) -> int:
    """Bytes of a word's number among so many."""
    return 2 if words <= 1 << 16 else 3 if words <= 1 << 24 else 4


def bytes_of(ids: np.ndarray, edges: np.ndarray, words: int) -> pa.Array:
    """Rows of word numbers, ``ids[edges[i]:edges[i + 1]]``, in as few bytes as ``words`` numbers need."""
    width = id_bytes(words)
    body = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges.astype(np.int64) * width).astype(np.int32)), pa.py_buffer(body)])


def numbers_of(column: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(all word numbers, how many in each row) back from ``bytes_of``."""
    width = id_bytes(words)
    body = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    whole = np.zeros((len(body), 4), np.uint8)
    whole[:, :width] = body
    return whole.view("<u4").ravel().astype(np.int64), pc.binary_length(column).to_numpy() // width


class Shape:
    """Sizes of the hashed tables; ``previous`` is a power of two, the joint table four times that."""

    def __init__(self, previous: int = 256):
        self.previous, self.joint = previous, 4 * previous
        self.size = 1 + previous + SKIPS + self.joint

    @staticmethod
    def of(volume: int) -> Shape:
        return Shape(256 << (volume // SMALL).bit_length() // 3)


def word_classes(found: W.Words) -> np.ndarray:
    lower = W.SPACED_LOWER[1]
    last = lower[found.data[found.ends - 1]].astype(np.uint64)
    before = np.where(found.ends - found.starts > 1, lower[found.data[np.maximum(found.ends - 2, 0)]], 0).astype(np.uint64)
    return (W.mix(last * np.uint64(257) + before) % np.uint64(END_CLASS)).astype(np.int64)


def buckets_of(hashes: np.ndarray, previous: int) -> np.ndarray:
    return (hashes % np.uint64(previous - 1)).astype(np.int32)


def histories(buckets: np.ndarray, classes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous-word bucket, skip bucket) of every token; ``firsts`` are the first tokens of texts."""
    previous, skip = np.zeros(len(buckets), np.int64), np.zeros(len(buckets), np.int64)
    previous[1:] = 1 + buckets[:-1]
    skip[2:] = 1 + classes[:-2] % (SKIPS - 1)
    previous[firsts] = skip[firsts] = 0
    second = firsts + 1
    skip[second[second < len(skip)]] = 0
    return previous, skip


def features(previous: np.ndarray, skip: np.ndarray, shape: Shape) -> np.ndarray:
    """Rows of the weight matrix: bias, previous word, skip, and the hashed pair."""
    pair = (W.mix((previous * SKIPS + skip).astype(np.uint64)) % np.uint64(shape.joint)).astype(np.int64)
    return np.stack([np.zeros_like(previous), 1 + previous, 1 + shape.previous + skip, 1 + shape.previous + SKIPS + pair])


def log_softmax(weights: np.ndarray, previous: np.ndarray, skip: np.ndarray, shape: Shape) -> np.ndarray:
    logits = weights[features(previous, skip, shape)].sum(axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train(statistics: DataFrame, rounds: int, rate: float, shape: Shape, tasks: int = 8) -> np.ndarray:
    """Adagrad on gradients summed over tasks; ``statistics`` has history (int) and counts (array of CLASSES)."""
    spark = statistics.sparkSession
    size, statistics = shape.size, statistics.coalesce(tasks)  # a row per history; a dense table per task comes back
    weights, squares = np.zeros((size, CLASSES)), np.full((size, CLASSES), 1e-8)

    def gradient(batches):
        total, seen = np.zeros((size, CLASSES)), np.zeros(size)
        for batch in batches:
            history = batch.column("history").to_numpy()
            counts = np.stack(batch.column("counts").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, CLASSES))
            previous, skip = history // SKIPS, history % SKIPS
            mass = counts.sum(axis=1)
            delta = counts - mass[:, None] * np.exp(log_softmax(shared.value, previous, skip, shape))
            for rows in features(previous, skip, shape):
                np.add.at(total, rows, delta)
                np.add.at(seen, rows, mass)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([seen.tobytes()])], ["total", "seen"])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # as wide as the feature tables
        parts = statistics.mapInArrow(gradient, "total binary, seen binary").collect()  # one table for each of at most ``tasks`` tasks
        total = sum((np.frombuffer(p.total).reshape(size, CLASSES) for p in parts), np.zeros((size, CLASSES)))
        seen = sum((np.frombuffer(p.seen) for p in parts), np.zeros(size))
        step = (total - PENALTY * weights) / (seen + 20)[:, None]
        squares += step * step
        weights = weights + rate * step / np.sqrt(squares)
        shared.unpersist()
    return weights


def score_texts(documents: DataFrame, rounds: int = 25, rate: float = 0.4, ranges: int | None = None, modulus: int = 10, remainder: int = 0) -> DataFrame:
    """Log10 probabilities of whole texts under the model and under add-0.1 unigrams.

    A-Z are lowered; the tokens of a text are its words between ASCII white
    space and one end token.  The model learns from rows whose crc32(doc_id)
    mod ``modulus`` is not ``remainder``.  Words are told apart by multilinear
    hashes under a secret that is drawn for the call, 64 bits within a block and
    80 between blocks; features come from hashes that do not change.
    Returns one row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Null and empty texts are one end token.  A null doc_id counts as training.
    Repeated rows count as often as they stand there.  Without training rows
    every count is zero and all tokens are unknown.  Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape, secret = Shape.of(volume), secrets.token_bytes(16)
    ranges = ranges or int(256 * max(1.0, (volume / SMALL) ** 0.5))  # a range's group grows with the root of the volume
    names = ["kind", "block", "range", "doc_id", "held_out", "ids", "hashes", "counts", "classes", "seconds", "buckets"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int16()), pa.list_(pa.int32())]

    def encode(batches):
        block = TaskContext.get().partitionId() << 24
        seen = np.zeros(shape.previous * SKIPS * CLASSES, np.int64)
        for batch in batches:
            for part in W.slices(batch):
                found = W.words_of(part.column("text"), W.SPACED_LOWER, secret=secret)
                n = part.num_rows
                ends = found.bounds[1:] + np.arange(n)  # where the end tokens go
                total = len(found.hashes) + n
                hashes, classes = np.full(total, END_HASH), np.full(total, END_CLASS, np.int64)
                body = np.ones(total, bool)
                body[ends] = False
                hashes[body] = found.hashes
                classes[body] = word_classes(found) if len(found.hashes) else 0
                learn = ~part.column("held_out").to_numpy(zero_copy_only=False)
                training = np.repeat(learn, np.diff(np.r_[-1, ends]))
                firsts = np.r_[0, ends[:-1] + 1]
                words, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
                counts, kind = np.bincount(ids, training, len(words)).astype(np.int64), classes[at].astype(np.uint8)
                # of each different word one place: the rest of its identity, and its bucket as a feature
                real, own = body[at], (np.cumsum(body) - 1)[at[body[at]]]
                seconds, plain = np.zeros(len(words), np.uint64), np.full(len(words), END_HASH)
                seconds[real] = W.hash_secret(found.mapped, found.starts[own], found.ends[own], secret, 1)
                plain[real] = W.hash_spans(found.mapped, found.starts[own], found.ends[own])
                seconds, buckets = (seconds >> np.uint64(48)).astype(np.uint16).view(np.int16), buckets_of(plain, shape.previous)
                previous, skip = histories(buckets[ids], classes, firsts)
                seen += np.bincount(((previous * SKIPS + skip) * CLASSES + classes)[training], minlength=len(seen))
                edges = np.r_[0, ends + 1].astype(np.int32)
                none = lambda i, k: pa.nulls(k, types[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), none(2, n), part.column("doc_id"), part.column("held_out"), bytes_of(ids, edges, len(words)), none(6, n), none(7, n), none(8, n), none(9, n), none(10, n)], names)
                cut = np.searchsorted(words, (np.arange(ranges + 1, dtype=np.float64) * (2.0**64 / ranges)).clip(max=2.0**64 - 2048).astype(np.uint64))
                cut[-1] = len(words)
                full = np.flatnonzero(np.diff(cut) > 0)
                k, edges = len(full), pa.array(np.r_[cut[full], len(words)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(np.full(k, block)), pa.array(full.astype(np.int32)), none(3, k), none(4, k), none(5, k), pa.ListArray.from_arrays(edges, pa.array(words.view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(counts)), pa.array([kind[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()), pa.ListArray.from_arrays(edges, pa.array(seconds)), pa.ListArray.from_arrays(edges, pa.array(buckets))], names)
                block += 1
        cells = seen.reshape(-1, CLASSES)
        used = np.flatnonzero(cells.sum(axis=1))
        none = lambda i: pa.nulls(len(used), types[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), 2, np.int32)), none(1), pa.array(used.astype(np.int32)), none(3), none(4), none(5), none(6), pa.array(list(cells[used]), pa.list_(pa.int64())), none(8), none(9), none(10)], names)

    encoded = written(texts.mapInArrow(encode, "kind int, block long, range int, doc_id long, held_out boolean, ids binary, hashes array<long>, counts array<long>, classes binary, seconds array<short>, buckets array<int>"), by="kind")

    cells = encoded.where("kind = 2").groupBy(F.col("range").alias("history")).agg(*[F.sum(F.col("counts")[c]).cast("double").alias(f"c{c}") for c in range(CLASSES)])
    statistics = written(cells.select("history", F.array(*[f"c{c}" for c in range(CLASSES)]).alias("counts")))
    weights = train(statistics, rounds, rate, shape)

    def merge(table):
        """All blocks' dictionaries in one range of hashes: sum, and give every block its words' sums."""
        sizes = pc.list_value_length(table.column("hashes")).to_numpy()
        hashes = pc.list_flatten(table.column("hashes")).to_numpy()
        counts = pc.list_flatten(table.column("counts")).to_numpy()
        classes = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.uint8)
        seconds = pc.list_flatten(table.column("seconds")).to_numpy()
        order = np.lexsort((seconds, hashes))
        new = np.r_[True, (np.diff(hashes[order]) != 0) | (np.diff(seconds[order]) != 0)][: len(order)]
        at, ids = order[new], np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new) - 1
        total = np.bincount(ids, counts, len(at)).astype(np.int64)
        own = np.stack([np.bincount(classes[at], total, CLASSES), np.bincount(classes[at], total > 0, CLASSES)]).astype(np.int64).ravel()
        edges = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        back = pa.ListArray.from_arrays(pa.array(edges), pa.array(total[ids]))
        return pa.table({"block": pa.concat_arrays([table.column("block").combine_chunks(), pa.nulls(1, pa.int64())]), "range": pa.concat_arrays([table.column("range").combine_chunks(), pa.nulls(1, pa.int32())]), "counts": pa.concat_arrays([back, pa.array([own], pa.list_(pa.int64()))])})

    dictionaries = encoded.where("kind = 1").select("block", "range", "hashes", "seconds", "counts", "classes")
    summed = written(dictionaries.groupBy("range").applyInArrow(merge, "block long, range int, counts array<long>"))
    by_class = np.zeros((2, CLASSES))
    for (row,) in summed.where("block is null").select("counts").collect():  # one row per range
        by_class += np.array(row, float).reshape(2, CLASSES)
    n_train, n_distinct = int(by_class[0].sum()), int(by_class[1].sum())
    log_class = log_softmax(weights, *np.divmod(np.arange(shape.previous * SKIPS), SKIPS), shape) / np.log(10)
    model = spark.sparkContext.broadcast((log_class, by_class))  # fixed-size tables

    def score(table):
        log_class, by_class = model.value
        kind = table.column("kind").to_numpy()
        pick = lambda k: table.filter(pa.array(kind == k))
        docs, words, sums = pick(0), pick(1).sort_by("range"), pick(3).sort_by("range")
        buckets = pc.list_flatten(words.column("buckets")).to_numpy()
        classes = np.frombuffer(b"".join(words.column("classes").to_pylist()), np.uint8).astype(np.int64)
        counts = pc.list_flatten(sums.column("counts")).to_numpy().astype(float)
        ids, sizes = numbers_of(docs.column("ids"), len(buckets))
        firsts = np.r_[0, np.cumsum(sizes)[:-1]]
        base = np.log10((counts + SMOOTH) / (n_train + SMOOTH * (n_distinct + 1)))
        within = np.log10((counts + SMOOTH) / (by_class[0] + SMOOTH * (by_class[1] + 1))[classes])
        previous, skip = histories(buckets[ids], classes[ids], firsts)
        token = log_class[previous * SKIPS + skip, classes[ids]] + within[ids]
        add = lambda x: np.add.reduceat(x, firsts)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": sizes.astype(np.int64), "n_known": add((counts[ids] > 0).astype(np.int64)), "train_tokens": np.full(len(sizes), n_train), "base_score": add(base[ids]), "score": add(token)})

    parts = encoded.where("kind < 2").select("block", "kind", "range", "doc_id", "held_out", "ids", "buckets", F.lit(None).cast("array<long>").alias("counts"), "classes")
    back = summed.where("block is not null").select("block", F.lit(3).alias("kind"), "range", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<int>").alias("buckets"), "counts", F.lit(None).cast("binary").alias("classes"))
    return parts.unionByName(back).groupBy("block").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
