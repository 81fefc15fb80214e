"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows gives the examples.  All their words are
terms, so every text that shares a word with an example meets its nearest ones;
words outside the examples are no terms.  A lexicon weighs extra: the terms
(words and their beginnings) that stand in toxic examples more often than
chance allows, judged on distinct contexts (neighbouring words), so a text that
was copied many times counts once.  Document frequencies are counted over all
documents.  The plain words' part of a vector has the length of the logarithm
of the text's words, so that one lexicon term in a long text is far from many
of them.

The examples form an inverted index in blocks of like examples.  A query walks
the short posting lists of its rarer terms, whose sums have a known maximum in
every block, and adds each block's largest weights of its frequent terms: a
bound for each block.  It scores the best blocks, and then only those whose bound
reaches the k-th cosine found, which keeps the search exact.  Votes are weighted
by distance and mapped to probabilities by isotonic regression on leave-one-out
votes of the examples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import written

#: Examples of a block, queries scored together, and the most terms that have a dense row.
BLOCK, TOGETHER, DENSE = 256, 128, 384
#: More than single precision can err on a cosine.
SLACK = 1e-4
#: Distance at which a vote weighs a quarter of one at distance 0.
HALF = 0.1
#: Beginnings of words, in bytes, that are terms besides the words: stems under many endings.
PREFIXES = (4, 5, 6, 7, 8)


def spans(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The integers lo[i] .. lo[i] + many[i] - 1 of all i, one behind the other."""
    return np.arange(many.sum()) + np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)


class Vectors:
    """Sparse rows: row i has ``terms`` and ``counts`` from ``bounds[i]`` to ``bounds[i + 1]``, and a length in words' logarithm."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, background: np.ndarray):
        self.bounds, self.terms, self.counts, self.background = bounds, terms, counts, background

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        many = np.diff(self.bounds)[rows]
        at = spans(self.bounds[:-1][rows], many)
        return Vectors(np.r_[0, np.cumsum(many)], self.terms[at], self.counts[at], self.background[rows])

    def unit(self, idf: np.ndarray, lexicon: int) -> np.ndarray:
        """Weights of length 1 a row: terms below ``lexicon`` as they are, the plain ones together as long as the background."""
        row = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        weight = (1 + np.log(np.maximum(self.counts, 1))) * idf[self.terms]
        plain = self.terms >= lexicon
        length = np.sqrt(np.bincount(row[plain], weight[plain] ** 2, len(self)))
        scale = self.background / np.maximum(length, 1e-300)
        weight[plain] *= scale[row[plain]]
        return weight / np.sqrt(np.maximum(np.bincount(row, weight**2, len(self)), 1e-300))[row]

    def units(self, idf: np.ndarray, lexicon: int, rows: int = 2048):
        """(rows, terms, weights) by parts of some rows, so that little is in memory besides the result."""
        for lo in range(0, len(self), rows):
            part = self.take(np.arange(lo, min(len(self), lo + rows)))
            yield lo + np.repeat(np.arange(len(part)), np.diff(part.bounds)), part.terms, part.unit(idf, lexicon)


class BlockMaxIndex:
    """Unit TF-IDF vectors of labelled examples; exact top-k by cosine."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: Vectors, idf: np.ndarray, lexicon: int, block: int = BLOCK):
        order = self.like(vectors, idf, lexicon)
        self.ids, self.labels, self.vectors = ids[order], labels[order].astype(np.float64), vectors.take(order)
        self.idf, self.lexicon, self.block, self.ready = idf, lexicon, block, False

    @staticmethod
    def like(vectors: Vectors, idf: np.ndarray, lexicon: int) -> np.ndarray:
        """An order of the rows that puts like ones together: by the nearest of some rows over the most frequent terms."""
        n = len(vectors)
        top = np.argsort(-np.bincount(vectors.terms, minlength=len(idf)), kind="stable")[:256]
        column = np.full(len(idf), -1, np.int32)
        column[top] = np.arange(len(top))
        dense, first = np.zeros((n, len(top)), np.float32), np.full(n, lexicon, np.int64)
        for row, terms, weight in vectors.units(idf, lexicon):
            at = column[terms]
            dense[row[at >= 0], at[at >= 0]] = weight[at >= 0]
            np.minimum.at(first, row, np.minimum(terms, lexicon))
        centers = dense[np.linspace(0, max(0, n - 1), min(n, 128)).astype(int)]
        return np.lexsort((np.argmax(dense @ centers.T, axis=1) if n else first, first))

    def prepare(self) -> None:
        """Posting lists, the dense part and the blocks' maxima; made where the search runs, so broadcasts stay small."""
        n, size, terms = len(self.ids), len(self.idf), self.vectors.terms
        blocks = -(-n // self.block)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.vectors.bounds))
        weight = np.concatenate([w for _, _, w in self.vectors.units(self.idf, self.lexicon)])
        often = np.bincount(terms, minlength=size)
        frequent = np.argsort(-often, kind="stable")[:DENSE]
        frequent = frequent[often[frequent] > n / 40]
        self.column = np.full(size, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        own = self.column[terms] >= 0
        # the frequent terms' part of every example, for exact cosines, and in single precision as a matrix
        self.parts, self.part_terms, self.part_weights = np.r_[0, np.cumsum(np.bincount(row[own], minlength=n))], self.column[terms[own]], weight[own]
        self.dense = np.zeros((len(frequent), blocks * self.block), np.float32)
        self.dense[self.part_terms, row[own]] = self.part_weights
        self.dense_most = self.dense.reshape(len(frequent), blocks, self.block).max(axis=2)
        order = np.flatnonzero(~own)[np.argsort(terms[~own], kind="stable")]
        self.rows, self.light, sorted_terms = row[order], weight[order], terms[order]
        self.heads = np.searchsorted(sorted_terms, np.arange(size + 1))
        self.vectors, self.ready = None, True  # all is in the parts and lists now

    def search(self, queries: Vectors, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest of every query, ties to the smaller doc_id; only cosines above 0.

        ``without`` gives the position of an example to leave out of a query's answer, or -1.
        """
        n, out = len(self.ids), [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if not n or not len(queries):
            return out
        if not self.ready:
            self.prepare()
        unit = queries.unit(self.idf, self.lexicon)
        heavy = np.zeros((len(queries), len(self.dense)))
        row, at = np.repeat(np.arange(len(queries)), np.diff(queries.bounds)), self.column[queries.terms]
        heavy[row[at >= 0], at[at >= 0]] = unit[at >= 0]
        single = heavy.astype(np.float32)
        often, blocks = single @ self.dense_most, self.dense_most.shape[1]  # bounds on the frequent terms' part
        order = np.argsort(np.argmax(often, axis=1), kind="stable")  # like queries share their blocks
        probes = -(-(k + 1) // self.block)
        for lo in range(0, len(order), TOGETHER):
            some = order[lo : lo + TOGETHER]
            rare, least = np.zeros((len(some), blocks * self.block)), np.zeros(len(some))
            for j, i in enumerate(some):
                own = slice(queries.bounds[i], queries.bounds[i + 1])
                first, many = self.heads[queries.terms[own]], self.heads[queries.terms[own] + 1] - self.heads[queries.terms[own]]
                here = spans(first, many)
                rare[j] = np.bincount(self.rows[here], self.light[here] * np.repeat(unit[own], many), blocks * self.block)
            # the largest sum over the rarer terms in every block is known, so only the frequent ones are bounded
            bound = often[some] + rare.reshape(len(some), blocks, self.block).max(axis=2)
            best = np.argpartition(-bound, probes - 1, axis=1)[:, :probes] if probes < blocks else np.tile(np.arange(blocks), (len(some), 1))
            for j, i in enumerate(some):
                probe = np.concatenate([rare[j, x : x + self.block] + single[i] @ self.dense[:, x : x + self.block] for x in best[j] * self.block])
                if without is not None and without[i] >= 0 and without[i] // self.block in best[j]:
                    probe[np.argmax(probe)] = 0  # no other is nearer than the example itself
                least[j] = max(self.kth(probe, k) - SLACK, 1e-12)
            alive = np.flatnonzero((bound >= least[:, None] - SLACK).any(axis=0))
            score = np.zeros(rare.shape, np.float32)
            for run in np.split(alive, np.flatnonzero(np.diff(alive) > 1) + 1):  # neighbouring blocks together, without copies
                own = slice(run[0] * self.block, (run[-1] + 1) * self.block)
                np.matmul(single[some], self.dense[:, own], out=score[:, own])
                np.add(score[:, own], rare[:, own], out=score[:, own], casting="same_kind")
            for j, i in enumerate(some):
                near = np.flatnonzero(score[j] >= least[j])
                if without is not None and without[i] >= 0:
                    near = near[near != without[i]]
                if len(near) > k:
                    near = near[score[j, near] >= self.kth(score[j, near], k) - SLACK]
                many = self.parts[near + 1] - self.parts[near]
                at = spans(self.parts[near], many)
                cosines = rare[j, near] + np.bincount(np.repeat(np.arange(len(near)), many), self.part_weights[at] * heavy[i][self.part_terms[at]], len(near))
                out[i] = self.top(near, np.minimum(cosines, 1.0), k)
        return out

    @staticmethod
    def kth(cosines: np.ndarray, k: int) -> float:
        return float(np.partition(cosines, len(cosines) - k)[len(cosines) - k]) if len(cosines) >= k else 0.0

    def top(self, found: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[found], -np.round(cosines, 9)))[:k]
        best = best[cosines[best] > 0]
        return found[best], cosines[best]

    def vote(self, at: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        weight = (HALF / (HALF + 1 - cosines)) ** 2
        return float(((weight * self.labels[at]).sum() + prior) / (weight.sum() + 1))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators with one success and failure's worth of smoothing; knots to interpolate between."""
    order = np.lexsort((y, x))
    mean = float(y.mean()) if len(y) else 0.0
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 2 * mean) / (p[1] + 2) for p in pools])


def surprise(inside: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Signed log-likelihood ratio of ``inside`` of ``total`` against a chance of ``share``."""
    outside = total - inside
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(inside > 0, inside * np.log(inside / (total * share)), 0) + np.where(outside > 0, outside * np.log(outside / (total * (1 - share))), 0))
    return np.where(inside > total * share, g, -g)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, their words, words' hashes, words' rows): all words, then the beginnings of longer ones."""
    found = W.words_of(column, W.ALNUM_LOWER)
    word = np.arange(len(found.hashes))
    terms, owners = [found.hashes], [word]
    for length in PREFIXES:
        long = word[found.ends - found.starts > length]
        terms.append(W.prefix_hashes(found, long, length))
        owners.append(long)
    return np.concatenate(terms), np.concatenate(owners), found.hashes, np.repeat(np.arange(len(column)), np.diff(found.bounds))


def place_in(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in sorted ``known``, whether it is there)."""
    place = np.searchsorted(known, hashes)
    same = place < len(known)
    same[same] = known[place[same]] == hashes[same]
    return place, same


class Terms:
    """Numbers of the terms: the lexicon's, then the plain words'."""

    def __init__(self, lexicon: np.ndarray, plain: np.ndarray):
        self.lexicon, self.plain = lexicon, plain
        self.size = len(lexicon) + len(plain)

    def vectors(self, column: pa.Array) -> Vectors:
        found, size = W.words_of(column, W.ALNUM_LOWER), np.int64(max(1, self.size))
        rows = np.repeat(np.arange(len(column)), np.diff(found.bounds))
        word, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        at, known = place_in(self.plain, word)
        cells = [(rows * size + len(self.lexicon) + at[inverse])[known[inverse]]]
        for length in (0, *PREFIXES):  # whole words, then beginnings of longer ones; each distinct word once
            long = np.flatnonzero((found.ends - found.starts)[first] > length)
            place, same = place_in(self.lexicon, W.prefix_hashes(found, first[long], length) if length else word)
            if same.any():
                number = np.full(len(word), -1)
                number[long[same]] = place[same]
                hit = number[inverse] >= 0
                cells.append(rows[hit] * size + number[inverse[hit]])
        cell, count = np.unique(np.concatenate(cells), return_counts=True)
        own, cell = np.divmod(cell, size)
        edges = np.arange(len(column) + 1)
        background = np.floor(np.log2(1 + np.diff(found.bounds)))
        return Vectors(np.searchsorted(own, edges), cell.astype(np.int32), count.astype(np.int32), background)


def per_row(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of every row, with their rows."""
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    new = np.r_[True, (np.diff(row) != 0) | (term[1:] != term[:-1])] if len(term) else np.zeros(0, bool)
    return term[new], row[new]


def toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = 20000, purity: float = 0.85, k: int = 32, threshold: float = 0.3, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Score whole texts; one row per input row: doc_id, held_out, score, predicted, evidence.

    Examples are at most ``max_examples`` labelled rows (the first by hash of
    doc_id) outside the held-out fold crc32(doc_id) mod ``modulus`` =
    ``remainder``; everything else covers all documents.  ``evidence`` lists
    the nearest examples (doc_id, cosine, label).  doc_id, label, language and
    source of a document are no input of its score.

    Null and empty texts, and texts without any word of the examples, get
    the label rate of such examples.  Labels other than 0 and 1 are ignored, a
    doc_id with several labels takes the largest.  Without labels every score
    is the smoothed prior.  Repeated rows and null doc_id pass through; examples
    as near as each other count by doc_id; clashing column names do not matter,
    as only doc_id, text and ``label`` are read.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    # at most max_examples rows are broadcast; a few small parts, so that all cores take a share
    examples = written(texts.join(F.broadcast(known), "doc_id").repartition(spark.sparkContext.defaultParallelism * 2))

    def slices(batches):
        for batch in batches:
            yield from W.slices(batch, size=W.SMALL_SLICE)

    def term_counts(batches):
        for part in slices(batches):
            term, owner, _, rows = tokens(part.column("text"))
            term, row = per_row(term, rows[owner])
            value, inverse = np.unique(term, return_inverse=True)
            toxic = np.bincount(inverse, part.column("label").to_numpy()[row], len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(value))), pa.array(toxic)], ["term", "n", "toxic"])

    n_examples, n_toxic = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (n_toxic + 0.5) / (n_examples + 5)
    share = n_toxic / n_examples if n_examples else 0.0
    counted = written(examples.select("text", "label").mapInArrow(term_counts, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("toxic >= 3"))
    # terms of at most max_examples documents, so their number is bounded
    candidates = counted.where((F.col("toxic") / F.col("n")) / F.lit(max(share, 1e-9)) > 1.5).select("term").toArrow().column("term").to_numpy()
    chosen = spark.sparkContext.broadcast(np.sort(candidates.view(np.uint64)))

    def contexts(batches):
        for part in slices(batches):
            term, owner, word, row = tokens(part.column("text"))
            _, same = place_in(chosen.value, term)
            at, edge = owner[same], np.uint64(0)
            left = np.where((at > 0) & (row[at - 1] == row[at]), word[at - 1], edge)
            after = np.minimum(at + 1, max(0, len(word) - 1))
            right = np.where((at + 1 < len(word)) & (row[after] == row[at]), word[after], edge)
            label = part.column("label").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(term[same].view(np.int64)), pa.array(W.joined(left, right).view(np.int64)), pa.array(label[row[at]].astype(np.int32))], ["term", "context", "label"])

    sizes = examples.select(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n"), "label").agg(F.sum("n"), F.sum(F.col("n") * F.col("label"))).first()
    words_share = min(0.99, max(1e-6, (sizes[1] or 0) / max(1, sizes[0] or 1)))
    support = examples.select("text", "label").mapInArrow(contexts, "term long, context long, label int").distinct().groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).toArrow()
    n, toxic = (support.column(c).to_numpy().astype(float) for c in ("n", "toxic"))
    sure = (surprise(toxic, n, words_share) >= 2 * math.log(max(10, counted.count())) + 2) & (toxic >= 3) & (toxic >= purity * n)
    lexicon = np.sort(support.column("term").to_numpy()[sure].view(np.uint64))

    def distinct_words(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(W.words_of(part.column("text"), W.ALNUM_LOWER).hashes).view(np.int64))], ["word"])

    # the words of at most max_examples documents
    plain = examples.select("text").mapInArrow(distinct_words, "word long").distinct().toArrow().column("word").to_numpy().view(np.uint64)
    numbers = Terms(lexicon, np.sort(np.setdiff1d(plain, lexicon)))
    terms = spark.sparkContext.broadcast(numbers)

    def document_counts(batches):
        total = np.zeros(terms.value.size, np.int64)
        rows = 0
        for part in slices(batches):
            found = terms.value.vectors(part.column("text"))
            total += np.bincount(found.terms, minlength=len(total))
            rows += len(found)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[total[used], rows])], ["term", "n"])

    often = texts.select("text").mapInArrow(document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the examples
    at, n = often.column("term").to_numpy(), often.column("n").to_numpy()
    total = int(n[at < 0].sum())
    idf = np.full(numbers.size, math.log(total + 1) + 1)
    idf[at[at >= 0]] = np.log((total + 1) / (n[at >= 0] + 1)) + 1

    def example_vectors(batches):
        for part in slices(batches):
            found = terms.value.vectors(part.column("text"))
            edges = pa.array(found.bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(edges, pa.array(found.terms)), pa.ListArray.from_arrays(edges, pa.array(found.counts)), pa.array(found.background)], ["doc_id", "label", "terms", "counts", "background"])

    sample = examples.mapInArrow(example_vectors, "doc_id long, label int, terms array<int>, counts array<int>, background double").toArrow().combine_chunks()  # at most max_examples documents
    held = [sample.column(c).to_numpy() for c in ("doc_id", "label", "background")]
    flat = [sample.column(c).combine_chunks() for c in ("terms", "counts")]
    flat = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in flat]
    lengths = np.array(flat[0].value_lengths().to_numpy(zero_copy_only=False), np.int64)
    vectors = Vectors(np.r_[0, np.cumsum(lengths)], *(x.flatten().to_numpy() for x in flat), held[2])
    order = np.argsort(held[0], kind="stable")
    full, bare = order[lengths[order] > 0], held[1][order[lengths[order] == 0]]
    index = spark.sparkContext.broadcast(BlockMaxIndex(held[0][full], held[1][full], vectors.take(full), idf, len(lexicon)))
    del sample, flat, vectors
    empty = float((bare.sum() + prior) / (len(bare) + 1))

    def leave_one_out(batches):
        at = np.argsort(index.value.ids, kind="stable")
        for part in slices(batches):
            found, ids = terms.value.vectors(part.column("text")), part.column("doc_id").to_numpy()
            rows = np.flatnonzero(np.diff(found.bounds) > 0)
            own = at[np.searchsorted(index.value.ids, ids[rows], sorter=at)] if len(rows) else rows
            answers = index.value.search(found.take(rows), k, own)
            yield pa.RecordBatch.from_arrays([pa.array([index.value.vote(*a, prior) for a in answers], pa.float64()), pa.array(part.column("label").to_numpy()[rows].astype(float))], ["vote", "label"])

    left_out = examples.mapInArrow(leave_one_out, "vote double, label double").toArrow()  # at most max_examples rows
    knots = isotonic(left_out.column("vote").to_numpy(), left_out.column("label").to_numpy())

    def score(batches):
        x, y = knots
        for part in slices(batches):
            found = terms.value.vectors(part.column("text"))
            rows = np.flatnonzero(np.diff(found.bounds) > 0)
            answers = index.value.search(found.take(rows), k)
            scores, many = np.full(len(found), empty), np.zeros(len(found), np.int64)
            raw = np.array([index.value.vote(*a, prior) for a in answers])
            scores[rows] = np.interp(raw, x, y) if len(x) else raw
            many[rows] = [len(at) for at, _ in answers]
            near = np.concatenate([at for at, _ in answers]) if answers else np.zeros(0, np.int64)
            cosines = np.concatenate([c for _, c in answers]) if answers else np.zeros(0)
            evidence = pa.StructArray.from_arrays([pa.array(index.value.ids[near]), pa.array(cosines), pa.array(index.value.labels[near].astype(np.int32))], ["doc_id", "cosine", "label"])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), evidence)], ["doc_id", "score", "evidence"])

    scored = texts.mapInArrow(score, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
