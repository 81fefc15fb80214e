"""Near-duplicate groups by Order MinHash and banded alignment.

Texts are sequences of five-word shingles.  Order MinHash labels equal
shingles of a text by occurrence, takes for each of ``sketches`` hash functions
the ``picks`` smallest, and hashes them in text order: two texts share a sketch
only if they hold the same shingles in the same order, so the sketch follows
edit similarity.  Texts that share a sketch are aligned, and linked if
matched / (m + n - matched) >= ``threshold`` where matched is the longest common
subsequence of their m and n shingles.

Short texts have too few shingles to sample.  A pair with one of at most
``brief`` shingles meets by an exact prefix filter instead: labels in order of
their frequency among short texts, of which a text of n shingles shares one of
its first n - ceil(threshold n) + 1 with every text that it can be linked with.

Sketches and prefix labels are buckets.  In each round every text meets one
text, the least of the firsts of its buckets in an order of the round's own, if
that is not in its group yet; what verifies joins groups, so a bucket of
thousands of near copies costs about as many alignments as it has texts.  At
last all texts that share a bucket and are still in different groups meet in
blocks, so no pair that shares a bucket is left out.  Groups are the connected
components of all links.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import written

SHINGLE = 5


def occurrence_labels(shingles: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mix the k-th occurrence of a shingle within its row into its hash."""
    order = np.lexsort((shingles, row))
    same = np.zeros(len(order), bool)
    same[1:] = (shingles[order][1:] == shingles[order][:-1]) & (row[order][1:] == row[order][:-1])
    rank = np.arange(len(order))
    first = np.maximum.accumulate(np.where(same, 0, rank))
    nth = np.empty(len(order), np.uint64)
    nth[order] = (rank - first).astype(np.uint64)
    return W.mix(shingles + nth * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(labels: np.ndarray, factors: np.ndarray, picks: int) -> np.ndarray:
    """One key per factor: the ``picks`` smallest of at least as many labels, in text order."""
    at = np.sort(np.argpartition(labels[:, None] * factors[None, :], picks - 1, axis=0)[:picks], axis=0)
    key = factors.copy()
    for i in range(picks):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + labels[at[i]])
    return key


def lcs_banded(a: list[int], b: list[int], band: int, block: int = 256) -> int:
    """Longest common subsequence with matches at most ``band`` off the diagonal, 64 cells to a machine word.

    Exact for every pair whose alignment needs no more than ``band`` insertions
    and deletions, which is all that the caller accepts.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return lead + tail
    column = (1 << len(a)) - 1
    for lo in range(0, len(b), block):
        left, right = max(0, lo - band), min(len(a), lo + block + band)
        if left >= right:
            break
        masks: dict[int, int] = {}
        for i in range(left, right):
            masks[a[i]] = masks.get(a[i], 0) | 1 << (i - left)
        width = (1 << (right - left)) - 1
        window = column >> left & width
        for x in b[lo : lo + block]:
            hit = window & masks.get(x, 0)
            window = ((window + hit) | (window - hit)) & width
        column = column & ~(width << left) | window << left
    return lead + tail + len(a) - column.bit_count()


def similarity(a: list[int], b: list[int], threshold: float) -> float:
    """matched / (m + n - matched); 0 as soon as the threshold is out of reach."""
    m, n = len(a), len(b)
    if not m or not n or min(m, n) < threshold * max(m, n):
        return 0.0
    band = int((m + n) * (1 - threshold) / (1 + threshold)) + 1
    matched = lcs_banded(a, b, band)
    return matched / (m + n - matched)


def shingles_of(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, row bounds); a row of one to four words is one shingle."""
    shingles, at = W.rolling(found.hashes, found.bounds, SHINGLE, 5)
    row = np.searchsorted(found.bounds, at, side="right") - 1
    sizes = np.diff(found.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        lone, row = [shingles], np.r_[row, short]
        for i in short:
            whole = found.hashes[found.bounds[i] : found.bounds[i + 1]]
            lone.append(W.rolling(whole, np.array([0, len(whole)]), len(whole), 6)[0])
        order = np.argsort(row, kind="stable")
        row, shingles = row[order], np.concatenate(lone)[order]
    return shingles, np.searchsorted(row, np.arange(len(found.bounds)))


def labels_of(column: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """(words, occurrence-labelled shingles, row bounds) of a text column."""
    found = W.words_of(column)
    shingles, bounds = shingles_of(found)
    return found, occurrence_labels(shingles, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))), bounds


def first_parts(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_id, size, bucket): the prefix labels of short texts, rarest first; labels of one text only are no buckets."""
    labels = classes.where("labels is not null").select("class_id", "size", F.explode("labels").alias("label"))
    common = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    held = labels.join(common, "label").groupBy("class_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "label"))).alias("held"))
    # unshared labels come first, as the rarest; at most ``brief`` / ``threshold`` labels a text are collected
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1 - (F.col("size") - F.size("held"))
    return held.select("class_id", "size", F.explode(F.slice("held.label", F.lit(1), F.greatest(F.lit(0), prefix.cast("int")))).alias("bucket"))


def likely(cell: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text of a cell that asks: its row, the rows of other groups that may reach the threshold with it, and the bounds of these."""
    homes, sizes, asks = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("home", "size", "asks"))
    bag = [np.frombuffer(x, "<u4") for x in cell.column("bag").to_pylist()]
    right = np.flatnonzero(~asks)
    theirs = np.concatenate([bag[j] for j in right]) if len(right) else np.zeros(0, "<u4")
    order = np.argsort(theirs, kind="stable")
    theirs, owner = theirs[order], np.repeat(np.arange(len(right)), [len(bag[j]) for j in right])[order]
    for i in np.flatnonzero(asks):
        lo, hi = np.searchsorted(theirs, bag[i]), np.searchsorted(theirs, bag[i], side="right")
        at = np.arange((hi - lo).sum()) + np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo)
        # labels of one text that fall on one number count as shared
        shared = np.bincount(owner[at], minlength=len(right)) + sizes[i] - len(bag[i])
        close = (np.minimum(sizes[right], sizes[i]) >= threshold * np.maximum(sizes[right], sizes[i])) & (homes[right] != homes[i])
        near, most = right[close], shared[close]
        bound = most / np.maximum(1, sizes[i] + sizes[near] - most)
        fits = np.flatnonzero((bound >= threshold - 1e-6) | (2 * most >= sizes[i] + sizes[near]))
        yield i, near[fits], bound[fits]


class Apart:
    """Texts that share a bucket and are in different groups, compared in blocks without moving their texts again.

    ``spots`` has bucket, class_id, home (the group) and size.  Buckets within
    one group are passed over.  In the others the texts outside the largest
    group meet all texts of the bucket; both sides are cut into blocks and
    every two blocks meet in a cell of their own, so no task holds a bucket.
    A cell compares lengths and then the sets of labelled shingles, which bound
    what two texts can share from above, and aligns what may reach the
    threshold.  ``best`` and ``others`` list such pairs without aligning them.
    """

    def __init__(self, spots: DataFrame, texts: DataFrame, threshold: float, block: int = 512, weight: int = 1 << 20):
        self.threshold, self.block, self.weight = threshold, block, weight
        self.members = written(self.mixed(spots))
        wanted = self.members.select("class_id").distinct()
        self.bags = written(texts.withColumnRenamed("doc_id", "class_id").join(wanted, "class_id").select("class_id", "text").mapInArrow(self.bag, "class_id long, bag binary, shingles binary"))

    def mixed(self, spots: DataFrame) -> DataFrame:
        """``spots`` of buckets with several groups, with the numbers of blocks and whether a text is outside the largest group."""
        groups = spots.groupBy("bucket", "home").agg(F.count("*").alias("n"), F.sum("size").alias("long"))
        buckets = groups.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("long").alias("long"), F.max(F.struct("n", "long", "home")).alias("main")).where("n > main.n")
        cuts = lambda n, long: F.ceil(F.greatest(n / self.block, long / self.weight))
        buckets = buckets.select("bucket", F.col("main.home").alias("main"), cuts(F.col("n"), F.col("long")).alias("wide"), cuts(F.col("n") - F.col("main.n"), F.col("long") - F.col("main.long")).alias("narrow"))
        return spots.join(buckets, "bucket").select("bucket", "class_id", "home", "size", "wide", "narrow", (F.col("home") != F.col("main")).alias("minor"))

    @staticmethod
    def bag(batches):
        for batch in batches:
            for part in W.slices(batch, size=W.SMALL_SLICE):
                shingles, bounds = shingles_of(W.words_of(part.column("text")))
                short = (occurrence_labels(shingles, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))) >> np.uint64(32)).astype("<u4")
                spans = list(zip(bounds[:-1], bounds[1:]))
                made = [pa.array([f(lo, hi).tobytes() for lo, hi in spans], pa.binary()) for f in (lambda lo, hi: np.unique(short[lo:hi]), lambda lo, hi: shingles[lo:hi].astype("<u8"))]
                yield pa.RecordBatch.from_arrays([part.column("class_id"), *made], ["class_id", "bag", "shingles"])

    def cells(self, members: DataFrame, *held: str) -> GroupedData:
        """Every two blocks of a bucket with ``held`` of their texts; ``asks`` tells the side of the texts outside the largest group."""
        full = members.join(self.bags, "class_id")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        part = lambda n: F.pmod(F.xxhash64("class_id"), n)
        columns = ["class_id", "home", "size", "bag", *held]
        there = full.select("bucket", F.explode(upto(F.col("narrow"))).alias("u"), part(F.col("wide")).alias("v"), F.lit(False).alias("asks"), *columns)
        here = full.where("minor").select("bucket", part(F.col("narrow")).alias("u"), F.explode(upto(F.col("wide"))).alias("v"), F.lit(True).alias("asks"), *columns)
        # a number of partitions is given, as these tasks are slow and not large: Spark is not to merge them
        dealt = there.unionByName(here).repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "u", "v")
        return dealt.groupBy("bucket", "u", "v")

    def links(self) -> DataFrame:
        """Links (a, b) that join the groups as all links between them would.

        A cell aligns the likeliest pairs first and no pair of groups that its
        own links have joined, so it makes fewer links than it holds groups.
        A pair is aligned in the least bucket that it shares, once.
        """
        buckets = self.members.groupBy("class_id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
        threshold = self.threshold

        def meet(cell: pa.Table) -> pa.Table:
            ids, homes, minor = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("class_id", "home", "minor"))
            here, held, shingles = cell.column("bucket")[0].as_py() if len(ids) else None, cell.column("buckets"), cell.column("shingles")
            joined: dict[int, int] = {}

            def top(home: int) -> int:
                while (up := joined.get(home, home)) != home:
                    joined[home] = home = joined.get(up, up)
                return home

            within = functools.cache(lambda i: frozenset(x for x in held[i].as_py() if x < here))
            sequence = functools.cache(lambda i: np.frombuffer(shingles[i].as_py(), "<u8").tolist())
            found = []
            for i, rows, bounds in likely(cell, threshold):
                for j in rows[np.argsort(-bounds, kind="stable")].tolist():
                    # both of a pair outside the largest group ask
                    if minor[j] and ids[j] > ids[i] or (low := top(int(homes[i]))) == (high := top(int(homes[j]))) or not within(int(i)).isdisjoint(within(j)):
                        continue
                    if similarity(sequence(int(i)), sequence(j), threshold) >= threshold:
                        joined[max(low, high)] = min(low, high)
                        found.append((ids[i], ids[j]))
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.table({"a": a, "b": b})

        members = self.members.join(buckets, "class_id")
        return self.cells(members, "minor", "buckets", "shingles").applyInArrow(meet, "a long, b long")

    def pairs(self, members: DataFrame, best: bool) -> DataFrame:
        """Pairs (class_id, first) that may reach the threshold; with ``best`` only the most similar one of two groups."""
        threshold = self.threshold

        def meet(cell: pa.Table) -> pa.Table:
            ids, homes = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("class_id", "home"))
            rows = []
            for i, fits, bound in likely(cell, threshold):
                if best:  # the most similar text of each group
                    order = np.lexsort((-bound, homes[fits]))
                    fits, bound = fits[order], bound[order]
                    first = np.r_[True, np.diff(homes[fits]) != 0] if len(fits) else np.zeros(0, bool)
                    fits, bound = fits[first], bound[first]
                rows.append(np.stack([np.full(len(fits), ids[i]), ids[fits], np.full(len(fits), homes[i]), homes[fits], (bound * 1e6).astype(np.int64)]))
            found = np.concatenate([np.empty((5, 0), np.int64), *rows], axis=1)
            return pa.table({"class_id": found[:2].max(axis=0), "first": found[:2].min(axis=0), "low": found[2:4].min(axis=0), "high": found[2:4].max(axis=0), "bound": found[4]})

        found = self.cells(members).applyInArrow(meet, "class_id long, first long, low long, high long, bound long")
        if not best:
            return found.select("class_id", "first", "low", "high").distinct()
        return found.groupBy("low", "high").agg(F.max(F.struct("bound", "class_id", "first")).alias("pair")).select("pair.class_id", "pair.first", "low", "high")

    def best(self) -> DataFrame:
        """For every two groups that may be linked, the pair with the highest bound: class_id, first, low, high (the groups)."""
        return self.pairs(self.members, True)

    def others(self, failed: DataFrame) -> DataFrame:
        """All pairs of the groups (low, high) in ``failed``, whose best pair is no link."""
        homes = failed.select(F.explode(F.array("low", "high")).alias("home")).distinct()
        return self.pairs(self.members.join(homes, "home"), False).join(failed.select("low", "high"), ["low", "high"])


def near_dedup(documents: DataFrame, threshold: float = 0.8, sketches: int = 24, picks: int = 5, brief: int = 24, rounds: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, class_id, group_id, kept.

    class_id is the smallest doc_id with the same words in the same order (told
    apart by 128 bits), group_id the smallest doc_id of the connected component
    under links of similarity >= ``threshold``, kept whether the row is that
    document.

    Null and empty texts link with nothing (class_id = group_id = doc_id).
    A null doc_id gives null class_id and group_id and is kept.  Rows with one
    doc_id count as one document, of whose texts the greatest is aligned; whole
    texts are compared, of any length.  Other columns are ignored; an empty
    table gives an empty result.
    """
    factors = np.random.default_rng(seed).integers(0, 1 << 63, sketches, np.uint64) * np.uint64(2) + np.uint64(1)
    bands = W.mix(np.arange(1, sketches + 1, dtype=np.uint64))
    reach = int(brief / threshold + 1e-9)  # the longest text that one of ``brief`` shingles can be linked with

    def sign(batches):
        for batch in batches:
            for part in W.slices(batch, size=W.SMALL_SLICE):
                found, labels, bounds = labels_of(part.column("text"))
                sizes = np.diff(bounds)
                place = W.mix(np.arange(len(found.hashes), dtype=np.uint64) - np.repeat(found.bounds[:-1], np.diff(found.bounds)).astype(np.uint64) + np.uint64(99))
                sums = [np.r_[np.uint64(0), np.cumsum(W.mix(h + place), dtype=np.uint64)] for h in (found.hashes, found.second)]
                a, b = ((s[found.bounds[1:]] - s[found.bounds[:-1]]).view(np.int64) for s in sums)
                keys = [W.mix(order_sketches(labels[lo:hi], factors, picks) + bands).view(np.int64) if hi - lo > brief else None for lo, hi in zip(bounds, bounds[1:])]
                short = [labels[lo:hi].view(np.int64) if 0 < hi - lo <= reach else None for lo, hi in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, mask=sizes == 0), pa.array(b, mask=sizes == 0), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64()))], ["doc_id", "a", "b", "size", "keys", "labels"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(sign, "doc_id long, a long, b long, size long, keys array<long>, labels array<long>"))
    full = signed.where("a is not null and doc_id is not null")
    classes = written(full.groupBy("a", "b").agg(F.min("doc_id").alias("class_id"), F.min("size").alias("size"), F.min("keys").alias("keys"), F.min("labels").alias("labels")))
    spots = classes.select("class_id", "size", F.explode("keys").alias("bucket")).unionByName(first_parts(classes, threshold))
    shared = spots.groupBy("bucket").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least < most").select("bucket")
    spots = written(spots.join(shared, "bucket"))
    # the texts that share a bucket; the others are not read again
    sharing = spots.select(F.col("class_id").alias("doc_id")).distinct()
    bodies = written(texts.join(sharing, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")))

    def verify(batches):
        for batch in batches:
            step = max(1, (4 << 20) * batch.num_rows // max(1, batch.nbytes))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                sides = []
                for name in ("text", "first_text"):
                    shingles, bounds = shingles_of(W.words_of(part.column(name)))
                    sides.append((shingles.tolist(), bounds))
                (x, xb), (y, yb) = sides
                linked = [similarity(x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]], threshold) >= threshold for i in range(part.num_rows)]
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (class_id, first), each side's text sent once per pair."""
        sides = pairs.select("class_id", "first", F.explode(F.array("class_id", "first")).alias("doc_id")).join(bodies, "doc_id")
        aligned = sides.groupBy(F.col("class_id").alias("a"), F.col("first").alias("b")).agg(*[F.max(F.when(F.col("doc_id") == F.col(c), F.col("text"))).alias(t) for c, t in (("class_id", "text"), ("first", "first_text"))])
        return written(aligned.mapInArrow(verify, "a long, b long"))

    def homed(spots: DataFrame, links: DataFrame | None) -> DataFrame:
        """``spots`` with their texts' groups."""
        if links is None:
            return spots.withColumn("home", F.col("class_id"))
        return spots.join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left").select("bucket", "class_id", "size", F.coalesce("component", "class_id").alias("home"))

    links = None
    for mask in np.random.default_rng(seed + 1).integers(0, 1 << 62, max(1, rounds)).tolist():
        own = homed(spots, links).withColumn("order", F.col("class_id").bitwiseXOR(F.lit(mask)))
        own = own if links is None else written(own)
        firsts = own.groupBy("bucket").agg(F.min("order").alias("first"), F.min("home").alias("least"), F.max("home").alias("most")).where("least < most").select("bucket", F.col("first").alias("order"))
        heads = own.join(firsts, ["bucket", "order"]).select("bucket", "order", F.col("home").alias("far"), F.col("size").alias("long"))
        near = own.drop("order").join(heads, "bucket").where((F.col("home") != F.col("far")) & (F.least("size", "long") >= threshold * F.greatest("size", "long")))
        often = near.groupBy("class_id", "order").agg(F.count("*").alias("n"))
        pairs = written(often.groupBy("class_id").agg(F.max(F.struct("n", (-F.col("order")).alias("order"))).alias("best")).select("class_id", (-F.col("best.order")).bitwiseXOR(F.lit(mask)).alias("first")))
        found = verified(pairs)
        links = found if links is None else links.unionByName(found)

    apart = Apart(homed(spots, links), bodies, threshold)
    links = links.unionByName(written(apart.links()))
    groups = components(links)
    named = classes.select("a", "b", "class_id").join(groups, F.col("class_id") == F.col("node"), "left").select("a", "b", "class_id", F.coalesce("component", "class_id").alias("group_id"))
    out = signed.select("doc_id", "a", "b").join(named, ["a", "b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id"))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), own.alias("group_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
