"""Embedding near-duplicates by a robust-pruned flat graph over overlapping shards.

Centroids are fitted on a bounded sample; every vector joins its ``overlap``
nearest clusters.  A cluster larger than ``shard`` is dealt into blocks, and
every vector of the cluster queries every block, so no task holds more than a
block and a batch of queries.  Each block builds a robust-pruned graph, the
adjacency lists of a vector are united over its blocks, and queries walk from
the medoid by greedy search, then widen over everything in range.  A pair is
counted only in the first block where it can meet, and verified in double
precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pc.list_flatten(flat).to_numpy(zero_copy_only=False).astype(np.float64)
    out = values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    scale = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out = out / scale
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample."""
    centers = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centers)
    return centers


def robust_prune(cosines: np.ndarray, degree: int, alpha: float, candidates: int = 96) -> list[np.ndarray]:
    """Out-neighbours of each row: nearest first, dropping those that a chosen one covers by ``alpha``."""
    n = len(cosines)
    distance = np.sqrt(np.maximum(0.0, 2 - 2 * cosines))
    out = []
    for i in range(n):
        row = distance[i]
        near = np.argpartition(row, min(candidates, n - 1))[: candidates + 1] if n > candidates + 1 else np.arange(n)
        near = near[near != i]
        near = near[np.argsort(row[near], kind="stable")]
        chosen = []
        while len(near) and len(chosen) < degree:
            best = near[0]
            chosen.append(best)
            near = near[1:]
            near = near[alpha * distance[best, near] > row[near]]
        out.append(np.array(chosen, np.int64))
    return out


class Graph:
    """A navigable graph over the vectors of one block."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray]):
        self.vectors = vectors
        n, both = len(vectors), [set(x.tolist()) for x in neighbours]
        for i, own in enumerate(neighbours):  # an edge serves both ends
            for j in own.tolist():
                both[j].add(i)
        for i in range(1, n):  # a thread through all nodes keeps every one reachable
            both[i].add(i - 1), both[i - 1].add(i)
        self.edges = [np.fromiter(x, np.int64, len(x)) for x in both]
        self.medoid = int(np.argmax(vectors @ vectors.mean(axis=0))) if n else 0

    def within(self, query: np.ndarray, threshold: float, beam: int, slack: float) -> np.ndarray:
        """Nodes with cosine >= threshold: greedy beam search, then expansion of all that are nearly in range."""
        seen = np.zeros(len(self.vectors), bool)
        seen[self.medoid] = True
        nodes, cosines = np.array([self.medoid]), self.vectors[[self.medoid]] @ query
        done = np.zeros(1, bool)
        while not done.all():
            at = np.flatnonzero(~done)[:4]  # the best unexpanded ones
            done[at] = True
            new = np.unique(np.concatenate([self.edges[i] for i in nodes[at]]))
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                nodes, cosines, done = np.r_[nodes, new], np.r_[cosines, self.vectors[new] @ query], np.r_[done, np.zeros(len(new), bool)]
                order = np.argsort(-cosines, kind="stable")
                keep = max(beam, int((cosines >= threshold - slack).sum()))
                nodes, cosines, done = nodes[order][:keep], cosines[order][:keep], done[order][:keep]
        return nodes[cosines >= threshold]


def valid(embedding: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, shard: int = 1024, overlap: int = 2, sample: int = 16384, degree: int = 24, alpha: float = 1.2, beam: int = 32, slack: float = 0.1) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links are pairs found with cosine >= ``threshold`` in double precision,
    never below it; n_links counts other rows linked directly, component_id is
    the smallest vec_id reachable, kept whether that is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths.  Equal vectors are
    one node and link with each other.  A null vec_id gives null component_id,
    is kept and counts nowhere.  Repeated rows of one vec_id count as rows and
    share their component.  Other columns are ignored, an empty table gives an
    empty result.  ``sample`` bounds only what the centroids are fitted on.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # one zero
    nodes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    lengths = [r[0] for r in nodes.select(F.size("embedding").alias("d")).distinct().collect()]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = matrix(batch.column("embedding")) @ centers.value.T
            k = min(overlap, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if cosines.shape[1] > k else np.tile(np.arange(k), (len(cosines), 1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("embedding"), pa.array(list(np.sort(near, axis=1).astype(np.int32)), pa.list_(pa.int32()))], ["node", "n", "embedding", "clusters"])

    placed = None
    for length in lengths:
        own = nodes.where(F.size("embedding") == length)
        picked = own.orderBy(F.xxhash64("node")).limit(sample).select("embedding").toArrow()  # at most ``sample`` rows
        k = max(1, min(-(-own.count() // (shard // 4)), picked.num_rows // 8, 1024))
        centers = spark.sparkContext.broadcast(centroids_of(matrix(picked.column("embedding")), k))  # at most 1024 rows
        part = written(own.mapInArrow(assign, "node long, n long, embedding array<double>, clusters array<int>")).withColumn("length", F.lit(length))
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    spread = placed.select("node", "n", "embedding", "clusters", "length", F.explode("clusters").alias("cluster"))
    sizes = spread.groupBy("length", "cluster").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
    spread = written(spread.join(F.broadcast(sizes), ["length", "cluster"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))  # sizes: a row per cluster

    def build(table):
        x = matrix(table.column("embedding"))
        ids = table.column("node").to_numpy()
        lists = [ids[out] for out in robust_prune(x @ x.T, degree, alpha)]
        return pa.table({"node": table.column("node"), "out": pa.array(lists, pa.list_(pa.int64()))})

    graph = spread.select("length", "cluster", "block", "node", "embedding").groupBy("length", "cluster", "block").applyInArrow(build, "node long, out array<long>")
    united = written(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out")))

    members = spread.join(united, "node").select("length", "cluster", "block", F.lit(True).alias("member"), "node", "n", "embedding", "clusters", "out")
    asked = spread.select("length", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"), "node", "n", "embedding", "clusters", F.lit(None).cast("array<long>").alias("out"))

    def search(table):
        member = table.column("member").to_numpy(zero_copy_only=False)
        mine, queries = table.filter(pa.array(member)), table.filter(pa.array(~member))
        cluster = table.column("cluster")[0].as_py()
        ids, weight = mine.column("node").to_numpy(), mine.column("n").to_numpy()
        order = np.argsort(ids)
        place = lambda out: order[np.minimum(np.searchsorted(ids, out, sorter=order), len(ids) - 1)]
        lists = []
        for out in mine.column("out").to_pylist():
            out = np.array(out, np.int64)
            at = place(out)
            lists.append(at[ids[at] == out])
        graph = Graph(matrix(mine.column("embedding")), lists)
        clusters = mine.column("clusters").to_pylist()
        nodes, counts, to = [], [], []
        label = np.arange(len(ids))  # local components of this block's members, by their smallest position
        x = matrix(queries.column("embedding"))
        for i, (node, own) in enumerate(zip(queries.column("node").to_pylist(), queries.column("clusters").to_pylist())):
            own = set(own)
            found = graph.within(x[i], threshold, beam, slack)
            found = np.array([j for j in found.tolist() if ids[j] != node and min(own.intersection(clusters[j])) == cluster], np.int64)
            nodes.append(node)
            counts.append(int(weight[found].sum()))
            to.append(int(ids[found[0]]) if len(found) else None)
            several = np.unique(label[found])
            if len(several) > 1:
                label[np.isin(label, several)] = several[0]
        # each query is linked to one member found, and members to the first of their local component
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"node": pa.array([*nodes, *ids[far].tolist()], pa.int64()), "links": pa.array([*counts, *[0] * len(far)], pa.int64()), "to": pa.array([*to, *ids[label[far]].tolist()], pa.int64())})

    blocks = members.unionByName(asked).repartition("length", "cluster", "block").groupBy("length", "cluster", "block")
    found = written(blocks.applyInArrow(search, "node long, links long, to long"))
    groups = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    linked = nodes.select("embedding", "node", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(groups, "node", "left")
    linked = linked.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = good.join(linked, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("vec_id").isNull() | ~valid(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.9, every: int = 50) -> float:
    """Share of brute-force links of every ``every``-th vec_id that ``found`` counts; queries meet all rows in blocks."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid(F.col("embedding")))
    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0)
    true = hit = 0
    ids = asked.select("vec_id").orderBy("vec_id").toArrow().column(0).to_numpy()
    counts = dict(found.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "n_links").collect())
    for lo in range(0, len(ids), 1024):
        block = asked.where(F.col("vec_id").between(int(ids[lo]), int(ids[min(lo + 1023, len(ids) - 1)]))).toArrow()
        queries = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), matrix(block.column("embedding"))))

        def compare(batches):
            own, x = queries.value
            for batch in batches:
                if batch.num_rows:
                    near = (x @ matrix(batch.column("embedding")).T >= threshold).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near)], ["vec_id", "n"])

        for vec_id, n in good.mapInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n")).collect():
            true += n - 1
            hit += min(counts.get(vec_id, 0), n - 1)
    return hit / true if true else 1.0
