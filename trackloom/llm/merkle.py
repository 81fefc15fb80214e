"""Merkle manifest of a dataset: trees of fan-out 8 over sorted leaves, and the proof of every leaf.

Leaves are dealt by ranges of (tree, order) and written once, so that the
partition, the place in it and the counts of all partitions give every leaf its
index.  A task walks the leaves of an indexed partition with a stack of
mountains, one pending run a level: a carry out of eight children completes a
peak, which becomes a child one level up.  Nothing is padded: the last run of a
level is as short as it is.  Runs that begin or end in another partition are
left over as node records; a round a level puts those together, a few nodes
a partition.  A second walk over each partition needs only these merged runs to
know every sibling on the way up.  The roots of all trees are the leaves of one
more tree, built and proved by the same code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

BITS = 3
FANOUT = 1 << BITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leaves of a partition, and the number of partitions from which on it is their size that grows.
LEAVES, PARTITIONS = 1 << 15, 50_000
NODES = "tree string, level int, index long, width long, node string, loose boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def widths(leaves: int) -> list[int]:
    """Nodes of every level from the leaves to the root."""
    found = [leaves]
    while found[-1] > 1:
        found.append(-(-found[-1] // FANOUT))
    return found


class Mountains:
    """The runs pending on each level while nodes of one tree arrive by rising index.

    ``loose`` gets (level, index, node) of nodes whose run is not whole here,
    the root among them; ``whole`` gets every node that a carry completed.
    """

    def __init__(self, leaves: int):
        self.widths = widths(leaves)
        self.pending: list[tuple[int, list[str]]] = [(0, []) for _ in self.widths]
        self.loose: list[tuple[int, int, str]] = []
        self.whole: list[tuple[int, int, str]] = []

    def leave(self, level: int) -> None:
        first, run = self.pending[level]
        self.loose += [(level, first + i, node) for i, node in enumerate(run)]
        self.pending[level] = (0, [])

    def push(self, index: int, node: str) -> None:
        level, top = 0, len(self.widths) - 1
        while level < top:
            first, run = self.pending[level]
            if not run or index != first + len(run):
                self.leave(level)
                first, run = self.pending[level] = (index, [])
            run.append(node)
            if index % FANOUT != FANOUT - 1 and index != self.widths[level] - 1:
                return
            if first % FANOUT:  # the run began in another partition
                self.leave(level)
                return
            self.pending[level] = (0, [])
            level, index, node = level + 1, index // FANOUT, digest("".join(run))
            self.whole.append((level, index, node))
        self.loose.append((level, index, node))

    def finish(self) -> None:
        for level in range(len(self.widths)):
            self.leave(level)


def indexed(leaves: DataFrame, size: int = LEAVES) -> DataFrame:
    """``leaves`` (tree, order columns at0, at1, ..., leaf, others) with part, index in the tree from 0, and width of the tree.

    Rows that agree in tree, order and leaf are alike to the tree; a number of
    their own keeps many of them out of one partition.
    """
    n = leaves.count()
    order = ["tree", *sorted(c for c in leaves.columns if c.startswith("at")), "leaf", "tie"]
    parts = max(1, min(PARTITIONS, n // size + 1))
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = written(ranged.drop("tie").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # a row per partition and tree
    of_tree = Window.partitionBy("tree")
    starts = runs.select("tree", "part", (F.sum("n").over(of_tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(of_tree).alias("width"))
    return dealt.join(written(starts), ["tree", "part"]).withColumn("index", F.col("place") + F.col("shift")).drop("place", "shift")


def climb(batches, every: bool = False) -> Iterator[pa.RecordBatch]:
    """Node records of sorted leaves (tree, part, index, width, leaf): loose ones, and with ``every`` the whole ones too."""
    at, mountains = None, None

    def hand_on():
        rows = [(*x, loose) for loose, found in ((True, mountains.loose), (False, mountains.whole if every else [])) for x in found]
        mountains.loose, mountains.whole = [], []
        columns = [pa.array([at[0]] * len(rows), pa.string()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64())]
        columns += [pa.array([mountains.widths[x[0]] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.string()), pa.array([x[3] for x in rows], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["tree", "level", "index", "width", "node", "loose"])

    for batch in batches:
        for tree, part, index, width, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "index", "width", "leaf"))):
            if at != (tree, part):
                if at:
                    mountains.finish()
                    yield hand_on()
                at, mountains = (tree, part), Mountains(width)
            mountains.push(index, node)
        if at:
            yield hand_on()
    if at:
        mountains.finish()
        yield hand_on()


def merge(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs: tree, level, run, nodes, node; tops: tree, subroot) out of loose node records, level by level."""
    loose = records.where("loose")
    highest = loose.agg(F.max("level"), F.max(F.when(F.col("level") == 0, F.col("width")))).first()
    levels = max(highest[0] or 0, len(widths(highest[1] or 1)) - 1) + 1
    runs, tops, carried = [], [], None
    for level in range(levels):
        nodes = loose.where(F.col("level") == level).select("tree", "index", "width", "node")
        nodes = nodes if carried is None else nodes.unionByName(carried)
        tops.append(nodes.where("width = 1").select("tree", F.col("node").alias("subroot")))
        members = F.array_sort(F.collect_list(F.struct("index", "node")))["node"]  # eight at most
        run = nodes.where("width > 1").groupBy("tree", "width", F.shiftright("index", BITS).alias("run")).agg(members.alias("nodes"))
        run = written(run.select("tree", F.lit(level).alias("level"), "run", "width", "nodes", F.sha2(F.array_join("nodes", ""), 256).alias("node")))
        runs.append(run)
        carried = run.select("tree", F.col("run").alias("index"), (F.shiftright(F.col("width") - 1, BITS) + 1).alias("width"), "node")
    whole, top = runs[0], tops[0]
    for run, more in zip(runs[1:], tops[1:]):
        whole, top = whole.unionByName(run), top.unionByName(more)
    return whole, written(top)


def levels_above(first: int, nodes: list[str], leaves: int, merged: dict[tuple[int, int], list[str]]) -> list[tuple[int, list[str]]]:
    """Per level (index of the first node, nodes) of whole runs above consecutive leaves; ``merged`` has the runs shared with other partitions."""
    found = []
    for level in range(len(widths(leaves)) - 1):
        lo, hi = first // FANOUT, (first + len(nodes) - 1) // FANOUT
        head, tail = merged.get((level, lo)), merged.get((level, hi))
        if tail:
            nodes, first = nodes[: max(0, hi * FANOUT - first)] + tail, min(first, hi * FANOUT)
        if head and lo < hi:
            nodes, first = head + nodes[(lo + 1) * FANOUT - first :], lo * FANOUT
        found.append((first, nodes))
        nodes, first = [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)], lo
    return found


def siblings(index: int, levels: list[tuple[int, list[str]]]) -> Iterator[tuple[str, str]]:
    """(nodes before, nodes behind) of a leaf and of each of its ancestors in their runs, joined."""
    for first, nodes in levels:
        run = (index - index % FANOUT) - first
        at = index - first
        yield "".join(nodes[run:at]), "".join(nodes[at + 1 : run + FANOUT])
        index //= FANOUT


def walk(placed: DataFrame, runs: DataFrame, above: DataFrame, each, columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every indexed partition once more, beside the runs that it shares with others and the row of its tree in ``above``.

    ``each(leaves, levels, row)`` makes the columns from a table of leaves in order.
    """
    ends = placed.groupBy("tree", "part", "width").agg(F.min("index").alias("lo"), F.max("index").alias("hi"))
    levels = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(63 // BITS - 1))).alias("level")).where(f"shiftright(width - 1, {BITS} * level) > 0")
    asked = levels.select("tree", "part", "level", F.explode(F.expr(f"array_distinct(array(shiftright(lo, {BITS} * (level + 1)), shiftright(hi, {BITS} * (level + 1))))")).alias("run"))
    shared = asked.join(runs, ["tree", "level", "run"]).groupBy("tree", "part").agg(F.collect_list(F.struct("level", "run", "nodes")).alias("merged"))  # two runs a level
    context = ends.select("tree", "part").join(shared, ["tree", "part"], "left").join(above, "tree")
    context = context.select(*[F.col(c).alias(f"its_{c}") for c in context.columns])

    def prove(rows: pa.Table, contexts: pa.Table) -> pa.Table:
        rows, context = rows.sort_by("index"), contexts.to_pylist()[0]
        merged = {(m["level"], m["run"]): m["nodes"] for m in context["its_merged"] or []}
        return each(rows, levels_above(rows.column("index")[0].as_py(), rows.column("leaf").to_pylist(), rows.column("width")[0].as_py(), merged), context)

    leaves = placed.select("tree", "part", "index", "width", "leaf", *keep)
    return leaves.groupBy("tree", "part").cogroup(context.groupBy("its_tree", "its_part")).applyInArrow(prove, columns)


def ways(rows: pa.Table, levels: list, context: dict) -> pa.Table:
    """Of every subroot: its tree and, level by level, the nodes before and behind it."""
    found = [[{"before": b, "behind": a} for b, a in siblings(i, levels)] for i in rows.column("index").to_pylist()]
    kind = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))
    return pa.table({"tree": rows.column("at0"), "way": pa.array(found, kind)})


def prove(rows: pa.Table, levels: list, context: dict) -> pa.Table:
    """The proof of every leaf, folded from its tampered or own digest."""
    beyond = [(x["before"], x["behind"]) for x in context["its_way"]]
    upper = levels[1:]
    proofs, folds, last, above, rest = [], [], None, [], ""
    for index, leaf, tampered in zip(*(rows.column(c).to_pylist() for c in ("index", "leaf", "tampered"))):
        if last != index // FANOUT:
            last = index // FANOUT
            above = [*siblings(last, upper), *beyond]
            rest = "".join([x for pair in above for x in pair])
        own = list(siblings(index, levels[:1]))
        proofs.append(digest("".join([x for pair in own for x in pair]) + rest))
        node = leaf if tampered is None else tampered
        for before, behind in (*own, *above):
            node = digest(before + node + behind)
        folds.append(node)
    n = rows.num_rows
    return pa.table({"doc_id": rows.column("at0"), "leaf": rows.column("leaf"), "subroot": pa.array([context["its_subroot"]] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folds, pa.string())})


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it; null is ``-``."""
    parts = []
    for value in (doc_id, source, lang, n_chars, text):
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def document_leaves(documents: DataFrame) -> DataFrame:
    """(tree, at0, leaf, tampered): a tree per lang, ordered null first; ``tampered`` only where the check tampers."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_of(*fields, F.translate(F.col("text").cast("string"), UPPER, LOWER))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return documents.select(tree.alias("tree"), F.col("doc_id").alias("at0"), leaf_of(*fields, F.col("text")).alias("leaf"), F.when(tampers, changed).alias("tampered"))


def manifest(documents: DataFrame, size: int = LEAVES) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's leaf is the digest of its five fields.  Leaves of one lang, ordered
    by doc_id, make a tree; runs of eight become the digest of their joined
    digests until one node, the subroot, is left, and the subroots, ordered by
    lang, make the tree of the root.  proof_sha256 is the digest of all siblings
    from the leaf's run to the root's; folded_root folds them around the leaf, of
    lower-cased text where 3 divides crc32(doc_id); verified: that is the root.
    A partition holds about ``size`` leaves; the result does not depend on it.

    Null fields count as ``-`` and null langs are a tree before the empty lang.
    A null doc_id stands first and is never tampered with.  Rows that repeat a
    doc_id are ordered by their leaf.  Other columns are ignored.  An empty table
    gives an empty result.
    """
    placed = indexed(written(document_leaves(documents)), size)
    runs, tops = merge(written(in_order(placed).mapInArrow(climb, NODES)))
    forest = indexed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("at0"), F.col("subroot").alias("leaf")), size)
    joints, top = merge(written(in_order(forest).mapInArrow(climb, NODES)))
    root = top.first()  # one row, or none
    way = walk(forest, joints, top, ways, "tree string, way array<struct<before: string, behind: string>>", ("at0",))
    kind = documents.schema["doc_id"].dataType.simpleString()
    proofs = walk(placed, runs, tops.join(way, "tree"), prove, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string", ("at0", "tampered"))
    root = F.lit(root and root["subroot"]).cast("string")
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def in_order(placed: DataFrame) -> DataFrame:
    return placed.select("tree", "part", "index", "width", "leaf").sortWithinPartitions("tree", "part", "index")


def node_records(documents: DataFrame, size: int = LEAVES) -> DataFrame:
    """All nodes above the leaves: lang, level from 1, index in the level, node; a lang of one document has none.

    Nulls, repeats and empty tables are as in ``manifest``.
    """
    placed = indexed(written(document_leaves(documents)), size)
    records = written(in_order(placed).mapInArrow(lambda batches: climb(batches, True), NODES))
    runs, _ = merge(records)
    lang = F.expr("CASE WHEN tree = '' THEN NULL ELSE substring(tree, 2) END").alias("lang")
    whole = records.where("not loose").select(lang, "level", "index", "node")
    return whole.unionByName(runs.select(lang, (F.col("level") + 1).alias("level"), F.col("run").alias("index"), "node"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL: both trees by recursion over levels, proofs by recursion over ancestors."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    up = "idx // 8"
    tree = lambda name, base: f"""{name} AS (SELECT * FROM {base} UNION ALL
  SELECT tree, level + 1, {up}, (any_value(width) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM {name} WHERE width > 1 GROUP BY tree, level, {up})"""  # noqa: E731
    way = lambda name, nodes, base: f"""{name} AS (SELECT * FROM {base} UNION ALL
  SELECT p.id, p.tree, p.level + 1, p.idx // 8, (p.width + 7) // 8,
    p.proof || coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (n.idx <> p.idx), ''),
    sha256(string_agg(CASE WHEN n.idx = p.idx THEN p.fold ELSE n.node END, '' ORDER BY n.idx))
  FROM {name} p JOIN {nodes} n ON n.tree = p.tree AND n.level = p.level AND n.idx // 8 = p.idx // 8 WHERE p.width > 1 GROUP BY p.id, p.tree, p.level, p.idx, p.width, p.proof, p.fold)"""  # noqa: E731
    return rf"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM documents),
l AS (SELECT row_number() OVER () AS id, tree, doc_id, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS width,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 AND text IS NOT NULL THEN lowered ELSE leaf END AS used FROM d),
l0 AS (SELECT tree, 0 AS level, idx, width, leaf AS node FROM l),
{tree("nodes", "l0")},
s AS (SELECT tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS width FROM nodes WHERE width = 1),
s0 AS (SELECT 'f' AS tree, 0 AS level, idx, width, node FROM s),
{tree("joints", "s0")},
p0 AS (SELECT id, tree, 0 AS level, idx, width, '' AS proof, used AS fold FROM l),
{way("p", "nodes", "p0")},
q0 AS (SELECT p.id, 'f' AS tree, 0 AS level, s.idx, s.width, p.proof, p.fold FROM p JOIN s ON s.name = p.tree WHERE p.width = 1),
{way("q", "joints", "q0")}
SELECT l.doc_id, l.leaf, s.node AS subroot, j.node AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = j.node AS verified
FROM q JOIN l ON l.id = q.id JOIN s ON s.name = l.tree JOIN joints j ON j.width = 1 WHERE q.width = 1"""
