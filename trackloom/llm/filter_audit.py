"""Filter interaction audit: what each of five filters removes under every order of applying them.

A document's failures are a mask of five bits.  ``FIRST`` holds, for each of
the 32 masks and 120 orders, the step at which such a document is removed; a
task looks its rows up in it and counts removals by part, order, step and label
with ``np.bincount``, and the tasks' arrays are summed.  Masks need each text
only once: equal texts meet as digests with counts, so a text that a third of
all rows share is a handful of rows before it is shuffled to one place.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: (order, step) -> number of the filter applied there.
APPLIED = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: (mask, order) -> step from 0 at which the first failing filter stands, ``STEPS`` if none fails.
FIRST = np.array([[next((s for s, f in enumerate(row) if mask >> f & 1), STEPS) for row in APPLIED] for mask in range(1 << STEPS)])
#: Rows looked up together, and parts whose arrays a task holds before it hands them on.
ROWS, PARTS = 1 << 14, 256
COUNTS = ["n", "removed", "fails", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D, which judge a text by itself."""
    words = F.array_remove(F.split(text, SPACES), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failing = [n_words < 200, 100 * distinct < 50 * n_words, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failing)), F.lit(0))


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by text, part and label, with all five failures in ``mask``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_failures(text).alias("own"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    same = ["digest", "part", "own", "good", "toxic"]
    rows = read.join(marked, "id", "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    # by id first: that is how the join left the rows, and no text is a hot key
    by_id = rows.groupBy(*same, "id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    lowest = F.min("least.id").over(Window.partitionBy("digest"))
    firsts = F.col("without_id") + F.when(F.col("least.id") == lowest, F.col("least.n")).otherwise(0)
    split = groups.withColumn("firsts", firsts)
    halves = F.array(F.struct(F.col("own").alias("mask"), F.col("firsts").alias("n")), F.struct(F.col("own").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(halves).alias("h")).select("part", F.col("h.mask").cast("int").alias("mask"), "good", "toxic", F.col("h.n").alias("n")).where("n > 0")


def tally(batches):
    """Sums of ``COUNTS`` by part and (order, step), one row a cell for all rows of a task."""
    cells = len(ORDERS) * STEPS
    at = np.arange(len(ORDERS)) * (STEPS + 1)
    held: dict[str, np.ndarray] = {}

    def hand_on():
        for part, sums in held.items():
            cell = np.arange(cells)
            columns = [pa.array([part] * cells), pa.array(cell // STEPS, pa.int32()), pa.array(cell % STEPS, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x.reshape(-1)) for x in sums], ["part", "order", "step", *COUNTS])
        held.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            some = batch.slice(lo, ROWS)
            coded = some.column("part").dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            mask, n = some.column("mask").to_numpy(), some.column("n").to_numpy()
            place = (codes[:, None] * (at[-1] + STEPS + 1) + at + FIRST[mask]).ravel()
            failing = mask[:, None] >> np.arange(STEPS) & 1
            alone = failing * (np.bitwise_count(mask)[:, None] == 1)

            def removals(weights):
                # weights are whole numbers below 2 ** 53, so that their sums in doubles are exact
                sums = np.bincount(place, np.repeat(weights, len(ORDERS)), len(names) * (at[-1] + STEPS + 1))
                return sums.reshape(len(names), len(ORDERS), STEPS + 1)[:, :, :STEPS].astype(np.int64)

            def by_filter(flags):
                sums = np.stack([np.bincount(codes, n * flags[:, f], len(names)) for f in range(STEPS)], 1).astype(np.int64)
                return sums[:, APPLIED]

            everything = by_filter(np.ones_like(failing))
            found = [everything, removals(n), by_filter(failing), by_filter(alone), removals(n * some.column("good").to_numpy()), removals(n * some.column("toxic").to_numpy())]
            for i, part in enumerate(names):
                sums = held.setdefault(part, np.zeros((len(COUNTS), len(ORDERS), STEPS), np.int64))
                for k, x in enumerate(found):
                    sums[k] += x[i]
            if len(held) > PARTS:
                yield from hand_on()
    yield from hand_on()


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang; null counts as empty), filter_order and step from 1: the counts of documents there.

    Filters fail a text with A: under 200 words, B: fewer distinct words than
    half, C: more than 3 % of A-Z among its code points, D: any of ``#$%&*|``,
    E: the text of any smaller doc_id.  kept: left after this step; removed:
    failing here first; redundant: failing this filter, but gone; unique_fails:
    failing no other; good_lost and toxic_lost: removed here with quality or
    toxic 1; shapley: what the filter removes summed over all orders.

    Null texts are empty and have no words (they fail A only, and E beside other
    empty ones).  Rows without doc_id are never E and make none; rows that repeat
    a doc_id are counted each, and are no copies of each other.  A doc_id with
    several labels is good or toxic if any row says so; labels without doc_id and
    other columns are ignored.  Without documents there are no parts.
    """
    fields = "part string, order int, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    partial = masks(documents, labels).mapInArrow(tally, fields)
    cells = written(partial.groupBy("part", "order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS]))  # 600 rows a part
    orders = F.element_at(F.lit(ORDERS), F.col("order") + 1)
    earlier = Window.partitionBy("part", "order").orderBy("step")
    named = cells.select("part", orders.alias("filter_order"), F.col("step").alias("at"), F.substring(orders, F.col("step") + 1, F.lit(1)).alias("filter"), *COUNTS, (F.col("n") - F.sum("removed").over(earlier)).alias("kept"))
    return named.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        "kept",
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def oracle_sql() -> str:
    """The same rows in DuckDB SQL, removal by removal."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
d AS (SELECT doc_id, part, [f.x FOR f IN [{'x': 'A', 'y': len(ws) < 200}, {'x': 'B', 'y': 100 * len(list_distinct(ws)) < 50 * len(ws)},
    {'x': 'C', 'y': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text)},
    {'x': 'D', 'y': regexp_matches(text, '[#$%&*|]')}, {'x': 'E', 'y': coalesce(low < doc_id, false)}] IF f.y] AS failing FROM w),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, failing, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM f a, f b, f c, f e, f g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, string_split(substr(filter_order, 1, step - 1), '') AS gone FROM o, (SELECT unnest(range(1, 6)) AS step) r),
c AS (SELECT part, filter_order, step, x, sum(n) AS total,
    sum(CASE WHEN list_contains(failing, x) AND NOT list_has_any(failing, gone) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(failing, x) AND list_has_any(failing, gone) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing = [x] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(failing, x) AND NOT list_has_any(failing, gone) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(failing, x) AND NOT list_has_any(failing, gone) THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c"""
