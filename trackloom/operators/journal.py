"""A journal of edits: what every version changed, the table as of any version, and undo.

Any edit is a function from one table to the next; its journal rows say, for
each key that it touched, the row before (``was``) and after (``now``), NULL
where there was or is none.  The table as of a version is the first table with
each key's last change up to then put over it, so keys that no edit touched are
never moved when a journal is small.

Where all edits look at one row at a time (``edits.RowEdit``), each row is
followed through them in one pass over the base: it tells which key it left and
which it came to, and only rows of one key meet.  No edit changes the keys that
it does not set, so a base that is dealt by one of those is not shuffled again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import RowEdit
from .scratch import written


def differ() -> Column:
    return ~F.col("was").eqNullSafe(F.col("now"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], version: int, operation: str) -> DataFrame:
    """(version, operation, keys, was, now) of the rows in which two tables with unique, non-null keys differ.

    Both have the same columns; rows that are equal, nulls included, are left out.
    """
    values = [c for c in before.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = side(before, "was").join(side(after, "now"), keys, "full")
    return both.where(differ()).select(F.lit(version).alias("version"), F.lit(operation).alias("operation"), *keys, "was", "now")


def last_changes(journal: DataFrame, keys: list[str], version: int | None) -> DataFrame:
    """Each key's last change up to ``version``: keys, at, now."""
    upto = journal if version is None else journal.where(F.col("version") <= version)
    last = upto.groupBy(*keys).agg(F.max(F.struct("version", F.col("now").isNotNull().alias("there"), "now")).alias("l"))
    return last.select(*keys, F.col("l.version").alias("at"), F.when(F.col("l.there"), F.col("l.now")).alias("now"))


def as_of(base: DataFrame, journal: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """The table after edits 1 to ``version`` (all of them without one) of ``base``; version 0 is the base."""
    last = last_changes(journal, keys, version)
    kept = base.join(last.select(keys), keys, "left_anti")
    now = last.where("now IS NOT NULL").select(*keys, "now.*")
    return kept.unionByName(now.select(base.columns))


def undo(journal: DataFrame, keys: list[str], version: int, next_version: int) -> DataFrame:
    """Journal rows that take back edit ``version`` where no later edit touched the same key (see ``conflicts``)."""
    last = last_changes(journal, keys, None).select(*keys, "at")
    mine = journal.where(F.col("version") == version).join(last, keys).where(F.col("at") == version)
    return mine.select(F.lit(next_version).alias("version"), F.concat(F.lit("undo "), "operation").alias("operation"), *keys, F.col("now").alias("was"), F.col("was").alias("now"))


def conflicts(journal: DataFrame, keys: list[str], version: int) -> DataFrame:
    """Keys of edit ``version`` that later edits touched, with the last of those."""
    last = last_changes(journal, keys, None).select(*keys, "at")
    return journal.where(F.col("version") == version).join(last, keys).where(F.col("at") > version).select(*keys, F.col("at").alias("by"))


def edited(base: DataFrame, keys: list[str], edits: list[tuple[str, object]]) -> DataFrame:
    """The journal of applying ``edits`` (operation, function of the table) one after the other.

    ``base`` is read once for every edit and has to give the same values each
    time: one that is computed, means say, which depend on the order in which
    their rows arrive, is to be ``settled`` first.  Edits that are all of single
    rows read it once.
    """
    if all(isinstance(function, RowEdit) for _, function in edits):
        steps = followed(base, keys, edits, False).groupBy("version", "operation", *keys)
        return steps.agg(F.max("was").alias("was"), F.max("now").alias("now")).where(differ())
    table, parts = base, []
    for version, (operation, function) in enumerate(edits, 1):
        after = function(table).select(base.columns)
        parts.append(changes(table, after, keys, version, operation))
        table = after
    return reduce(DataFrame.unionByName, parts)


def followed(base: DataFrame, keys: list[str], edits: list[tuple[str, RowEdit]], first: bool) -> DataFrame:
    """(keys, version, operation, was, now): the key that a row was at and the one that it is at, for every edit that changed it.

    A row that stays at its key has both sides in one; ``first`` adds the rows of
    the base as version 0.
    """
    names, kinds = base.columns, {c: base.schema[c].dataType for c in base.columns}
    values = [c for c in names if c not in keys]
    fixed = [k for k in keys if all(k not in edit.sets for _, edit in edits)]
    moving = [k for k in keys if k not in fixed]
    rows = lambda v: [F.col(f"_{v}_{c}") for c in (*moving, *values)]
    state = base.select(*names, F.lit(True).alias("_there_0"), *[F.col(c).alias(f"_0_{c}") for c in (*moving, *values)])
    for v, (_, edit) in enumerate(edits, 1):
        past = state.columns[len(names) :]
        stays = F.lit(True) if edit.stays is None else F.coalesce(edit.stays, F.lit(False))
        now = state.select(*[edit.sets.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in names], *past, (F.col(f"_there_{v - 1}") & stays).alias(f"_there_{v}"))
        state = now.select("*", *[F.col(c).alias(f"_{v}_{c}") for c in (*moving, *values)])

    kept = lambda v: F.struct(*[F.col(f"_{v}_{c}").alias(c) for c in values])
    none = F.lit(None).cast(base.select(F.struct(*values).alias("r")).schema["r"].dataType)

    def entry(v: int, at: int, was: Column, now: Column) -> Column:
        return F.struct(F.lit(v).alias("version"), F.lit(edits[v - 1][0] if v else "").alias("operation"), *[F.col(f"_{at}_{k}").alias(k) for k in moving], was.alias("was"), now.alias("now"))

    found = [entry(0, 0, none, kept(0))] if first else []
    for v in range(1, len(edits) + 1):
        before, there = F.col(f"_there_{v - 1}"), F.col(f"_there_{v}")
        same = lambda some: reduce(Column.__and__, [F.col(f"_{v - 1}_{c}").eqNullSafe(F.col(f"_{v}_{c}")) for c in some], F.lit(True))  # noqa: B023, E731
        found.append(F.when(before & ~(there & same([*moving, *values])), entry(v, v - 1, kept(v - 1), F.when(there & same(moving), kept(v)))))
        if moving:
            found.append(F.when(there & ~same(moving), entry(v, v, none, kept(v))))
    each = state.select(*fixed, F.explode(F.array(*found)).alias("e")).where("e IS NOT NULL")
    return each.select(*fixed, "e.*")


def versions(base: DataFrame, keys: list[str], edits: list[tuple[str, RowEdit]]) -> DataFrame:
    """A row a key: what every version made of it, in one pass over ``base``.

    ``at_3`` says whether version 3 left a row there, NULL if it did not change
    the key, and ``u_3`` what column u became.  Values are such that max() takes.
    """
    values = [c for c in base.columns if c not in keys]
    steps = followed(base, keys, edits, True).select(*keys, "version", F.col("now").isNotNull().alias("there"), "now.*")
    mine = lambda c, v: F.max(F.when(F.col("version") == v, F.col(c)))
    book = steps.groupBy(*keys).agg(*[mine(c, v).alias(f"{n}_{v}") for v in range(len(edits) + 1) for c, n in (("there", "at"), *zip(values, values))])
    for v in range(1, len(edits) + 1):  # equal rows that changed places changed nothing
        then = state_at(book, values, v - 1)
        same = F.coalesce(F.col(f"at_{v}") == then["there"], ~F.col(f"at_{v}")) & reduce(Column.__and__, [F.col(f"{c}_{v}").eqNullSafe(then[c]) for c in values], F.lit(True))
        book = book.withColumn(f"at_{v}", F.when(~same, F.col(f"at_{v}")))
    return book


def state_at(book: DataFrame, values: list[str], version: int) -> Column:
    """(there, values) of a key as of ``version``."""
    known = [F.when(F.col(f"at_{v}").isNotNull(), F.struct(F.col(f"at_{v}").alias("there"), *[F.col(f"{c}_{v}").alias(c) for c in values])) for v in range(version, -1, -1)]
    return F.coalesce(*known)


def taken_back(book: DataFrame, values: list[str], version: int, next_version: int) -> DataFrame:
    """``versions`` with an edit more, ``next_version``, the last one: takes back ``version`` where no later edit changed the key."""
    mine = reduce(Column.__and__, [F.col(f"at_{v}").isNull() for v in range(version + 1, next_version)], F.col(f"at_{version}").isNotNull())
    then = state_at(book, values, version - 1)
    return book.withColumns({f"at_{next_version}": F.when(mine, F.coalesce(then["there"], F.lit(False)))} | {f"{c}_{next_version}": F.when(mine, then[c]) for c in values})


def every_version(book: DataFrame, keys: list[str], values: list[str], last: int) -> DataFrame:
    """(version, keys, values): the tables as of versions 0 to ``last`` below each other."""
    states = F.array(*[F.struct(F.lit(v).alias("version"), state_at(book, values, v).alias("s")) for v in range(last + 1)])
    return book.select(*keys, F.explode(states).alias("e")).where("e.s.there").select("e.version", *keys, *[F.col(f"e.s.{c}").alias(c) for c in values])


def settled(table: DataFrame) -> DataFrame:
    """A journal or the table under it written into the session's checkpoint folder, so that it is read and not made again."""
    return written(table)


def folded(base: DataFrame, journal: DataFrame, keys: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """(base, journal) that begin at ``version``: older ones can no longer be asked for."""
    return as_of(base, journal, keys, version), journal.where(F.col("version") > version)


def history(journal: DataFrame) -> DataFrame:
    """Rows set, changed and removed by every version."""
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).alias
    was, now = F.col("was").isNotNull(), F.col("now").isNotNull()
    return journal.groupBy("version", "operation").agg(count(~was & now)("added"), count(was & now)("changed"), count(was & ~now)("removed"))
