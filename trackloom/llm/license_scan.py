"""License scan: phrases in place, and templates by an exact set-similarity join.

A text block is any run of as many words as a template of n words may be spread
over, n / ``threshold``; line ends do not matter.  It holds the template if at
least ``threshold`` of the template's distinct words stand in it.  Words are
ordered by how often they occur in all documents, rarest first.  A block that
reaches the overlap has one of the first |T| - overlap + 1 words of the template
(prefix), so only the places of such words are joined with templates; around
each there must be ``overlap`` template words (length) that do not come before
it in that order (position), and what passes is counted exactly in every block.
A place carries only the template words within reach of it, so that the work is
linear in a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hits of a text that are looked at together.
STRETCH = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (phrase, label): labels wherever the words stand one after the other.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: (label, template).
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def scan(documents: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lowered and words are runs of ASCII digits, letters and non-ASCII
    characters.  n_base counts all places of phrases, first_word and last_word
    are the smallest and largest of their first words (null without any).
    labels joins the labels of phrases and templates, distinct, sorted and
    separated by commas.  score is 1 with a phrase, else the largest share of a
    template in a block that reaches ``threshold``, else 0.

    Phrases and templates are parameters of a few rows, or of none.  Null and
    empty texts have no words and empty labels.  Repeated rows, null doc_id and
    clashing columns do no harm: rows are told apart by doc_id and a hash of the
    text.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER).alias("text"))
    split = texts.select("doc_id", F.xxhash64("text").alias("key"), "text", words_in(F.col("text")).alias("words"))
    sets = [(label, sorted(set(text.split())), math.ceil(len(text.split()) / threshold - 1e-9)) for label, text in templates]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})

    # how often the templates' words occur in all documents decides their order
    counts = dict(split.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("word")).groupBy("word").count().collect())  # a row per template word
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    plans = []
    for number, (label, ws, length) in enumerate(sets):
        ranks, need = sorted(order[w] for w in ws), max(1, math.ceil(threshold * len(ws) - 1e-9))
        plans += [(number, label, rank, len(ranks), need, length, ranks) for rank in ranks[: len(ranks) - need + 1]]
    prefix = sorted({w for w in vocabulary for p in plans if order[w] == p[2]})

    def places(phrase: str) -> Column:
        first, *rest = phrase.split()
        here = lambda w, i: F.when(sum(((F.get("words", i + k + 1) == r).cast("int") for k, r in enumerate(rest)), (w == first).cast("int")) == len(rest) + 1, i)
        likely = F.lit(True)
        for word in (first, *rest):
            likely = likely & F.col("text").contains(word)
        return F.when(likely, F.filter(F.transform("words", here), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))

    # places and ranks of template words, in texts with one of a prefix
    hits = F.array().cast("array<struct<at: int, rank: int>>")
    if vocabulary:
        number_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
        ranked = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), F.when(w.isin(vocabulary), number_of[w]).alias("rank"))), lambda h: h["rank"].isNotNull())
        hits = F.when(F.exists("words", lambda w: w.isin(prefix)), ranked).otherwise(hits)
    digests = written(split.select("doc_id", "key", F.size("words").alias("n_words"), *[places(p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)], hits.alias("hits")))

    plan = spark.createDataFrame(plans, "template int, label string, rank int, size int, need int, length int, of array<int>")
    # long texts are cut into stretches of hits that overlap by the longest block; each place in a prefix keeps only the hits near it
    reach = max([length for _, _, length in sets], default=1) - 1
    lead = lambda j: F.least(F.lit(reach), j * STRETCH)
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / STRETCH).cast("int")), lambda j: F.struct(lead(j).alias("lead"), F.slice("hits", j * STRETCH - lead(j) + 1, lead(j) + STRETCH + reach).alias("part")))
    cut = digests.where(F.size("hits") > 0).select("doc_id", "key", F.explode(stretches).alias("s")).select("doc_id", "key", F.col("s.lead").alias("lead"), F.col("s.part").alias("part"))
    low = [i for i, w in enumerate(sorted(order, key=order.get)) if w in prefix]
    own = lambda h, i: (i >= F.col("lead")) & (i < F.col("lead") + STRETCH) & h["rank"].isin(low)
    placed = F.transform("part", lambda h, i: F.when(own(h, i), F.struct(h["at"].alias("at"), h["rank"].alias("rank"), F.slice("part", F.greatest(i - reach + 1, F.lit(1)), 2 * reach + 1).alias("hits"))))
    found = cut.select("doc_id", "key", F.explode(F.array_compact(placed)).alias("hit")).select("doc_id", "key", F.col("hit.hits").alias("hits"), F.col("hit.at").alias("at"), F.col("hit.rank").alias("rank"))
    around = F.filter("hits", lambda h: (h["at"] > F.col("at") - F.col("length")) & (h["at"] < F.col("at") + F.col("length")) & (h["rank"] >= F.col("rank")) & F.array_contains("of", h["rank"]))
    near = found.join(F.broadcast(plan), "rank").select("doc_id", "key", "label", "at", "size", "need", "length", around.alias("around")).where(F.size(F.array_distinct("around.rank")) >= F.col("need"))
    inside = lambda start: F.size(F.array_distinct(F.transform(F.filter("around", lambda h: (h["at"] >= start["at"]) & (h["at"] < start["at"] + F.col("length"))), lambda h: h["rank"])))
    overlap = F.array_max(F.transform(F.filter("around", lambda h: h["at"] <= F.col("at")), inside))
    held = near.withColumn("overlap", overlap).where("overlap >= need").groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("share"))

    joined = digests.alias("d").join(held.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.key = h.key"), "left").select("d.*", "h.more", "h.share")
    starts = F.concat(F.array().cast("array<int>"), *[F.col(f"p{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle_sql(phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same rows by plain containment in DuckDB SQL."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrase_rows = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in phrases)
    template_rows = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {math.ceil(len(t.split()) / threshold - 1e-9)})" for label, t in templates)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{pattern}') AS ws FROM d),
p(label, pw) AS (VALUES {phrase_rows}),
m(label, tw, n) AS (VALUES {template_rows}),
places AS (SELECT r, label, i FROM (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM w) x, p WHERE ws[i + 1 : i + len(pw)] = pw),
b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi FROM places GROUP BY r),
blocks AS (SELECT r, label, tw, ws[i : i + n - 1] AS bw FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) x, m WHERE list_contains(tw, ws[i])),
held AS (SELECT r, label, max(len(list_intersect(bw, tw)) / len(tw)::DOUBLE) AS share FROM blocks WHERE len(list_intersect(bw, tw)) >= ceil({threshold} * len(tw) - 1e-9) GROUP BY r, label),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT r, label FROM places) x GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT r, label FROM places UNION SELECT r, label FROM held) x GROUP BY r),
sh AS (SELECT r, max(share) AS s FROM held GROUP BY r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(sh.s, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sh USING (r)"""
