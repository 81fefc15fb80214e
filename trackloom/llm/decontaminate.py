"""Benchmark decontamination by SimHash of item-sized windows.

Documents are cut into overlapping windows of as many words as a benchmark item
has.  Only windows that can reach the threshold are built: they must share
enough of the item's shingles, which one broadcast-sized join finds.  A
window's fingerprint of 128 bits is compared with the items of its size through
a multi-index: twelve blocks of bits, of which two fingerprints within the
radius differ in at most ``radius`` / 12 bits in one at least; items stand under
all values that close to theirs.  Candidates are verified by weighted Jaccard of
five-word shingles, weighted by how few items hold a shingle.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_scan import LOWER, UPPER, words_in
from .scratch import written

SHINGLE = 5
#: Up to so many item shingles are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(words: Column, k: Column | int) -> Column:
    """Hashes of every run of ``k`` words (fewer words: none)."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.slice(words, i + 1, k)))
    return F.when(F.size(words) >= k, hashed).otherwise(F.array().cast("array<long>"))


def shingles_of_five(words: Column) -> Column:
    """The same for five words, without copying them."""
    at = lambda i: F.xxhash64(F.array(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), at)).otherwise(F.array().cast("array<long>"))


#: Blocks of a fingerprint, half of them in each of its two longs.
BLOCKS = 12


def fingerprint(weighted: Column) -> Column:
    """SimHash of an array of (h, w): two longs."""

    def half(hash_of) -> Column:
        bit = lambda b: F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + F.when(F.getbit(hash_of(x["h"]), b) == 1, x["w"]).otherwise(-x["w"])) >= 0
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    return F.array(half(lambda h: h), half(lambda h: F.xxhash64(h)))


def blocks(simhash: Column, errors: int = 0) -> Column:
    """(block, value) of a fingerprint's blocks, and of all values that differ in at most ``errors`` bits from theirs."""

    def near(block: int) -> Column:
        lo, hi = (64 * (block % (BLOCKS // 2) + i) // (BLOCKS // 2) for i in (0, 1))
        masks = [sum(1 << bit for bit in bits) for n in range(errors + 1) for bits in itertools.combinations(range(hi - lo), n)]
        value = F.shiftrightunsigned(simhash[block // (BLOCKS // 2)], lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        return F.transform(F.lit(masks).cast("array<long>"), lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[near(block) for block in range(BLOCKS)])


def distance(one: Column, other: Column) -> Column:
    return F.bit_count(one[0].bitwiseXOR(other[0])) + F.bit_count(one[1].bitwiseXOR(other[1]))


def total(weighted: Column) -> Column:
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x["w"])


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 35) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, first_word, similarity, hamming.

    One row per document and item with a window of the item's number of words
    (the whole text if that is shorter) whose shingle similarity is at least
    ``threshold`` and whose fingerprint is within ``radius`` of 128 bits (at 0.8
    some 19 differ, and more than 35 with probability below 1e-4); the most similar
    window, the first of equals.  A-Z are lowered and only words count.

    Items of fewer than five words are one shingle.  Null and empty texts and
    items match nothing, rows without doc_id or item_id are left out, repeated
    rows give one row, and other columns are ignored.
    """
    normal = lambda c: words_in(F.translate(F.col(c).cast("string"), UPPER, LOWER))
    items = benchmark.where("item_id is not null").select("item_id", normal("text").alias("words")).where(F.size("words") > 0).distinct()
    items = items.select("item_id", F.size("words").alias("n_words"), F.least(F.lit(SHINGLE), F.size("words")).alias("k"), "words").withColumn("shingles", shingles(F.col("words"), F.col("k"))).drop("words")
    items = written(items)
    n_items = items.count()
    weights = items.select("item_id", F.explode(F.array_distinct("shingles")).alias("h")).groupBy("h").agg(F.log(1 + F.lit(float(max(1, n_items))) / F.count("*")).alias("w"))
    unknown = F.log(F.lit(1.0 + n_items))
    weighed = items.select("item_id", "n_words", "k", F.size("shingles").alias("n_shingles"), F.explode(F.array_distinct("shingles")).alias("h")).join(weights, "h")
    weighed = written(weighed.groupBy("item_id", "n_words", "k", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("item")).withColumn("simhash", fingerprint(F.col("item"))))
    # the fewest distinct shingles whose weights can make the threshold: S >= threshold * W(item)
    falling = F.reverse(F.array_sort(F.transform("item", lambda x: x["w"])))
    need = F.size(F.filter(F.transform(falling, lambda _, i: F.aggregate(F.slice(falling, 1, i), F.lit(0.0), lambda acc, w: acc + w)), lambda s: s < threshold * total(F.col("item")) - 1e-9))
    plans = written(weighed.withColumn("need", F.greatest(F.lit(1), need)))
    keys = written(plans.select("item_id", "k", F.explode("item.h").alias("h")))
    n_keys, widths = keys.count(), [r.k for r in keys.select("k").distinct().collect()]  # one to five
    small = F.broadcast if n_keys <= BROADCAST_ROWS else lambda df: df

    texts = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), normal("text").alias("words"))
    hits = None
    for k in widths:
        rows = texts.select("doc_id", "key", F.posexplode(shingles_of_five(F.col("words")) if k == SHINGLE else shingles(F.col("words"), k)).alias("p", "h"))
        part = rows.join(small(keys.where(F.col("k") == k)), "h").select("doc_id", "key", "item_id", "p", "h")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("first_word"), F.lit(0.0).alias("similarity"), F.lit(0).alias("hamming")).limit(0)
    pairs = hits.groupBy("doc_id", "key", "item_id").agg(F.sort_array(F.collect_set("p")).alias("ps"), F.size(F.collect_set("h")).alias("n"))
    pairs = pairs.join(small(plans.select("item_id", "n_words", "k", "n_shingles", "need")), "item_id").where("n >= need")
    # windows that hold at least ``need`` hits
    runs = F.transform(F.sequence(F.lit(0), F.size("ps") - F.col("need")), lambda i: F.struct(F.greatest(F.lit(0), F.get("ps", i + F.col("need") - 1) - F.col("n_shingles") + 1).alias("lo"), F.get("ps", i).alias("hi")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"]))))
    wanted = written(pairs.select("doc_id", "key", "n_words", "k", F.explode(starts).alias("start")).distinct().groupBy("doc_id", "key", "n_words", "k").agg(F.sort_array(F.collect_set("start")).alias("starts")))
    # windows stay within the text: a later start is moved back to the last whole window
    last = F.greatest(F.lit(0), F.size("words") - F.col("n_words"))
    cut = wanted.join(texts, ["doc_id", "key"]).select("doc_id", "key", "n_words", "k", F.explode(F.array_distinct(F.transform("starts", lambda s: F.least(s, last)))).alias("start"), "words")
    cut = cut.select("doc_id", "key", "n_words", "start", F.array_distinct(shingles(F.slice("words", F.col("start") + 1, F.col("n_words")), F.col("k"))).alias("hs")).distinct()
    windows = cut.select("doc_id", "key", "n_words", "start", F.explode("hs").alias("h")).join(small(weights), "h", "left").groupBy("doc_id", "key", "n_words", "start").agg(F.sort_array(F.collect_list(F.struct("h", F.coalesce("w", unknown).alias("w")))).alias("window"))
    windows = written(windows.withColumn("simhash", fingerprint(F.col("window"))))

    left = windows.select("*", F.explode(blocks(F.col("simhash"))).alias("b")).select("*", "b.block", "b.value").drop("b")
    right = plans.select("item_id", "n_words", F.explode(blocks(F.col("simhash"), radius // BLOCKS)).alias("b")).select("*", "b.block", "b.value").drop("b")
    keys = right.select("n_words", "block", "value", "item_id")
    hamming = distance(F.col("simhash"), F.col("item_simhash"))
    near = left.select("doc_id", "key", "n_words", "start", "simhash", "block", "value").join(keys, ["n_words", "block", "value"]).join(small(plans.select("item_id", F.col("simhash").alias("item_simhash"))), "item_id").where(hamming <= radius)
    near = near.select("doc_id", "key", "n_words", "start", "item_id", hamming.alias("hamming"))
    near = near.distinct().join(windows.drop("simhash"), ["doc_id", "key", "n_words", "start"]).join(small(plans.select("item_id", "item")), "item_id")
    shared = F.aggregate(F.filter("item", lambda x: F.array_contains("window.h", x["h"])), F.lit(0.0), lambda acc, x: acc + x["w"])
    scored = near.select("doc_id", "item_id", "start", "hamming", (shared / (total(F.col("item")) + total(F.col("window")) - shared)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("first_word"), F.round("best.similarity", 6).alias("similarity"), "best.hamming")
