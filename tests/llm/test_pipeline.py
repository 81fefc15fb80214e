"""The pipeline's stages, each judged on its own input: on the smallest tables, and on odd rows against brute force."""

import hashlib
import itertools
import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import odd_rows, removed

from trackloom.llm import byte_bpe

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, words array<string>, n_words long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert before > kept["toxicity"] > kept["near_dedup"] == kept["substring_dedup"] >= kept["decontamination"] == kept["byte_bpe"] > 0.6 * before
    run = corpus_pipeline.run(spark, SF)
    assert sorted(run.collect()) == sorted(docs.collect())


@pytest.fixture
def odd(spark):
    """Null, empty, repeated and very long rows, with columns whose names clash with those inside the operators."""
    rows = odd_rows()
    return rows, spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "k", ["w"], 1) for i, t in rows], SCHEMA)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_stage(spark, odd):
    rows, docs = odd
    kept = STAGES["near_dedup"](spark, docs, SF)
    split = {i: t.split() for i, t in rows if i is not None and (t or "").split()}
    shingles = {i: {tuple(w[p : p + 5]) + (n,) for p, n in zip(range(max(1, len(w) - 4)), itertools.count())} if len(set(w)) == 1 else {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, w in split.items()}
    group = {i: i for i in split}
    for a, b in itertools.combinations(sorted(split), 2):  # no shingle of these rows occurs twice, or all are equal
        x, y = shingles[a], shingles[b]
        if len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    assert texts(kept) == sorted(((i, t) for i, t in rows if group.get(i, i) == i), key=repr)
    assert kept.columns == docs.columns


def test_repeats_stage(spark, odd):
    rows, docs = odd
    cut = STAGES["substring_dedup"](spark, docs, SF)
    assert cut.columns == docs.columns and cut.where("n_chars <> length(text)").count() == 0
    gone = {i: sorted(x[2] for x in v) for i, v in removed(rows).items()}
    got = {}
    for i, t in texts(cut):
        got.setdefault(i, []).append(hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest())
    assert {i: sorted(v) for i, v in got.items()} == gone
    assert STAGES["substring_dedup"](spark, docs.drop("n_chars"), SF).columns == docs.drop("n_chars").columns


def test_toxicity_and_leaks_stages(spark, odd):
    rows, docs = odd
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    more = [(1000, "before. " + benchmark.text + " and after"), (1001, benchmark.text), (1001, benchmark.text)]
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t), 0.5, "k", ["w"], 1) for i, t in more], SCHEMA))
    assert texts(STAGES["decontamination"](spark, both, SF)) == texts(docs)
    unlabelled = docs.withColumn("doc_id", F.col("doc_id") + 10**9)  # no examples: every score is the prior
    scored = STAGES["toxicity"](spark, unlabelled, SF)
    assert scored.columns == docs.columns and texts(scored) == texts(unlabelled)


def test_encoding_stage(spark, odd):
    rows, docs = odd
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = sorted((str(i), hashlib.sha256(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in STAGES["byte_bpe"](spark, docs, SF).collect()) == expected


def test_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd[1].limit(0), SF).count() == 0
