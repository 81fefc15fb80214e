"""The training-data operators against brute force, and on nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from trackloom.llm import byte_bpe, decontaminate, license_scan, maxent_lm, near_dedup, packing, substring_dedup, tool_calls, toxicity, vector_dedup
from trackloom.llm.components import components

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    rows = [(i, t, 1, "k", [1], 0.5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, words string, keys array<int>, score double")


def odd_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long, shared = text(6000), text(70)
    rows = [(1, None), (2, ""), (3, " \n "), (None, text(80)), (4, "one"), (5, "one"), (6, "same " * 300), (7, "same " * 280), (8, long), (9, long), (10, long[: len(long) // 2])]
    rows += [(20 + i, text(40) + " " + shared + " " + text(30)) for i in range(6)] + [(40, shared), (40, shared), (50, text(100)), (51, None)]
    base = text(200).split()
    for i in range(8):
        copy = list(base)
        copy[10 + 20 * i] = "changed"
        rows.append((60 + i, " ".join(copy)))
    return rows


def removed(rows, size=50):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("bits", [26, 16])  # a full sketch costs time, never a window
def test_substring_dedup(spark, bits):
    rows = odd_rows()
    got = {}
    for r in substring_dedup.substring_dedup(docs(spark, rows), width_bits=bits).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {i: sorted(v) for i, v in got.items()} == removed(rows)


def test_near_dedup(spark):
    rows = odd_rows()
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    shingles = {i: [tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))] for i, t in rows if i is not None and (w := WORD.findall(t or ""))}
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sorted(shingles), 2):
        ids = {s: n for n, s in enumerate({*shingles[a], *shingles[b]})}
        if near_dedup.similarity([ids[s] for s in shingles[a]], [ids[s] for s in shingles[b]], 0.8) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for r in got:
        assert r.group_id == (None if r.doc_id is None else find(r.doc_id)) and r.kept == (r.doc_id is None or r.group_id == r.doc_id)


def test_near_dedup_follows_drift(spark):
    rng = random.Random(11)
    words = [f"d{i}" for i in range(520)]
    rows = [(100 - i, " ".join(words[8 * i : 8 * i + 150])) for i in range(45)]  # each text resembles its neighbours only
    rng.shuffle(rows)
    assert {r.group_id for r in near_dedup.near_dedup(docs(spark, rows)).collect()} == {56}


@pytest.mark.parametrize("block", [2, 512])
def test_texts_in_different_groups_meet(spark, block):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(90)]
    rows, spots = [], []
    for i in range(40):
        words = list(base) if i % 2 else [f"c{j}" for j in range(90)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(90)] = f"x{rng.random()}"
        words = words[: rng.choice([60, 88, 90])]
        rows.append((i, " ".join(words)))
        home = i % 5 if i < 30 else i
        spots += [(bucket, i, home, len(words) - 4) for bucket in sorted({rng.randrange(3) for _ in range(2)})]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    apart = near_dedup.Apart(spark.createDataFrame(spots, "bucket long, class_id long, home long, size long"), texts, 0.8, block)
    bags = {i: (lambda w: Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4)))(t.split()) for i, t in rows}
    of = {i: (b, h, n) for b, i, h, n in spots}
    expected = {}
    for (b, i, h, n), (c, j, k, m) in itertools.combinations(spots, 2):
        most = sum((bags[i] & bags[j]).values())
        if b == c and h != k and i != j and most >= 0.8 * (n + m - most):
            expected.setdefault((min(h, k), max(h, k)), set()).add((max(i, j), min(i, j)))
    best = apart.best().collect()
    assert {(r.low, r.high) for r in best} >= set(expected) and len(best) == len({(r.low, r.high) for r in best})
    others = {(r.class_id, r.first) for r in apart.others(apart.best()).collect()}
    assert others >= {p for ps in expected.values() for p in ps} and all(of[i][1] != of[j][1] for i, j in others)


def test_cells_make_fewer_links_than_they_hold_groups(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):  # 50 texts that all resemble each other and ten that share buckets with them only
        words = [f"n{j}" for j in range(100)] if i < 50 else [f"o{i}{j}" for j in range(100)]
        words[rng.randrange(10)] = f"y{i}"
        rows.append((i, " ".join(words)))
    spots = [(bucket, i, i, 96) for i in range(60) for bucket in (1, 2, 3)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, 512):
        apart = near_dedup.Apart(spark.createDataFrame(spots, "bucket long, class_id long, home long, size long"), texts, 0.8, block)
        found = [tuple(r) for r in apart.links().collect()]
        assert {r.node: r.component for r in near_dedup.components(spark.createDataFrame(found, "a long, b long")).collect()} == dict.fromkeys(range(50), 0)
        assert all(a < 50 and b < 50 for a, b in found) and (block == 7 or len(found) == 49)


def test_short_near_copies_all_link(spark):
    rng = random.Random(21)
    rows, links = [], []
    for i in range(150):  # texts of 8 to 28 words and a copy at similarity 0.8 or just above
        n = rng.randrange(8, 29)
        words = [f"s{rng.randrange(5000)}" for _ in range(n)]
        more = [f"t{rng.randrange(5000)}" for _ in range(int((n - 4) / 0.8 + 1e-9) - (n - 4))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(more + words if i % 2 else words + more))]
    rows += [(900, "one two"), (901, "one two three"), (902, "one two")]
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, rows)).collect()}
    assert all(got[2 * i + 1].group_id == 2 * i for i in range(150))
    assert got[902].class_id == 900 and got[901].group_id == 901


def thue_morse(steps=10):
    """Two words of 1,024 letters that a polynomial hash with wrap-around cannot tell apart."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_words_that_break_polynomial_hashes(spark):
    one, other = thue_morse()
    rows = [(1, " ".join([one] * 50)), (2, " ".join([other] * 50)), (3, " ".join([one] * 50))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    assert {r.doc_id: r.group_id for r in near_dedup.near_dedup(docs(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 10 == 0)
    learnt = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 10)
    known = {r.doc_id: r.n_known for r in maxent_lm.score_texts(docs(spark, [(learnt, one), (held, other)]), rounds=1).collect()}
    assert known == {learnt: 2, held: 1}


def test_banded_lcs_is_exact():
    rng = random.Random(4)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
            row = new
        return row[-1]

    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(40))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        assert near_dedup.lcs_banded(a, b, len(a) + len(b), rng.choice([3, 7, 256])) == lcs(a, b)
        band = len(a) + len(b) - 2 * lcs(a, b)
        assert near_dedup.lcs_banded(a, b, band, 5) == lcs(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_byte_bpe(spark):
    ranks = byte_bpe.read_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_rows() + [(90, "日本語 テスト 😀 " * 30), (91, "x" * 3000), (92, "a b　 c\r\n\n  d"), (93, "<|endoftext|>")]
    got = byte_bpe.encode_documents(docs(spark, rows), PATH, P.PATTERN).collect()
    expected = Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == expected


def test_packing(spark):
    sizes = [random.Random(7).randrange(1, 65) for _ in range(300)]

    def plain(sizes, length):
        free, rows = [], []
        for s in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fit = min((c for c in free if c >= sizes[s]), default=None)
            if fit is None:
                rows.append([s]), free.append(length - sizes[s])
            else:
                at = max(i for i, c in enumerate(free) if c == fit)
                rows[at].append(s)
                free[at] -= sizes[s]
        return sorted(sum(sizes[s] for s in r) for r in rows)

    packed = packing.best_fit_decreasing(sizes, 64)
    assert sorted(s for r in packed for s in r) == list(range(300))
    assert sorted(sum(sizes[s] for s in r) for r in packed) == plain(sizes, 64)
    rows = [r for r in odd_rows() if r[0] != 40] + [(40, "tie")]
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    parts = {}
    for r in packing.pack(docs(spark, rows), PATH, P.PATTERN, length=256).collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 256 and r.cu_seqlens[-1] == r.n_ids <= 256
        for doc_id, part, lo, hi in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[(doc_id, part)] = ids[lo:hi].tolist()
            assert places[lo:hi].tolist() == list(range(hi - lo))
    for i, t in rows:
        joined = [x for part in range(sum(k[0] == i for k in parts)) for x in parts[(i, part)]]
        assert joined == [*reference.encode_ordinary(t or ""), 50256]


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["Vile", "vilest!", "hateful"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), None))
    rows += [(700, None), (701, ""), (None, "vile vile hateful"), (0, rows[0][1])]
    labels += [(0, 1, None), (1, None, None), (None, 1, None), (2, 7, None)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: t for i, t, _ in labels[:600]}
    fold = [r for r in got if r.held_out and r.doc_id in truth]
    assert fold and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in fold) / len(fold) >= 0.95
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    none = toxicity.toxicity(docs(spark, rows[:5]), marks.limit(0)).collect()
    assert len(none) == 5 and len({r.score for r in none}) == 1


def test_toxicity_finds_copies_without_a_lexicon_term(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"plain{rng.randrange(400)}" for _ in range(30))
    rows = [(i, text() + (" vile hateful" if i % 6 == 0 else "")) for i in range(600)]
    labels = [(i, int(i % 6 == 0)) for i in range(600)]
    rare = next(i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 4 != 2)  # toxic by words of its own
    rows += [(rare, "grimble snark wozzle fnord " + text()), (1000, text())]
    rows.append((1001, rows[-2][1]))
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame([*labels, (rare, 1)], "doc_id long, toxic int")).where("doc_id >= 1000").collect()}
    assert got[1001].evidence[0].doc_id == rare and got[1001].evidence[0].cosine == pytest.approx(1) and got[1001].predicted == 1
    assert got[1000].evidence and got[1000].predicted == 0


@pytest.mark.parametrize("block", [4, 64])
def test_block_max_search_is_exact(block):
    rng = np.random.default_rng(5)
    idf, rows, sizes = rng.random(90) + 0.5, [], []
    for i in range(700):  # frequent and rare terms, ties and rows of lexicon terms only
        common, rare = rng.choice(20, rng.integers(0, 4), replace=False), 20 + rng.choice(70, rng.integers(1, 4), replace=False)
        rows.append(np.sort(np.r_[common, rare]) if i % 9 else np.array([1, 4]))
        sizes.append(len(rows[-1]))
    terms = np.concatenate(rows).astype(np.int32)
    vectors = toxicity.Vectors(np.r_[0, np.cumsum(sizes)], terms, rng.integers(1, 4, len(terms)).astype(np.int32), rng.integers(1, 9, 700).astype(float))
    ids = rng.permutation(700).astype(np.int64)
    index = toxicity.BlockMaxIndex(ids, rng.integers(0, 2, 700), vectors, idf, 8, block)
    dense = np.zeros((700, 90))
    dense[np.repeat(np.arange(700), sizes), terms] = vectors.unit(idf, 8)
    dense = dense[np.argsort(ids)]  # by doc_id
    some = np.arange(0, 700, 3)
    places = np.argsort(index.ids)[ids[some]]
    for without in (None, places):
        for i, (at, cosines) in zip(ids[some], index.search(vectors.take(some), 20, without)):
            true = np.minimum(dense @ dense[i], 1)
            if without is not None:
                true[i] = 0
            best = np.lexsort((np.arange(700), -np.round(true, 9)))[:20]
            best = best[true[best] > 0]
            assert np.allclose(cosines, true[best]) and index.ids[at].tolist() == best.tolist()


def test_toxicity_against_brute_force(spark):
    """The whole query again, from its learnt parts, by all cosines."""
    rng = random.Random(31)
    rows = [(i, " ".join(f"b{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))) + (" foul" if i % 5 == 0 else "")) for i in range(150)]
    rows += [(200, rows[0][1]), (201, "word " * 30_000 + "foul"), (202, "b1 unknown"), (203, "unknown")]
    labels = [(i, int(i % 5 == 0)) for i in range(150)]
    got = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), k=7).collect()
    fold = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    split = {i: re.findall(r"[a-z0-9]+", t) for i, t in rows}
    plain = {w for i in fold for w in split[i]}
    lexicon = {"foul"} if any(e.cosine > 0 and e.label for r in got if r.doc_id == 201 for e in r.evidence) else set()
    df = Counter(w for ws in split.values() for w in set(ws) & plain)
    idf = lambda w: math.log((len(rows) + 1) / (df[w] + 1)) + 1

    def unit(ws):
        own = {w: (1 + math.log(c)) * idf(w) for w, c in Counter(ws).items() if w in plain}
        length = math.sqrt(sum(x * x for w, x in own.items() if w not in lexicon))
        own = {w: x if w in lexicon else x * math.floor(math.log2(1 + len(ws))) / length for w, x in own.items()}
        whole = math.sqrt(sum(x * x for x in own.values()))
        return {w: x / whole for w, x in own.items()}

    units = {i: unit(split[i]) for i in split}
    for r in got:
        true = {j: min(1.0, sum(x * units[j].get(w, 0) for w, x in units[r.doc_id].items())) for j in fold}
        best = sorted((j for j in fold if true[j] > 0), key=lambda j: (-round(true[j], 9), j))[:7]
        assert [e.doc_id for e in r.evidence] == best and np.allclose([e.cosine for e in r.evidence], [true[j] for j in best])


def test_language_model(spark):
    rows = odd_rows()
    got = maxent_lm.score_texts(docs(spark, rows), rounds=8, ranges=16).collect()
    tokens = [[bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode()) for w in WORD.findall(t or "")] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for (i, _), w, h in zip(rows, tokens, held))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    real = maxent_lm.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert real[0] > real[1]


@pytest.mark.parametrize("previous", [256, 1024])
def test_class_softmax_sums_to_one(previous):
    shape = maxent_lm.Shape(previous)
    weights = np.random.default_rng(1).normal(size=(shape.size, maxent_lm.CLASSES))
    assert np.allclose(np.exp(maxent_lm.log_softmax(weights, np.array([0, 5]), np.array([3, 0]), shape)).sum(axis=1), 1)
    assert maxent_lm.features(np.array([previous - 1]), np.array([maxent_lm.SKIPS - 1]), shape).max() < shape.size


def test_language_model_tables_grow():
    sizes = [maxent_lm.Shape.of(v).previous for v in (0, 1 << 29, 1 << 30, 1 << 32, 30 << 30, 100 << 40)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[1] == 256 and sizes[-1] > sizes[-2] > 256


def test_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    for i in range(1, 120):
        x[i] = x[0] + rng.normal(size=16) * 0.12  # a dense ball
    x[200] = x[201] = x[202]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(900, None, 1.0), (901, [0.0] * 16, 1.0), (902, [1.0] * 15 + [None], 1.0), (903, [float("nan")] * 16, 1.0), (904, [float("inf")] + [1.0] * 15, 1.0), (905, [], 1.0), (906, [1.0, 0.0], 1.0), (907, [2.0, 0.0], 1.0), (None, x[0].tolist(), 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node double")
    found = vector_dedup.near_vectors(df, shard=64)
    got = {r.vec_id: r for r in found.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == len(rows)
    true, hits = near.sum(), sum(min(got[i].n_links, near[i].sum()) for i in range(400))
    assert all(got[i].n_links <= near[i].sum() for i in range(400)) and hits >= 0.98 * true
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906)) and got[907].component_id == 906 and got[None].component_id is None
    assert got[201].component_id == 200 and not got[202].kept
    assert vector_dedup.audit_recall(df.where("vec_id < 400"), found) >= 0.9


def test_decontamination(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(n))
    items = [(1, text(40)), (2, text(18)), (3, "Short One."), (4, None), (5, ""), (None, text(30))]
    near = items[0][1].split()
    near[0], near[-1] = "other", "words"
    rows = [(1, text(50) + "\n" + items[0][1].upper() + ". " + text(20)), (2, text(9) + " " + " ".join(near) + " " + text(9)), (3, items[1][1]), (4, "a short, one here"), (5, text(400)), (6, None), (7, ""), (None, items[0][1]), (8, items[1][1]), (8, items[1][1])]
    half = items[0][1].split()
    rows.append((9, " ".join(half[:20]) + " " + text(20)))
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, rows), benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 3), (8, 2)}
    assert got[(1, 1)].first_word == 50 and got[(1, 1)].similarity == 1.0 and got[(1, 1)].hamming == 0
    assert 0.8 <= got[(2, 1)].similarity < 1 and got[(4, 3)].first_word == 1
    assert decontaminate.leaks(docs(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(docs(spark, rows).limit(0), benchmark).count() == 0


def test_decontamination_against_brute_force(spark):
    """All windows of all documents against all items, by exact weighted Jaccard."""
    rng = random.Random(26)
    word = lambda: f"g{rng.randrange(25)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 30)))) for i in range(12)] + [(12, "g1 g2"), (13, "g1 g2")]
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(60))]
        copy = items[rng.randrange(12)][1].split()
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        at = rng.randrange(len(words) + 1)
        rows.append((i, " ".join(words[:at] + copy + words[at:])))
    rows += [(50, "far " * 4000 + items[3][1]), (51, None), (52, "")]
    split = lambda t: re.findall(r"[a-z0-9]+", t or "")
    grams = lambda w, k: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
    sets = {i: (len(w), k := min(5, len(w)), grams(w, k)) for i, t in items for w in [split(t)]}
    held = Counter(g for _, _, s in sets.values() for g in s)
    weight = lambda g: math.log(1 + len(items) / held[g]) if g in held else math.log(1 + len(items))
    total = lambda s: sum(map(weight, s))
    expected = {}
    for d, t in rows:
        w = split(t)
        for i, (n, k, s) in sets.items():
            for p in range(max(1, len(w) - n + 1)):
                own = grams(w[p : p + n], k)
                if own & s and total(own & s) / total(own | s) >= 0.8 - 1e-9:
                    best = expected.get((d, i), (0,))
                    expected[(d, i)] = max(best, (round(total(own & s) / total(own | s), 6), -p))
    got = {(r.doc_id, r.item_id): (r.similarity, -r.first_word) for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(expected) and len(got) > 10
    assert all(abs(got[k][0] - expected[k][0]) < 2e-6 and got[k][1] == expected[k][1] for k in got)


def test_multi_index_is_complete_and_selective(spark):
    rng = np.random.default_rng(3)
    item, far = rng.integers(-(1 << 63), 1 << 63, (300, 2)), rng.integers(-(1 << 63), 1 << 63, (300, 2))
    near = item.copy()
    for row in near:  # exactly as far as the radius
        for bit in rng.choice(128, 35, replace=False):
            row[bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64))
    table = lambda x, errors: spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, s array<long>").select("i", F.explode(decontaminate.blocks(F.col("s"), errors)).alias("b"))
    items = table(item, 35 // decontaminate.BLOCKS).withColumnRenamed("i", "j")
    assert table(near, 0).join(items, "b").where("i = j").select("i").distinct().count() == 300
    assert table(far, 0).join(items, "b").select("i", "j").distinct().count() < 0.45 * 300 * 300


def test_license_scan_matches_sql(spark):
    rows = odd_rows() + [(80, "CC BY, cc-by cc.by\nAll   Rights\nReserved"), (81, "Released under the MIT-License."), (82, "GNU General Public License 3\nlicensed under the Apache license"), (83, "Kcc by K general public licenseé")]
    frame = docs(spark, rows)
    got = license_scan.scan(frame).collect()
    c = duckdb.connect()
    c.register("documents", frame.select("doc_id", "text").toPandas())
    expected = c.sql(license_scan.oracle_sql()).fetchall()
    clean = lambda rs: sorted([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rs], key=repr)
    assert clean(tuple(r) for r in got) == clean((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in expected)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "f", '{"y":1,"x":{"b":2,"a":[1,2]}}', ["b"]), (1, "b", 3, "f", '{"x":"s","w":null}', []), (1, "c", 4, "g", "nope", ["a", "missing"]), (2, "p", 0, "f", '{"x":{}}', ["q"]), (2, "q", 1, "f", None, ["p"]), (3, "r", 0, "h", "{}", None), (None, "s", 0, "f", "{}", []), (1, "b", 9, "f", "{}", [])], tool_calls.CALLS)
    results = spark.createDataFrame([(1, "a", 5, "ok"), (1, "a", 6, "again"), (1, "z", 7, None), (1, "b", 1, "early")], tool_calls.RESULTS)
    schemas = spark.createDataFrame([("f", "x", "object", True), ("f", "w", "string", True), ("g", "x", "string", False)], tool_calls.SCHEMAS)
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert {k: (r.status, r.stage, r.errors) for k, r in got.items()} == {
        (1, "a"): ("linked", 1, "extra:y,missing:w"), (1, "b"): ("linked", 0, "early_result,type:w,type:x"), (1, "c"): ("unanswered", 1, "bad_json"),
        (1, "z"): ("orphan", None, ""), (2, "p"): ("unanswered", None, "cycle,missing:w"), (2, "q"): ("unanswered", None, "bad_json,cycle"), (3, "r"): ("unanswered", 0, "unknown_tool"),
    }
    assert got[(1, "a")].json == '{"arguments":{"x":{"a":[1,2],"b":2},"y":1},"content":"ok","id":"a","name":"f"}' and got[(1, "a")].n_results == 2
    assert got[(1, "z")].json == '{"content":null,"id":"z","name":null}' and got[(1, "c")].json == '{"arguments_text":"nope","id":"c","name":"g"}'
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    linked = tool_calls.link(*tool_calls.from_conversations(talk), schemas)
    turns = {(r.conv_id, r.turn): r for r in talk.collect()}
    for r in linked.collect():
        body, said = json.loads(r.json), turns[(r.conv_id, r.turn)]
        answer = turns.get((r.conv_id, r.turn + 1))
        assert body["arguments"] == {"prompt": said.text, "turn": said.turn} and body.get("content") == (answer.text if answer and answer.role == "assistant" else None)


def test_tool_calls_against_brute_force(spark):
    rng = random.Random(17)
    rows, answers = [], []
    for conv in range(25):
        ids = [f"c{i}" for i in range(rng.randrange(1, 9))]
        for i, name in enumerate(ids):
            before = rng.sample(ids, rng.randrange(min(3, len(ids)))) + ["elsewhere"] * rng.randrange(2)
            rows.append((conv, name, 2 * i, "f", json.dumps({"x": "y" * rng.choice([1, 50_000])}), before, "clash"))
            if rng.random() < 0.8:
                answers.append((conv, name, rng.choice([2 * i + 1, 2 * i + 1, max(0, 2 * i - 1)]), "z" * rng.choice([0, 9, 50_000]), 7))
    calls = spark.createDataFrame(rows, tool_calls.CALLS + ", content string").withColumn("stage", F.lit("clash"))
    results = spark.createDataFrame(answers, tool_calls.RESULTS + ", n_results int").withColumn("tool", F.lit("clash"))
    schemas = spark.createDataFrame([("f", "x", "string", True)], tool_calls.SCHEMAS)
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert len(got) == len(rows)
    by_id = {(c, i): (t, before) for c, i, t, _, _, before, _ in rows}
    for conv in range(25):
        own = {i: (t, [b for b in before if (conv, b) in by_id]) for (c, i), (t, before) in by_id.items() if c == conv}

        def reaches(start, goal, seen=()):
            return any(b == goal or b not in seen and reaches(b, goal, (*seen, b)) for b in own[start][1])

        cyclic = {i for i in own if reaches(i, i)}
        stuck = {i for i in own if i in cyclic or any(reaches(i, c) for c in cyclic)}
        assert {i for i in own if got[(conv, i)].stage is None} == stuck
        place = {i: n for n, i in enumerate(sorted(set(own) - stuck, key=lambda i: (got[(conv, i)].stage, own[i][0], i)))}
        assert all(place[b] < place[i] for i in place for b in own[i][1])
    turn = {(c, i): t for c, i, t, _, _ in answers}
    for key, r in got.items():
        assert r.status == ("linked" if key in turn else "unanswered")
        assert ("early_result" in r.errors) == (key in turn and turn[key] < by_id[key][0]) and ("cycle" in r.errors) == (r.stage is None)


def test_empty_tables(spark):
    none = docs(spark, odd_rows()).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (substring_dedup.substring_dedup(none), near_dedup.near_dedup(none), byte_bpe.encode_documents(none, PATH, P.PATTERN), packing.pack(none, PATH, P.PATTERN), maxent_lm.score_texts(none, rounds=1), toxicity.toxicity(none, labels), license_scan.scan(none)):
        assert made.count() == 0
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    empty = lambda s: spark.createDataFrame([], s)
    assert tool_calls.link(empty(tool_calls.CALLS), empty(tool_calls.RESULTS), empty(tool_calls.SCHEMAS)).count() == 0


def unmix(x):
    """The inverse of ``words.mix``."""
    back = lambda y, s: y ^ (y >> s) ^ (y >> 2 * s) if 3 * s >= 64 else None
    x = back(x, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) % (1 << 64)
    x = back(x, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) % (1 << 64)
    return back(x, 30)


def chained(side):
    """Two words of 16 bytes that meet in the unkeyed hash of a side, by solving its last step."""
    from trackloom.llm import words as W

    full, odd, (seed, step) = 1 << 64, int(W._ODD), (int(W._SEEDS[side]), int(W._SEEDS[1 - side]))
    mix = lambda x: int(W.mix(np.array([x % full], np.uint64))[0])
    head = mix(16 * odd + seed)
    state = lambda first: mix((head ^ mix(first + seed)) * odd + step)
    one, ok = b"abcdefghijklmnop", set(range(33, 127))
    load = lambda b: int.from_bytes(b, "little")
    goal = state(load(one[:8])) ^ mix(load(one[8:]) + seed)
    rng = random.Random(side)
    while True:
        first = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        last = ((unmix(goal ^ state(load(first))) - seed) % full).to_bytes(8, "little")
        if set(last) <= ok and not any(65 <= b <= 90 for b in last):
            return one.decode(), (first + last).decode()


@pytest.mark.parametrize("side", [0, 1])
def test_words_that_solve_the_chained_hash(spark, side):
    from trackloom.llm import words as W

    one, other = chained(side)
    raw = np.frombuffer((one + other).encode(), np.uint8)
    plain = W.hash_spans(raw, np.array([0, 16]), np.array([16, 32]), side)
    assert plain[0] == plain[1] and one != other
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 10 == 0)
    learnt = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 10)
    known = {r.doc_id: r.n_known for r in maxent_lm.score_texts(docs(spark, [(learnt, one), (held, other)]), rounds=1).collect()}
    assert known == {learnt: 2, held: 1}
    rng = random.Random(side)
    rows, at = [], 1
    for _ in range(12):
        text = [f"u{rng.randrange(10**6)}" for _ in range(50)]
        place = rng.randrange(50)
        rows += [(at, " ".join([*text[:place], one, *text[place + 1 :]])), (at + 1, " ".join([*text[:place], other, *text[place + 1 :]]))]
        at += 2
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()} == {0}


def test_secret_words_are_the_words():
    import pyarrow as pa

    from trackloom.llm import words as W

    texts = ["a b a", None, "", "é  B\n" + "x" * 100, " a"]
    found = W.words_of(pa.array(texts), W.SPACED_LOWER, secret=b"k" * 16)
    words = [w.lower() if w.isascii() else w for t in texts for w in WORD.findall(t or "")]
    assert len(found.hashes) == len(words) and found.bounds.tolist() == [0, 3, 3, 3, 6, 7]
    assert len(set(zip(words, found.hashes.tolist(), found.second.tolist()))) == len(set(words)) == len(set(found.hashes.tolist()))
    assert len(W.words_of(pa.array([None, ""]), W.SPACED, secret=b"k" * 16).hashes) == 0


def test_license_scan_of_very_long_texts(spark):
    template = license_scan.TEMPLATES[1][1]
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.2 else f"x{rng.randrange(5000)}" for _ in range(n))
    dense = " ".join(rng.choice(vocabulary) for _ in range(200_000))
    rows = [(1, prose(200_000) + " " + template), (2, template + " " + prose(1000)), (3, prose(300) + "\n" + template.replace(" ", "\n") + " " + prose(700)), (4, dense), (5, prose(600))]
    found = {r.doc_id: (r.n_words, r.labels, r.score) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert found[1] == (200_000 + len(template.split()), found[1][1], 1.0) and "bsd" in found[1][1].split(",")
    assert found[2][2] == found[3][2] == 1.0 and "bsd" in found[2][1] and "bsd" in found[3][1]
    assert found[4][0] == 200_000 and found[5][2] == 0.0


def test_license_scan_across_stretches_matches_sql(spark, monkeypatch):
    vocabulary = [w for _, t in license_scan.TEMPLATES for w in t.split()]
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(license_scan.TEMPLATES)[1] if rng.random() < 0.08 else rng.choice(vocabulary) if rng.random() < 0.7 else "other" for _ in range(rng.randrange(120)))
    documents = docs(spark, [(i, text()) for i in range(60)])
    con = duckdb.connect()
    con.register("documents", documents.select("doc_id", "text").toPandas())
    expected = sorted(con.sql(license_scan.oracle_sql()).fetchall())
    assert any(r[-1] for r in expected)
    for stretch in (1, 7, 256):
        monkeypatch.setattr(license_scan, "STRETCH", stretch)
        found = license_scan.scan(documents)
        assert sorted(map(tuple, found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())) == expected


def test_words_under_a_secret():
    import pyarrow as pa

    from trackloom.llm import words as W

    words = ["a", "aa", "a\0", "\0", "\0\0", "abcdefgh", "abcdefgh\0", "abcdefgi", "é" * 30, "x" * 64, "x" * 65, "x" * 66, *[f"w{i}" for i in range(20_000)]]
    sides = {}
    for secret in (b"1" * 16, b"2" * 16):
        found = W.words_of(pa.array([" ".join(words), " ".join(reversed(words))]), W.SPACED, secret=secret)
        n = len(words)
        for side, hashes in enumerate((found.hashes, found.second)):
            assert len(set(hashes[:n].tolist())) == n and (hashes[:n] == hashes[n:][::-1]).all()
            sides[secret, side] = hashes[:n]
    assert all(not np.isin(x, y).any() for (a, x), (b, y) in itertools.combinations(sides.items(), 2))
    for x in sides.values():  # every bit is set about as often as not
        share = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
        assert abs(share - 0.5).max() < 0.03


def test_word_numbers_in_few_bytes():
    import pyarrow as pa

    for words in (3, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 1):
        ids = np.array([0, words - 1, 1, words // 2, 2], np.int64)
        packed = maxent_lm.bytes_of(ids, np.array([0, 2, 2, 5], np.int32), words)
        back, sizes = maxent_lm.numbers_of(pa.chunked_array([packed]), words)
        assert back.tolist() == ids.tolist() and sizes.tolist() == [2, 0, 3]
        assert len(packed[0].as_py()) == 2 * maxent_lm.id_bytes(words)


def written_out(texts, learn, rounds, rate=0.4):
    """(score, n_known) of every text by the model in plain loops: counts, Adagrad on a softmax over classes, a bias a word."""
    from trackloom.llm import words as W

    shape, classes = maxent_lm.Shape(), maxent_lm.CLASSES
    mix = lambda x: int(W.mix(np.array([x % (1 << 64)], np.uint64))[0])

    def class_of(word):
        raw = word.encode()
        last, before = raw[-1], raw[-2] if len(raw) > 1 else 0
        return mix(last * 257 + before) % (classes - 1)

    def bucket_of(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(W.hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]) % (shape.previous - 1)

    def tokens(text):
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return [*words, None], [*(class_of(w) for w in words), classes - 1], [bucket_of(w) for w in words]

    def history(kinds, buckets, i):
        previous = 1 + buckets[i - 1] if i else 0
        skip = 1 + kinds[i - 2] % (maxent_lm.SKIPS - 1) if i > 1 else 0
        pair = mix(previous * maxent_lm.SKIPS + skip) % shape.joint
        return [0, 1 + previous, 1 + shape.previous + skip, 1 + shape.previous + maxent_lm.SKIPS + pair]

    read = [tokens(t) for t in texts]
    seen, word_counts = Counter(), Counter()
    for (words, kinds, buckets), learns in zip(read, learn):
        if learns:
            for i, (word, kind) in enumerate(zip(words, kinds)):
                seen[tuple(history(kinds, buckets, i)), kind] += 1
                word_counts[word] += 1
    weights, squares = np.zeros((shape.size, classes)), np.full((shape.size, classes), 1e-8)
    chance = lambda rows: (lambda e: e / e.sum())(np.exp((lambda z: z - z.max())(weights[list(rows)].sum(axis=0))))
    for _ in range(rounds):
        total, mass = np.zeros_like(weights), np.zeros(shape.size)
        for rows in {r for r, _ in seen}:
            counts = np.array([seen[rows, k] for k in range(classes)], float)
            delta = counts - counts.sum() * chance(rows)
            for row in rows:
                total[row] += delta
                mass[row] += counts.sum()
        step = (total - maxent_lm.PENALTY * weights) / (mass + 20)[:, None]
        squares += step * step
        weights = weights + rate * step / np.sqrt(squares)
    in_class, kinds_of = Counter(), Counter()
    for word, n in word_counts.items():
        kind = classes - 1 if word is None else class_of(word)
        in_class[kind] += n
        kinds_of[kind] += 1
    out = []
    for words, kinds, buckets in read:
        score = sum(math.log10(chance(history(kinds, buckets, i))[k]) + math.log10((word_counts[w] + 0.1) / (in_class[k] + 0.1 * (kinds_of[k] + 1))) for i, (w, k) in enumerate(zip(words, kinds)))
        out.append((score, sum(word_counts[w] > 0 for w in words)))
    return out


def test_language_model_written_out(spark):
    rng = random.Random(11)
    words = ["the", "The", "a", "of", "Ünder", "one", "two", "x" * 70, "é", "z"]
    texts = [None, ""] + [" ".join(rng.choice(words) if rng.random() < 0.9 else f"n{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(18)]
    learn = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    assert not all(learn)
    expected = written_out(texts, learn, 6)
    found = {r.doc_id: r for r in maxent_lm.score_texts(docs(spark, list(enumerate(texts))), rounds=6).collect()}
    for i, (score, known) in enumerate(expected):
        assert found[i].score == pytest.approx(score, rel=1e-9) and found[i].n_known == known and found[i].held_out == (not learn[i])
