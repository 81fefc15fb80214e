"""Filter audit, Merkle manifest and personal data against brute force, and on nulls, empty, repeated and very long rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from trackloom.llm import filter_audit, merkle, personal

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "doc_id long, source string, lang string, n_chars long, text string, part int, leaf string, n string, tree int, mask string"


def rows_of(seed=3, n=300):
    """Documents with nulls, ties, repeats, empty and long texts, and columns whose names clash."""
    rng = random.Random(seed)
    texts = [None, "", " \n", "a#b", "ABC def", "same " * 250, "w " * 300, " ".join(f"w{i}é" for i in range(260)), "X" + " ".join(f"Wörd{i}" for i in range(400)), "long " * 50_000]
    out = []
    for i in range(n):
        text = rng.choice(texts) if rng.random() < 0.6 else " ".join(rng.choice("aa bb CC dd$ ee ff".split()) + str(rng.randrange(900)) for _ in range(rng.randrange(400)))
        out.append((rng.choice([i, i, i, i // 2, None]), rng.choice([None, "", "s1"]), rng.choice([None, "", "en", "en", "en", "dé", "z" * 3]), rng.choice([None, 5]), text, 1, "x", "y", 2, "z"))
    return out + out[:5] + [out[7]] * 30


def audited(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[4] or ""] = min(least.get(r[4] or "", r[0]), r[0])
    parts = defaultdict(list)
    for r in rows:
        text, words = r[4] or "", WORD.findall(r[4] or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": re.search("[#$%&*|]", text) is not None, "E": r[0] is not None and least[text] < r[0]}
        parts[r[2] or ""].append((r[0], {f for f in fails if fails[f]}))
    out = {}
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_filtering_in_every_order(spark):
    rows = rows_of()
    rng = random.Random(5)
    labels = [(rng.choice([rng.randrange(310), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(250)]
    found = filter_audit.audit(spark.createDataFrame(rows, FIELDS).repartition(7), spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == audited(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_nothing(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_first_failure_table():
    for mask, order in itertools.product(range(32), range(120)):
        steps = [s for s, f in enumerate(filter_audit.ORDERS[order]) if mask >> "ABCDE".index(f) & 1]
        assert filter_audit.FIRST[mask, order] == min(steps, default=5)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def proved(rows):
    """Leaf, subroot, root, proof digest, folded root and verdict of each row, by building every level as a list."""
    leaf = lambda r, text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            lo = i - i % 8
            yield nodes[lo:i], nodes[i + 1 : lo + 8]
            i //= 8

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([e[2] for e in sorted(by[x], key=lambda e: e[:3])]) for x in names}
    forest = tree([trees[x][-1][0] for x in names])
    out = []
    for x in names:
        for i, (there, _, own, r) in enumerate(sorted(by[x], key=lambda e: e[:3])):
            steps = [*way(trees[x], i), *way(forest, names.index(x))]
            tampered = there and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r[4])) if tampered else own
            for before, behind in steps:
                node = sha("".join([*before, node, *behind]))
            root = forest[-1][0]
            out.append((r[0], own, trees[x][-1][0], root, sha("".join(s for b, a in steps for s in b + a)), node, node == root))
    return sorted(out, key=repr), trees


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 15])
def test_merkle_equals_levels_as_lists(spark, size):
    rows = rows_of(8, 420)
    found = merkle.manifest(spark.createDataFrame(rows, FIELDS).repartition(5), size).collect()
    expected, _ = proved(rows)
    assert sorted(map(tuple, found), key=repr) == expected
    assert any(not r.verified for r in found) and any(r.verified for r in found)


def test_merkle_of_many_small_trees_one_leaf_and_nothing(spark):
    rows = [(i, "s", f"lang{i % 150}", 3, f"Text {i}") for i in range(200)]
    fields = FIELDS[: FIELDS.index(", part")]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, fields), 16).collect()), key=repr) == proved(rows)[0]
    one = merkle.manifest(spark.createDataFrame(rows[:1], fields)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")
    assert merkle.manifest(spark.createDataFrame([], fields)).count() == 0


def test_merkle_node_records(spark):
    rows = rows_of(9, 200)
    found = {(r.lang, r.level, r["index"]): r.node for r in merkle.node_records(spark.createDataFrame(rows, FIELDS).repartition(4), 20).collect()}
    _, trees = proved(rows)
    assert found == {(x, level, i): node for x, levels in trees.items() for level, nodes in enumerate(levels) if level for i, node in enumerate(nodes)}


NAIVE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    out = []
    for kind, pattern in NAIVE:
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)
            if kind == "card" and 13 <= len(digits) <= 19:
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                ok = sum(d // 10 + d % 10 for d in doubled) % 10 == 0
            if ok:
                out.append((kind, *m.span()))
    return out


def digest_of(spans):
    return sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(2)
    pieces = ["@", ".", "a", "bc", "-", "_", "+", "+1", " ", "  ", "(", ")", "1", "22", "255", "300", "007", "4041894974608795", "4041-8949-7460-8795", "1.2.3.4", "x@y.z", "é", "😀", "\n", "%"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", "a@b.c" * 500, "1.2.3.4." * 300]
    fields = "doc_id long, text string, spans string, n_email string"
    found = personal.find_personal(spark.createDataFrame([(i, t, "s", "e") for i, t in enumerate(texts)], fields).repartition(6)).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = plain_spans(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in personal.KINDS), texts[r.doc_id]
        assert r.base_sha256 == digest_of(spans)
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(",")) | {""}


DISGUISED = [
    ("email", "bosbt.42 [at] mail8.example.com"),
    ("email", "bosbt.42 (at) mail8 (dot) example (dot) com"),
    ("email", "bob at mail8 dot example dot com"),
    ("email", "bob AT mail8 DOT example DOT com"),
    ("email", "bosbt.42＠mail8.example.com"),
    ("email", "bоsbt.42@mаil8.example.com"),
    ("email", "bos​bt.42@mail8.example.com"),
    ("email", "bob_at_mail_dot_com"),
    ("email", "bob&#64;mail.com"),
    ("email", "bosbt.42 @ mail8 . example . com"),
    ("card", "four zero four one eight nine four nine seven four six zero eight seven nine five"),
    ("card", "Four-Zero-Four-One 8949 7460 8795"),
    ("card", "４０４１８９４９７４６０８７９５"),
    ("card", "٤٠٤١٨٩٤٩٧٤٦٠٨٧٩٥"),
    ("card", "4O41 8949 746O 8795"),
    ("card", "4041​8949​7460​8795"),
    ("card", "4041–8949–7460–8795"),
    ("phone", "plus one nine eight eight five five five two four eight five"),
    ("phone", "＋1 (988) 555-2485"),
    ("phone", "+1 (988) five double five 2485"),
    ("ip", "42[.]144[.]35[.]254"),
    ("ip", "42 dot 144 dot 35 dot 254"),
    ("ip", "four two dot one four four dot three five dot two five four"),
    ("ip", "l92.168.O.1"),
]
CLEAN = ["look at the dot product of com", "arrive at home. The dot com boom", "see them at example.com now", "one two three four five", "meet at one dot two", "Ça va à la fête — um 8 Uhr, así", "point at point com", "a​b ＡＢＣ 12", "Привет, мир", "add one plus two dash three"]
PLAIN = ["à 39.49.44.23 une fois", "un 56.219.220.54", "une, 48.173.242.112", "one 4041894974608795", "4041894974608795 two", "the 2 one 42.1.1.1 two"]


@pytest.mark.parametrize("before, behind", [("", ""), ("Write to: ", " today."), ("élan 😀 ", ", thanks"), ("x​y (", ")")])
def test_disguises_map_back_to_their_source(before, behind):
    for kind, text in DISGUISED:
        base, every = personal.spans_of(before + text + behind)
        assert (kind, len(before), len(before) + len(text)) in every, (before, text, every)
        assert set(base) <= set(every)


def test_clean_texts_are_left_alone():
    assert all(base and base == every for base, every in map(personal.spans_of, PLAIN))
    assert [personal.spans_of(t)[1] for t in CLEAN] == [[]] * len(CLEAN)


def test_rewritings_map_any_span_to_its_source():
    rng = random.Random(4)
    for _ in range(300):
        source = "".join(rng.choice("abcd") for _ in range(20))
        out, origin = personal.Rewritten(source), [(i, i + 1) for i in range(20)]
        for _ in range(3):
            edits, at, changed = [], 0, []
            while at < len(out.text):
                size = rng.randrange(1, 4)
                end = min(at + size, len(out.text))
                if rng.random() < 0.4:
                    new = "XYZW"[: rng.randrange(1, 4)]
                    if new != out.text[at:end]:
                        edits.append((at, end, new))
                        changed += [(origin[at][0], origin[end - 1][1])] * len(new)
                        at = end
                        continue
                changed += origin[at:end]
                at = end
            out.replace(edits)
            origin = changed
        for _ in range(10):
            lo = rng.randrange(len(out.text))
            hi = rng.randrange(lo + 1, len(out.text) + 1)
            assert out.source(lo, hi) == (origin[lo][0], origin[hi - 1][1])


def test_very_long_texts_take_linear_time():
    for piece in ["a", "1", "1 ", "a.", "1.1.", "@", "a@", "one ", "zero-", " at a", "a at a.a.", " dot ", "(", "O0", "|", "plus ", "+ ", "1,", "​", " "]:
        personal.spans_of(piece * (200_000 // len(piece)))


def test_personal_keeps_columns_and_empty_tables(spark):
    fields = "doc_id long, text string, lang string"
    row = personal.find_personal(spark.createDataFrame([(None, "mail x1 [at] y.org", None)], fields), keep=("lang", "text")).first()
    assert (row.doc_id, row.lang, row.spans) == (None, None, "email:5:18")
    assert personal.find_personal(spark.createDataFrame([], fields)).count() == 0
