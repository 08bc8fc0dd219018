"""Top-k search, hard negatives and the filter audit against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import filter_audit, hard_negatives, topk_search, vectors
from tests.llm.helpers import corpus, empty, frame

SCHEMA = "vec_id long, embedding array<float>, label int, score string, part string, rank string"


def table(n=400, dim=6, seed=1, near=False):
    """Rows with copies, ties, NULLs, bad components, other lengths and repeated rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = centres[i % 8] if near else [0.0] * dim
        rows.append((i, [c[k] + rng.gauss(0, 0.15 if near else 1) for k in range(dim)], rng.randrange(4)))
    rows += [(1000 + i, rows[100][1], i % 4) for i in range(60)]  # one group of copies, with a query in it
    rows += [(2000, rows[5][1], 1), (2000, rows[5][1], 1), (2100, rows[6][1], 2), (2100, rows[7][1], 2)]  # a repeated row, two rows of one id
    rows += [(None, rows[200][1], 3), (3000, None, 1), (3100, [1.0, None] + [0.0] * (dim - 2), 1), (3200, [float("nan")] * dim, 2), (3300, [float("inf")] + [0.0] * (dim - 1), 2)]
    rows += [(4000, [0.5, -0.25], 1), (4001, [0.5, 0.25], 1), (4002, [0.5, 0.5], 2), (4100, [], 0), (4101, [], 0), (4102, [], 1), (5000, [3000.0] * dim, 1), (5001, [2500.0] * dim, 2)]
    rows += [(6000, [0.1] * dim, None), (6100, [0.0] * dim, 0), (6101, [-0.0] * dim, 0)]
    return [(i, v, label, "x", "y", "z") for i, v, label in rows]


def valid(rows, scale):
    """(id, label, integers as float32 components give them) of the rows that take part."""
    out = []
    for i, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def ranked(rows):
    """(score, id) in order: highest first, then by id, without an id last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def test_search_matches_brute_force(spark, monkeypatch):
    rows = table()
    all_rows = valid(rows, 1024)
    want = Counter()
    for i, z in {(i, z) for i, _, z in all_rows if i is not None and i % 100 == 0}:
        best = ranked([(dot(z, w), j) for j, _, w in all_rows if j != i and len(w) == len(z)])[:10]
        want.update((i, r, j, s) for r, (s, j) in enumerate(best, 1))
    # Small blocks and cells: several tiles, cells and levels of the tree.
    for block, cell, fan in ((2048, 16_384, 16), (16, 32, 2)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "CELL", cell)
        monkeypatch.setattr(topk_search, "FAN", fan)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        out = topk_search.search(docs, docs.filter("vec_id % 100 = 0"))
        assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
        got = Counter(map(tuple, out.collect()))
        assert got == want


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(table()[:50], SCHEMA)
    assert topk_search.search(none, none).count() == 0
    assert topk_search.search(none, some).count() == 0 and topk_search.search(some, none).count() == 0


def test_wide_numbers_are_exact():
    a = np.array([[2**40, 3], [1, -(2**35)]])
    got = vectors.products(a, a)
    assert got.dtype == np.int64 and got[1, 1] == 1 + 2**70 % 2**64 and got[0, 1] == 2**40 - 3 * 2**35
    assert vectors.unpacked(vectors.packed(a), 2, 2).tolist() == a.tolist() and len(vectors.packed(a % 1000)) == 16


def brute_negatives(rows):
    all_rows = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, z) for i, label, z in valid(rows, 256) if label is not None]
    want = Counter()
    for i, label, z in {(i, label, z) for i, label, z in all_rows if i is not None and i % 100 == 0}:
        others = [(dot(z, w), j, other == label) for j, other, w in all_rows if j != i and len(w) == len(z)]
        for ps, p in ranked([(s, j) for s, j, same in others if same])[:5]:
            hard = ranked([(s, j) for s, j, same in others if not same and 80 * ps <= 100 * s <= 100 * ps])[:5]
            want.update((i, p, r, j, ps, s) for r, (s, j) in enumerate(hard, 1))
    return want


@pytest.mark.parametrize("near", [False, True])
def test_negatives_match_brute_force(spark, monkeypatch, near):
    rows = table(near=near)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute_negatives(rows)
    assert len(want) > 30
    for block, cell, kwargs in ((2048, 16_384, {}), (16, 32, {"ways": 3, "levels": 3, "sample": 200})):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "CELL", cell)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        out = hard_negatives.mine(docs, F.col("vec_id") % 100 == 0, label, **kwargs)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert Counter(map(tuple, out.collect())) == want


def test_negatives_of_empty_tables(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_tree_eliminates_and_loses_nothing(spark):
    """On rows in clusters most leaves are eliminated for a narrow window, and no row of the window lies in one of them."""
    rng = np.random.default_rng(4)
    z = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(scale=0.05, size=(4000, 16)))).astype(np.int64)
    trees = {16: hard_negatives.grow(z[:1000])}
    leaf = hard_negatives.route(trees[16], z)
    rows = spark.createDataFrame([(i, (v / 256).tolist(), 0) for i, v in enumerate(z)], "vec_id long, embedding array<float>, label long")
    blocks = hard_negatives.index(rows, trees, 256)
    assert sum(r["n"] for r in blocks.select("n").collect()) == 4000
    tree = hard_negatives.measure(blocks, trees)[16]
    asked = z[:50]
    scores = asked @ z.T
    lo = np.sort(scores, axis=1)[:, -20]
    visit = hard_negatives.survivors(tree, asked, lo, np.full(50, 1 << 62))
    visited = {(x, int(a)) for x, who in visit.items() for a in who}
    assert all((int(leaf[j]), i) in visited for i, j in zip(*np.nonzero(scores >= lo[:, None])))
    assert len([1 for x, _ in visited if x >= 0]) < 0.2 * 50 * tree.leaves


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def masks(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t, w = t or "", word_list(t or "")
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first.get(t, i)]
        out.append(sum(1 << k for k, f in enumerate(fails) if f))
    return out


def test_audit_matches_brute_force(spark):
    rows = corpus()
    rows += [(300, "SHOUT " * 150 + "#", "de", None, 1, None, None), (301, "é\x0bÀ\tZ$ " * 120, "de", None, 1, None, None), (302, rows[4][1], "de", None, 1, None, None),
             (302, rows[4][1], "en", None, 1, None, None), (None, rows[4][1], None, None, 1, None, None), (-5, rows[5][1], "", None, 1, None, None)]
    labels = [(i, i % 2, (i // 2) % 3 % 2) for i in range(0, 303)] + [(7, 1, None), (7, None, 1), (None, 1, 1), (-5, None, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = frame(spark, rows)
    marked = spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, part string")
    held = masks(rows)
    of = defaultdict(list)
    for r, m in zip(rows, held):
        of[r[2] or ""].append((m, r[0] in good, r[0] in toxic))
    want, shapley = {}, Counter()
    for part, rs in of.items():
        for order in itertools.permutations("ABCDE"):
            applied = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in rs if not x[0] & applied and x[0] & bit]
                want[part, "".join(order), step] = [
                    sum(not x[0] & (applied | bit) for x in rs), len(gone), sum(bool(x[0] & applied and x[0] & bit) for x in rs), sum(x[0] == bit for x in rs),
                    sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[part, letter] += len(gone)
                applied |= bit
    counted = filter_audit.cells(docs, marked, F.coalesce("lang", F.lit("")))
    out = filter_audit.audit(spark, counted).collect()
    assert len(out) == len(want) == 600 * len(of)
    for r in out:
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == want[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counted = filter_audit.cells(empty(spark), labels, F.coalesce("lang", F.lit("")))
    assert filter_audit.audit(spark, counted).count() == 0
