"""Vector codes: trees hold every point, bounds lose no entry, and the operator against plain rounds."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import vector_codes as module
from strata.llm.vector_codes import anchors, ball_tree, nearest, scaled, squares, sums, vector_codes

POINTS = st.integers(1, 3).flatmap(
    lambda width: st.lists(st.lists(st.integers(-9, 9) | st.sampled_from([-(1 << 26), 1 << 26]), min_size=width, max_size=width), min_size=1, max_size=90)
)


@settings(max_examples=150, deadline=None)
@given(POINTS, st.data())
def test_tree_gives_what_all_distances_give(rows, data):
    points = np.array(rows, np.int64)
    tree = ball_tree(points, leaf=3)
    assert sorted(tree.place.tolist()) == list(range(len(points)))
    assert (tree.points == points[tree.place]).all()
    assert tree.span[0].tolist() == [0, len(points)]
    for (a, z), (left, right), total in zip(tree.span, tree.child, tree.total):
        assert (tree.points[a:z].sum(0) == total).all()
        if left >= 0:
            assert tree.span[left][0] == a and tree.span[left][1] == tree.span[right][0] and tree.span[right][1] == z
    book = points[data.draw(st.lists(st.integers(0, len(points) - 1), min_size=1, max_size=6))]
    want = squares(tree.points, book).argmin(1)
    assert nearest(tree, book).tolist() == want.tolist()
    count, total = sums(tree, book)
    assert count.tolist() == np.bincount(want, minlength=len(book)).tolist()
    for e in range(len(book)):
        assert (total[e] == tree.points[want == e].sum(0)).all()


@settings(max_examples=60, deadline=None)
@given(POINTS, st.integers(1, 8))
def test_points_go_to_their_nearest_anchor(rows, count):
    points = np.array(rows, np.float64)
    groups = anchors(points, count)
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(points)))
    assert len(groups) <= count


def test_balls_are_owned_whole():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (12, 8))
    points = centres[rng.integers(0, 12, 4000)] + rng.integers(-30, 30, (4000, 8))
    tree = ball_tree(points)
    owned = [z - a for a, z, entry, _ in module.owned(tree, centres) if entry >= 0]
    assert sum(owned) > 3000 and len(owned) < 1000


def test_whole_numbers_round_down():
    values = np.array([-0.00001, 0.0, 0.5, -1 / 4096, 3.3])
    assert scaled(values).tolist() == [math.floor(Fraction(v) * 4096) for v in values]
    large = np.array([1e30, -1e30, -0.1])
    assert scaled(large).tolist() == [math.floor(Fraction(v) * 4096) for v in large]


def plain(rows, rounds=6, entries=16):
    """Codes by all distances, in unbounded whole numbers."""
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, label, [math.floor(Fraction(x) * 4096) for x in v], v) for i, v, label in rows if sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    width = len(kept[0][2]) // 8
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(8)] for _, _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min(range(len(book)), key=lambda e: (distance(x, book[e]), e))
    for _ in range(rounds):
        for p in range(8):
            mine = {}
            for c in cut:
                mine.setdefault(best(c[p], books[p]), []).append(c[p])
            for e, members in mine.items():
                books[p][e] = tuple(sum(x) // len(members) for x in zip(*members))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, per_label = [], {}
    for (i, label, *_), c in zip(kept, cut):
        code = [best(c[p], books[p]) for p in range(8)]
        error = sum(distance(c[p], books[p][code[p]]) for p in range(8))
        per_label[label] = per_label.get(label, 0) + error
        out.append((i, label, bytes(code).hex(), error))
    fits = lambda x: x if x < 1 << 63 else None
    return sorted([(i, code, fits(e), fits(per_label[label]), digest) for i, label, code, e in out], key=str)


def run(frame, **options):
    rows = vector_codes(frame, **options).collect()
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows], key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def rows_of(n, seed, dims=16):
    rng = random.Random(seed)
    near = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(near)], rng.choice([1, 2, None])) for i in range(n)]


ODD = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, None), (904, [0.0] * 16, 2)]


@pytest.mark.parametrize("block", [module.BLOCK, 37])
def test_operator_against_all_distances(spark, block):
    rows = rows_of(400, 0) + ODD
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 1), (None, rows[7][1], None), (None, rows[8][1], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert run(frame, block=block) == plain(rows)


def test_few_rows_ties_and_none(spark):
    rows = [(3, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [-1.0] * 8, None)]
    frame = lambda r: spark.createDataFrame([(*x, "x", 1) for x in r], SCHEMA)
    assert run(frame(rows)) == plain(rows)
    assert {r[1] for r in run(frame(rows))} == {"00" * 8, "01" * 8}
    assert run(frame([])) == run(frame(ODD[:4])) == run(frame([(1, [], 1)])) == run(frame([(1, [0.5] * 9, 1)])) == []
    assert len(run(frame(rows + [(9, [1.0] * 16, 1), (10, [], 1)]))) == 3


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([3e38, -2e38, 1.5, 0.0, 4e4]) for _ in range(8)], i % 2) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert run(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(2)) == plain(rows)


def test_whole_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert run(frame) == plain([(r.vec_id, r.embedding, r.label) for r in frame.collect()])
