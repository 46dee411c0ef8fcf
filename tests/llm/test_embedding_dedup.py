"""Embedding near duplicates against the cosines of all pairs."""

import numpy as np
import pytest

from strata.llm.embedding_dedup import SIMILARITY, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links int"


def plain(rows):
    """[(id, n_links, component_id)] by comparing every pair."""
    sound = []
    for n, (i, v, label) in enumerate(rows):
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            sound.append((n, np.array(v, np.float32).astype(float)))
    links = [0] * len(rows)
    group = list(range(len(rows)))

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for x, (n, a) in enumerate(sound):
        for m, b in sound[:x]:
            if rows[n][2] == rows[m][2] and len(a) == len(b):
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= SIMILARITY:
                    links[n] += 1
                    links[m] += 1
                    group[root(n)] = root(m)
    least = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, links[n], least.get(root(n))) for n, (i, _, _) in enumerate(rows)), key=str)


def found(frame):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in frame.collect()), key=str)


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 8))
    near = lambda v: (v + rng.normal(size=8) * 0.01).tolist()
    one = base[0].tolist()
    rows = [
        (5, one, 1), (2, one, 1), (2, one, 1), (9, near(base[0]), 1), (7, [2 * x for x in one], 1), (1, one, 2), (3, one, None),
        (4, None, 1), (6, [0.0] * 8, 1), (8, [float("nan"), *one[1:]], 1), (10, [None, *one[1:]], 1), (11, [], 1),
        (12, one[:4], 1), (13, base[1].tolist(), 1), (None, near(base[1]), 1), (None, base[2].tolist(), 1), (14, one[:4], 1),
        (15, [float("inf"), *one[1:]], 1), (16, [-0.0, 1.0], 3), (17, [0.0, 1.0], 3),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    result = embedding_dedup(frame)
    assert found(result) == plain(rows)
    for r in result.collect():
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert embedding_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_large_groups_in_blocks(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(400):
        spread = rng.choice([0.02, 0.05, 0.09])
        rows.append((i, (centres[min(i % 9, 5)] + rng.normal(size=16) * spread).tolist(), i % 2))
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got, want = found(embedding_dedup(frame, block=block)), plain(rows)
    recall = sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True)) / sum(w[1] for w in want)
    assert recall >= 0.9
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_recall_over_a_table_with_planted_neighbours(spark, sf_dir):
    """The table's own vectors are far apart; noisy copies lie around the limit on both sides."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(5)
    planted = [
        (10_000 + 10 * i + k, (np.array(v) + rng.normal(size=len(v)) * np.linalg.norm(v) * noise).tolist(), label)
        for i, v, label in own[::4]
        for k, noise in enumerate((0.01, 0.016, 0.02, 0.025))
    ]
    rows = own + planted
    got = found(embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    want = plain(rows)
    links = sum(w[1] for w in want)
    assert links > 500 and sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True)) >= 0.97 * links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_links_do_not_depend_on_how_many_vectors_there_are(spark):
    """Lists are compared whole, in blocks of any size; a vector's further pivots say nothing about whom it meets."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.12).tolist(), 0) for i in range(800)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = found(embedding_dedup(frame, block=1024))
    assert sum(links for _, links, _ in got) > 100
    assert found(embedding_dedup(frame, block=16)) == got == found(embedding_dedup(frame, block=100))
