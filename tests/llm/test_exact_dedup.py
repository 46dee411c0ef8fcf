"""Exact duplicates: the code of fingerprint lists, and the operator against plain grouping."""

import hashlib
import re
import time

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import exact_dedup as module
from strata.llm.exact_dedup import drop_copies, exact_dedup, golomb_decode, golomb_encode


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 10_000_000), max_size=400), st.integers(10_000_001, 1 << 48))
def test_lists_come_back(values, universe):
    values = np.array(sorted(values), np.int64)
    width, code = golomb_encode(values, universe)
    assert golomb_decode(len(values), width, code).tolist() == values.tolist()


def test_code_is_near_the_entropy():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 48, 50_000))
    _, code = golomb_encode(values, 1 << 48)
    assert 8 * len(code) / len(values) < np.log2((1 << 48) / len(values)) + 2.2


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        out += [(i, first, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


CASES = [
    (5, "a  b"), (2, "a\tb"), (9, "a b "), (4, None), (8, ""), (1, " "), (7, "x" * 300_000), (6, "x" * 300_000),
    (3, "a b"), (2, "a\tb"), (2, "another"), (None, "a b"), (None, "alone"), (None, "twin"), (None, "twin"),
]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, "z", True) for i, t in CASES], "doc_id long, text string, digest string, kept boolean")
    got = exact_dedup(docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == plain(CASES)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    stays = drop_copies(docs)
    assert stays.columns == docs.columns
    assert stays.count() == len(kept)
    assert exact_dedup(docs.limit(0)).count() == 0
    assert drop_copies(docs.limit(0)).count() == 0


def test_collisions_of_fingerprints_part_again(spark, monkeypatch):
    monkeypatch.setattr(module, "FINGERPRINT_BITS", 8)
    rows = [(i, f"text {i % 150}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_several_lists_of_one_partition(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(module, "FRAME_ROWS", 16)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs).collect()]
    assert sorted(got, key=str) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_many_lists_of_one_owner():
    rng = np.random.default_rng(3)
    lists = []
    for k in range(800):
        values = np.unique(rng.integers(0, 1 << 30, 1300))
        width, code = golomb_encode(values, 1 << 30)
        lists.append((k, 0, 0, width, len(values), code, values))
    frame = pd.DataFrame(lists, columns=["sender", "frame", "owner", "width", "n", "code", "values"])
    begin = time.perf_counter()
    got = module._answer(frame.drop(columns="values"))
    assert time.perf_counter() - begin < 2
    values, counts = np.unique(np.concatenate(frame["values"]), return_counts=True)
    twice = set(values[counts > 1].tolist())
    for bitmap, held in zip(got["bitmap"], frame["values"], strict=True):
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(held)]
        assert bits.tolist() == [v in twice for v in held.tolist()]


def test_texts_are_not_shuffled_to_be_found(spark, sf_dir, monkeypatch):
    """Whole texts meet the bitmaps in their buckets; only suspects go on."""
    plans = []
    stored = module.settled
    monkeypatch.setattr(module, "settled", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or stored(df, name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert drop_copies(docs).count() < docs.count()
    for name in ("verified", "kept"):
        plan = dict(plans)[name].split("== Physical Plan ==")[1]
        scan = plan.index("Bucketed: true")
        above = plan[plan.index("ShuffledHashJoin") : scan]
        assert "Exchange" not in above and "Sort" not in above


def test_one_text_on_every_writer(spark):
    rows = [(i, "the same text everywhere" if i % 3 else f"own {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert sorted(r.doc_id for r in drop_copies(docs).collect()) == [i for i in range(900) if i % 3 == 0 or i == 1]
