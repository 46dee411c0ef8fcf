"""Repeated passages: suffix order and intervals against enumeration, the operator against plain windows."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import repeated_passages as module
from strata.llm.repeated_passages import (
    LENGTH, maximal_groups, maximal_repeats, merged, prefix_intervals, segments_of, suffix_array, without_repeats,
)


def packed(texts):
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab\0", min_size=1, max_size=12)), min_size=1, max_size=25))
def test_suffixes_are_in_order(rows):
    texts = [t.encode() for _, t in rows]
    data, start, end = packed(texts)
    bucket = np.array([b for b, _ in rows])
    order, lcp = suffix_array(data, start, end, bucket)
    got = [(rows[i][0], texts[i]) for i in order]
    assert got == sorted(got)
    want = [common(x, y) if a == b else 0 for (a, x), (b, y) in zip(got, got[1:])]
    assert lcp.tolist() == [0, *want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=14), st.data())
def test_intervals_are_all_found(lcp, data):
    lcp[0] = 0
    left = data.draw(st.lists(st.integers(0, 1), min_size=len(lcp), max_size=len(lcp)))
    changes = np.cumsum([0, *[a != b for a, b in zip(left, left[1:])]]).tolist()
    want = set()
    for i, j in combinations(range(len(lcp)), 2):
        length = min(lcp[i + 1 : j + 1])
        wider = lcp[i] < length and (j + 1 == len(lcp) or lcp[j + 1] < length)
        if length >= 2 and wider and len(set(left[i : j + 1])) > 1:
            want.add((length, i, j))
    got = prefix_intervals(lcp, changes, 2)
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_windows_have_one_gram_at_one_place():
    rng = random.Random(1)
    shared = bytes(rng.choices(b"abcdef ", k=400))
    texts = [bytes(rng.choices(b"abcdef ", k=n)) + shared + bytes(rng.choices(b"abcdef ", k=70)) for n in (0, 31, 250)]
    seen = {}
    for text, start, windows, lead, gram, _ in segments_of(*packed(texts)):
        for t, s, n, place, g in zip(text, start, windows, lead, gram, strict=True):
            assert 1 <= n <= module.SPAN
            for k in range(n):
                seen.setdefault(texts[t][s + k : s + k + LENGTH], []).append((g, place - k))
    assert sum(len(v) for v in seen.values()) == sum(len(t) - LENGTH + 1 for t in texts)
    assert max(len(v) for v in seen.values()) == 3
    assert all(len(set(v)) == 1 for v in seen.values())


def test_groups_are_the_maximal_repeats():
    rng = random.Random(2)
    core = bytes(rng.choices(b"abcd", k=130))
    texts = [b"x" + core + b"1", b"y" + core + b"2", core[:110] + b"z", b"q" + core[20:] + b"1", bytes(rng.choices(b"abcd", k=140))]
    data, start, end = packed(texts)
    got = {}
    for g, length, segment, offset, first in zip(*maximal_groups(data, start, end, np.zeros(5, int), np.arange(5) << 32)):
        got.setdefault((int(g), int(length)), []).append((int(segment), int(offset), bool(first)))
    found = {(length, *sorted((s, o) for s, o, _ in members)) for (_, length), members in got.items()}
    assert found == {
        (130, (0, 1), (1, 1)), (110, (0, 1), (1, 1), (2, 0)), (110, (0, 21), (1, 21), (3, 1)), (111, (0, 21), (3, 1)),
    }
    assert all(sum(first for *_, first in members) == 1 for members in got.values())


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=20))
def test_union_of_spans(spans):
    covered = {p for a, n in spans for p in range(a, a + n)}
    runs = merged(np.array([(a, a + n) for a, n in spans], np.int64).reshape(-1, 2)).tolist()
    assert {p for a, z in runs for p in range(a, z)} == covered
    assert all(z < a for (_, z), (a, _) in zip(runs, runs[1:]))


def plain(rows):
    """(id, bytes, runs, hash of the rest) by a set of all windows in order of (id, text)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for s in range(len(b) - LENGTH + 1):
            if b[s : s + LENGTH] in seen:
                gone[s : s + LENGTH] = 1
            seen.add(b[s : s + LENGTH])
        turns = np.flatnonzero(np.diff(gone, prepend=0)).reshape(-1, 2).tolist()
        rest = np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()
        out.append((i, len(b), turns, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def run(docs, **options):
    rows = without_repeats(docs, **options).collect()
    return sorted(
        [(r.doc_id, r.n_bytes, [[s.start, s.end] for s in r.spans], hashlib.sha256(r.kept).hexdigest()) for r in rows], key=str
    )


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(1, 8))) for _ in range(n))
    passage, other = words(60), words(30)
    rows = [
        (10, passage), (4, words(20) + passage + words(5)), (7, words(3) + passage[50:] + words(9) + passage[:120]),
        (3, None), (8, ""), (5, "short"), (6, "z" * 5000), (11, "z" * 300), (12, "ab" * 700 + other), (13, other[:99]),
        (14, other[:100]), (15, "é中" * 90 + other), (16, words(40) + "中" * 80), (2, passage), (2, passage),
        (2, words(30) + other), (None, passage + words(30)), (None, other), (None, other), (9223372036854775807, other + passage),
        (20, words(25000)), (21, words(2) + other + passage + other),
    ]
    return rows + [(100 + i, words(6) + passage[: 130 + i] + words(6)) for i in range(40)]


@pytest.mark.parametrize("crowd", [module.CROWD, 3])
def test_operator_against_all_windows(spark, cases, crowd):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in cases], "doc_id long, text string, g string, spans int")
    assert run(docs.repartition(3), crowd=crowd) == plain(cases)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_blocks_and_chunks_change_nothing(cases):
    rows = [t.encode() for _, t in cases if t]
    data, first, last = packed(rows)
    whole = {(t, s + k) for t, s, n, *_ in zip(*next(segments_of(data, first, last))[:3]) for k in range(n)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(module, "BLOCK", 700)
        parts = {
            (t, s + k) for block in segments_of(data, first, last) for t, s, n in zip(*block[:3]) for k in range(n)
        }
    assert parts == whole == {(i, s) for i, t in enumerate(rows) for s in range(len(t) - LENGTH + 1)}


def test_groups_list_every_occurrence(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(150)
    texts = {i: word(49 + i) + "UVWXYZ"[i] + passage + "ABCDEF"[i] + word(40) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = maximal_repeats(docs).collect()
    covered = {i: set() for i in texts}
    for r in rows:
        string = texts[r.doc_id][r.start : r.start + r.length]
        assert r.length >= LENGTH and string == texts[r.first_doc][r.first_start : r.first_start + r.length]
        assert r.first_doc == 0
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
    for i, seen in covered.items():
        assert seen == set(range(50 + i, 200 + i))
    groups = {}
    for r in rows:
        groups.setdefault((r.length, r.first_start), []).append((r.doc_id, r.start - r.doc_id))
    assert groups and all(sorted(v) == [(i, s) for i in range(6)] for (_, s), v in groups.items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run(docs) == []
    assert maximal_repeats(docs).collect() == []


def test_a_class_has_one_row_however_many_repeats_nest_in_it():
    """Segments that share ever longer prefixes: each is in a group with all that share more."""
    rng = random.Random(4)
    base = bytes(rng.choices(range(97, 123), k=168))
    texts = [base[: 100 + i] + bytes([200 + i % 50]) * (68 - i) for i in range(60)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1] * 60), pa.array(range(60)), pa.array(range(60)), pa.array([0] * 60), pa.array([0] * 60), pa.array(texts, pa.binary())],
        ["g", "h", "doc", "sub", "start", "segment"],
    )
    listed = [r for b in module._groups(iter([rows])) for r in b.to_pylist()]
    covers = [r for b in module._covers(iter([rows])) for r in b.to_pylist()]
    spans = {}
    for r in listed:
        if not r["earliest"]:
            spans.setdefault(r["h"], set()).update(range(r["offset"], r["offset"] + r["length"]))
    assert len(listed) > 500 and len(covers) == len(spans) <= 60
    assert {r["h"]: set(range(r["offset"], r["offset"] + r["length"])) for r in covers} == spans
