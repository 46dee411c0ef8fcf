"""Fill in the middle: the rank index is exact, outputs against a regular expression, texts come back."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm.fill_in_middle import ERROR, boundaries, digests, fill_in_middle, fit, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(" \t\n\x0b\x1c\x85\xa0ab<>PSMé中😀"), max_size=60)


@given(TEXT)
def test_boundaries_are_those_of_the_pattern(text):
    ends = [m.end() for m in TOKEN.finditer(text)]
    assert boundaries(text).tolist() == [0, *ends]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 400) | st.just(1), min_size=0, max_size=900), st.integers(0, 200))
def test_index_is_exact_and_bounded(gaps, error):
    offsets = np.cumsum([0, *gaps])
    index = fit(offsets, error)
    assert [index.offset(k) for k in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.residuals.astype(np.int64)).max() <= error + 1
    assert index.ranks[0] == 0 and (np.diff(index.ranks) > 0).all()


def test_pieces_are_few_where_lines_fit():
    rng = np.random.default_rng(0)
    offsets = np.concatenate([[0], np.cumsum(rng.integers(4, 9, 100_000))])
    index = fit(offsets)
    assert index.residuals.dtype == np.int8 and len(index.ranks) < 400
    steep = np.cumsum(np.concatenate([[0], np.full(5000, 2), np.full(5000, 90)]))
    assert len(fit(steep).ranks) == 2


def expected(doc_id, text):
    """(n, form, prefix, middle, output) as the contract says, from the pattern alone."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, z = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:z], units[z:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    pieces = [" ", "  ", "\n", "a", "bc", "<", "<P", "S>", "é", "中文", "😀", "word", "\x85", "\x1f", "\t"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "x <M> y"), (1004, "one"), (7, "twice"), (7, "twice"), (None, "no id at all"), (None, None)]
    return rows + [(2000 + i, "long word " * 60_000 + "end") for i in range(4)] + [(3000 + i, " \n" * 4000) for i in range(4)]


def test_operator_and_restoring(spark, cases):
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in cases], "doc_id long, text string, form string, n int").repartition(3)
    rows = fill_in_middle(docs).withColumn("restored", restored()).collect()
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows], key=str)
    assert got == sorted([(i, *expected(i, t)) for i, t in cases], key=str)
    assert sorted((str(r.doc_id), r.restored) for r in rows) == sorted((str(i), t or "") for i, t in cases)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_digests(spark, cases):
    docs = spark.createDataFrame(cases[:60], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(i, sha(expected(i, t)[4]), sha(t)) for i, t in cases[:60]}
    assert {(r.doc_id, r.output_sha256, r.restored_sha256) for r in digests(docs).collect()} == want
    assert digests(docs.limit(0)).collect() == []


def test_words_longer_than_the_error_cost_no_more_than_their_length():
    text = " ".join(("y" * (ERROR * 3), "x")[i % 2] for i in range(20_000))
    begin = time.perf_counter()
    index = fit(boundaries(text))
    assert time.perf_counter() - begin < 5
    assert index.offset(20_000) == len(text)
