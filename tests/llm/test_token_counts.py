"""Token counts against the tokenizer library's own offsets and a plain join of intervals."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm.token_counts import byte_bpe, sections, token_counts

TEXTS = [None, "", "\n", "one", "one\ntwo three\n\n\nfour  \n x", "é\U0001f600\n日本\n\n語", "\n\n\nabc", "a" * 30_000 + "\n" + "b c " * 9000, " \n \n\t\n."]


def library_spans(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    done = library.encode(text, add_special_tokens=False)
    return done.ids, done.offsets


def plain(fields, rule):
    """[(field, section, start, stop, n_tokens, n_crossing)] by comparing every token with every section."""
    parts, at = [], 0
    for f, text in enumerate(fields):
        for n, line in enumerate((text or "").split("\n")):
            parts.append([f, n, at, at + len(line) + 1, 0, 0])
            at += len(line) + 1
    whole = "\n".join(t or "" for t in fields)
    parts[-1][3] = len(whole)
    for a, z in library_spans(whole)[1]:
        held = [max(0, min(z, p[3]) - max(a, p[2])) for p in parts]
        touched = [k for k, h in enumerate(held) if h]
        k = {"most": held.index(max(held)), "first": touched[0], "last": touched[-1]}[rule]
        parts[k][4] += 1
        parts[k][5] += len(touched) > 1
    return [tuple(p) for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab \n\té日\U0001f600.'s"), max_size=60))
def test_spans_are_those_of_the_library(text):
    ids, start, stop = byte_bpe().spans(text)
    want, offsets = library_spans(text)
    assert ids.tolist() == want
    assert list(zip(start.tolist(), stop.tolist())) == [tuple(o) for o in offsets]


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_operator(spark, rule):
    rows = [(i, t, "x\ny") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None), (None, "no id", "z")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, title string, field string, start int")
    got = sorted((tuple(r) for r in token_counts(docs, fields=("text", "title"), rule=rule).collect()), key=str)
    names = ("text", "title")
    want = [(i, names[f], *rest) for i, text, title in rows for f, *rest in plain([text, title], rule)]
    assert got == sorted(want, key=str)
    assert token_counts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, rule="half")


def test_counts_of_lines_add_up(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in token_counts(docs).collect():
        got.setdefault(r.doc_id, []).append((0, r.section, r.start, r.stop, r.n_tokens, r.n_crossing))
    for r in docs.limit(60).collect():
        assert sorted(got[r.doc_id]) == plain([r.text], "most")
    for r in docs.collect():
        assert sum(p[4] for p in got[r.doc_id]) == len(byte_bpe().encoding.encode_ordinary(r.text))


def test_sections_tile_the_document():
    whole, names, borders = sections(["a\n\nb", "", "c"])
    assert whole == "a\n\nb\n\nc" and names == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)] and borders.tolist() == [0, 2, 3, 5, 6]
