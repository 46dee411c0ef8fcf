"""The pipeline's stages against plain versions, each on its own input."""

import re

import corpus_pipeline
from strata.llm.secrets import MASK
from strata.llm.toxicity import train
from tests.llm.test_secrets import plain as plain_spans
from tests.llm.test_simhash import plain_components, plain_print


def masked(text):
    out, at, any_span = [], 0, False
    for s, _, e in plain_spans(text):
        if any_span and s <= at:
            at = max(at, e)
            continue
        out.append(text[at:s])
        at, any_span = e, True
    return MASK.join([*out, text[at:]]) if any_span else text


def plain_stages(spark, docs, sf_dir):
    """(name, {doc_id: text}) after each stage that returns documents."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if model.score(t.encode()) < 0.5}
    yield "toxicity", rows
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    yield "exact_dedup", rows
    groups = plain_components([(i, plain_print(t)) for i, t in sorted(rows.items())])
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    yield "simhash_near_dedup", rows
    yield "secret_scan", {i: masked(t) for i, t in rows.items()}


def test_stages_follow_their_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    for (name, stage), (want_name, want) in zip(corpus_pipeline.STAGES, plain_stages(spark, docs, sf_dir)):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == want_name and docs.columns == columns
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
        assert all(r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(want)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_stages_on_rows_out_of_the_ordinary(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, "token=abcdefgh and more words here", "en", "s", 34, None),
            (3, "token=abcdefgh and more words here", "en", "s", 34, None), (None, "some other words stand here", "en", "s", 27, None),
            (4, "z " * 100_000, "en", "s", 200_000, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() >= 4
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
