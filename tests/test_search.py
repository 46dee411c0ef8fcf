"""The inverted index against the scan, and what a search opens of it."""

import math

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strata.operators.search import search, search_index, write_index

ROWS = [
    (1, "red bus Red", ["bus", "city"]), (2, "a RED tour of the city", []), (3, None, ["red"]), (4, "", None), (5, "blue", ["sea"]),
    (6, "red-blue red", ["city", "city"]), (7, "red " * 500, ["x"]),
]


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, name string, tags array<string>")
    write_index(df, "id", ["name", "tags"], str(tmp_path / "i"))
    for query in ("red city", "blue", "nowhere", "red red BUS", ""):
        got = search_index(spark, str(tmp_path / "i"), "id", "bigint", {"name": 2.0, "tags": 1.0}, query, 5).collect()
        if not query:
            assert got == []
            continue
        want = [r for r in search(df, "id", {"name": 2.0, "tags": 1.0}, query, 5).collect()]
        assert [(r.id, r.score) for r in got] == [(r.id, r.score) for r in want if r.score]
    only = search_index(spark, str(tmp_path / "i"), "id", "bigint", {"tags": 1.0}, "red", 5).collect()
    assert [(r.id, r.score) for r in only] == [(3, round(math.log(1 + 7 / 1), 6))]


def test_a_search_opens_the_groups_of_its_terms(spark, tmp_path):
    docs = spark.range(4000).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % (50 + k)) for k in range(20)]).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        write_index(docs, "id", ["text"], str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    found = search_index(spark, str(tmp_path / "i"), "id", "bigint", {"text": 1.0}, "w3x7 w11x0", 10)
    plan = found._jdf.queryExecution().toString()
    assert len(jobs.getJobIdsForGroup("plan")) == 0
    spark.sparkContext.setJobGroup("", "")
    assert plan.count("In(term, [w11x0,w3x7])") >= 2
    assert [r.id for r in found.collect()] == [r.id for r in search(docs, "id", {"text": 1.0}, "w3x7 w11x0", 10).collect()]
    # sorted files: a file begins and ends with terms in order
    for name in (tmp_path / "i" / "postings").glob("*.parquet"):
        terms = [t.as_py() for t in pq.read_table(name).column("term")]
        assert terms == sorted(terms)
