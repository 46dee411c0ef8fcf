"""Keyword search with per-field boosts, by a scan of the texts or through an inverted index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import computed_once, count_of
from strata.session import cut_lineage

WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), WORD_BREAK)


def _frequency(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def search(df: DataFrame, key: str, fields: dict[str, float], query: str, size: int = 10) -> DataFrame:
    """Rows matching any query term, best first: sum over fields and terms of
    ``boost * tf * ln(1 + N / df)``.

    Term frequencies are counted inside each row, over its whole text, so nothing is exploded or
    shuffled.  Texts are read once: the hits, a key and a few counts per row, are materialised in
    the shared folder, and their document frequencies enter the scoring as scalars.  Only
    ``size`` rows per task reach the final order.
    """
    terms = sorted(set(t for t in query.lower().split() if t))
    cells = [(f"tf_{i}_{j}", f, t) for i, f in enumerate(fields) for j, t in enumerate(terms)]
    words = {f: F.col(f) if dict(df.dtypes)[f].startswith("array") else tokens(F.col(f)) for f in fields}
    staged = computed_once(df.select(key, *fields), **{f"w_{f}": w for f, w in words.items()})
    counted = computed_once(staged, **{c: _frequency(F.col(f"w_{f}"), t) for c, f, t in cells}).select(
        key, *[c for c, _, _ in cells]
    )
    hits = cut_lineage(counted.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c, _, _ in cells])))
    rows = df.agg(F.count("*")).scalar()
    stats = hits.agg(F.struct(*[count_of(F.col(c) > 0).alias(c) for c, _, _ in cells])).scalar()
    scored = hits.withColumns({"_n": rows, "_s": stats})
    weights = [
        F.when(
            F.col(c) > 0, fields[f] * F.col(c) * F.ln(1 + F.col("_n") / F.col(f"_s.{c}"))
        ).otherwise(0.0)
        for c, f, _ in cells
    ]
    score = F.round(reduce(lambda a, b: a + b, weights), 6)
    return scored.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(size)


# Bytes of a row group of the index.
GROUP_BYTES = 8 << 20
POSTING = "term string, field string, {key}, tf bigint"
TERM = "term string, field string, df bigint"


def postings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, field, key, tf): how often each term stands in each field of a row.  Empty terms are none."""
    words = {f: F.col(f) if dict(df.dtypes)[f].startswith("array") else tokens(F.col(f)) for f in fields}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), words[f].alias("terms")) for f in fields])
    return (
        df.select(key, F.inline(cells))
        .select(key, "field", F.explode("terms").alias("term"))
        .where("term <> ''")
        .groupBy("term", "field", key)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def write_index(df: DataFrame, key: str, fields: list[str], path: str) -> None:
    """Writes the inverted index of ``df`` once: postings in the order of terms, document frequencies, row count.

    The shuffle that counts terms per row also deals them out to the files, so a term that most rows hold lies in all
    of them and in no task alone.  Each file is sorted by term, and statistics of its row groups and pages name few
    terms: a search opens those of its terms and no others.
    """
    rows = postings(df, key, fields)
    rows.sortWithinPartitions("term", key).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    written = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/postings")
    terms = written.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")
    df.agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/rows")


def search_index(
    spark: SparkSession, path: str, key: str, key_type: str, boosts: dict[str, float], query: str, size: int = 10
) -> DataFrame:
    """As :func:`search`, from the index at ``path``.  Runs no job while the plan is built.

    Document frequencies are one row per asked term and field; which way they meet the postings is left to the
    optimizer.
    """
    asked = sorted(set(t for t in query.lower().split() if t))
    mine = F.col("term").isin(asked) & F.col("field").isin(list(boosts))
    found = spark.read.schema(POSTING.format(key=f"{key} {key_type}")).parquet(f"{path}/postings").where(mine)
    known = spark.read.schema(TERM).parquet(f"{path}/terms").where(mine)
    rows = spark.read.schema("rows bigint").parquet(f"{path}/rows").agg(F.max("rows")).scalar()
    boost = F.create_map(*[F.lit(x) for f, b in boosts.items() for x in (f, float(b))])
    part = boost[F.col("field")] * F.col("tf") * F.ln(1 + rows / F.col("df"))
    return (
        found.join(known, ["term", "field"])
        .select(key, part.alias("part"))
        .groupBy(key)
        .agg(F.round(F.sum("part"), 6).alias("score"))
        .orderBy(F.desc("score"), key)
        .limit(size)
    )
