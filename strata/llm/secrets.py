"""Secrets in texts, with multipart credentials linked by an interval join.

Strong patterns are reported wherever they stand.  Weak candidates (user names, key-shaped strings, endpoints) are
common in harmless text; they are reported only where a complementary part of a credential stands within the same
scope, some code points around.  Candidates and parts meet in buckets of the text as wide as a scope, so the join
compares neighbours only.

Everything is DataFrame functions.  Spark's regular expressions give matches but no places: the text is split at the
matches, and lengths of the parts add up to places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import stored


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    shortest: int
    group: int = 0  # the part of a match whose length counts
    needs: tuple[str, ...] = ()  # a weak kind is reported near one of these


# The strong patterns; order is that of reports.  A run that starts with no longer match is dropped as a
# whole, so for access and hex "at least so many" in the pattern gives the same spans as a look at the length after.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 20),
    Kind("hex", r"[0-9a-f]{24,}", 24),
    Kind(
        "user", r"""(?i:(user_?name|user|login|account_?id|client_?id|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""",
        3, 2, ("assign", "hex", "key"),
    ),
    Kind("key", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 40, 0, ("access", "user")),
    Kind("endpoint", r"(?i:https?|ftps?|postgres(?:ql)?|mysql|mongodb|rediss?|amqps?)://[^\x20\x09-\x0D\"'<>]+", 8, 0, ("assign", "access")),
)
STRONG = 3
# Code points between a weak candidate and its complementary part at most.
SCOPE = 200
MASK = "[SECRET]"

_PART = "array<struct<kind:int,place:int,gap:int,width:int,counts:int>>"


def _parts(number: int, kind: Kind) -> Column:
    """The matches of a kind in ``text``: text before each since the last one, its length, the length that counts."""
    text = F.col("text")
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    widths = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.length)
    if kind.group:
        counts = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)), F.length)
    else:
        counts = widths
    zipped = F.zip_with(
        F.zip_with(gaps, widths, lambda g, w: F.struct(g.alias("gap"), w.alias("width"))),
        counts,
        lambda gw, n: F.struct(gw["gap"].alias("gap"), gw["width"].alias("width"), n.alias("counts")),
    )
    numbered = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("place"), x["gap"].alias("gap"), x["width"].alias("width"), x["counts"].alias("counts")
        ),
    )
    # Most texts hold no match of most kinds; the first look ends at the first match.
    return F.when(text.rlike(kind.pattern), F.filter(numbered, lambda x: x["width"].isNotNull())).otherwise(F.array().cast(_PART))


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans that have a complementary span at most ``scope`` code points away."""
    number = {k.name: n for n, k in enumerate(KINDS)}
    serves = {
        n: [number[w.name] for w in KINDS if k.name in w.needs] for n, k in enumerate(KINDS) if any(k.name in w.needs for w in KINDS)
    }
    weak = spans.where(F.col("kind") >= STRONG).withColumn(
        "bucket", F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"stop div {scope}")))
    )
    asked = F.array().cast("array<int>")
    for n, wanted in serves.items():
        asked = F.when(F.col("kind") == n, F.array(*[F.lit(w) for w in wanted])).otherwise(asked)
    parts = (
        spans.withColumn("kind", F.explode(asked))
        .withColumn("bucket", F.explode(F.expr(f"sequence(floor((start - {scope}) / {scope}), floor((stop + {scope}) / {scope}))")))
        .select("uid", "kind", "bucket", F.col("start").alias("from"), F.col("stop").alias("to"))
    )
    near = (F.col("from") <= F.col("stop") + scope) & (F.col("to") >= F.col("start") - scope)
    same = [weak[c] == parts[c] for c in ("uid", "kind", "bucket")]
    met = weak.join(parts, same[0] & same[1] & same[2] & near, "left_semi")
    return met.select("uid", "kind", "start", "stop").distinct()


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
    )


def _found(docs: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """(id, digest, spans) per row of ``docs``; spans are (start, kind, stop) in order."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(
        texts.select(
            F.monotonically_increasing_id().alias("uid"),
            "id",
            _digest("text").alias("digest"),
            F.concat(*[_parts(n, k) for n, k in enumerate(KINDS)]).alias("parts"),
        ),
        "parts",
    )
    before = Window.partitionBy("uid", "kind").orderBy("place")
    shortest = F.get(F.array(*[F.lit(k.shortest) for k in KINDS]), F.col("kind"))
    spans = (
        rows.where(F.size("parts") > 0)
        .select("uid", F.inline("parts"))
        .withColumn("stop", F.sum(F.col("gap") + F.col("width")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("counts") >= shortest)
        .select("uid", "kind", (F.col("stop") - F.col("width")).alias("start"), "stop")
    )
    spans = stored(spans, "spans")
    reported = spans.where(F.col("kind") < STRONG).unionByName(_linked(spans, scope))
    per_row = reported.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return rows.select("uid", "id", "digest").join(per_row, "uid", "left").select("id", "digest", F.coalesce("spans", empty).alias("spans"))


def _digest(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def _number_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then by the order of kinds, comma-joined.
    The counts and the digest are those of the strong kinds; ``spans`` holds the linked weak ones too.  Null texts
    count as empty; a text without spans has empty lists.  Repeated rows are repeated; an empty table gives an empty
    result; other columns are not read.
    """
    found = _found(docs, id_col, text_col, scope)
    strong = F.filter("spans", lambda s: s["kind"] < STRONG)
    counts = [_number_of(n).cast("long").alias(f"n_{KINDS[n].name}") for n in range(STRONG)]
    return found.select(
        F.col("id").alias(id_col), *counts, F.sha2(_listed(strong).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by a mark; all rows and columns stay.

    Spans that touch or overlap get one mark.  A column ``n_chars`` follows the text where that changed.
    """
    spans = _found(docs, id_col, text_col, scope).where(F.size("spans") > 0)
    # Rows with equal id and text have equal spans; one of them speaks for all.
    spans = spans.groupBy("id", "digest").agg(F.first("spans").alias("spans")).select("id", "digest", F.inline("spans"))
    order = Window.partitionBy("id", "digest").orderBy("start", "kind")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = (
        spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
        .withColumn("part", F.sum("new").over(order))
        .groupBy("id", "digest", "part")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    )
    joined = stored(joined, "cuts")
    keyed = docs.withColumn("_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    met = keyed.join(
        joined.hint("merge"), keyed[id_col].eqNullSafe(joined["_id"]) & (keyed["_key"] == joined["_digest"]), "left"
    )
    # The text between the cuts, from the stop before to the start after.
    starts = F.concat(F.lit([0]).cast("array<bigint>"), F.transform("_cuts", lambda c: c["stop"]))
    stops = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length(text_col).cast("bigint")))
    kept = F.zip_with(starts, stops, lambda a, z: F.substring(F.col(text_col), (a + 1).cast("int"), (z - a).cast("int")))
    masked = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, MASK))
    columns = {c: F.col(c) for c in docs.columns} | {text_col: masked.alias(text_col)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = F.aggregate("_cuts", F.lit(0).cast("bigint"), lambda total, c: total + c["stop"] - c["start"] - len(MASK))
        changed = F.length(text_col) - cut
        columns["n_chars"] = F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(changed).cast(kind).alias("n_chars")
    return met.select(*columns.values())
