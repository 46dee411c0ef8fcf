"""Quality checks as result rows.

Checks that count bad rows are described first and then evaluated together: one aggregate over
the table, whatever the number of checks and columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.functions.columns import blank, count_of, epoch, percent
from strata.functions.contracts import Field, is_type

# Pass marks of the checks, in percent.
COMPLETENESS_AT_LEAST = 95.0
DUPLICATES_BELOW = 1.0
OUT_OF_RANGE_BELOW = 5.0
TYPE_MISMATCH_BELOW = 2.0
STALE_BELOW = 10.0
DUPLICATE_ROWS_FAIL_ABOVE = 5.0
NULLS_FAIL_ABOVE = 50.0
MIN_PARTITION_ROWS = 100
MAX_FUTURE_SECONDS, MAX_PAST_SECONDS = 300, 86_400
EXAMPLES = 10

RESULT = (
    "check string, field string, total_records bigint, bad_records bigint, percent double, "
    "threshold double, passed boolean"
)


@dataclass(frozen=True)
class Check:
    """Rows where ``bad`` holds are counted.  ``at_least`` reads the percentage as the share of
    good rows that must reach the threshold, otherwise bad rows must stay strictly below it."""

    name: str
    field: str
    bad: Column
    threshold: float
    at_least: bool = False


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def completeness(df: DataFrame, fields: list[str], threshold: float = COMPLETENESS_AT_LEAST) -> list[Check]:
    """Missing means absent, null or empty; an empty table is 0 % complete."""
    return [Check("completeness", f, blank(_field(df, f)), threshold, True) for f in fields]


def in_range(field: str, low: float, high: float, threshold: float = OUT_OF_RANGE_BELOW) -> list[Check]:
    """Nulls and values that are no number do not count as out of range."""
    return [Check("range", field, out_of_range(field, low, high), threshold)]


def out_of_range(field: str, low: float, high: float) -> Column:
    value = F.col(field).try_cast("double")
    return F.coalesce((value < low) | (value > high), F.lit(False))


def _age_hours(field: str, as_of: str) -> tuple[Column, Column]:
    ts = F.col(field).cast("string").try_cast("timestamp")
    return ts, (epoch(F.lit(as_of).cast("timestamp")) - epoch(ts)) / 3600


def fresh(field: str, as_of: str, max_age_hours: float = 24, threshold: float = STALE_BELOW) -> list[Check]:
    _, age = _age_hours(field, as_of)
    return [Check("freshness", field, age > max_age_hours, threshold)]


def same_types(column: str, expected: dict[str, str], threshold: float = TYPE_MISMATCH_BELOW) -> list[Check]:
    """Types as sent: JSON text keeps ``"2"`` and ``2`` apart, and int and float are compatible."""
    # Expected type name -> JSON types that satisfy it.
    accepts = {"int": "number", "float": "number", "str": "string", "bool": "boolean", "dict": "object", "list": "array"}
    record = F.try_parse_json(column)
    out = []
    for name, wanted in expected.items():
        kind = F.schema_of_variant(F.variant_get(record, f"$.{name}", "variant"))
        bad = kind.isNotNull() & (kind != "VOID") & ~is_type(kind, accepts[wanted])
        out.append(Check("schema", name, bad, threshold))
    return out


def evaluate(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks over ``df`` in one aggregate, then one result row per check and field."""
    counts = df.agg(
        F.count("*").alias("total"), *[count_of(c.bad).alias(f"bad_{i}") for i, c in enumerate(checks)]
    )
    total = F.col("total")
    rows = []
    for i, c in enumerate(checks):
        bad = F.col(f"bad_{i}")
        value = percent(total - bad, total) if c.at_least else percent(bad, total)
        passed = value >= c.threshold if c.at_least else value < c.threshold
        if c.name == "schema":
            passed = passed & (total > 0)
        rows.append(
            F.struct(
                F.lit(c.name).alias("check"),
                F.lit(c.field).alias("field"),
                total.alias("total_records"),
                bad.alias("bad_records"),
                value.alias("percent"),
                F.lit(float(c.threshold)).alias("threshold"),
                passed.alias("passed"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def uniqueness(df: DataFrame, fields: list[str], threshold: float = DUPLICATES_BELOW) -> DataFrame:
    """Duplicates are non-null values beyond the distinct ones, as % of all rows."""
    total = F.col("total")
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count(f).alias(f"n_{i}") for i, f in enumerate(fields)],
        *[F.countDistinct(f).alias(f"u_{i}") for i, f in enumerate(fields)],
    )
    rows = []
    for i, f in enumerate(fields):
        bad = F.col(f"n_{i}") - F.col(f"u_{i}")
        rows.append(
            F.struct(
                F.lit("uniqueness").alias("check"),
                F.lit(f).alias("field"),
                total.alias("total_records"),
                bad.alias("bad_records"),
                percent(bad, total).alias("percent"),
                F.lit(float(threshold)).alias("threshold"),
                (percent(bad, total) < threshold).alias("passed"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def freshness_span(df: DataFrame, field: str, as_of: str) -> DataFrame:
    """Oldest and newest time, and how many values are no time at all."""
    ts, _ = _age_hours(field, as_of)
    return df.agg(
        F.min(ts).alias("oldest"),
        F.max(ts).alias("newest"),
        count_of(F.col(field).isNotNull() & ts.isNull()).alias("unparsable"),
    )


def examples(df: DataFrame, checks: list[Check], key: str, n: int = EXAMPLES) -> DataFrame:
    """The first ``n`` offending rows of each check.  Each check is a top-n of its own, so a task
    never keeps more than ``n`` rows, however many rows are bad."""
    out = None
    for c in checks:
        found = (
            df.where(c.bad)
            .select(
                F.lit(c.name).alias("check"),
                F.lit(c.field).alias("field"),
                F.col(key).alias("record_id"),
                _field(df, c.field).cast("string").alias("value"),
            )
            .orderBy("record_id")
            .limit(n)
        )
        out = found if out is None else out.unionByName(found)
    return out


def checks_passed(results: DataFrame) -> DataFrame:
    """Field rows folded to one row per check; a type check over no rows is not recorded."""
    return (
        results.where((F.col("check") != "schema") | (F.col("total_records") > 0))
        .groupBy("check")
        .agg(F.bool_and("passed").alias("passed"))
    )


def summary(checks: DataFrame) -> DataFrame:
    counted = checks.agg(F.count("*").alias("total_checks"), count_of(F.col("passed")).alias("passed"))
    failed = F.col("total_checks") - F.col("passed")
    return counted.select(
        "total_checks",
        "passed",
        failed.alias("failed"),
        percent("passed", "total_checks").alias("success_rate"),
        F.when(failed == 0, "PASS").otherwise("FAIL").alias("status"),
    )


# --- table checks with PASSED / WARNING / FAILED -------------------------------------------------


def expected_columns(df: DataFrame, expected: list[str], dataset: str) -> DataFrame:
    """Missing columns fail, extra ones warn.  Reads the schema only, no rows."""
    missing = sorted(set(expected) - set(df.columns))
    extra = sorted(set(df.columns) - set(expected))
    # Names of the checks, here and in table_checks.
    rows = [(dataset, "expected_columns_exist", "FAILED" if missing else "PASSED", ",".join(missing))]
    if extra:
        rows.append((dataset, "no_extra_columns", "WARNING", ",".join(extra)))
    return df.sparkSession.createDataFrame(rows, "dataset string, check string, status string, detail string")


def table_checks(df: DataFrame, dataset: str, rules: dict[str, dict] | None = None) -> DataFrame:
    """Non-empty, duplicate rows, nulls per column and custom rules from one aggregate.

    A rule is ``{"type": "range", "column": c, "min": a, "max": b}``; nulls pass and rules of
    another type pass.
    """
    rules = rules or {}
    broken = {}
    for name, rule in rules.items():
        bad = F.lit(False)
        if rule.get("type") == "range":
            value = F.col(rule["column"])
            if rule.get("min") is not None:
                bad = bad | (value < rule["min"])
            if rule.get("max") is not None:
                bad = bad | (value > rule["max"])
        broken[name] = F.coalesce(bad, F.lit(False))
    counts = df.agg(
        F.count("*").alias("total"),
        # a digest of the row is shuffled, not the row
        F.countDistinct(F.unhex(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))).alias("distinct_rows"),
        *[count_of(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)],
        *[count_of(b).alias(f"rule_{i}") for i, b in enumerate(broken.values())],
    )
    total = F.col("total")
    copies = total - F.col("distinct_rows")
    nulls = [percent(f"null_{i}", total) for i in range(len(df.columns))]
    worst = F.greatest(*nulls, F.lit(0.0), F.lit(0.0))
    with_nulls = F.concat_ws(",", *[F.when(n > 0, c) for n, c in zip(nulls, df.columns)])
    row = lambda check, status, detail: F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(check).alias("check"),
        status.alias("status"),
        detail.cast("string").alias("detail"),
    )
    graded = lambda bad, limit, p: (
        F.when(~bad, "PASSED").when(p > limit, "FAILED").otherwise("WARNING")
    )
    # Names of the checks.
    always = [row("non_empty_dataset", F.when(total > 0, "PASSED").otherwise("FAILED"), total)]
    if_rows = [
        row("duplicate_rows", graded(copies > 0, DUPLICATE_ROWS_FAIL_ABOVE, percent(copies, total)), copies),
        row("null_values", graded(worst > 0, NULLS_FAIL_ABOVE, worst), with_nulls),
        *[
            row(name, F.when(F.col(f"rule_{i}") > 0, "FAILED").otherwise("PASSED"), F.col(f"rule_{i}"))
            for i, name in enumerate(broken)
        ],
    ]
    return counts.select(
        F.inline(F.when(total > 0, F.array(*always, *if_rows)).otherwise(F.array(*always)))
    )


def score(results: DataFrame) -> DataFrame:
    """PASSED share of all checks; a warning lowers the score like a failure."""
    return results.agg(
        F.count("*").alias("checks"), count_of(F.col("status") == "PASSED").alias("passed_checks")
    ).withColumn("quality_score", percent("passed_checks", "checks"))


class QualityGateError(ValueError):
    """Raised by a job whose input broke a check that must hold."""


def gate(results: DataFrame) -> None:
    """Fails the run when a check failed, naming all that did (one row per check); call it after the rows were diverted."""
    failed = [r.check for r in results.where("status = 'FAILED'").select("check").collect()]
    if failed:
        raise QualityGateError("failed checks: " + ", ".join(failed))


# --- rates, dimensions, board --------------------------------------------------------------------


def overall_rates(df: DataFrame, required: list[str], key: str, value: str, low: float, high: float) -> DataFrame:
    """Null % over all required cells, duplicate-key % and out-of-range %, over all rows."""
    cells = sum((F.when(blank(_field(df, f)), 1).otherwise(0) for f in required), F.lit(0))
    # a null key is one more value here, hence the struct
    return df.agg(
        F.count("*").alias("total_records"),
        F.sum(cells).alias("null_count"),
        (F.count("*") - F.countDistinct(F.struct(key))).alias("duplicate_count"),
        count_of(out_of_range(value, low, high)).alias("out_of_range"),
    ).select(
        "*",
        percent("null_count", F.col("total_records") * len(required)).alias("null_percentage"),
        percent("duplicate_count", "total_records").alias("duplicate_percentage"),
        percent("out_of_range", "total_records").alias("range_percentage"),
    )


def timestamp_state(ts: Column, as_of: Column) -> Column:
    """Too far in the future, too old, or ok, against a reference time."""
    ahead = epoch(ts) - epoch(as_of)
    return (
        F.when(ts.isNull(), "missing")
        .when(ahead > MAX_FUTURE_SECONDS, "future")
        .when(ahead < -MAX_PAST_SECONDS, "past")
        .otherwise("ok")
    )


def thin_partitions(df: DataFrame, *partition: str, minimum: int = MIN_PARTITION_ROWS) -> DataFrame:
    return df.groupBy(*partition).agg(F.count("*").alias("records")).where(F.col("records") < minimum)


def valid_share(df: DataFrame, by: str, valid: Column) -> DataFrame:
    """Layer score: valid rows per event type in %."""
    return df.groupBy(by).agg(
        F.count("*").alias("total_ingested"), count_of(valid).alias("valid")
    ).select(
        by,
        "total_ingested",
        "valid",
        (F.col("total_ingested") - F.col("valid")).alias("invalid"),
        percent("valid", "total_ingested").alias("quality_score"),
    )


def dimension_scores(
    df: DataFrame,
    by: list[str],
    required: list[str],
    key: str,
    consistent: Column,
    accurate: Column,
    threshold: float,
) -> DataFrame:
    """Completeness, uniqueness, consistency, accuracy and their mean per group.  The distinct
    keys are counted per (group, key) first, so a group with most of the rows is spread out."""
    complete = sum((F.when(blank(f), 0).otherwise(1) for f in required), F.lit(0))
    total = F.col("total_records")
    counts = df.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        count_of(consistent & accurate).alias("valid_records"),
        F.sum(F.lit(len(required)) - complete).alias("null_count"),
        (F.count(key) - F.countDistinct(key)).alias("duplicate_count"),
        count_of(consistent).alias("consistent"),
        count_of(accurate).alias("accurate"),
    )
    scored = counts.select(
        *by,
        "total_records",
        "valid_records",
        (total - F.col("valid_records")).alias("invalid_records"),
        "null_count",
        "duplicate_count",
        (100 - percent("null_count", total * len(required))).alias("completeness_score"),
        (100 - percent("duplicate_count", total)).alias("uniqueness_score"),
        percent("consistent", total).alias("consistency_score"),
        percent("accurate", total).alias("accuracy_score"),
    )
    parts = ["completeness_score", "uniqueness_score", "consistency_score", "accuracy_score"]
    return scored.withColumn("overall_quality_score", sum(F.col(p) for p in parts) / 4).withColumn(
        "threshold_met", F.col("overall_quality_score") >= threshold
    )


def board(scores: DataFrame, dataset: str, at: str) -> DataFrame:
    """Per dataset: pass rate, failed checks, validated rows and the latest status."""
    return scores.groupBy(dataset).agg(
        F.count("*").alias("checks"),
        count_of(~F.col("threshold_met")).alias("failed_checks"),
        F.sum("total_records").alias("validated_records"),
        percent(count_of(F.col("threshold_met")), F.count("*")).alias("pass_rate"),
        F.max_by(F.when(F.col("threshold_met"), "PASS").otherwise("FAIL"), at).alias("latest_status"),
    )


# --- drift ---------------------------------------------------------------------------------------


def schema_changes(spark, old: StructType, new: StructType, defaults: frozenset[str] = frozenset()) -> DataFrame:
    """Field changes between two schema versions.  A new field is safe when it may be null or has
    a default; a removed field breaks unless it has a default; a changed type breaks."""
    before, after = {f.name: f for f in old}, {f.name: f for f in new}
    rows = []
    for name in sorted(before.keys() | after.keys()):
        if name not in before:
            rows.append((name, "added", not (after[name].nullable or name in defaults)))
        elif name not in after:
            rows.append((name, "removed", name not in defaults))
        elif before[name].dataType != after[name].dataType:
            rows.append((name, "retyped", True))
    return spark.createDataFrame(rows, "field string, change string, breaking boolean")


def observed_drift(df: DataFrame, payload: str, expected: list[str]) -> DataFrame:
    """Payload keys that were seen but not expected, and expected keys that are rare or absent.
    One row per key: keys are counted map-side and the expected list is a literal."""
    wanted = F.array(*[F.lit(k) for k in expected])
    counts = df.select(
        F.explode(F.array_union(F.map_keys(payload), wanted)).alias("field"), F.col(payload).alias("_p")
    ).groupBy("field").agg(
        F.count("*").alias("rows"), count_of(F.map_contains_key("_p", F.col("field"))).alias("seen")
    )
    kind = F.when(~F.col("field").isin(expected), "added").when(F.col("seen") == 0, "absent").otherwise("expected")
    return counts.select("field", "seen", kind.alias("state"))


def observed_types(df: DataFrame, payload: str, depth: int = 2) -> DataFrame:
    """(path, type, seen): how often each JSON type was sent under each key of the payload text, down to ``depth``.

    Integers and other numbers are types of their own.  Counts are formed in each task before the shuffle.
    """
    spark = df.sparkSession
    level = df.select(F.lit("").alias("path"), F.try_parse_json(payload).alias("value")).where("value IS NOT NULL")
    found = []
    for _ in range(depth):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select("key", F.col("value").alias("inner")))
        level = inner.where("key IS NOT NULL").select(
            F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key").alias("path"), F.col("inner").alias("value")
        )
        found.append(level.select("path", json_type(F.schema_of_variant("value")).alias("type")))
    return reduce(DataFrame.unionByName, found).groupBy("path", "type").agg(F.count(F.lit(1)).alias("seen"))


def json_type(kind: Column) -> Column:
    """The JSON type of a variant's type; null for null."""
    out = F.when(is_type(kind, "integer"), "integer")
    for name in ("number", "string", "boolean", "object", "array"):
        out = out.when(is_type(kind, name), name)
    return out.otherwise("null")


def type_drift(df: DataFrame, payload: str, contract: list[Field], depth: int = 2) -> DataFrame:
    """(path, expected, type, seen, state): what the payloads hold against what the contract says.

    ``added`` keys are not in the contract, ``missing`` ones in no payload, ``retyped`` ones come with another type;
    integers are numbers, and null is no type of its own where the contract allows it.
    """
    wanted = [(f.path, f.type, f.nullable) for f in contract if "[]" not in f.path and f.path.count(".") < depth]
    known = df.sparkSession.createDataFrame(wanted, "path string, expected string, nullable boolean")
    seen = observed_types(df, payload, depth)
    fits = (
        F.col("expected").isNull() | (F.col("type") == F.col("expected"))
        | ((F.col("expected") == "number") & (F.col("type") == "integer")) | (F.col("nullable") & (F.col("type") == "null"))
    )
    state = (
        F.when(F.col("nullable").isNull(), "added").when(F.col("type").isNull(), "missing")
        .when(fits, "expected").otherwise("retyped")
    )
    return seen.join(known, "path", "full_outer").select(
        "path", "expected", "type", F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen"), state.alias("state")
    )
