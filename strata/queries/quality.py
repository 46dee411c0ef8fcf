"""Quality checks, contracts, drift and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import contracts, envelope
from strata.functions.columns import day_text, ts_text
from strata.operators import dlq, quality
from strata.queries import query
from strata.queries.cleaning import queue_records
from strata.queries.entity_sql import using

NOW = "2024-01-30 12:00:00"


def _result(check, field, total, bad, percent, threshold, passed):
    return (f"SELECT '{check}' AS \"check\", '{field}' AS field, {total} AS total_records, {bad} AS bad_records, "
            f"{percent} AS percent, CAST({threshold} AS DOUBLE) AS threshold, {passed} AS passed FROM a")


@query("Q1", using("dirty_events", a="""
        SELECT count(*) AS n, count(*) FILTER (WHERE user_id IS NULL) AS b0, count(*) FILTER (WHERE event_type = '') AS b1
        FROM dirty_events""") + " UNION ALL ".join([
    _result("completeness", "user_id", "n", "b0", "(n - b0) / n * 100", 95, "(n - b0) / n * 100 >= 95"),
    _result("completeness", "event_type", "n", "b1", "(n - b1) / n * 100", 95, "(n - b1) / n * 100 >= 95"),
    _result("completeness", "email", "n", "n", "0.0", 95, "false"),
]))
def completeness(e):
    df = e.dirty_events()
    return quality.evaluate(df, quality.completeness(df, ["user_id", "event_type", "email"]))


@query("Q2", using("dirty_events", a="""
        SELECT count(*) AS n, count(event_id) - count(DISTINCT event_id) AS b0, count(user_id) - count(DISTINCT user_id) AS b1
        FROM dirty_events""") + " UNION ALL ".join(
    _result("uniqueness", f, "n", b, f"{b} / n * 100", 1, f"{b} / n * 100 < 1")
    for f, b in (("event_id", "b0"), ("user_id", "b1"))))
def uniqueness(e):
    return quality.uniqueness(e.dirty_events(), ["event_id", "user_id"])


@query("Q3", using("dirty_events", a="""
        SELECT count(*) AS n, count(*) FILTER (WHERE amount < 0 OR amount > 200) AS b0 FROM dirty_events""")
       + _result("range", "amount", "n", "b0", "b0 / n * 100", 5, "b0 / n * 100 < 5"))
def value_range(e):
    return quality.evaluate(e.dirty_events(), quality.in_range("amount", 0, 200))


@query("Q3 L4", using("dirty_events") + """
    SELECT 'range' AS "check", 'event_id' AS field, event_id AS record_id, CAST(event_id AS VARCHAR) AS value
    FROM (SELECT DISTINCT event_id FROM dirty_events) WHERE event_id > 900 ORDER BY event_id LIMIT 10""")
def out_of_range_examples(e):
    return quality.examples(e.app_events(), quality.in_range("event_id", 0, 900), "event_id")


def json_events(e):
    """App events as JSON text, with defects that depend on the id: wrong id form, user id sent as
    text, device without system, lower-case country, negative amount."""
    mod = lambda n: F.col("event_id") % n == 0
    number = F.col("event_id").cast("string")
    return e.table("events").select(
        "event_id",
        F.concat(
            F.when(mod(17), '{"event_id":"bad_').otherwise('{"event_id":"evt_'), F.lpad(number, 10, "0"),
            F.lit('","user_id":'), F.when(mod(13), F.concat(F.lit('"'), F.col("user_id"), F.lit('"'))).otherwise(F.col("user_id").cast("string")),
            F.lit(',"session_id":"sess_'), F.lpad(number, 10, "0"), F.lit('","event_type":"'), F.col("event_type"),
            F.lit('","timestamp":"'), ts_text("ts"), F.lit('","device":{"type":"mobile"'),
            F.when(mod(11), "").otherwise(',"os":"iOS"'), F.lit('},"location":{"country":"'),
            F.when(mod(7), "vn").otherwise("VN"), F.lit('"},"amount":'),
            F.when(mod(29), -F.col("value")).otherwise(F.col("value")).cast("string"), F.lit("}"),
        ).alias("json"),
    )


@query("Q4", """
    WITH a AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 13 = 0) AS b0 FROM events) """ + " UNION ALL ".join([
    _result("schema", "user_id", "n", "b0", "b0 / n * 100", 2, "b0 / n * 100 < 2"),
    _result("schema", "event_type", "n", "CAST(0 AS BIGINT)", "0.0", 2, "true"),
    _result("schema", "amount", "n", "CAST(0 AS BIGINT)", "0.0", 2, "true"),
]))
def value_types(e):
    expected = {"user_id": "int", "event_type": "str", "amount": "float"}
    return quality.evaluate(json_events(e), quality.same_types("json", expected))


@query("Q5", f"""
    WITH a AS (SELECT count(*) AS n, count(*) FILTER (WHERE
        (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000 > 24) AS b0 FROM events) """
       + _result("freshness", "ts", "n", "b0", "b0 / n * 100", 10, "b0 / n * 100 < 10"))
def freshness(e):
    return quality.evaluate(e.table("events"), quality.fresh("ts", NOW))


@query("Q5", """
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS newest,
           CAST(0 AS BIGINT) AS unparsable FROM events""")
def freshness_span(e):
    span = quality.freshness_span(e.table("events"), "ts", NOW)
    return span.withColumns({c: ts_text(c) for c in ("oldest", "newest")})


@query("Q6", using("dirty_events", a="""
        SELECT count(*) FILTER (WHERE user_id IS NULL) / count(*) * 100 AS m, (count(event_id) - count(DISTINCT event_id)) / count(*) * 100 AS d,
               count(*) FILTER (WHERE amount < 0) / count(*) * 100 AS r FROM dirty_events""",
    b="SELECT (100 - m >= 95)::INT + (d < 1)::INT + (r < 5)::INT AS p FROM a") + """
    SELECT CAST(3 AS BIGINT) AS total_checks, CAST(p AS BIGINT) AS passed, CAST(3 - p AS BIGINT) AS failed,
           p / 3 * 100 AS success_rate, CASE WHEN p = 3 THEN 'PASS' ELSE 'FAIL' END AS status FROM b""")
def quality_summary(e):
    df = e.dirty_events()
    results = quality.evaluate(
        df, quality.completeness(df, ["user_id", "event_id"]) + quality.in_range("amount", 0, 100_000)
    ).unionByName(quality.uniqueness(df, ["event_id"]))
    return quality.summary(quality.checks_passed(results))


RULES = {
    "user_id_positive": {"type": "range", "column": "user_id", "min": 1},
    "amount_in_bounds": {"type": "range", "column": "amount", "min": -1000, "max": 1000},
}


_TABLE_CHECKS = using("dirty_events", c="""
        SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_events)) AS d,
               count(*) FILTER (WHERE user_id IS NULL) AS un, count(*) FILTER (WHERE user_id < 1) AS r0,
               count(*) FILTER (WHERE amount < -1000 OR amount > 1000) AS r1 FROM dirty_events""",
    r="""SELECT 'non_empty_dataset' AS "check", 'PASSED' AS status, CAST(n AS VARCHAR) AS detail FROM c
        UNION ALL SELECT 'duplicate_rows', CASE WHEN n = d THEN 'PASSED' WHEN (n - d) / n * 100 > 5 THEN 'FAILED' ELSE 'WARNING' END,
                         CAST(n - d AS VARCHAR) FROM c
        UNION ALL SELECT 'null_values', CASE WHEN un = 0 THEN 'PASSED' WHEN un / n * 100 > 50 THEN 'FAILED' ELSE 'WARNING' END, 'user_id' FROM c
        UNION ALL SELECT 'user_id_positive', CASE WHEN r0 > 0 THEN 'FAILED' ELSE 'PASSED' END, CAST(r0 AS VARCHAR) FROM c
        UNION ALL SELECT 'amount_in_bounds', CASE WHEN r1 > 0 THEN 'FAILED' ELSE 'PASSED' END, CAST(r1 AS VARCHAR) FROM c""")


@query("Q8 Q9", _TABLE_CHECKS + "SELECT 'app_events' AS dataset, \"check\", status, detail FROM r")
def table_checks(e):
    return quality.table_checks(e.dirty_events(), "app_events", RULES)


@query("Q15", _TABLE_CHECKS + """
    SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'PASSED') AS passed_checks,
           count(*) FILTER (WHERE status = 'PASSED') / count(*) * 100 AS quality_score FROM r""")
def quality_score(e):
    return quality.score(quality.table_checks(e.dirty_events(), "app_events", RULES))


@query("Q10", """
    SELECT event_id, concat_ws(',', CASE WHEN event_id % 17 = 0 THEN 'pattern:event_id' END,
        CASE WHEN event_id % 13 = 0 THEN 'type:user_id' WHEN user_id < 1 THEN 'minimum:user_id' END,
        CASE WHEN event_type NOT IN ('click', 'view', 'search', 'booking', 'rating', 'navigation') THEN 'enum:event_type' END,
        CASE WHEN event_id % 11 = 0 THEN 'missing:device.os' END,
        CASE WHEN event_id % 7 = 0 THEN 'pattern:location.country' END,
        CASE WHEN event_id % 29 = 0 AND value > 0 THEN 'minimum:amount' END) AS errors FROM events""")
def contract_errors(e):
    checked = contracts.validate(json_events(e), "json", contracts.APP_EVENT)
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"))


@query("Q11", """
    SELECT event_id % 31 <> 0 AS valid, CASE WHEN event_id % 31 = 0 THEN 'missing:data' ELSE '' END AS message, count(*) AS records
    FROM events GROUP BY ALL""")
def required_fields(e):
    # the decoded envelope drops null fields on the way, so absent keys show here
    fields = [contracts.Field(n, required=True) for n in ("source_name", "ingestion_timestamp", "data")]
    text = queue_records(e).select(F.try_parse_json(F.col("value").cast("string")).alias("record"))
    found = text.select(F.array_join(contracts.required_errors(F.col("record"), fields), ",").alias("message"))
    return found.groupBy((F.col("message") == "").alias("valid"), "message").agg(F.count("*").alias("records"))


@query("Q14", """
    SELECT * FROM (VALUES ('event_id', 'expected'), ('user_id', 'expected'), ('event_type', 'expected'),
                          ('amount', 'added'), ('region', 'absent')) v(field, state),
         LATERAL (SELECT CASE WHEN state = 'absent' THEN CAST(0 AS BIGINT) ELSE count(*) END AS seen
                  FROM events WHERE event_id % 31 <> 0 AND event_id % 19 <> 0)""")
def payload_drift(e):
    rows = envelope.with_validity(envelope.decode(queue_records(e))).where("is_valid")
    return quality.observed_drift(rows, "raw_data", ["event_id", "user_id", "event_type", "region"])


@query("Q16", f"""
    SELECT CASE WHEN (epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 1000000 > 300 THEN 'future'
                WHEN (epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 1000000 < -86400 THEN 'past' ELSE 'ok' END AS state,
           count(*) AS events FROM events GROUP BY ALL""")
def timestamp_sanity(e):
    state = quality.timestamp_state(F.col("ts"), F.lit(NOW).cast("timestamp"))
    return e.table("events").groupBy(state.alias("state")).agg(F.count("*").alias("events"))


@query("Q17", using("app_events") + """
    SELECT processing_date, region, count(*) AS records FROM app_events GROUP BY ALL HAVING count(*) < 100""")
def thin_partitions(e):
    return quality.thin_partitions(e.app_events(), "processing_date", "region")


_SCORES = using("dirty_events", c="""
        SELECT region, strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS n,
               count(*) FILTER (WHERE coalesce(amount >= 0 AND event_type = trim(event_type), false)) AS v,
               count(*) FILTER (WHERE user_id IS NULL) AS nulls, count(event_id) - count(DISTINCT event_id) AS dups,
               count(*) FILTER (WHERE event_type = trim(event_type)) AS cons, count(*) FILTER (WHERE amount >= 0) AS acc
        FROM dirty_events GROUP BY ALL""", s="""
        SELECT region, day, n AS total_records, v AS valid_records, n - v AS invalid_records,
               CAST(nulls AS BIGINT) AS null_count, dups AS duplicate_count,
               100 - nulls / (n * 2) * 100 AS completeness_score, 100 - dups / n * 100 AS uniqueness_score,
               cons / n * 100 AS consistency_score, acc / n * 100 AS accuracy_score FROM c""", t="""
        SELECT *, (completeness_score + uniqueness_score + consistency_score + accuracy_score) / 4 AS overall_quality_score,
               (completeness_score + uniqueness_score + consistency_score + accuracy_score) / 4 >= 92 AS threshold_met FROM s""")


def _scores(e):
    df = e.dirty_events().withColumn("day", day_text("timestamp"))
    trimmed = F.col("event_type") == F.trim("event_type")
    return quality.dimension_scores(
        df, ["region", "day"], ["user_id", "region"], "event_id", trimmed, F.col("amount") >= 0, 92
    )


@query("Q18", _SCORES + "SELECT * FROM t")
def dimension_scores(e):
    return _scores(e)


@query("Q22", _SCORES + """
    SELECT region, count(*) AS checks, count(*) FILTER (WHERE NOT threshold_met) AS failed_checks,
           CAST(sum(total_records) AS BIGINT) AS validated_records,
           count(*) FILTER (WHERE threshold_met) / count(*) * 100 AS pass_rate,
           CASE WHEN max_by(threshold_met, day) THEN 'PASS' ELSE 'FAIL' END AS latest_status FROM t GROUP BY region""")
def quality_board(e):
    return quality.board(_scores(e), "region", "day")


@query("Q19", using("dirty_events", a="""
        SELECT count(*) AS n, count(*) FILTER (WHERE user_id IS NULL) + count(*) FILTER (WHERE event_type = '') AS m,
               count(*) - count(DISTINCT event_id) AS d, count(*) FILTER (WHERE amount < 0 OR amount > 300) AS r FROM dirty_events""") + """
    SELECT n AS total_records, m AS null_count, d AS duplicate_count, r AS out_of_range,
           m / (n * 2) * 100 AS null_percentage, d / n * 100 AS duplicate_percentage, r / n * 100 AS range_percentage FROM a""")
def overall_rates(e):
    return quality.overall_rates(e.dirty_events(), ["user_id", "event_type"], "event_id", "amount", 0, 300)


@query("Q21", using("app_events") + """
    SELECT event_type, count(*) AS total_ingested, count(*) FILTER (WHERE amount >= 5) AS valid,
           count(*) FILTER (WHERE amount < 5) AS invalid, count(*) FILTER (WHERE amount >= 5) / count(*) * 100 AS quality_score
    FROM app_events GROUP BY ALL""")
def valid_share(e):
    return quality.valid_share(e.app_events(), "event_type", F.col("amount") >= 5)


# --- dead letters --------------------------------------------------------------------------------


def dead_letters(e):
    """Contract failures of the app events; retry counts grow with the id."""
    bad = contracts.validate(json_events(e), "json", contracts.APP_EVENT).where(~F.col("is_valid"))
    return dlq.letters(
        bad, "json", "app_events", F.lit(NOW).cast("timestamp"), errors="errors",
        retry_count=(F.col("event_id") % 5).cast("int"),
    )


_BAD = """
    WITH bad AS (SELECT *, CAST(event_id % 5 AS INT) + 1 AS retries FROM events WHERE event_id % 17 = 0 OR event_id % 13 = 0 OR user_id < 1
        OR event_type NOT IN ('click', 'view', 'search', 'booking', 'rating', 'navigation') OR event_id % 11 = 0
        OR event_id % 7 = 0 OR (event_id % 29 = 0 AND value > 0)) """


@query("X1 X3", _BAD + """
    SELECT 'dlq_schema_validation_errors' AS queue, 'ValueError' AS error_type, retries AS retry_count, count(*) AS messages
    FROM bad GROUP BY retries""")
def dead_letter_queues(e):
    return dead_letters(e).groupBy("queue", F.col("error.type").alias("error_type"), "retry_count").agg(
        F.count("*").alias("messages")
    )


@query("X3", _BAD + "SELECT 'dlq_schema_validation_errors' AS queue, count(*) AS message_count FROM bad")
def dead_letter_stats(e):
    return dlq.stats(dead_letters(e))


@query("X2", _BAD + """
    SELECT CASE WHEN retries >= 3 THEN 'skipped' ELSE 'retried' END AS outcome, count(*) AS messages FROM bad GROUP BY ALL""")
def dead_letter_replay(e):
    return dlq.replay_stats(dlq.replay(dead_letters(e)))


_DRIFT = [f for f in contracts.APP_EVENT if f.path not in ("amount", "location.country", "location")] + [contracts.Field("location", "string")]


@query("Q14", """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 13 = 0) AS t, count(*) FILTER (WHERE event_id % 11 <> 0) AS o FROM events),
    seen AS (
      SELECT unnest(['event_id', 'session_id', 'event_type', 'timestamp', 'device', 'device.type']) AS path,
             unnest(['string', 'string', 'string', 'string', 'object', 'string']) AS expected, n AS seen, 'expected' AS state FROM n
      UNION ALL SELECT 'user_id', 'integer', n - t, 'expected' FROM n UNION ALL SELECT 'user_id', 'integer', t, 'retyped' FROM n
      UNION ALL SELECT 'device.os', 'string', o, 'expected' FROM n
      UNION ALL SELECT 'location', 'string', n, 'retyped' FROM n UNION ALL SELECT 'location.country', NULL, n, 'added' FROM n
      UNION ALL SELECT 'amount', NULL, n, 'added' FROM n
      UNION ALL SELECT unnest(['action', 'tour_id', 'device.version', 'device.browser', 'location.city', 'location.region', 'location.latitude', 'location.longitude', 'metadata']),
                unnest(['string', 'string', 'string', 'string', 'string', 'string', 'number', 'number', 'object']), 0, 'missing' FROM n)
    SELECT path, expected, CAST(seen AS BIGINT) AS seen, state FROM seen""")
def payload_types(e):
    """The JSON events against a contract that knows no amount and no country, and a location sent as text."""
    found = quality.type_drift(json_events(e), "json", _DRIFT)
    return found.groupBy("path", "expected", "state").agg(F.sum("seen").alias("seen"))


@query("Q10 P19 P20", """
    SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN '' WHEN event_id % 7 = 3 THEN 'several:data'
                          WHEN event_id % 7 = 4 THEN 'none:data' WHEN event_id % 7 = 5 THEN 'none:data' ELSE 'missing:data' END AS errors FROM events""")
def external_record_errors(e):
    """External records whose data is a forecast, a place, a post, none of them by a wrong item, or any of them."""
    n = F.col("event_id") % 7
    data = (
        F.when(n == 0, '{"current":{"temp":21.5,"humidity":"wet"},"place_id":7,"post_id":"p","sentiment":"neutral"}')
        .when(n == 1, '{"current":"warm","place_id":"x","rating":4.5,"sentiment":"angry"}')
        .when(n == 2, '{"forecast":[{"date":"2024-01-01","temp_min":1},{"date":"2024-01-02"}],"rating":9,"engagement":{"likes":-1}}')
        .when(n == 3, '{"anything":1}')
        .when(n == 4, '{"forecast":[{"date":"2024-01-01"},{"date":"soon"}],"rating":9,"engagement":{"likes":-1}}')
        .when(n == 5, '{"current":{"humidity":101},"name":1,"text":2}')
    )
    text = F.concat(
        F.lit('{"source":"openweather","data_type":"weather","timestamp":"'), ts_text("ts"), F.lit('"'),
        F.coalesce(F.concat(F.lit(',"data":'), data), F.lit("")), F.lit("}"),
    )
    checked = contracts.validate(e.table("events").select("event_id", text.alias("json")), "json", contracts.EXTERNAL, [contracts.EXTERNAL_DATA])
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"))
