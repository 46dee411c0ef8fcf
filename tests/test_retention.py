"""Retention over folders of days, also after an abort between two of them."""

from datetime import date

import pytest

from strata.sinks import layers, retention

AS_OF = date(2024, 3, 1)


def land(spark, path, days):
    rows = [(k, d) for d in days for k in range(3)]
    layers.write_path(spark.createDataFrame(rows, "v int, day string"), path, ["day"])


def held(spark, path):
    try:
        rows = spark.read.schema("v int, day string").parquet(path).groupBy("day").count().collect()
    except Exception:
        return {}
    return {r.day: r["count"] for r in rows}


DAYS = ["2024-02-29", "2024-02-01", "2024-01-31", "2024-01-15", "2023-12-01", "2023-01-01"]


def test_days_are_archived_and_dropped_once(spark, tmp_path):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    land(spark, path, DAYS)
    assert retention.apply(spark, path, archive, "day", AS_OF, 30, 80) == 3
    # 30 days old is not older than 30 days
    assert held(spark, path) == {"2024-02-29": 3, "2024-02-01": 3, "2024-01-31": 3}
    assert held(spark, archive) == {"2024-01-15": 3}
    assert retention.apply(spark, path, archive, "day", AS_OF, 30, 80) == 0


@pytest.mark.parametrize("stop", [0, 1, 2, 3])
def test_a_stopped_run_is_completed(spark, tmp_path, monkeypatch, stop):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    land(spark, path, DAYS)
    whole, calls = retention.carry_out, []

    def stopped(spark, path, archive, column):
        """Carries out the first ``stop`` rows of the list only."""
        listed = f"{path}/{retention.LIST}"
        if not retention.exists(spark, f"{listed}/_SUCCESS") or calls:
            return whole(spark, path, archive, column)
        calls.append(1)
        rows = spark.read.schema(retention.PLAN).json(listed).orderBy("day").collect()[:stop]
        for day, action in rows:
            source = tmp_path / "t" / f"day={day}"
            if action == "archive":
                (tmp_path / "a").mkdir(exist_ok=True)
                source.rename(tmp_path / "a" / f"day={day}")
            else:
                for f in source.iterdir():
                    f.unlink()
                source.rmdir()
        raise RuntimeError("stopped")

    monkeypatch.setattr(retention, "carry_out", stopped)
    with pytest.raises(RuntimeError):
        retention.apply(spark, path, archive, "day", AS_OF, 30, 80)
    before = held(spark, path) | held(spark, archive)
    assert len(before) >= 4
    retention.apply(spark, path, archive, "day", AS_OF, 30, 80)
    active, archived = held(spark, path), held(spark, archive)
    assert set(active) == {"2024-02-29", "2024-02-01", "2024-01-31"} and set(archived) == {"2024-01-15"}
    assert sum(active.values()) + sum(archived.values()) + 3 * 2 == 3 * len(DAYS)
    assert not (tmp_path / "t" / retention.LIST).exists()


def test_archived_days_expire_and_late_days_replace_them(spark, tmp_path):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    land(spark, path, ["2024-01-15", "2024-02-29", "no-date"])
    retention.apply(spark, path, archive, "day", AS_OF, 30, 80)
    assert held(spark, archive) == {"2024-01-15": 3} and "no-date" in held(spark, path)
    spark.createDataFrame([(1, "2024-01-15")], "v int, day string").write.mode("append").partitionBy("day").parquet(path)
    retention.apply(spark, path, archive, "day", AS_OF, 30, 80)
    assert held(spark, archive) == {"2024-01-15": 1}
    retention.apply(spark, path, archive, "day", date(2024, 6, 1), 30, 80)
    assert held(spark, archive) == {} and held(spark, path) == {"no-date": 3}
