"""spark-submit entry: one day from bronze to silver."""

from __future__ import annotations

import argparse

from strata.plans import medallion
from strata.plans.tracking import tracked
from strata.session import build


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--date", required=True, help="processing date, YYYY-MM-DD")
    p.add_argument("--bronze", required=True)
    p.add_argument("--silver", required=True)
    p.add_argument("--audit", required=True, help="folder of run, lineage and metric records")
    p.add_argument("--dead-letters", help="turns on the governed run")
    a = p.parse_args(argv)
    spark = build(f"bronze_to_silver_{a.date}")
    events = medallion.bronze_events(spark, a.bronze, a.date)
    dead = a.dead_letters or f"{a.silver}/_dead_letters"
    with tracked(spark, a.audit, "medallion", "bronze_to_silver") as run:
        if a.dead_letters:
            expected = list(medallion.EVENT_FIELDS)
            medallion.governed_bronze_to_silver(
                spark, events, a.silver, a.dead_letters, a.audit, a.date, expected
            ).show()
        else:
            counts = medallion.bronze_to_silver(events, a.silver, a.date)
            run.source("app_events", counts["records_before"], counts["records_after"])
            print(counts)
        print(medallion.other_silver(spark, a.bronze, a.silver, dead, a.date))


if __name__ == "__main__":
    main()
