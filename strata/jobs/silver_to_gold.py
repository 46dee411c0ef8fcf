"""spark-submit entry: one day from silver to gold."""

from __future__ import annotations

import argparse

from strata.plans import medallion
from strata.plans.tracking import tracked
from strata.session import build


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--date", required=True, help="processing date, YYYY-MM-DD")
    p.add_argument("--silver", required=True)
    p.add_argument("--gold", required=True)
    p.add_argument("--audit", required=True, help="folder of run records")
    a = p.parse_args(argv)
    spark = build(f"silver_to_gold_{a.date}")
    silver = spark.read.parquet(f"{a.silver}/{medallion.SILVER}")
    with tracked(spark, a.audit, "medallion", "silver_to_gold"):
        medallion.silver_to_gold(spark, silver, a.gold, a.date)


if __name__ == "__main__":
    main()
