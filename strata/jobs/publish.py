"""spark-submit entry: one day of gold to the OLAP store."""

from __future__ import annotations

import argparse
import os

from strata.session import build
from strata.sinks import publish


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--date", required=True, help="processing date, YYYY-MM-DD")
    p.add_argument("--gold", required=True)
    p.add_argument("--url", required=True)
    p.add_argument("--driver", required=True)
    p.add_argument("--user", required=True)
    p.add_argument("--password-variable", default="OLAP_PASSWORD")
    a = p.parse_args(argv)
    spark = build(f"publish_{a.date}")
    target = lambda table: publish.jdbc_writer_options(
        a.url, a.driver, a.user, os.environ[a.password_variable], table
    )
    publish.publish_day(spark, lambda t: spark.read.parquet(f"{a.gold}/{t}"), target, a.date).show(truncate=False)


if __name__ == "__main__":
    main()
