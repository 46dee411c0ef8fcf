"""spark-submit entry: message queue to bronze, until stopped."""

from __future__ import annotations

import argparse

from strata.session import build
from strata.sources import queue
from strata.streaming import ingest
from strata.streaming.monitor import ProgressSamples


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--servers", required=True)
    p.add_argument("--bronze", required=True)
    p.add_argument("--dead-letters", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--metrics", required=True, help="folder of the progress samples")
    p.add_argument("--max-offsets", type=int, default=queue.MAX_OFFSETS_PER_TRIGGER, help="records per trigger")
    p.add_argument("--fail-on-loss", action="store_true", help="stop when offsets are gone before they were read")
    a = p.parse_args(argv)
    spark = build("stream_intake")
    spark.streams.addListener(ProgressSamples(spark, a.metrics))
    records = queue.kafka_stream(spark, a.servers, limit=a.max_offsets, fail_on_loss=a.fail_on_loss)
    ingest.start(records, a.bronze, a.dead_letters, a.checkpoint).awaitTermination()


if __name__ == "__main__":
    main()
