"""Command line: ``python -m vigil.cli -i KIND -p PATH --root ROOT``."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import functions as F

from vigil.session import build_session
from vigil.sinks import ingest


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Ingest raw security logs and feeds.")
    kinds = [*ingest.LOG_KINDS, *ingest.FEED_KINDS, ingest.ALL]
    parser.add_argument("-i", "--ingest", action="append", choices=kinds, required=True)
    parser.add_argument("-p", "--path", action="append", required=True)
    parser.add_argument("--root", required=True, help="folder of the tables")
    parser.add_argument("--rejects", help="folder for lines no format fits (default: below the root)")
    parser.add_argument("--year", type=int, help="year of syslog stamps")
    parser.add_argument(
        "--asof", type=datetime.date.fromisoformat, help="day the logs arrived (default: today)"
    )
    parser.add_argument(
        "--by-day", action="store_true", help="each input file holds one day: write without a shuffle"
    )
    parser.add_argument("--run", help="name of the run: the same one again replaces what it wrote")
    args = parser.parse_args(argv)
    spark = build_session("vigil ingest")
    asof = F.lit(args.asof) if args.asof else None
    for kind in args.ingest:
        if kind in ingest.FEED_KINDS:
            ingest.ingest_feed(spark, kind, args.path, args.root)
        else:
            ingest.ingest_logs(
                spark, kind, args.path, args.root, asof, args.year, args.rejects, args.by_day, args.run
            )


if __name__ == "__main__":
    main()
