"""Command line: ``python -m keelson.cli JOB --config FILE``."""

from __future__ import annotations

import argparse
import logging

from keelson import config as configs
from keelson.plans import jobs
from keelson.session import get_spark
from keelson.sources.store import Table
from keelson.streaming import dedupe as streaming

JOBS = ("ingest", "bronze", "silver", "gold", "all", "history", "show", "reset-checkpoints")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keelson", description=__doc__)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--config", required=True, help="JSON file with sources, root, connections and schemas, at any URI that Spark reads")
    p.add_argument("--source", help="only this source, in any case")
    p.add_argument("--mode", choices=("batch", "streaming"), default="batch", help="of the job bronze")
    p.add_argument("--available-now", action="store_true", help="streaming: stop when all that is there has been read")
    p.add_argument("--change-column", choices=("ingestion_ts", "updated_ts"), default="ingestion_ts")
    p.add_argument("--table", help="history and show: the table's folder")
    p.add_argument("--version", type=int)
    p.add_argument("--timestamp")
    p.add_argument("--master")
    p.add_argument("--log-file")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(filename=args.log_file, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = get_spark(f"keelson-{args.job}", args.master)
    config = configs.load(args.config, spark)
    if args.job in ("history", "show"):
        table = Table(spark, args.table)
        (table.history() if args.job == "history" else table.read(args.version, args.timestamp)).show(truncate=False)
        return 0
    if args.job == "reset-checkpoints":
        jobs.reset_checkpoints(spark, config)
        return 0
    if args.job == "bronze" and args.mode == "streaming":
        streaming.wait(spark, streaming.dedupe_all(spark, config, args.source, args.available_now), args.available_now)
        return 0
    if args.job == "all":
        runs = jobs.run_all(spark, config, change_column=args.change_column)
    elif args.job == "ingest":
        runs = [jobs.ingest(spark, config, args.source)]
    elif args.job == "bronze":
        runs = [jobs.bronze(spark, config, args.source, args.change_column)]
    else:
        runs = [getattr(jobs, args.job)(spark, config)]
    for run in runs:
        for o in run.outcomes:
            logging.info("%s %s %s: %s in, %s inserted, %s conflicted, %s", run.job_name, o.target, o.load_type, o.incoming, o.inserted, o.conflicted, o.status)
    return int(any(r.status == "FAILED" for r in runs))


if __name__ == "__main__":
    raise SystemExit(main())
