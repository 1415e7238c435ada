"""Command line of the step runner.

``python -m orbitframe.cli module:STEPS --cities a b --out DIR --first 2 --workers 4``

``module:STEPS`` names a list of ``orchestrate.Step``. Exit codes: 0 all cities
done, 1 a city failed or there is none, 2 wrong arguments, 130 interrupted.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import sys

from pyspark.sql import SparkSession

from orbitframe.plans import orchestrate
from orbitframe.sources import geotiff

#: More cities side by side than this draw a warning.
MANY_WORKERS = 8


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orbitframe", description="Runs the steps of cities, resuming what is done.")
    p.add_argument("steps", help="module:NAME of a list of steps")
    p.add_argument("--out", required=True, help="folder of outputs and the run log")
    p.add_argument("--cities", nargs="*", default=None, help="names; without them, all folders with scenes under --raw")
    p.add_argument("--raw", nargs="*", default=[], help="folders to look for cities in, the first that has any")
    p.add_argument("--first", type=int, default=1, help="first step")
    p.add_argument("--last", type=int, default=None, help="last step")
    p.add_argument("--workers", type=int, default=4, help="cities side by side")
    p.add_argument("--keep", nargs="*", default=None, help="clean up intermediate steps of all cities but these")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    args = parser().parse_args(argv)
    if args.workers < 1 or (args.last is not None and args.first > args.last):
        parser().print_usage(sys.stderr)
        return 2
    if args.workers > MANY_WORKERS:
        logging.warning("%d workers share the executors of one session", args.workers)
    module, _, name = args.steps.partition(":")
    steps = getattr(importlib.import_module(module), name or "STEPS")
    spark = spark or SparkSession.builder.appName("orbitframe").getOrCreate()
    try:
        cities = args.cities if args.cities is not None else [r["city"] for r in geotiff.discover_cities(spark, *args.raw).collect()]
        if not cities:
            logging.error("no cities")
            return 1
        workers = 1 if len(cities) == 1 else args.workers
        log = orchestrate.run_cities(spark, steps, cities, args.out, args.first, args.last, workers)
        failed = sorted({r["city"] for r in log.where("status = 'failed'").collect()})
        if args.keep is not None:
            done = [c for c in cities if c not in failed]
            orchestrate.clean_up(spark, args.out, [s.name for s in steps[:-1]], done, tuple(args.keep))
        logging.info("%d of %d cities done%s", len(cities) - len(failed), len(cities), f"; failed: {', '.join(failed)}" if failed else "")
        return 1 if failed else 0
    except ValueError as wrong:
        logging.error("%s", wrong)
        return 2
    except KeyboardInterrupt:
        logging.warning("interrupted; a rerun goes on where this one stopped")
        return 130


if __name__ == "__main__":
    sys.exit(main())
