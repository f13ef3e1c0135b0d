"""Command line: run the imaging steps over an acquisition folder, a table of frames, or a batch."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.runs import Run, run_batch
from .sources import folders, models, settings

logger = logging.getLogger(__name__)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pulsegrid")
    parser.add_argument("input", help="an acquisition folder or .holo file, a Parquet table of frames, or with -b a folder of these or a text file with a path on each line")
    parser.add_argument("-o", "--out", help="folder of the artifacts; beside the input by default")
    parser.add_argument("-c", "--config", help="settings JSON; wins over the input's own")
    parser.add_argument("-b", "--batch", action="store_true", help="many inputs; one that fails does not end the others")
    parser.add_argument("-t", "--targets", nargs="+", help="steps to reach; all by default")
    parser.add_argument("-d", "--debug", action="store_true", help="run the targets again and reuse all else that is there")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("--models", help="JSON or YAML file of models")
    parser.add_argument("--model-folder", help="folder with the models' files, or where they are downloaded with --download")
    parser.add_argument("--download", action="store_true")
    parser.add_argument("--layout", help="JSON of the artifacts' groups")
    parser.add_argument("--rendered", help="JSON of what is rendered, and how")
    parser.add_argument("--h5", help="folder for the artifacts as HDF5 files too (needs h5py)")
    parser.add_argument("--logs", help="folder of last_run.log")
    args = parser.parse_args(argv)
    settings.start_logging(args.logs, logging.DEBUG if args.verbose else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if "://" not in args.input and not Path(args.input).exists() and not args.input.endswith(".holo"):
        print(f"there is no {args.input}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    options = {"config": args.config, "debug": args.debug, "layout": args.layout, "rendered": args.rendered}
    if args.models:
        fetch = (models.hub_files if args.download else models.local_files)(args.model_folder or str(settings.user_folder() / "models"))
        options["models"] = models.Manager(models.Registry.from_file(args.models), fetch)
    if args.batch:
        failed = run_batch(spark, folders.batch(args.input), args.targets, args.out, **options).where("not ok").collect()
        for r in failed:
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
        return 1 if failed else 0
    run = Run(spark, args.input, args.out, **options)
    run(args.targets, lambda *e: logger.info("%s", " ".join(map(str, e))))
    if args.h5:
        run.export_h5(args.h5)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
