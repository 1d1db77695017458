"""Assess a source tree from the command line: python -m corpusweave SOURCE --output FOLDER."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from corpusweave import runtime
from corpusweave.plans.assess import assess
from corpusweave.sinks import reports
from corpusweave.sources import scan


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusweave", description="Licence assessment of a source tree, archives included.")
    parser.add_argument("source", nargs="?", help="folder, file or address; by default SOURCE_DIR of the properties")
    parser.add_argument("--output", help="folder for report.csv and the snapshot")
    parser.add_argument("--previous", help="snapshot of an earlier run to compare with")
    parser.add_argument("--properties", help="file of key=value lines")
    parser.add_argument("--texts", action="append", default=[], help="folder of licence texts (repeatable)")
    parser.add_argument("--headers", action="append", default=[], help="folder of licence headers (repeatable)")
    parser.add_argument("--cpus", default="*", help="cores of a local session; a cluster's session is taken as it is")
    given = parser.parse_args(arguments)
    config = scan.Config.of(scan.load_properties(given.properties) if given.properties else {}, given.source)
    config = dataclasses.replace(
        config, output=given.output or config.output, previous=given.previous or config.previous, full_texts=tuple(given.texts) or config.full_texts, headers=tuple(given.headers) or config.headers
    )
    if not config.source:
        parser.error("no source")
    spark, timer = runtime.session("corpusweave", given.cpus), reports.Timer()
    with runtime.scope():
        with timer.stage("assess"):
            result = assess(spark, config)
        with timer.stage("report"):
            reports.write_csv(result.files, f"{config.output}/report.csv")
        with timer.stage("snapshot"):
            reports.write_snapshot(result.files, f"{config.output}/snapshot")
        counted = reports.totals(result.files).first().asDict()
        if result.changed is not None:
            counted |= {"changed": result.changed.count(), "removed": result.removed.count()}
    print(" ".join(f"{k}={v}" for k, v in counted.items()), *(f"{k}={v:.1f}s" for k, v in timer.took.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
