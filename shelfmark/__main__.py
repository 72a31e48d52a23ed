"""Command line: ``python -m shelfmark organize|scan|init``."""

from __future__ import annotations

import argparse
import os
import sys

from shelfmark import config as c

STATE = ".shelfmark"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="shelfmark")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("organize", "scan"):
        p = sub.add_parser(name)
        p.add_argument("directory", nargs="?", default=".")
        p.add_argument("-c", "--config")
        p.add_argument("-l", "--log-level", choices=("debug", "info", "warn", "error"))
        if name == "organize":
            p.add_argument("-d", "--dry-run", action="store_true")
            p.add_argument("--no-manifest", action="store_true")
            p.add_argument("-o", "--output")
    p = sub.add_parser("init")
    p.add_argument("-f", "--format", default="yaml")
    return out


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.appName("shelfmark").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


# The texts that the commands below print and log.


def init(kind: str) -> int:
    path = os.path.join(os.getcwd(), c.config_filename(c.validate_format(kind)))
    if os.path.exists(path):
        print(f"Config file already exists: {path}", file=sys.stderr)
        return 1
    c.save(c.Config(), path)
    print(f"✓ Created config file: {path}")
    return 0


def scan(args) -> int:
    from shelfmark.operators.summary import category_summary, operation_type_counts
    from shelfmark.plans.organizer import Organizer
    from shelfmark.sinks.console import Console

    cfg = c.with_overrides(c.load(args.config), dry_run=True, log_level=args.log_level)
    console, organizer = Console(), Organizer(session(), cfg, args.directory)
    files = organizer.scan()
    if files.isEmpty():
        console.info("No files found")
        return 0
    console.section("\nFile categories:")
    for row in category_summary(files).orderBy("first_index").collect():
        console.info(f"  {row['category']}: {row['n']} files")
    counts = {r["type"]: r["n"] for r in operation_type_counts(organizer.plan(files)).collect()}
    console.section(f"\nOperations needed: {sum(counts.values())}")
    for label, kind in (("Move", "move"), ("Rename", "rename"), ("Move + Rename", "move-rename")):
        console.info(f"  {label}: {counts[kind]}")
    return 0


def organize(args) -> int:
    from shelfmark.operators.summary import category_summary, outcome_counts
    from shelfmark.plans.organizer import Organizer
    from shelfmark.sinks.logger import Logger
    from shelfmark.tables import staged

    cfg = c.with_overrides(c.load(args.config), args.dry_run, not args.no_manifest, args.log_level, args.output)
    logger = Logger(cfg.log_level, cfg.log_file or os.path.join(os.getcwd(), STATE, "shelfmark.log"))
    organizer = Organizer(session(), cfg, args.directory, logger)
    logger.info(f"Target directory: {organizer.base}")
    if cfg.dry_run:
        logger.warn("Running in DRY RUN mode - no files will be modified")
    files = organizer.scan()
    if files.isEmpty():
        logger.info("No files found to organize")
        return 0
    logger.info("\nFile categories found:")
    for row in category_summary(files).orderBy("first_index").collect():
        logger.info(f"  {row['category']}: {row['n']} files")
    operations = staged(organizer.plan(files), "operations")
    if operations.isEmpty():
        logger.info("\n✓ All files are already organized!")
        return 0
    logger.info(f"\nPlanned operations: {operations.count()}")
    results = organizer.execute(operations)
    counts = outcome_counts(results).first()
    logger.info(f"✓ Completed: {counts['successful']} operations")
    if counts["failed"]:
        logger.error(f"✗ Failed: {counts['failed']} operations")
    if cfg.generate_manifest and not cfg.dry_run:
        folder = os.path.join(os.getcwd(), STATE)
        organizer.save_manifests(organizer.manifest(results), folder)
        logger.info(f"\nManifest files created in: {folder}")
    return 1 if counts["failed"] else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            return init(args.format)
        if not os.path.isdir(args.directory):
            print(f"Directory does not exist: {args.directory}", file=sys.stderr)
            return 1
        return {"scan": scan, "organize": organize}[args.command](args)
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
