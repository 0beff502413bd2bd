"""python -m tracewell.cli lineage --sql-folder DIR --output PATH [--schema JSON | --schema-file F | --schema-csv F] [--mode M]
python -m tracewell.cli chains INPUT_CSV OUTPUT_PATH

An output path that ends in .csv is one file, any other a folder.

Exit codes: 0 done, 1 a schema that cannot be read or wrong arguments, 2 no SQL files.
"""

from __future__ import annotations

import argparse
import glob
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from . import sinks
from .engine import LineageEngine
from .operators import chains
from .operators.records import MODES, RECORD
from .sources.catalog import catalog_from_csv, catalog_from_json, read_json
from .sources.scripts import read_lineage, read_scripts

log = logging.getLogger("tracewell")


def _schema(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The CSV file goes before the JSON file, that before the inline JSON, that before ./schema.json."""
    if args.schema_csv:
        if not os.path.exists(args.schema_csv):
            raise FileNotFoundError(args.schema_csv)
        return catalog_from_csv(spark, args.schema_csv)
    if args.schema_file:
        return catalog_from_json(spark, read_json(args.schema_file))
    if args.schema:
        return catalog_from_json(spark, json.loads(args.schema))
    try:
        return catalog_from_json(spark, read_json("schema.json") if os.path.exists("schema.json") else {})
    except ValueError as error:
        log.warning("schema.json is not read: %s", error)
        return catalog_from_json(spark, {})


def with_overlays(base: DataFrame, folder: str) -> DataFrame:
    """base, and for each script with a ``<script>_schema.json`` beside it the tables of that file as its own."""
    spark, out = base.sparkSession, base
    for path in sorted(glob.glob(os.path.join(folder, "**", "*_schema.json"), recursive=True)):
        script = os.path.abspath(path.removesuffix("_schema.json") + ".sql")
        try:
            out = out.unionByName(catalog_from_json(spark, read_json(path), script))
        except ValueError as error:
            log.debug("%s is not read: %s", path, error)
    return out


def lineage(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        catalog = _schema(spark, args)
    except (OSError, ValueError) as error:
        log.error("the schema cannot be read: %s", error)
        return 1
    scripts = read_scripts(spark, args.sql_folder)
    if scripts.isEmpty():
        log.error("no SQL files in %s", args.sql_folder)
        return 2
    found = LineageEngine(spark, with_overlays(catalog, args.sql_folder), args.engines.split(",")[0], args.mode).extract(scripts)
    if args.show:
        found.show(1000, truncate=False)
    n = sinks.write_csv(found, args.output, RECORD)
    log.info("%d rows of lineage in %s", n, args.output)
    return 0


def chain(spark: SparkSession, args: argparse.Namespace) -> int:
    steps = chains.chain_steps(read_lineage(spark, args.input)).cache()
    n = sinks.write_csv(steps, args.output, chains.STEP)
    steps.orderBy(*chains.STEP).limit(10).show(truncate=False)
    log.info("%d steps", n) if n else log.info("no chains found, nothing is written")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Column lineage of SQL scripts")
    parser.add_argument("--log-level", default=os.getenv("LOG_LEVEL", "INFO"))
    kinds = parser.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("lineage")
    for flag, value in (("--sql-folder", "sql"), ("--engines", "spark,hive"), ("--output", "lineage_csv"), ("--schema", None), ("--schema-file", None), ("--schema-csv", None)):
        one.add_argument(flag, default=value)
    one.add_argument("--mode", default="compat", choices=MODES)
    one.add_argument("--show", action="store_true")
    two = kinds.add_parser("chains")
    two.add_argument("input")
    two.add_argument("output")
    try:
        args = parser.parse_args(argv)
    except SystemExit as stop:
        return 1 if stop.code else 0
    logging.basicConfig(level=args.log_level, stream=sys.stdout)
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    return lineage(spark, args) if args.command == "lineage" else chain(spark, args)


if __name__ == "__main__":
    sys.exit(main())
