"""Command line: ``python -m graphwright.cli process TEXTS OUT`` and ``config --show | --validate``."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphwright.plans.config import Config
from graphwright.plans.pipeline import extract_knowledge, write_artifacts
from graphwright.sources.loader import load_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphwright")
    commands = parser.add_subparsers(dest="command", required=True)
    process = commands.add_parser("process", help="texts to a knowledge graph")
    process.add_argument("input")
    process.add_argument("output")
    process.add_argument("--language", default=None)
    settings = commands.add_parser("config", help="show or check the settings")
    settings.add_argument("--show", action="store_true")
    settings.add_argument("--validate", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    config = Config.from_env()
    if args.command == "config":
        problems = config.problems()
        print(json.dumps({"problems": problems} if args.validate else config.to_dict(), indent=2))
        return int(bool(args.validate and problems))
    if args.language:
        config = config.with_(language=args.language)
    spark = SparkSession.builder.appName("graphwright").getOrCreate()
    texts = load_files(spark, args.input).select(F.col("path").alias("doc_id"), "text")
    result = extract_knowledge(texts, config)
    write_artifacts(result, args.output)
    logging.info("counts %s", result.counts().first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
