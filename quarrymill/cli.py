"""Command line: scan a folder with rules and write the tables as Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark import SparkConf
from pyspark.sql import SparkSession

from quarrymill.engine import CODECS, Engine
from quarrymill.sources.config import signature_file

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrymill", description=__doc__)
    p.add_argument("output", metavar="OUTPUT", help="folder for the tables")
    p.add_argument("input", metavar="INPUT", help="folder to scan")
    p.add_argument("-f", "--rule-file", action="append", default=[])
    p.add_argument("-F", "--rule-folder", action="append", default=[])
    p.add_argument("-s", "--signature-file", help="magic signatures as JSON")
    p.add_argument("-k", "--keyword-file", action="append", default=[])
    p.add_argument("-j", "--cores", type=int, help="cores at most; all by default")
    p.add_argument("--codec", choices=CODECS, default="lz4")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def session(cores: int | None = None) -> SparkSession:
    """A session on the master that spark-submit names; where none is named, a local one."""
    builder = SparkSession.builder.appName("quarrymill")
    if SparkConf().contains("spark.master"):
        return (builder.config("spark.cores.max", cores) if cores else builder).getOrCreate()
    return builder.master(f"local[{cores or '*'}]").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or session(args.cores)
    engine = Engine(spark)
    for path in args.rule_file:
        engine.load_rule_file(path)
    for path in args.rule_folder:
        engine.load_rule_folder(path)
    if args.keyword_file:
        engine.load_keywords(*args.keyword_file)
    if args.signature_file:
        engine.with_signatures(signature_file(args.signature_file))
    for error in engine.errors:
        print(error, file=sys.stderr)
    engine.scan(args.input).export(args.output, args.codec)
    return 0


if __name__ == "__main__":
    sys.exit(main())
