"""python -m lodestream [--start-url URL] [--domain HOST] [--index PATH]: the shell."""

import argparse
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from lodestream.shell import Shell
from lodestream.shipping import ship


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestream", description="Full-text search shell")
    parser.add_argument("--start-url", default="", help="where a build begins to crawl")
    parser.add_argument("--domain", default="", help="host to stay on (of the start URL unless given)")
    parser.add_argument("--index", default="data/index.json", help="file that build writes and load reads")
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("lodestream").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    Shell(spark, got.start_url, got.domain or urlsplit(got.start_url).hostname or "", got.index).loop()


if __name__ == "__main__":
    main()
