"""spark-submit job: the texts of all files below a path, scored or rewritten.

python -m prosemeter INPUT OUTPUT [--rewrite] [--fmt txt|docx|pdf]; exit code 1 if no file had a text.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import sentences
from .operators import issues, transforms
from .sources import files


def main() -> int:
    parser = argparse.ArgumentParser(prog="prosemeter", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--rewrite", action="store_true")
    parser.add_argument("--fmt", choices=("txt", "docx", "pdf"), default="txt")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    read = files.read_files(spark, args.input)
    text = transforms.rewrite(F.col("text")) if args.rewrite else F.col("text")
    out = read.withColumn("text", text).withColumn("issues", issues.distinct_issues(issues.checks(F.col("text"), sentences(F.col("text")))))
    out = out.select("path", "fmt", "error", "text", issues.naturalness(F.col("issues")).alias("score"), "issues", files.exported(F.col("text"), F.lit(args.fmt)).alias("content"))
    out.write.mode("overwrite").parquet(args.output)
    return 0 if not spark.read.parquet(args.output).where("error IS NULL").isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
