"""python -m trimlake.cli [-r] [-q] [-j] [-o FILE] PATH...: optimise files, beside themselves or into FILE."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trimlake.operators.ooxml import Options
from trimlake.plans.optimize import batch_totals, format_bytes, optimize_documents, text_report
from trimlake.sources.files import scan_files, write_files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trimlake", description=__doc__)
    parser.add_argument("paths", nargs="*")
    parser.add_argument("-r", "--recursive", action="store_true")
    parser.add_argument("-q", "--quiet", action="store_true")
    parser.add_argument("-j", "--json", action="store_true")
    parser.add_argument("-o", "--output")
    parser.add_argument("--risky", action="store_true", help="also passes that change settings, themes and properties")
    a = parser.parse_args(args)
    there = [p for p in a.paths if "://" in p or Path(p).exists()]
    for p in set(a.paths) - set(there):
        print(f"Warning: {p} does not exist", file=sys.stderr)
    if not there:
        parser.print_usage(sys.stderr)
        return 1
    spark = SparkSession.builder.appName("trimlake").getOrCreate()
    results = optimize_documents(scan_files(spark, *there, recursive=a.recursive), Options(risky=a.risky)).persist()
    if a.output and results.count() == 1:
        row = results.first()
        if row["success"]:
            Path(a.output).write_bytes(row["content"])
    else:
        write_files(results).count()
    if not a.quiet:
        for r in text_report(results).toLocalIterator():
            print(r["json"] if a.json else r["line"])
        if not a.json:
            for r in batch_totals(results).withColumn("from", format_bytes(F.col("original_size"))).withColumn("to", format_bytes(F.col("optimized_size"))).collect():
                print(f"{r['format']}: {r['optimized']} of {r['files']} files, {r['from']} -> {r['to']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
