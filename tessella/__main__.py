"""Commands, each printing its seconds.

python -m tessella 0 [SCHEMA] [CSV] [OUT]: delimited text to columnar.
python -m tessella 1 [IN] [CSV] [SCHEMA]: columnar to delimited text.
python -m tessella workload TABLES OUT [QUERY...]: the analytic queries, each into OUT/result<i>.csv.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tessella.sources.convert import columnar_to_csv, csv_to_columnar

#: Paths that are taken where none are given.
DEFAULTS = {"0": ("schema.csv", "input.csv", "output.parquet"), "1": ("output.parquet", "output.csv", "output_schema.csv")}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("mode", choices=["0", "1", "workload"])
    parser.add_argument("paths", nargs="*", metavar="PATH", help="missing ones of modes 0 and 1 are " + "; ".join(f"{k}: {' '.join(v)}" for k, v in DEFAULTS.items()))
    parser.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks; each file is then one task")
    parser.add_argument("--overwrite", action="store_true", help="replace outputs that exist")
    args = parser.parse_args(argv)
    if args.mode == "workload" and len(args.paths) < 2:
        parser.error("workload needs the folder of the tables and the output folder")
    if args.mode != "workload" and len(args.paths) > 3:
        parser.error("too many paths")
    mode = "overwrite" if args.overwrite else "errorifexists"
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    began = time.perf_counter()
    if args.mode == "workload":
        from tessella.plans.sink import write_results

        write_results(spark, args.paths[0], args.paths[1], args.paths[2:] or None, mode)
    else:
        paths = [*args.paths, *DEFAULTS[args.mode][len(args.paths) :]]
        if args.mode == "0":
            csv_to_columnar(spark, *paths, multi_line=args.multi_line, mode=mode)
        else:
            columnar_to_csv(spark, *paths, mode=mode)
    print(f"{time.perf_counter() - began:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
