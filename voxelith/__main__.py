"""Command line: convert, info, merge, export."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def boolean(text: str) -> bool:
    if text.lower() in ("yes", "true", "t", "y", "1"):
        return True
    if text.lower() in ("no", "false", "f", "n", "0"):
        return False
    raise argparse.ArgumentTypeError("expected true or false")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxelith", description=__doc__)
    p.add_argument("--verbose", type=int, default=0)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="point clouds to a tileset")
    c.add_argument("files", nargs="+")
    c.add_argument("--out", default="./tileset")
    c.add_argument("--overwrite", type=boolean, default=False)
    c.add_argument("--srs_in")
    c.add_argument("--srs_out")
    c.add_argument("--fraction", type=int, default=100)
    c.add_argument("--rgb", type=boolean, default=True)
    c.add_argument("--color_scale", type=float)
    c.add_argument("--benchmark")
    i = sub.add_parser("info", help="what a tile holds")
    i.add_argument("path")
    m = sub.add_parser("merge", help="tilesets below a folder to one")
    m.add_argument("folder")
    m.add_argument("--overwrite", type=boolean, default=False)
    e = sub.add_parser("export", help="polygons to a tileset")
    e.add_argument("--directory")
    e.add_argument("--offset", nargs=3, type=float, default=(0.0, 0.0, 0.0))
    e.add_argument("--url", help="JDBC address of a database")
    e.add_argument("--table")
    e.add_argument("--column")
    e.add_argument("--id_column")
    e.add_argument("--out", default=".")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("voxelith").getOrCreate()
    from voxelith.functions.crs import SourceSystemMissing, UnknownSystem

    try:
        if args.command == "convert":
            import time

            from voxelith.plans.convert import Options, convert

            began = time.time()
            done = convert(spark, args.files, args.out, Options(args.srs_in, args.srs_out, args.fraction, args.rgb, args.overwrite, color_scale=args.color_scale))
            if args.benchmark:
                print(f"{args.benchmark},{','.join(args.files)},{done['points']},{time.time() - began:.1f}")
        elif args.command == "info":
            from voxelith.plans.info import descriptions

            for r in descriptions(spark, args.path).toLocalIterator():
                print(r["text"])
        elif args.command == "merge":
            from voxelith.plans.merge import merge, remove

            if args.overwrite:
                try:
                    remove(args.folder)
                except FileNotFoundError:
                    pass
            merge(spark, args.folder, args.overwrite)
        else:
            from voxelith.plans.export import export_database, export_directory

            if args.directory:
                export_directory(spark, args.directory, args.out, tuple(args.offset))
            else:
                export_database(spark, args.url, args.table, args.column, args.out, args.id_column)
    except (SourceSystemMissing, UnknownSystem, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
