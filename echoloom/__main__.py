"""Command line: scan, compare and fingerprint."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from . import api
from .config import CompareConfig, PreprocessConfig
from .operators import cluster
from .sources import audio


def _put(lines: Iterable[str], output: str | None) -> None:
    """Lines to a file, or to the terminal."""
    if output is None:
        for line in lines:
            print(line)
        return
    with open(output, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)


def main(argv: list[str]) -> int:
    """0 if all went well, 1 if a file is missing or can't be fingerprinted."""
    top = argparse.ArgumentParser(prog="echoloom")
    sub = top.add_subparsers(dest="what", required=True)
    s = sub.add_parser("scan")
    s.add_argument("dirs", nargs="+")
    s.add_argument("--threshold", type=float, default=0.85)
    s.add_argument("--extensions", default=".wav")
    s.add_argument("--format", choices=["text", "json", "csv"], default="text")
    c = sub.add_parser("compare")
    c.add_argument("files", nargs=2)
    c.add_argument("--threshold", type=float, default=0.85)
    f = sub.add_parser("fingerprint")
    f.add_argument("file")
    for p in (s, f):
        p.add_argument("--max-duration", type=float)
        p.add_argument("--output")
    for p in (s, c):
        p.add_argument("--sliding", action="store_true")
    for p in (s, c, f):
        p.add_argument("--prepare", action="store_true")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("echoloom").getOrCreate()
    prepare = PreprocessConfig() if args.prepare else None
    try:
        if args.what == "scan":
            wanted = tuple(e if e.startswith(".") else "." + e for e in args.extensions.split(","))
            groups = api.scan_for_duplicates(spark, args.dirs, CompareConfig(similarity_threshold=args.threshold), wanted, prepare, args.sliding, args.max_duration)
            _put(cluster.report(groups, args.format), args.output)
            print(cluster.summary(groups).toJSON().first(), file=sys.stderr)
        elif args.what == "compare":
            row = api.compare_files(spark, *args.files, CompareConfig(similarity_threshold=args.threshold), prepare, args.sliding).first()
            print(json.dumps(row.asDict(recursive=True)))
            if row["error"]:
                return 1
        else:
            row = audio.fingerprints(api.one_file(spark, args.file), prepare=prepare, max_seconds=args.max_duration).first()
            if row["error"]:
                print(f"{row['file_path']}: {row['error']}", file=sys.stderr)
                return 1
            _put([json.dumps({"data": row["data"], "sampleRate": row["sample_rate"], "duration": row["duration"], "filePath": row["file_path"]}, indent=2)], args.output)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
