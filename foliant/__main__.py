"""``python -m foliant PATH -o OUT``: convert a folder of files to a table of Markdown, or one file to stdout."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators.convert import convert, convert_bytes
from .operators.registry import TYPES
from .sources import readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliant", description=__doc__)
    p.add_argument("path", nargs="?", help="a file or a folder; standard input without one")
    p.add_argument("-o", "--output", help="folder for the Parquet result, or file for one document")
    p.add_argument("-x", "--extension", help="extension hint")
    p.add_argument("-m", "--mimetype", help="mime type hint")
    p.add_argument("-c", "--charset", help="charset hint")
    p.add_argument("--keep-data-uris", action="store_true")
    a = p.parse_args(argv)
    if a.path and os.path.isdir(a.path):
        spark = SparkSession.builder.appName("foliant").getOrCreate()
        out = convert(readers.files(spark, a.path), keep_data_uris=a.keep_data_uris)
        out.write.mode("errorifexists").parquet(a.output or f"{a.path.rstrip('/')}-markdown")
        return 0
    data = open(a.path, "rb").read() if a.path else sys.stdin.buffer.read()
    ext = a.extension or os.path.splitext(a.path or "")[1].lower() or None
    got = convert_bytes(data, {"extension": ext, "mimetype": a.mimetype or TYPES.get(ext), "charset": a.charset, "filename": os.path.basename(a.path or ""), "keep_data_uris": a.keep_data_uris})
    if got["status"] != "ok":
        print(f"{got['status']}: {got['attempts']}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(got["markdown"])
    else:
        sys.stdout.buffer.write(got["markdown"].encode(sys.stdout.encoding or "utf-8", "replace") + b"\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
