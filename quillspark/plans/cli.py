"""The command line: convert files, or standard input, to Markdown; or Markdown to another format.

    python -m quillspark FILE... [--format F] [--to T] [--output-dir DIR] [--permissive]

Files are converted by one Spark job, in the session's own cluster or on this machine. Texts go to standard output in
the order of the arguments with a rule between them, or each to a file of its own. The first error ends the run, unless
it is to be permissive: then it is reported and the others are written.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.plans import api, registry
from quillspark.sinks.files import SEPARATOR, write_files


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillspark", description="Convert documents to Markdown, and Markdown to other formats.")
    p.add_argument("files", nargs="*", help="files; standard input if there are none")
    p.add_argument("--format", choices=sorted([*registry.READERS, registry.MARKDOWN]), help="the input's format, instead of finding it")
    p.add_argument("--to", choices=sorted([*registry.SHORT, *registry.WRITERS]), help="the target of Markdown input")
    p.add_argument("--output-dir", help="a folder for one output file each")
    p.add_argument("--permissive", action="store_true", help="report errors and go on")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("quillspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if args.files:
            order = spark.createDataFrame([(k, f) for k, f in enumerate(args.files)], "seq int, name string")
            tail = F.regexp_replace(F.col("path"), r"^file:/*", "/")
            full = {os.path.abspath(f): f for f in args.files}
            found = spark.read.format("binaryFile").load(list(full)).withColumn("path", tail)
            names = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])
            files = found.withColumn("name", F.element_at(names, F.col("path"))).join(order, "name").select("seq", "path", "content")
        else:
            if sys.stdin.isatty():
                print("no input: name files, or pipe one in", file=sys.stderr)
                return 2
            files = spark.createDataFrame([(0, None, bytearray(sys.stdin.buffer.read()))], "seq int, path string, content binary")
        out = api.convert(files, format=args.format, to=args.to)
        if args.output_dir:
            out = out.persist()
        failed = [(r["path"], r["error"]) for r in out.filter("error IS NOT NULL").orderBy("seq").select("path", "error").collect()]
        for path, error in failed:
            print(f"{path or 'standard input'}: {error}", file=sys.stderr)
        if failed and not args.permissive:
            return 1
        if args.output_dir:
            write_files(out, args.output_dir, order="seq")
        else:
            for k, r in enumerate(out.filter("error IS NULL").orderBy("seq").toLocalIterator()):  # one document at a time
                if k:
                    sys.stdout.write(SEPARATOR)
                sys.stdout.flush()
                sys.stdout.buffer.write(bytes(r["output_data"]) if r["output_data"] is not None else (r["output"] or "").encode())
            sys.stdout.flush()
        return int(bool(failed))
    finally:
        if own:
            spark.stop()
