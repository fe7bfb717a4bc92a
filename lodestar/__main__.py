"""Command line: python -m lodestar scan ROOT | findings ROOT | snapshot ROOT OUT | diff ROOT OLD."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import reports
from .operators.snapshot import Snapshot
from .sources.scan import SourceScan


def _scan(args) -> SourceScan:
    scan = SourceScan(args.crate).ignore_parse_errors(args.permissive).span_locations(True).exclude_generated()
    root = Path(args.root)
    scan = scan.scan_workspace_root(args.root) if (root / "Cargo.toml").is_file() else scan.scan_in_folder(args.root)
    return scan.only_newest(args.newest) if args.newest else scan


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    parser.add_argument("command", choices=["scan", "findings", "snapshot", "diff"])
    parser.add_argument("root")
    parser.add_argument("file", nargs="?", help="where a snapshot is written, or the older one to compare with")
    parser.add_argument("--crate", default="crate")
    parser.add_argument("--newest", type=int)
    parser.add_argument("--permissive", action="store_true")
    parser.add_argument("--format", choices=["table", "markdown", "json"], default="table")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    corpus = _scan(args).parse(spark)
    if args.command == "scan":
        for name, df in (("functions", corpus.functions_df), ("imports", corpus.imports_df), ("exports", corpus.exports), ("macro invocations", corpus.macros_inv), ("paths", corpus.paths), ("calls", corpus.calls)):
            print(f"{name}: {df.count()}")
        cover = corpus.doc_coverage().first()
        print(f"documented public functions: {cover['public_documented']} of {cover['public_total']} ({cover['percent']:.1f} %)")
    elif args.command == "findings":
        found = corpus.rules().with_default_rules().run()
        print({"table": reports.to_table, "markdown": reports.to_markdown, "json": reports.to_json}[args.format](found), end="")
    elif args.command == "snapshot":
        if not args.file:
            parser.error("snapshot needs a file")
        corpus.snapshot().write(args.file)
    else:
        if not args.file:
            parser.error("diff needs the older snapshot")
        for r in corpus.diff_snapshot(Snapshot.read(spark, args.file)).orderBy("entity", "change", "key", F.coalesce("new", "old")).toLocalIterator():
            print(f"{r['entity']} {r['change']}: {r['key']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
