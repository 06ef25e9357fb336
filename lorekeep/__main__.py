"""Command line: python -m lorekeep --help."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import config
from .engine import MemoryEngine
from .sources import exports


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorekeep", description="Ingests exports of conversations and answers over them.")
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--root", help="folder of the tables")
    p.add_argument("--source", help="export of the provider claude")
    p.add_argument("--chatgpt-source", help="export of the provider chatgpt")
    p.add_argument("--add-source", nargs=2, action="append", default=[], metavar=("PROVIDER", "PATH"), help=f"export of one of {', '.join(exports.providers())}")
    p.add_argument("--reembed", action="store_true", help="ingest everything anew, embeddings too")
    p.add_argument("--dry-run", action="store_true", help="report what would be ingested, write nothing")
    p.add_argument("--search", metavar="QUERY", help="print the best conversations")
    p.add_argument("--provider", help="only conversations of this provider are found")
    p.add_argument("--stats", action="store_true", help="print the state of the tables")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lorekeep").getOrCreate()
    settings = config.load(spark, args.config)
    own = settings["engine"]
    engine = MemoryEngine(spark, args.root or own["root"], progress=lambda name, done, total: print(f"{name}: {done}/{total}", file=sys.stderr))
    paths = [*settings["sources"].items(), *args.add_source]
    paths += [(p, path) for p, path in (("claude", args.source), ("chatgpt", args.chatgpt_source)) if path]
    show = lambda x: print(json.dumps(x, ensure_ascii=False))
    if paths:
        read = exports.unite(*(exports.read(spark, provider, path) for provider, path in paths))
        if args.reembed and not args.dry_run:
            show({"version": engine.ingest(read, mode="replace", k=own["clusters"])})
        else:
            show(engine.update(read, dry_run=args.dry_run, least=own["least_user_messages"], k=own["clusters"]))
    if args.search:
        show(engine.search(args.search, settings["search"]["top_k"], args.provider))
    if args.stats:
        show(engine.server_info(dict(paths)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
