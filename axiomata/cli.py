"""Command line: ingest, search, facets, dedup, proof, stats, version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

import axiomata
from axiomata import config as settings
from axiomata.functions import features
from axiomata.functions.canonical import canonical, engine_probe
from axiomata.functions.expressions import ParseError, parse
from axiomata.operators import search
from axiomata.operators.store import Store
from axiomata.schema import SCHEMA_VERSION
from axiomata.sources.corpus import sources


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="axiomata")
    top.add_argument("-config")
    top.add_argument("-store")
    top.add_argument("-fuzzy-limit", type=int)
    top.add_argument("-pool", type=int)
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("-rebuild", action="store_true")
    ingest.add_argument("paths", nargs="*")
    find = commands.add_parser("search")
    find.add_argument("-n", type=int, default=10)
    find.add_argument("query", nargs="+")
    facet = commands.add_parser("facets")
    facet.add_argument("selected", nargs="*")
    dedup = commands.add_parser("dedup")
    dedup.add_argument("-n", type=int, default=25)
    proof = commands.add_parser("proof")
    proof.add_argument("-set")
    proof.add_argument("-system", default="")
    proof.add_argument("-status", default="draft")
    proof.add_argument("entry")
    commands.add_parser("stats")
    commands.add_parser("version")
    return top


def run(spark: SparkSession, argv: list[str]) -> int:
    args = arguments().parse_args(argv)
    if args.command == "version":
        print(f"axiomata {axiomata.__version__}, schema {SCHEMA_VERSION}, engine {engine_probe()[:12]}")
        return 0
    config = settings.load(args.config, args.store, args.fuzzy_limit, args.pool)
    store = Store(spark, config.store)
    if args.command in ("search", "facets", "dedup") and store.warning():
        print(store.warning(), file=sys.stderr)
    if args.command == "ingest":
        done = store.ingest(sources(args.paths, list(config.corpus.roots), spark), args.rebuild)
        for row in done.skipped.toLocalIterator():
            print(f"SKIP {row['path']}")
        print(f"indexed {done.indexed} of {done.total} formulas, {done.total - done.indexed} not parsed; {store.count()} stored")
    elif args.command == "search":
        text = " ".join(args.query)
        try:
            form = canonical(parse(text))
        except ParseError as e:
            print(f"can't parse: {e}", file=sys.stderr)
            return 1
        for title, hits in (("exact", store.exact(text)), ("similar", store.fuzzy(features.tokens_from(form), args.n, config.search.pool))):
            print(title)
            for row in search.hit_lines(hits).collect():
                print("  " + row["line"])
    elif args.command == "facets":
        found = store.facets(args.selected, config.search.fuzzy_limit)
        print(f"{found.total.first()['total']} formulas")
        for row in found.refine.collect():
            print(f"  {row['facet']} {row['n']}")
        for row in search.hit_lines(found.hits).collect():
            print("  " + row["line"])
    elif args.command == "dedup":
        total, groups = store.duplicates(args.n)
        print(f"{total} signatures under several entries")
        for row in search.duplicate_report(groups).collect():
            print(row["line"])
    elif args.command == "proof" and args.set:
        with open(args.set, "rb") as f:
            store.set_proof(args.entry, args.system, f.read(), args.status)
    elif args.command == "proof":
        row = store.proof(args.entry).first()
        if row is None:
            print("no proof", file=sys.stderr)
            return 1
        print(f"{row['system']} {row['status']}\n{bytes(row['proof']).decode(errors='replace')}")
    else:
        print(store.count())
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("axiomata").getOrCreate(), sys.argv[1:]))
