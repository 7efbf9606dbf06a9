"""A thin command line: add, update, list, search, export and validate."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from docloom.plans import ingest
from docloom.plans.service import Service
from docloom.sources import store as st
from docloom.sources.config import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("add", "update"):
        s = sub.add_parser(name)
        s.add_argument("pages", help="Parquet of page_id, url and html")
        s.add_argument("--now", default=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        if name == "update":
            s.add_argument("--prune", action="store_true")
            s.add_argument("--force", action="store_true")
    sub.add_parser("list")
    s = sub.add_parser("search")
    s.add_argument("kb")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    for name in ("export", "validate"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        if name == "export":
            s.add_argument("kb")
    return p


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("docloom").getOrCreate()
    store = st.Store(spark, a.store, read_only=a.what not in ("add", "update"))
    try:
        if a.what == "add":
            ingest.add(store, spark.read.parquet(a.pages), a.now)
        elif a.what == "update":
            print(json.dumps(ingest.update(store, spark.read.parquet(a.pages), a.now, a.prune, a.force)), file=out)
        elif a.what == "export":
            print(store.export(a.kb, a.folder), file=out)
        elif a.what == "validate":
            checks = st.validate(spark, a.folder)
            print(json.dumps(checks), file=out)
            return int(not all(checks.values()))
        else:
            s = Service(store)
            got = s.kb_list() if a.what == "list" else s.kb_search(a.kb, a.query, a.limit)
            print(got["text"], file=out)
            return int(got["error"])
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
