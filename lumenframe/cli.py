"""Command line: index, search, categories, category-add, parse, golden, notes, licences, doctor."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence


def _index(spark, a):
    from .plans.index import Index
    from .plans.plugins import HashEmbedder
    from .plans.profiles import profile

    return Index(spark, a.root, HashEmbedder(), profile(a.profile))


def report(response, names: Sequence[str] = ()) -> str:
    """Results as text with fixed columns, notices first."""
    rows = response.results.orderBy("place").collect()
    lines = [f"query: {response.query}", *[f"note: {n}" for n in response.notices]]
    lines += [f"{r['place']:>3}  {r['probability']:7.4f}  {r['score']:7.4f}  {r['frame_id']}" + "".join(f"  {r[n]}" for n in names if n in r) for r in rows]
    return "\n".join(lines)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenframe", description=__doc__)
    p.add_argument("--root", default="index", help="folder of the index")
    p.add_argument("--profile", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("path")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=24)
    s.add_argument("--scope", default="auto", choices=["auto", "frames", "regions", "both"])
    s.add_argument("--category")
    sub.add_parser("categories")
    c = sub.add_parser("category-add")
    c.add_argument("name")
    c.add_argument("phrases", nargs="+")
    c.add_argument("--negative", nargs="*", default=[])
    sub.add_parser("parse").add_argument("query")
    g = sub.add_parser("golden")
    g.add_argument("assets")
    g.add_argument("queries")
    n = sub.add_parser("notes")
    n.add_argument("--asset")
    n.add_argument("--text")
    m = sub.add_parser("licences")
    m.add_argument("models", help="folder with manifest.lock")
    m.add_argument("--strict", action="store_true")
    sub.add_parser("doctor")
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    a = build_parser().parse_args(argv)
    if a.command == "parse":
        from .plans.query import described, parse

        print(described(parse(a.query)))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lumenframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        began = time.time()
        print(", ".join(f"{k}: {v}" for k, v in _index(spark, a).add(a.path).items()), f"({time.time() - began:.1f} s)")
    elif a.command == "search":
        print(report(_index(spark, a).searcher().search(a.query, a.limit, scope=a.scope, category=a.category), ("path",)))
    elif a.command == "categories":
        for p in _index(spark, a)._all_prototypes():
            print(p.key, p.kind, f"gate {p.gate}" if p.gate else "")
    elif a.command == "category-add":
        for r in _index(spark, a).add_category(a.name, a.phrases, a.negative).collect():
            print(f"{r['table']}: {r['positive']} of {r['scanned']}")
    elif a.command == "golden":
        from .operators.metrics import problems
        from .sources import golden

        bad = problems(golden.read_assets(spark, a.assets), golden.read_queries(spark, a.queries)).collect()
        for r in bad:
            print(f"{r['query_id']}: {r['problem']}")
        return int(bool(bad))
    elif a.command == "notes":
        catalog = _index(spark, a).catalog
        if a.asset:
            paths = [r["path"] for r in catalog.read("assets").where(f"asset_id = '{a.asset}'").collect()]
            catalog.save_note(a.asset, paths[0] if paths else "", a.text or "", int(time.time()))
        for r in catalog.read("notes").orderBy("updated_at", ascending=False).collect():
            print(f"{r['asset_id']}  {r['note']}")
    elif a.command == "licences":
        from .plans import licences
        from .sources.registry import Registry

        table = licences.audit(Registry(a.models).table(spark))
        for r in table.orderBy("model").collect():
            print(f"{r['model']}: {r['license']} {r['verdict']}")
        return int(not licences.is_clean(table, a.strict))
    elif a.command == "doctor":
        print(f"spark {spark.version}, {spark.sparkContext.defaultParallelism} threads")
        for k, v in _index(spark, a).status().items():
            print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
