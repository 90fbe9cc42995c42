"""The command line: python -m larkspur ROOT COMMAND [ARGS]. Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("root")
    p.add_argument("--store", help="where the tables are (default: ROOT/.larkspur)")
    p.add_argument("--master")
    p.add_argument("--overlay", help="a YAML file that declares fields")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("status", "info", "orphans", "doctor", "chunks", "tree", "clusters", "modules", "module-status", "config"):
        sub.add_parser(name)
    init = sub.add_parser("init", help="write a configuration with all settings at their defaults")
    init.add_argument("--force", action="store_true")
    i = sub.add_parser("ingest")
    i.add_argument("--reindex", action="store_true")
    i.add_argument("--preview", action="store_true")
    i.add_argument("--file", help="only this document")
    for kind, place in (("shards", "path"), ("topics", "description")):
        t = sub.add_parser(kind).add_subparsers(dest="action", required=True)
        t.add_parser("list")
        for action in ("add", "update", "remove", "assign") if kind == "topics" else ("add", "update", "remove"):
            q = t.add_parser(action)
            if action != "assign":
                q.add_argument("name")
            if action in ("add", "update"):
                q.add_argument(f"--{place}")
            if action == "update" and kind == "shards":
                q.add_argument("--rename")
            if kind == "topics" and action in ("add", "update"):
                q.add_argument("--threshold", type=float)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--path", default="")
    s.add_argument("--filter", action="append", default=[])
    s.add_argument("--min-score", type=float)
    s.add_argument("--boost-links", action="store_true")
    for name in ("links", "backlinks", "get"):
        sub.add_parser(name).add_argument("path")
    for name, option in (("schema", "--path"), ("edges", "--path"), ("graph", "--path")):
        q = sub.add_parser(name)
        q.add_argument(option, default=None)
        if name == "graph":
            q.add_argument("--level", default="document", choices=("document", "chunk"))
    c = sub.add_parser("collection")
    c.add_argument("path", nargs="?", default="")
    c.add_argument("--recursive", action="store_true")
    c.add_argument("--sort")
    c.add_argument("--desc", action="store_true")
    c.add_argument("--filter", action="append", default=[])
    c.add_argument("--limit", type=int)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--populate", action="store_true")
    return p.parse_args(argv)


def run(a: argparse.Namespace, spark) -> dict[str, DataFrame]:
    """Named results of a command."""
    from larkspur import config
    from larkspur.api import Collection
    from larkspur.functions.predicates import parse
    from larkspur.operators.schema import load_overlay

    overlay = load_overlay(open(a.overlay).read()) if a.overlay else []
    c = Collection(spark, a.root, a.store or f"{a.root.rstrip('/')}/.larkspur", config.load(os.path.join(a.root, ".larkspur.yml")), overlay=overlay)
    if a.command == "ingest":
        return {"changes": c.preview() if a.preview else c.ingest(a.reindex, a.file)}
    if a.command in ("config", "init"):
        if a.command == "init":
            path = os.path.join(a.root, ".larkspur.yml")
            if os.path.exists(path) and not a.force:
                raise FileExistsError(f"{path} is there already")
            with open(path, "w") as out:
                out.write(config.dump(config.Config()))
        rows = [(k, json.dumps(v)) for k, v in vars(c.config).items()]
        return {"settings": spark.createDataFrame(rows, "name string, value string")}
    if a.command == "shards":
        if a.action == "add":
            c.add_shard(a.name, a.path or "")
        elif a.action == "update":
            c.update_shard(a.name, a.path, a.rename)
        elif a.action == "remove":
            c.remove_shard(a.name)
        return {"shards": c.shard_table()}
    if a.command == "topics":
        if a.action == "assign":
            assigned, rest = c.topics(c.topic_definitions())
            return {"assigned": assigned, "unassigned": rest}
        if a.action in ("add", "update"):
            c.set_topic(a.name, a.description, a.threshold, new=a.action == "add")
        elif a.action == "remove":
            c.remove_topic(a.name)
        return {"topics": c.topic_table()}
    if a.command == "search":
        return {"results": c.search(a.query, mode=a.mode, limit=a.limit, scope=a.path, filters=a.filter, min_score=a.min_score, boost_links=a.boost_links)}
    if a.command == "collection":
        rows, columns, total = c.collection(a.populate, path=a.path, recursive=a.recursive, sort=a.sort, descending=a.desc, filters=tuple(map(parse, a.filter)), limit=a.limit, offset=a.offset)
        return {"rows": rows, "columns": columns, "total": total}
    if a.command == "graph":
        nodes, edges = c.graph(a.level, a.path or "")
        return {"nodes": nodes, "edges": edges}
    if a.command == "clusters":
        return c.clusters()
    if a.command in ("links", "backlinks", "get"):
        return {a.command: getattr(c, a.command)(a.path)}
    if a.command == "schema":
        return {"fields": c.schema(a.path or "")}
    if a.command == "edges":
        return {"edges": c.edges(a.path)}
    return {a.command: {"modules": c.run_modules, "module-status": c.module_status}.get(a.command, getattr(c, a.command.replace("-", "_"), None))()}


def main(argv: list[str] | None = None) -> int:
    from larkspur.session import session

    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = session(master=a.master)
    for name, rows in run(a, spark).items():
        for line in rows.toJSON().toLocalIterator():
            print(json.dumps({"kind": name} | json.loads(line), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
